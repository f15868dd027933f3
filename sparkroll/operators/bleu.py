"""Corpus BLEU over all ordered pairs i < j of a group, without building the pairs.

A pair's clipped matches of a gram are min(c_i, c_j), and

    sum over i < j of min(c_i, c_j)  =  sum over v >= 1 of N_v (N_v - 1) / 2

where N_v counts the members that hold the gram at least v times. Numbering the
occurrences of a gram inside a member therefore turns the quadratic self-join
into one aggregation whose input is one row per token and gram length. A worker
that meets all members of a group one after the other adds them up itself and
returns one row for the group; grams are shuffled only of groups that are
spread over tasks or have too many of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.skew import with_group_stats

MAX_N = 4
WORDS = r"[^ \t\n\r\f]+"
#: Grams that leave a Python worker in one batch.
GRAMS = 20_000
#: Different grams of a group that a worker holds before they leave with their counts.
HELD = 100_000
ORDERS = range(1, MAX_N + 1)
#: What is added up for each group: sizes of the members, sizes times position, and matches, by gram length.
SUMS = [f"__{what}_{n}" for what in ("s", "is", "match") for n in ORDERS]


def numbered_grams(text: str | None) -> Iterator[str]:
    """All grams of a text as "length:occurrence:words"."""
    words = re.findall(WORDS, text or "")
    for n in range(1, MAX_N + 1):
        seen: dict[str, int] = {}
        for at in range(len(words) - n + 1):
            gram = " ".join(words[at : at + n])
            seen[gram] = seen.get(gram, 0) + 1
            yield f"{n}:{seen[gram]}:{gram}"


def _gram_rows(members: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """One row for each gram, with the group; a worker holds the grams of one text and GRAMS more."""
    rows = members.select(*group, F.col(text).alias("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = ((k, g) for k in range(batch.num_rows) for g in numbered_grams(batch.column(len(group))[k].as_py()))
            while piece := list(islice(grams, GRAMS)):
                at = pa.array([k for k, _ in piece])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(len(group))], pa.array([g for _, g in piece], pa.string())], [*group, "__g"])

    return rows.mapInArrow(run, rows.schema)


class _Run:
    """Members of one group that follow each other in a task."""

    def __init__(self, key: list, size: int) -> None:
        self.key, self.size, self.seen, self.spread = key, size, 0, False
        self.lengths, self.placed = [0] * MAX_N, [0] * MAX_N
        #: for each length: members that hold a gram (a tuple of words), or hold it (times, gram)
        self.held: list[Counter] = [Counter() for _ in ORDERS]

    def add(self, idx: int, text: str | None) -> None:
        words = re.findall(WORDS, text or "")
        self.seen += 1
        for n in ORDERS:
            grams = len(words) - n + 1
            if grams <= 0:
                break
            self.lengths[n - 1] += grams
            self.placed[n - 1] += idx * grams
            times = Counter(zip(*(words[k:] for k in range(n))))
            self.held[n - 1].update(times.keys())
            if len(times) < grams:
                self.held[n - 1].update((v, gram) for gram, t in times.items() for v in range(2, t + 1))

    def grams(self) -> Iterator[tuple]:
        """The held grams as rows of their own."""
        self.spread = True
        for n, held in zip(ORDERS, self.held, strict=True):
            for gram, members in held.items():
                v, words = gram if isinstance(gram[0], int) else (1, gram)
                yield self.key, f"{n}:{v}:{' '.join(words)}", members, 0, [0] * len(SUMS)
            held.clear()

    def closed(self) -> Iterator[tuple]:
        """The row of the group; its matches are in it if all of the group was here."""
        if self.spread or self.seen != self.size:
            yield from self.grams()
        matches = [sum(h * (h - 1) for h in held.values()) // 2 for held in self.held]
        yield self.key, None, 0, self.seen, [*self.lengths, *self.placed, *matches]


def _added_up(members: DataFrame, group: Sequence[str], idx: str, text: str, size: str) -> DataFrame:
    """group, __g, __h, members and SUMS: a row for each group and task, and one for each gram and number of holders that still have to be added up."""
    rows = members.select(*group, F.col(idx).cast("bigint").alias("__i"), F.col(text).alias("__t"), F.col(size).alias("__m"))
    schema = rows.select(*group, F.lit(None).cast("string").alias("__g"), *[F.lit(0).cast("bigint").alias(c) for c in ("__h", "members", *SUMS)]).schema

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        run = None
        for batch in batches:
            for *key, at, words, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run is None or key != run.key:
                    if run is not None:
                        yield from run.closed()
                    run = _Run(key, members)
                run.add(at, words)
                if sum(map(len, run.held)) > HELD:
                    yield from run.grams()
        if run is not None:
            yield from run.closed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [*first.schema.types[: len(group)], pa.string(), *[pa.int64()] * (2 + len(SUMS))]
        rows = ((*key, gram, held, members, *sums) for key, gram, held, members, sums in found(chain([first], batches)))
        while piece := list(islice(rows, GRAMS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece, strict=True), types, strict=True)], schema.names)

    return rows.mapInArrow(run, schema)


def group_bleu(members: DataFrame, group: Sequence[str], idx: str, text: str, hot: bool | None = None) -> DataFrame:
    """BLEU of every group of at least two members; member i predicts, each later j is a reference.

    `idx` is the dense 0-based position of the member in its group; `hot` says whether a group is too large for one window.
    """
    group = list(group)
    sized = with_group_stats(members, group, {"__m": F.count(F.lit(1))}, hot).where("__m > 1")
    rows = _added_up(sized, group, idx, text, "__m")
    counted = rows.groupBy(*group, "__g").agg(*[F.sum(c).alias(c) for c in ("__h", "members", *SUMS)])
    # grams of the groups that no task had as a whole; members of a null group match nothing
    paired = {n: F.when(F.col("__g").startswith(f"{n}:"), F.col("__h") * (F.col("__h") - 1) / 2).otherwise(0.0) for n in ORDERS}
    known = F.lit(True)
    for c in group:
        known = known & F.col(c).isNotNull()
    totals = counted.groupBy(*group).agg(F.sum("members").alias("members"), *[F.sum(c).alias(c) for c in SUMS], *[F.sum(p).alias(f"__paired_{n}") for n, p in paired.items()])
    # member i predicts m - 1 - i times and is the reference i times: sums of sizes and of i * sizes say it all
    possible = {n: (F.col("members") - 1) * F.col(f"__s_{n}") - F.col(f"__is_{n}") for n in ORDERS}
    matched = {n: F.when(known, F.col(f"__match_{n}") + F.col(f"__paired_{n}")).otherwise(0.0) for n in ORDERS}
    precision = [matched[n] / F.when(possible[n] > 0, possible[n]) for n in ORDERS]
    usable = (F.least(*[F.coalesce(p, F.lit(0.0)) for p in precision]) > 0) & (F.col("__is_1") > 0)
    mean_log = sum((F.log(p) for p in precision[1:]), F.log(precision[0])) / MAX_N
    ratio = possible[1] / F.col("__is_1")
    brevity = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))
    return totals.select(*group, "members", F.when(usable, F.exp(mean_log) * brevity).otherwise(0.0).alias("bleu"))
