"""Hard negatives by threshold joins over an inverted index that leaves out what suffix norms cover.

Vectors are rows of whole numbers, floor(256 * x) of each component. A block of
rows has an index of its own: dimensions stand in chunks, the strongest first,
and a row is listed under a chunk only if what it has from there on could still
matter: if the norm of its suffix times the largest such norm of the queries
reaches a share of the threshold. Partial scores are added up chunk by chunk.
By Cauchy and Schwarz a row cannot reach the threshold once its partial score
and the norms of what remains fall short; such rows are dropped, the others
are scored to the end. A search starts with a high threshold and lowers it, with
a new index, until every window holds enough rows or the threshold has reached
the window's end. So it gives exactly the rows that a full comparison gives.

Queries are a stated set of rows (ids divisible by 100). They travel in packs to
the blocks of all rows; a block answers with its best rows of each window only,
and these answers are ranked in a shuffle on the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkroll.llm.common import prepared, stored, table

#: Rows of a block, queries of a pack, queries scored at once: bounds on what a task holds.
BLOCK_ROWS, PACK_QUERIES, AT_ONCE = 131_072, 512, 64
#: Dimensions that are looked at together.
CHUNK = 8
#: Thresholds of open windows as shares of the largest score that the norms allow; the last one is the window's own end.
LEVELS = (0.5, 0.3, 0.2, 0.1)
#: A row's suffix is left out of the index where it is worth less than this share of the threshold.
COVERED = 0.5
#: Whole numbers up to these are exact in floats of 4 and of 8 bytes.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
BOTTOM, TOP = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Anchor:
    """One query: a row, and windows (number, lowest score, highest score) that want the best rows inside."""

    vec_id: int
    label: int
    windows: list[tuple[int, int, int]]


class BlockIndex:
    """Rows of one block (n x width whole numbers), with suffix norms over dimensions in the order of their energy."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.starts = list(range(0, vectors.shape[1], CHUNK))
        self.left = self.suffix_norms(vectors[:, self.order])
        self.largest = float(self.left[:, 0].max(initial=0))

    def suffix_norms(self, turned: np.ndarray) -> np.ndarray:
        """Norm of each row from each chunk on; the last column is zero."""
        if not self.starts:
            return np.zeros((len(turned), 1))
        chunks = np.add.reduceat(turned.astype(np.float64) ** 2, self.starts, axis=1)
        suffix = np.cumsum(chunks[:, ::-1], axis=1)[:, ::-1]
        # a hair more than the sum, so that rounding never makes a bound too small
        return np.sqrt(np.concatenate([suffix, np.zeros((len(turned), 1))], axis=1)) * (1 + 1e-9)

    def reaching(self, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) for each query: all rows whose score reaches the query's threshold."""
        tails = self.suffix_norms(queries[:, self.order])
        product = self.largest * float(tails[:, 0].max(initial=0))
        if product >= DOUBLE:
            for q, low in zip(queries.astype(np.int64), least, strict=True):
                scores = (self.vectors.astype(np.int64) * q).sum(axis=1)
                hit = np.flatnonzero(scores >= low)
                yield hit, scores[hit]
            return
        # every partial sum is at most the product of the norms, so it is exact
        kind = np.float32 if product < SINGLE else np.float64
        turned = queries[:, self.order].astype(kind)
        listed = self.lengths(tails, least)
        by_length = np.argsort(-listed, kind="stable")
        listed = listed[by_length]
        rows, left = self.vectors[by_length][:, self.order].astype(kind), self.left[by_length]
        # the postings of a chunk are the rows that list it: a prefix of the rows in the order of their lengths
        postings = [int(np.searchsorted(-listed, -c, side="left")) for c in range(len(self.starts))]
        unlisted = left[np.arange(len(rows)), listed]
        for at in range(0, len(turned), AT_ONCE):
            some = turned[at : at + AT_ONCE]
            partial = np.zeros((len(some), len(rows)), kind)
            for n, start in zip(postings, self.starts, strict=True):
                partial[:, :n] += some[:, start : start + CHUNK] @ rows[:n, start : start + CHUNK].T
            for k, q in enumerate(some):
                low, tail = least[at + k], tails[at + k]
                hit = np.flatnonzero(partial[k] + unlisted * tail[listed] >= low - 0.5)
                scores, first = partial[k][hit], listed[hit]
                for chunk, start in enumerate(self.starts):
                    late = first <= chunk
                    if not late.any():
                        continue
                    # rows that do not list this chunk get its part now, unless the norms behind it say they are out
                    scores[late] += rows[hit[late], start : start + CHUNK] @ q[start : start + CHUNK]
                    alive = ~late | (scores + left[hit, chunk + 1] * tail[chunk + 1] >= low - 0.5)
                    hit, scores, first = hit[alive], scores[alive], first[alive]
                scores = np.rint(scores.astype(np.float64)).astype(np.int64)
                good = scores >= low
                yield by_length[hit[good]], scores[good]

    def lengths(self, tails: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many chunks list each row: all up to where its suffix is worth less than a share of every threshold."""
        if least.min(initial=1) <= 0:
            return np.full(len(self.left), len(self.starts))
        worth = self.left[:, :-1] * (tails[:, :-1] / least[:, None]).max(axis=0)
        return (worth >= COVERED).sum(axis=1)


def best_in_windows(index: BlockIndex, ids: np.ndarray, labels: np.ndarray, anchors: list[Anchor], vectors: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int]]:
    """(window, row, score): the best `k` rows in each window of each anchor (ties: smaller ids first).

    `same` asks for rows of the anchor's label and another id, else rows of other labels count.
    """
    out: list[tuple[int, int, int]] = []
    if len(ids) == 0:
        return out
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    waiting = {q: list(a.windows) for q, a in enumerate(anchors) if a.windows}
    for share in (*LEVELS, None):
        if not waiting:
            break
        numbers = list(waiting)
        least = np.array([min(w[1] for w in waiting[q]) for q in numbers], dtype=np.float64)
        if share is not None:
            # nothing above the highest open window is of use, so its end bounds the level
            highs = np.array([max(w[2] for w in waiting[q]) for q in numbers], dtype=np.float64)
            least = np.maximum(least, np.minimum(np.ceil(share * norms[numbers] * index.largest), np.ceil(highs * (0.75 + share / 2))))
        for q, low, (rows, scores) in zip(numbers, least, index.reaching(vectors[numbers], least), strict=True):
            anchor = anchors[q]
            fits = (labels[rows] == anchor.label) & (ids[rows] != anchor.vec_id) if same else labels[rows] != anchor.label
            rows, scores = rows[fits], scores[fits]
            order = np.lexsort((ids[rows], -scores))
            rows, scores, still = rows[order], scores[order], []
            for window in waiting.pop(q):
                # scores descend: the window begins behind those above its end
                first = int(np.searchsorted(-scores, -window[2], side="left"))
                last = int(np.searchsorted(-scores, -max(window[1], low), side="right"))
                if last - first < k and low > window[1]:
                    still.append(window)
                    continue
                out += [(window[0], int(rows[j]), int(scores[j])) for j in range(first, min(last, first + k))]
            if still:
                waiting[q] = still
    return out


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part: floor(256 * x) of each component; see `hard_negatives`."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    used = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    return used.select(F.col("vec_id").cast("bigint"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint")).alias("v"))


def _packed_vectors(lists: pa.Array) -> tuple[int, int, bytes]:
    """(width, bytes of a number, numbers) of vectors as one table; short ones are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    most = int(np.abs(out).max(initial=0))
    item = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, item, out.astype(f"<i{item}").tobytes()


def _table_of(width: int, item: int, data: bytes, n: int, wanted: int) -> np.ndarray:
    found = np.frombuffer(data, f"<i{item}").reshape(n, width)
    return found if wanted == width else np.pad(found, ((0, 0), (0, wanted - width)))


PACK = "part bigint, kind int, n int, width int, item int, v binary, ids binary, labels binary, numbers binary, owners binary, lows binary, highs binary"


def packs(rows: DataFrame, kind: int, size: int | None) -> DataFrame:
    """Rows of each task as packs of at most `size` (None: one pack), their numbers as binary arrays.

    Kind 0 are blocks of rows; kind 1 are queries, whose `windows` are flattened beside the rows that own them.
    """
    names = [f.split(" ")[0] for f in PACK.split(", ")]

    def one(found: pa.Table) -> pa.RecordBatch:
        lists = found["v"].combine_chunks()
        width, item, data = _packed_vectors(lists)
        row = {"part": TaskContext.get().partitionId(), "kind": kind, "n": len(found), "width": width, "item": item, "v": data}
        row |= {"ids": found["vec_id"].to_numpy().astype(np.int64).tobytes(), "labels": found["label"].to_numpy().astype(np.int64).tobytes()}
        if kind:
            windows = [(w["number"], q, w["low"], w["high"]) for q, ws in enumerate(found["windows"].to_pylist()) for w in ws]
            flat = np.array(windows, np.int64).reshape(-1, 4)
            row |= {name: np.ascontiguousarray(flat[:, c]).tobytes() for c, name in enumerate(("numbers", "owners", "lows", "highs"))}
        types = [pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            while size and sum(map(len, waiting)) >= size:
                joined = pa.Table.from_batches(waiting)
                yield one(joined.slice(0, size))
                waiting = joined.slice(size).to_batches()
        if sum(map(len, waiting)):
            yield one(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, PACK)


def search(blocks: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """number, vec_id, score: the best `k` rows of each block in each window. `blocks` and `queries` are stored packs.

    Every pack of queries goes to every block, as one row. A task reads its
    block first and then holds it while the packs stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, part = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    block, index, part = row, None, row["part"]
                    continue
                if row["part"] != part:
                    continue
                width = max(block["width"], row["width"])
                if index is None or index.vectors.shape[1] < width:
                    index = BlockIndex(_table_of(block["width"], block["item"], block["v"], block["n"], width))
                vectors = _table_of(row["width"], row["item"], row["v"], row["n"], index.vectors.shape[1])
                ids, labels, names, kinds = (np.frombuffer(x, np.int64) for x in (block["ids"], block["labels"], row["ids"], row["labels"]))
                windows: list[list[tuple[int, int, int]]] = [[] for _ in range(row["n"])]
                for number, q, low, high in zip(*(np.frombuffer(row[c], np.int64).tolist() for c in ("numbers", "owners", "lows", "highs")), strict=True):
                    windows[q].append((number, low, high))
                anchors = [Anchor(int(names[q]), int(kinds[q]), windows[q]) for q in range(row["n"])]
                found = best_in_windows(index, ids, labels, anchors, vectors, k, same)
                columns = [[f[0] for f in found], [int(ids[f[1]]) for f in found], [f[2] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "vec_id", "score"])

    parts = blocks.agg(F.max("part")).first()[0]
    n = 0 if parts is None else parts + 1
    # a query set against all rows, in blocks: packs of bounded size are paired, not rows
    sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))) if n else queries.limit(0)
    met = blocks.unionByName(sent).repartition(max(n, 1), "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(run, "number bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of each window over all blocks, with their rank from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
    block_rows: int = BLOCK_ROWS, pack_queries: int = PACK_QUERIES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, embedding and label. Rows without id, label or vector
    take no part, nor do those with a null or non-finite component. Shorter
    vectors count as filled up with zeros. An anchor's positives are rows of
    another id; where an anchor's row is repeated, each copy has its own
    results, and a positive or negative that is repeated counts as often. An
    empty table gives no rows.
    """
    spark = prepared(vectors.sparkSession)
    rows = stored(whole_numbers(vectors))
    parts = max(-(-rows.count() // block_rows), spark.sparkContext.defaultParallelism)
    # dealt out evenly, so a task has a block of block_rows at most, or one a few rows larger
    blocks = stored(packs(rows.repartition(parts), 0, None))
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("number", F.monotonically_increasing_id()))
    everything = F.array(F.struct("number", F.lit(BOTTOM).alias("low"), F.lit(TOP).alias("high")))
    asked = stored(packs(anchors.select("vec_id", "label", "v", everything.alias("windows")), 1, pack_queries))
    found = best(search(blocks, asked, positives, same=True), positives)
    pairs = stored(found.select("number", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("number") * positives + F.col("rank") - 1).alias("window")))
    score = F.col("positive_score").cast("decimal(38,0)")
    ends = (F.ceil(score * low / 100).cast("bigint").alias("low"), F.floor(score * high / 100).cast("bigint").alias("high"))
    windows = pairs.select("number", F.struct(F.col("window").alias("number"), *ends).alias("w")).where("w.low <= w.high")
    wanted = anchors.join(windows.groupBy("number").agg(F.collect_list("w").alias("windows")), "number").select("vec_id", "label", "v", "windows")
    chosen = best(search(blocks, stored(packs(wanted, 1, pack_queries)), negatives, same=False), negatives)
    scored = chosen.select(F.col("number").alias("window"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return named.join(scored, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = """
with used as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as other_id, b.label as other_label,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from used a, used b where a.vec_id % 100 = 0
), positives as (
  select anchor_id, anchor_label, other_id as positive_id, score as positive_score from scored
  where other_label = anchor_label and other_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), ranked as (
  select p.anchor_id, p.positive_id, p.positive_score, s.other_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and s.other_label <> p.anchor_label
  where 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
