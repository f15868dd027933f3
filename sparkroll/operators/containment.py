"""First source row whose problem text is a substring of the query, without a cross join.

A text that holds a problem also holds the problem's inner words as whole,
consecutive words: only the first and the last word can be cut. The rarest
inner word sequence of each problem is its anchor; queries meet problems by
anchor hash and every candidate is verified.

Problems of few words have no telling inner sequence: an anchor of one common
word or a few characters would meet nearly every query. They go into
Aho-Corasick automata instead, and each query leaves one row, the lowest id it
holds, so a problem that stands in every text costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroll.functions.arrays import let
from sparkroll.session import reliable_checkpoint

MAX_WORDS = 5
ANCHOR_WORDS = 3  # problems with fewer inner words go to the automata
AUTOMATON_BYTES = 2_000_000  # problem texts of one automaton
HEAD = 64  # characters of a problem that the automaton reads; the rest is compared
WORD = r"[^ \t\n\r\f]+"


def _word_grams(words: Column, n: Column | int) -> Column:
    """All n-word sequences of an array of words."""
    n = F.lit(n) if isinstance(n, int) else n
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))


def _hashes(n: int, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.xxhash64(F.lit(n), g))


class LowestHeld:
    """Finds the lowest place in a list of non-empty problems whose text a query holds.

    The automaton knows the first `HEAD` characters of each problem, so one very
    long word cannot blow it up; what follows is compared where a head was met.
    """

    def __init__(self, problems: Sequence[str]):
        heads: dict[str, list[tuple[int, str]]] = {}
        for place, problem in enumerate(problems):
            heads.setdefault(problem[:HEAD], []).append((place, problem[HEAD:]))
        self.none = len(problems)
        self.machine = ahocorasick.Automaton()
        for head, ends in heads.items():
            self.machine.add_word(head, ends)
        self.machine.make_automaton()

    def __call__(self, text: str) -> int | None:
        best = self.none
        for last, ends in self.machine.iter(text):
            for place, rest in ends:
                if place >= best:
                    break
                if not rest or text.startswith(rest, last + 1):
                    best = place
                    break
            if best == 0:
                break
        return None if best == self.none else best


def _lowest_id(entries: Sequence[tuple], dtype: T.DataType):
    """A column function of a text: the lowest id of the (id, problem) entries it holds, or null."""
    ids, problems = [e[0] for e in entries], [e[1] for e in entries]

    @F.pandas_udf(dtype)
    def lowest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = LowestHeld(problems)
        for texts in batches:
            places = (None if text is None else find(text) for text in texts)
            yield pd.Series([None if place is None else ids[place] for place in places], dtype=object)

    return lowest


def _short_hits(texts: DataFrame, short: DataFrame, parts: int) -> list[DataFrame]:
    """(query id, problem id) for the problems of few words: one scan of the queries for each automaton."""
    if parts > 1:
        short = reliable_checkpoint(short)
    dtype, hits = short.schema["__pid"].dataType, []
    for part in range(parts):
        # dealt by hash, so a part holds about as many bytes as the others
        entries = short.where(F.pmod(F.xxhash64("__problem"), F.lit(parts)) == part).orderBy("__pid").collect()
        hits.append(texts.select("__qid", _lowest_id(entries, dtype)("__query").alias("__pid")).where(F.col("__pid").isNotNull()))
    return hits


def _anchored_hits(texts: DataFrame, pool: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(query id, problem id) for the problems with enough inner words; `sizes` are the lengths of their anchors."""
    worded = pool.select("__pid", "__n", F.explode(let(F.col("__inner"), lambda w: _word_grams(w, F.col("__n")))).alias("__g"))
    frequency = worded.groupBy("__n", "__g").agg(F.count(F.lit(1)).alias("__f"))
    rarest = worded.join(frequency, ["__n", "__g"]).groupBy("__pid", "__n").agg(F.min_by("__g", F.struct("__f", "__g")).alias("__g"))
    anchors = rarest.select("__pid", F.xxhash64("__n", "__g").alias("__anchor"))

    def all_keys(words: Column) -> Column:
        return F.array_distinct(F.concat(*[_hashes(n, _word_grams(words, n)) for n in sizes]))

    # the words are bound once: a lambda would split the text again for every gram
    query_keys = texts.select("__qid", F.explode(let(F.regexp_extract_all("__query", F.lit(WORD), F.lit(0)), all_keys)).alias("__anchor"))
    # only ids and hashes meet here; texts follow for the few candidates
    candidates = query_keys.join(anchors, "__anchor").select("__qid", "__pid").distinct()
    checked = candidates.join(pool.select("__pid", "__problem"), "__pid").join(texts, "__qid").where(F.col("__query").contains(F.col("__problem")))
    return checked.select("__qid", "__pid")


def attach_source_row(
    queries: DataFrame, query_id: str, query: str, problems: DataFrame, problem_id: str, problem: str, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """Each (unique) query id with the lowest problem id whose text it holds; queries without one are left out.

    Null ids and null or empty texts take no part on either side. Equal problems count once, by their lowest id.
    """
    stated = problems.where((F.length(problem) > 0) & F.col(problem_id).isNotNull())
    pool = stated.groupBy(F.col(problem).alias("__problem")).agg(F.min(problem_id).alias("__pid"))
    words = F.regexp_extract_all("__problem", F.lit(WORD), F.lit(0))
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    pool = pool.withColumn("__inner", inner).withColumn("__n", F.least(F.size("__inner"), F.lit(MAX_WORDS)))
    texts = queries.where(F.col(query_id).isNotNull() & F.col(query).isNotNull()).select(F.col(query_id).alias("__qid"), F.col(query).alias("__query"))
    anchored, short = pool.where(F.col("__n") >= ANCHOR_WORDS), pool.where(F.col("__n") < ANCHOR_WORDS)
    # at most six sizes, known before the queries are read
    weight = {r["__n"]: r["bytes"] for r in pool.groupBy("__n").agg(F.sum(F.octet_length("__problem")).alias("bytes")).collect()}
    found = _short_hits(texts, short.select("__pid", "__problem"), -(-sum(b for n, b in weight.items() if n < ANCHOR_WORDS) // automaton_bytes))
    sizes = sorted(n for n in weight if n >= ANCHOR_WORDS)
    if sizes or not found:
        found.append(_anchored_hits(texts, anchored, sizes or [ANCHOR_WORDS]))
    hits = reduce(DataFrame.unionByName, found)
    return hits.groupBy(F.col("__qid").alias(query_id)).agg(F.min("__pid").alias(problem_id))
