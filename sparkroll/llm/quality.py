"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import (
    COUNTED, LETTER, ODD, OTHER, SPACE, UPPER, bounded_sample, counted, counted_features, character_tables, code_points, fold, mixed, pieces, prepared, run_hashes, sums_by, table, text_buffers,
)

BITS = 18
#: The most labelled documents the model is fitted on, shared out among the labels.
TRAINING_DOCUMENTS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.01
#: Shares of features are multiplied by this, so that a document's values are of the order of 1.
SCALE = 20.0
KEEP_FROM = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(points: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of words and of word shapes, as (feature numbers, texts) lists.

    A word is a run of letters, of digits or of other signs. Its shape says
    which of these it is, whether it is all upper case or capitalised, and
    whether it repeats one of the two words before it. Words count alone and in
    pairs, shapes alone, in pairs and in threes.
    """
    kinds, lowered = character_tables()
    small = np.minimum(points, 0x10000)
    kind = kinds[small]
    group = np.where(kind == UPPER, LETTER, kind)
    starts_here = np.zeros(len(points), bool)
    starts_here[offsets[:-1][offsets[:-1] < len(points)]] = True
    starts_here[1:] |= group[1:] != group[:-1]
    starts = np.flatnonzero(starts_here)
    if len(starts) == 0:
        return []
    values = np.where(group == SPACE, 0, np.where(points < 0x10000, lowered[small], points) + 1).astype(np.uint64)
    words = run_hashes(values, starts)
    size = np.diff(np.append(starts, len(points)))
    uppers = np.add.reduceat((kind == UPPER).astype(np.int64), starts)
    shape = group[starts].astype(np.uint64) * np.uint64(8)
    shape += np.where(uppers == 0, 0, np.where((uppers == size) & (size > 1), 1, 2)).astype(np.uint64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    real = group[starts] != SPACE
    words, shape, owner, sign = words[real], shape[real], owner[real], group[starts][real] == OTHER
    for back in (1, 2):
        same = np.zeros(len(words), bool)
        same[back:] = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back]) & ~sign[back:]
        shape |= same.astype(np.uint64) << np.uint64(8)
    out = []
    for base, longest, salt in ((words, 2, 1), (mixed(shape + np.uint64(77)), 3, 5)):
        gram = base
        for n in range(1, longest + 1):
            if n > 1:
                gram = gram[:-1] * ODD + base[n - 1 :]
            inside = owner[: len(gram)] == owner[n - 1 :]
            out.append(((mixed(gram + np.uint64(salt + n)) >> np.uint64(64 - BITS)).astype(np.int64)[inside], owner[: len(gram)][inside]))
            if len(gram) < 2:
                break
    return out


def _feature_rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        data, offsets = text_buffers(batch)
        lists = [np.zeros(0, np.int64)] * len(batch)
        for part, own, numbers in pieces(data, offsets, 1 << 18):
            found = features(*code_points(part, own))
            for k, number in enumerate(numbers):
                mine = [f[np.searchsorted(o, k) : np.searchsorted(o, k, side="right")] for f, o in found]
                lists[number] = np.concatenate([lists[number], *mine])
        yield counted(lists)


def train(documents: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS, seed: int = 11) -> Model | None:
    """Fit on at most `bound` labelled documents, outside remainder 0 of `fold`; None if there are none.

    `documents` has doc_id and text, `labels` has doc_id and quality (0 or 1).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).select("doc_id", "quality")
    picked = bounded_sample(known, "quality", "doc_id", bound)
    # at most `bound` ids with a label, so the broadcast has a fixed size
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").limit(2 * bound)
    rows = sample.select("doc_id", "quality", arrow_udf(_feature_rows, COUNTED)("text").alias("f"))
    rows = sorted(counted_features(rows, "doc_id", "quality"), key=lambda r: (r[0], r[1], r[2][:8].tolist()))
    if not rows:
        return None
    return fit([(numbers, counts.astype(float)) for _, _, numbers, counts in rows], np.array([r[1] for r in rows], float), seed)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int) -> Model:
    """Follow the regularised leader, one document at a time; weights below L1 stay exactly zero."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    z, n, weights = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            numbers, counts = samples[k]
            at = np.append(numbers, size)
            x = np.append(SCALE * counts / max(1.0, counts.sum()), 1.0)
            w = weights[at]
            gradient = (_sigmoid(w @ x) - target[k]) * x
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
            left = np.abs(z[at]) - L1
            weights[at] = np.where(left > 0, -np.sign(z[at]) * left / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(model: Model | None, text: str | Column) -> Column:
    """Probability of label 1 for a whole text, as a column.

    A null or empty text gets the probability of the bias alone, and every text
    gets 0.5 if no label could be learned from. A text above 256 KiB is read
    in passages cut at white space; no n-gram spans a cut.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sums, counts = np.zeros(len(batch)), np.zeros(len(batch))
            data, offsets = text_buffers(batch)
            for part, own, numbers in pieces(data, offsets, 1 << 18) if model else ():
                for found, owner in features(*code_points(part, own)):
                    edges = np.searchsorted(owner, np.arange(len(numbers) + 1))
                    sums[numbers] += sums_by(edges, model.weights[found])
                    counts[numbers] += np.diff(edges)
            yield pa.array(_sigmoid(SCALE * sums / np.maximum(counts, 1) + (model.bias if model else 0.0)))

    return arrow_udf(run, "double").asNondeterministic()(text)


def grade(documents: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of `documents`."""
    scored = documents.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score(model, "text").alias("score"))
    return scored.select("*", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return grade(documents, train(documents, table(spark, sf_dir, "labels")))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with the columns they came with."""
    prepared(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", score(model, "text")).where(F.col("__score") >= KEEP_FROM).drop("__score")
