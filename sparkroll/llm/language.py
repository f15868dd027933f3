"""Language identification with averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import COUNTED, LETTER, ODD, UPPER, bounded_sample, counted, counted_features, character_tables, code_points, fold, mixed, pieces, prepared, sums_by, table, text_buffers

BUCKETS = 1 << 16
WIDTH = 16
ORDERS = (1, 2, 3, 4)
#: The most labelled documents the model is fitted on, shared out among the languages.
TRAINING_DOCUMENTS = 3000
EPOCHS = 6
RATE = 0.5
#: Probability and evidence have to reach what all but this share of the calibration documents reach.
REJECTED = 0.002
NO_LETTER = "und"


@dataclass(frozen=True)
class Model:
    """Class scores of each subword bucket (embedding times class weights), bias and calibration.

    A text of n subwords divides its class scores by temperature * (1 + shortness / n). The last column of the table is
    the logarithm of a subword's share in all learned text. The mean of it is the evidence of a text: `usual` for each language, with
    variance spread[0] + spread[1] / n. Less than `least` deviations from the usual is rejected, whatever the probabilities say.
    """

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    shortness: float
    threshold: float
    usual: np.ndarray
    spread: tuple[float, float]
    least: float


def subwords(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the letter n-grams inside words (with their borders), and their texts.

    Everything that is not a letter is one border; borders next to each other are one.
    """
    kinds, lowered = character_tables()
    small = np.minimum(points, 0x10000)
    kind = kinds[small]
    letters = (kind == LETTER) | (kind == UPPER)
    values = np.where(letters, np.where(points < 0x10000, lowered[small], points), 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # a border in front of every text and behind the last one
    values = np.concatenate([np.insert(values, offsets[:-1], 0), [np.uint64(0)]]).astype(np.uint64)
    owner = np.concatenate([np.insert(owner, offsets[:-1], np.arange(len(offsets) - 1)), [len(offsets) - 2]])
    keep = np.concatenate([[True], (values[1:] != 0) | (values[:-1] != 0) | (owner[1:] != owner[:-1])])
    values, owner = values[keep], owner[keep]
    inner = values != 0
    rolled = np.zeros(len(values), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(values) < n:
            return
        rolled = rolled[: len(values) - n + 1] * ODD + values[n - 1 :] + np.uint64(n)
        good = inner[: len(rolled)] if n == 1 else np.ones(len(rolled), bool)
        if n == 2:
            good = inner[:-1] | inner[1:]
        for k in range(1, n - 1):
            good = good & inner[k : k + len(rolled)]
        if n in ORDERS:
            yield (mixed(rolled[good]) >> np.uint64(48)).astype(np.int64), owner[: len(rolled)][good]


def _subword_rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct buckets and their counts of each text, for training."""
    for batch in texts:
        data, offsets = text_buffers(batch)
        counts = [np.zeros(0, np.int64)] * len(batch)
        for part, own, numbers in pieces(data, offsets, 1 << 18):
            points, at = code_points(part, own)
            found = list(subwords(points, at))
            for k, number in enumerate(numbers):
                mine = [b[np.searchsorted(o, k) : np.searchsorted(o, k, side="right")] for b, o in found]
                counts[number] = np.concatenate([counts[number], *mine])
        yield counted(counts)


def train(documents: DataFrame, bound: int = TRAINING_DOCUMENTS, seed: int = 7) -> Model | None:
    """Fit on at most `bound` documents with a language, outside remainder 0 of `fold`.

    `documents` has doc_id, text and lang. None if there is nothing to learn from.
    """
    labelled = documents.where(F.col("lang").isNotNull() & (fold("doc_id") != 0))
    picked = bounded_sample(labelled.select("doc_id", "lang"), "lang", "doc_id", bound).dropDuplicates(["doc_id"])
    # at most `bound` ids, so the broadcast has a fixed size
    sample = labelled.select("doc_id", "text", "lang").join(F.broadcast(picked.select("doc_id")), "doc_id").limit(2 * bound)
    features = arrow_udf(_subword_rows, COUNTED)
    rows = counted_features(sample.select("doc_id", "lang", features("text").alias("f")), "doc_id", "lang")
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], r[2][:8].tolist()))
    return fit([(buckets, counts.astype(float)) for _, _, buckets, counts in rows], [r[1] for r in rows], seed) if rows else None


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int) -> Model:
    """Stochastic gradient descent over documents; a fifth of them calibrates."""
    langs = tuple(sorted(set(labels)))
    target = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.zeros((len(langs), WIDTH), np.float32)
    bias = np.zeros(len(langs), np.float32)
    order = rng.permutation(len(samples))
    held = order[: len(order) // 5] if len(order) >= 10 * len(langs) else order
    learn = order[len(order) // 5 :] if len(order) >= 10 * len(langs) else order
    steps = EPOCHS * len(learn)
    for step in range(steps):
        k = learn[step % len(learn)]
        buckets, counts = samples[k]
        share = (counts / counts.sum()).astype(np.float32)
        mean = share @ embedding[buckets]
        z = weights @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[target[k]] -= 1
        rate = RATE * (1 - step / steps)
        back = weights.T @ p
        weights -= rate * np.outer(p, mean)
        bias -= rate * 0.05 * p
        # a bucket moves by its share; the factor undoes the averaging over the document
        embedding[buckets] -= (rate * len(buckets) ** 0.5) * share[:, None] * back
    table = embedding @ weights.T
    calibration = []
    for k in held:
        buckets, counts = samples[k]
        # the document itself and a random part of it, as short texts are less certain
        part = rng.choice(len(buckets), int(np.exp(rng.uniform(np.log(min(6, len(buckets))), np.log(len(buckets) + 0.5)))), replace=False)
        for b, c in ((buckets, counts), (buckets[part], counts[part])):
            calibration.append((c / c.sum() @ table[b] + bias, c.sum(), target[k]))
    logits, sizes, truth = (np.array(x) for x in zip(*calibration, strict=True))
    seen = np.zeros(BUCKETS)
    for k in learn:
        np.add.at(seen, *samples[k])
    known, *rest = evidence([samples[k] for k in held], target[held], seen, len(langs), len(held) == len(learn))
    return Model(langs, np.column_stack([table, known]).astype(np.float32), bias.astype(np.float64), *calibrated(logits, sizes, truth), *rest)


def evidence(samples: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seen: np.ndarray, n_langs: int, learned: bool) -> tuple[np.ndarray, np.ndarray, tuple[float, float], float]:
    """Log share of each bucket, the usual evidence of each language, its variances, and the least deviation.

    `samples` are the calibration documents. If the model `learned` them too, each is judged by the counts of the others.
    """
    share = lambda own, n: np.log((own + 0.5) / (n + 0.5 * BUCKETS))
    means, within, sizes = [], [], []
    for buckets, counts in samples:
        n = counts.sum()
        values = share(seen[buckets] - counts, seen.sum() - n) if learned else share(seen[buckets], seen.sum())
        mean = counts @ values / n
        means.append(mean)
        within.append(counts @ (values - mean) ** 2 / n)
        sizes.append(n)
    means, sizes = np.array(means), np.array(sizes)
    usual = np.array([np.median(means[target == k]) if (target == k).any() else np.median(means) for k in range(n_langs)])
    # the n-grams of all orders at one place depend on each other
    short = len(ORDERS) * float(np.mean(within))
    off = means - usual[target]
    between = max(float(np.median(np.abs(off)) * 1.4826) ** 2, 0.01)
    deviations = off / np.sqrt(between + short / sizes)
    return share(seen, seen.sum()), usual, (between, short), float(min(-3.0, np.quantile(deviations, REJECTED, method="lower")))


def softmax(logits: np.ndarray, sizes: np.ndarray, temperature: float, shortness: float) -> np.ndarray:
    z = logits / (temperature * (1 + shortness / np.maximum(sizes, 1)))[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def calibrated(logits: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Temperature and shortness of least log loss, and the lowest probability that is accepted."""
    rows = np.arange(len(target))
    grid = [(t, s) for t in np.geomspace(0.1, 20, 30) for s in (0, 10, 30, 100, 300, 1000)]
    loss = [-np.log(softmax(logits, sizes, *x)[rows, target] + 1e-12).mean() for x in grid]
    best = grid[int(np.argmin(loss))]
    reached = softmax(logits, sizes, *best).max(axis=1)
    return float(best[0]), float(best[1]), float(np.quantile(reached, REJECTED, method="lower"))


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, confidence and acceptance of each text of a batch."""
    data, offsets = text_buffers(texts)
    n = len(texts)
    langs = model.langs if model else ()
    sums, counts = np.zeros((n, len(langs) + 1)), np.zeros(n)
    for part, own, numbers in pieces(data, offsets, 1 << 18):
        points, at = code_points(part, own)
        for buckets, owner in subwords(points, at):
            edges = np.searchsorted(owner, np.arange(len(numbers) + 1))
            counts[numbers] += np.diff(edges)
            if model:
                sums[numbers] += sums_by(edges, model.table[buckets])
    known = counts > 0
    if not model:
        return [NO_LETTER] * n, np.zeros(n), np.zeros(n, bool)
    means = sums / np.maximum(counts, 1)[:, None]
    p = softmax(means[:, :-1] + model.bias, counts, model.temperature, model.shortness)
    best, confidence = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
    deviation = (means[:, -1] - model.usual[best]) / np.sqrt(model.spread[0] + model.spread[1] / np.maximum(counts, 1))
    # rounding must not reject the calibration document at the limit itself
    accepted = known & (confidence >= model.threshold - 1e-6) & (deviation >= model.least - 1e-3)
    return [langs[b] if k else NO_LETTER for b, k in zip(best, known, strict=True)], confidence, accepted


def language(model: Model | None, text: str | Column) -> Column:
    """struct(lang_pred string, score double, accepted boolean) of a whole text.

    A null or letterless text, and every text when there was nothing to learn
    from, is `und` with score 0 and not accepted. Equal texts get equal results;
    a text of any length is read in bounded passages whose n-grams add up.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            pred, score, accepted = predict(model, batch)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["lang_pred", "score", "accepted"])

    return arrow_udf(run, "struct<lang_pred:string,score:double,accepted:boolean>").asNondeterministic()(text)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted, one row for each row of `documents`."""
    found = documents.select("doc_id", (fold("doc_id") == 0).alias("held_out"), language(model, "text").alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.accepted")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents))


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` whose language is accepted, with the columns they came with; all if there is nothing to learn from."""
    prepared(spark)
    model = train(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs
    return docs.withColumn("__language", language(model, "text")).where("__language.accepted").drop("__language")
