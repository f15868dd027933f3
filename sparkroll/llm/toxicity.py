"""Toxicity by a subsequence string kernel: a support vector machine over Nystrom landmarks.

A text is a list of sentences, a sentence a list of units: its words, and runs
of very short words taken together, so that letters set apart by blanks stand in
one unit; signs inside a unit are left out. The kernel of two units counts the
subsequences of three letters they share, each weighted by LAMBDA for every place
it spans beyond three (spans of up to SPAN places), is normalised to 1 for equal
units, and is raised to a power. Inserted letters only widen a span, so `idixot`
stays near `idiot`, and `i.d.i.o.t` is the same. Two sentences have the sum over their pairs of
distinct units.

The Nystrom landmarks are units of the training sentences: those that tell the
two labels apart best, and frequent units of both. A unit's features are its
kernel values with the landmarks times the inverse root of the landmarks' own
kernel matrix; a sentence has the sum. A linear machine (hinge loss) is trained
on sentences, which take the label of their text at first; sentences of toxic
texts that look like those of other texts are then relabelled, a few times over.
As the machine is linear, a unit has one value and a sentence a sum of them. A
text is scored by its TOP greatest sentences, turned into a probability (Platt's
logistic curve), so that one slip weighs less than a habit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import bounded_sample, code_points, fold, mixed, pieces, prepared, run_hashes, shuffle_partitions, stored, table, text_buffers

#: The most labelled documents and sentences the model is fitted on, shared out among the labels.
TRAINING_DOCUMENTS, TRAINING_SENTENCES = 6000, 24_000
#: Landmarks that tell the labels apart, and frequent ones.
TELLING, FREQUENT = 96, 32
#: Units that the telling ones are picked from, and the kernel value from which two are too alike to be both landmarks.
CANDIDATES, ALIKE = 1000, 0.9
#: A telling unit is in so many toxic documents of the sample at least.
LEAST_DOCUMENTS = 3
ORDER, SPAN, LAMBDA, POWER = 3, 6, 0.8, 2
#: Kernel values below this (before the power) count as zero.
FLOOR = 0.3
#: A unit is read in windows of so many places, each beginning HOP behind the one before.
WIDTH, HOP = 24, 16
#: Words of at most so many letters are joined with their short neighbours.
SHORT = 2
#: Weight of the loss against the norm, Newton steps, rounds of relabelling, and the share of clean sentences that a toxic one lies above.
PENALTY, NEWTON_STEPS, ROUNDS, CLEAN_SHARE = 2000.0, 30, 5, 0.998
FLAG_FROM = 0.5
#: Sentences that a text is scored by, and the bound on their values.
TOP, CLIP = 3, 5.0
#: Distinct units whose values a task remembers.
REMEMBERED = 500_000

GAP, BLANK, STOP = 0, 27, 28
#: Signs that stand for letters in disguised words (fixed values).
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """What each code point of the first plane is: 1 to 26 for letters, GAP, BLANK or STOP. Entry 65,536 stands for the rest.

    Accents are left out; letters of other scripts share the 26 numbers.
    """
    if not _letters:
        out = np.zeros(0x10001, np.uint8)
        for c in range(0x10000):
            char = chr(c)
            if char in ".!?\n\r。！？":
                out[c] = STOP
            elif char.isspace():
                out[c] = BLANK
            elif char in DISGUISES:
                out[c] = ord(DISGUISES[char]) - 96
            elif char.isalpha():
                base = unicodedata.normalize("NFKD", char.lower())[0]
                out[c] = ord(base) - 96 if "a" <= base <= "z" else ord(base) % 26 + 1
        _letters.append(out)
    return _letters[0]


@dataclass(frozen=True)
class Units:
    """The units of a batch of texts: letters (WIDTH wide, GAP behind the end), their hashes, sentences and texts."""

    rows: np.ndarray
    hashes: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray


def units_of(points: np.ndarray, offsets: np.ndarray) -> Units:
    """Words and runs of short words of texts given as code points; a sentence is numbered within the batch.

    A sentence ends at a line end, or at a full stop, exclamation or question
    mark that a blank follows. Marks inside a word are gaps.
    """
    kind = letters()[np.minimum(points, 0x10000)]
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    # a stop inside a word, as in i.d.i.o.t, is a gap
    line = np.isin(points, (10, 13))
    ahead = np.append(kind[1:], BLANK)
    ahead[np.flatnonzero(first[1:])] = BLANK
    stop = (kind == STOP) & (line | (ahead == BLANK) | (ahead == STOP))
    blank = (kind == BLANK) | stop
    kind = np.where((kind > 26) & ~blank, GAP, np.where(blank, BLANK, kind)).astype(np.uint8)
    sentence_at = np.cumsum(np.concatenate([[0], stop[:-1]]) if len(stop) else stop)
    owner_at = np.searchsorted(offsets, np.arange(len(points)), side="right") - 1
    sentence_at = sentence_at + owner_at
    starts_here = ~blank & (np.concatenate([[True], blank[:-1]]) if len(blank) else blank)
    starts_here |= ~blank & first[:-1]
    starts = np.flatnonzero(starts_here)
    if len(starts) == 0:
        return Units(np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    blanks = np.append(np.flatnonzero(blank), len(points))
    ends = np.minimum(blanks[np.searchsorted(blanks, starts)], np.append(starts[1:], len(points)))
    ends = np.minimum(ends, offsets[owner_at[starts] + 1])
    amount = np.concatenate([[0], np.cumsum((kind >= 1) & (kind <= 26))])
    size = amount[ends] - amount[starts]
    # runs of short words within a sentence become one more unit each
    small = (size <= SHORT) & (size > 0)
    follows = np.zeros(len(starts), bool)
    follows[1:] = small[1:] & small[:-1] & (sentence_at[starts[1:]] == sentence_at[starts[:-1]]) & (starts[1:] - ends[:-1] <= 3)
    heads = np.flatnonzero(small & ~follows)
    lasts = np.append(np.flatnonzero(~follows), len(starts))
    lasts = lasts[np.searchsorted(lasts, heads, side="right")] - 1
    joined = lasts - heads >= 2
    begin = np.concatenate([starts, starts[heads[joined]]])
    end = np.concatenate([ends, ends[lasts[joined]]])
    keep = amount[end] - amount[begin] >= ORDER
    begin, end = begin[keep], end[keep]
    # only letters count from here on: signs and blanks inside a unit are left out
    at = np.flatnonzero((kind >= 1) & (kind <= 26))
    only = kind[at]
    begin, end = amount[begin], amount[end]
    # long units in overlapping windows
    windows = np.maximum(1, -(-(end - begin - WIDTH) // HOP) + 1)
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, end = np.repeat(begin, windows) + step * HOP, np.repeat(end, windows)
    end = np.minimum(end, begin + WIDTH)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    inside = np.arange(WIDTH)[None, :] < (end - begin)[:, None]
    rows = np.where(inside, only[np.minimum(begin[:, None] + np.arange(WIDTH), max(len(only) - 1, 0))] if len(only) else 0, 0).astype(np.uint8)
    begin = at[begin] if len(at) else begin
    flat = np.concatenate([rows.astype(np.uint64) + np.uint64(1), np.zeros((len(rows), 1), np.uint64)], axis=1).ravel()
    hashes = run_hashes(flat, np.arange(len(rows)) * (WIDTH + 1)) if len(rows) else np.zeros(0, np.uint64)
    sentence, owner = sentence_at[begin], owner_at[begin]
    # a unit counts once in a sentence, however often it is said
    once = np.sort(np.unique(mixed(hashes + mixed(sentence.astype(np.uint64) + np.uint64(9))), return_index=True)[1])
    return Units(rows[once], hashes[once], sentence[once], owner[once])


def _shapes() -> list[tuple[int, int, float]]:
    """Places of the second and third letter behind the first, and the weight of the span."""
    return [(a, b, LAMBDA ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of each subsequence of three letters, sorted by unit; one entry for each occurrence."""
    padded = np.concatenate([rows, np.zeros((len(rows), SPAN), np.uint8)], axis=1).astype(np.int32)
    width = rows.shape[1]
    units, codes, weights = [], [], []
    first = padded[:, :width]
    for a, b, weight in _shapes():
        second, third = padded[:, a : a + width], padded[:, b : b + width]
        unit, place = np.nonzero((first > 0) & (second > 0) & (third > 0))
        units.append(unit)
        codes.append((first[unit, place] * 27 + second[unit, place]) * 27 + third[unit, place])
        weights.append(np.full(len(unit), weight))
    unit, code, weight = np.concatenate(units), np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(unit, kind="stable")
    return unit[order], code[order], weight[order]


class Landmarks:
    """Units that others are compared with: by code of a subsequence, the landmarks that hold it and its weight in them."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        unit, code, weight = subsequences(rows)
        norms = np.maximum(_norms(unit, code, weight, len(rows)), 1e-12)
        table = np.zeros((27**ORDER, len(rows)))
        np.add.at(table, (code, unit), weight)
        codes, self.holders = np.nonzero(table)
        self.weights = table[codes, self.holders] / norms[self.holders]
        self.first = np.searchsorted(codes, np.arange(27**ORDER + 1))

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Kernel values of each unit with each landmark."""
        out = np.zeros((len(rows), len(self.rows)), np.float32)
        if len(rows) == 0 or len(self.rows) == 0:
            return out
        unit, code, weight = subsequences(rows)
        # each subsequence meets only the landmarks that hold it
        times = self.first[code + 1] - self.first[code]
        met = np.repeat(self.first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        if len(met) == 0:
            return out
        cells = np.repeat(unit * len(self.rows), times) + self.holders[met]
        sums = np.bincount(cells, np.repeat(weight, times) * self.weights[met], minlength=out.size).reshape(out.shape)
        # without repeats of a subsequence the norm is the root of the squares; repeats only enlarge it
        least = np.sqrt(np.bincount(unit, weight**2, minlength=len(rows)))
        near = np.flatnonzero(sums.max(axis=1) >= FLOOR * np.maximum(least, 1e-12))
        if len(near) == 0:
            return out
        place = np.full(len(rows), -1)
        place[near] = np.arange(len(near))
        mine = place[unit] >= 0
        norms = _norms(place[unit[mine]], code[mine], weight[mine], len(near))
        cosine = sums[near] / np.maximum(norms, 1e-12)[:, None]
        out[near] = np.where(cosine >= FLOOR, cosine, 0) ** POWER
        return out


def _norms(unit: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The root of a unit's kernel with itself."""
    together = unit.astype(np.int64) * 27**ORDER + code
    order = np.argsort(together, kind="stable")
    together, weight = together[order], weight[order]
    starts = np.flatnonzero(np.diff(together, prepend=-1))
    if len(starts) == 0:
        return np.zeros(n)
    totals = np.add.reduceat(weight, starts)
    return np.sqrt(np.bincount(together[starts] // 27**ORDER, totals**2, minlength=n))


@dataclass(frozen=True)
class Model:
    """Landmarks, the weight of each kernel value, the machine's bias, and the slopes and shift of its probability."""

    landmarks: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float


def sentence_sums(units: Units, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, sum of `values`) of each sentence that has units."""
    if len(values) == 0:
        return np.zeros(0, np.int64), np.zeros((0, *values.shape[1:]))
    starts = np.flatnonzero(np.diff(units.sentence, prepend=-1))
    return units.owner[starts], np.add.reduceat(values, starts, axis=0)


def _batches(texts: pa.Array) -> Iterator[tuple[Units, np.ndarray]]:
    """Units of the texts of a batch, read in passages of bounded size, and the numbers of the texts in them."""
    data, offsets = text_buffers(texts)
    for part, own, numbers in pieces(data, offsets, 1 << 18):
        points, places = code_points(part, own)
        yield units_of(points, places), numbers


UNIT_LIST = "array<binary>"


def _distinct_units(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found: list[set[bytes]] = [set() for _ in range(len(batch))]
        for units, numbers in _batches(batch):
            for row, owner in zip(units.rows, units.owner, strict=True):
                found[numbers[owner]].add(row.tobytes())
        yield pa.array([sorted(f) for f in found], pa.list_(pa.binary()))


def pick_landmarks(sample: DataFrame, telling: int = TELLING, frequent: int = FREQUENT, least: int = LEAST_DOCUMENTS) -> np.ndarray:
    """Landmark units of labelled texts (text, toxic): by how well they tell the labels apart, and by frequency.

    Units are counted by documents in a shuffle; only the landmarks reach the driver.
    """
    units = sample.select("toxic", F.explode(arrow_udf(_distinct_units, UNIT_LIST)("text")).alias("unit"))
    counts = units.groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    share_bad = F.col("bad") / F.lit(max(totals.bad or 0, 1))
    share_good = F.col("good") / F.lit(max(totals.good or 0, 1))
    # the difference of the shares over its deviation, as for two proportions
    score = (share_bad - share_good) / F.sqrt((share_bad + share_good) / 2 + F.lit(1e-3))
    ranked = stored(counts.withColumn("score", score))
    best = ranked.where((F.col("bad") >= least) & (F.col("score") > 0)).orderBy(F.desc("score"), "unit").limit(CANDIDATES).collect()
    common = ranked.orderBy(F.desc(F.col("bad") + F.col("good")), "unit").limit(2 * frequent).collect()
    best, common = (np.array([np.frombuffer(r.unit, np.uint8) for r in c], np.uint8).reshape(-1, WIDTH) for c in (best, common))
    chosen = spread_out(best, np.zeros((0, WIDTH), np.uint8), telling)
    return spread_out(common, chosen, len(chosen) + frequent)


def spread_out(candidates: np.ndarray, chosen: np.ndarray, most: int) -> np.ndarray:
    """`chosen` and further candidates in their order, each unlike all before it, `most` at the utmost."""
    together = np.concatenate([chosen, candidates])
    if len(together) == 0:
        return chosen
    alike = Landmarks(together).kernel(together) >= ALIKE
    kept = list(range(len(chosen)))
    for k in range(len(chosen), len(together)):
        if len(kept) >= most:
            break
        if not alike[k, kept].any():
            kept.append(k)
    return together[kept]


def _root(rows: np.ndarray) -> tuple[Landmarks, np.ndarray]:
    """The landmarks and the inverse root of their kernel matrix."""
    landmarks = Landmarks(rows)
    values, vectors = np.linalg.eigh(landmarks.kernel(rows).astype(np.float64))
    values = np.where(values > 1e-6, values, np.inf)
    return landmarks, (vectors / np.sqrt(values)) @ vectors.T


def sentence_features(rows: np.ndarray) -> Column:
    """Nystrom features of each sentence of a text, as a column of arrays."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        landmarks, root = _root(rows)
        for batch in texts:
            found: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for units, numbers in _batches(batch):
                owner, sums = sentence_sums(units, landmarks.kernel(units.rows) @ root)
                for k, features in zip(owner, sums, strict=True):
                    found[numbers[k]].append(features.astype(np.float32))
            yield pa.array(found, pa.list_(pa.list_(pa.float32())))

    return arrow_udf(run, "array<array<float>>").asNondeterministic()("text")


def fit_machine(features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, both labels weighing alike, by Newton steps."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    y = np.where(toxic, 1.0, -1.0)
    weight = PENALTY * np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9)) / len(x)
    ridge = np.append(np.ones(features.shape[1]), 1e-6)
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float((ridge * v**2).sum() / 2 + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    for _ in range(NEWTON_STEPS):
        slack = np.maximum(0, 1 - y * (x @ w))
        inside = slack > 0
        gradient = ridge * w - 2 * ((weight * slack * y) @ x)
        hessian = np.diag(ridge) + 2 * (x[inside] * weight[inside, None]).T @ x[inside]
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit(sentences: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float]:
    """(weights, bias, slopes, shift) from the sentence features of each text (n x landmarks) and the texts' labels.

    At first a sentence has the label of its text. In each further round only
    those sentences of toxic texts keep it that the machine places above nearly
    all sentences of other texts; the rest are harmless ones of toxic texts.
    """
    owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    x, of_toxic = np.concatenate(sentences), toxic[owner].astype(bool)
    labels = of_toxic
    w, b = np.zeros(x.shape[1]), -1.0
    for _ in range(ROUNDS):
        if not labels.any() or labels.all():
            break
        used = labels | ~of_toxic
        w, b = fit_machine(x[used], labels[used])
        values = x @ w + b
        again = of_toxic & (values > np.quantile(values[~of_toxic], CLEAN_SHARE))
        if (again == labels).all() or not again.any():
            break
        labels = again
    return w, b, *platt(greatest(owner, x @ w + b, len(sentences), b), toxic.astype(bool))


def greatest(owner: np.ndarray, values: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The TOP greatest values of each of `n` texts, falling; none is below the bias, which also fills up."""
    out = np.full((n, TOP), bias)
    order = np.lexsort((-values, owner))
    owner, values = owner[order], np.maximum(values[order], bias)
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    some = rank < TOP
    out[owner[some], rank[some]] = values[some]
    return np.clip(out, -CLIP, CLIP)


def platt(values: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the probability of the label for rows of values, by Newton steps with Platt's smoothed targets."""
    up, down = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.concatenate([values, np.ones((len(values), 1))], axis=1)
    ridge = np.append(np.full(values.shape[1], 0.1), 1e-6)
    w = np.append(np.zeros(values.shape[1]), np.log((up + 1) / (down + 1)))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - target * z).sum() + (ridge * v**2).sum() / 2)

    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS, sentences: int = TRAINING_SENTENCES) -> Model | None:
    """Fit on at most `bound` labelled documents outside remainder 0 of `fold`; None if there are none.

    `documents` has doc_id and text, `labels` has doc_id and toxic (0 or 1). Of
    the sentences of these documents at most `sentences` with features train the
    machine, about equally many of each document.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = bounded_sample(known, "toxic", "doc_id", bound)
    # at most `bound` ids with a label, so the broadcast has a fixed size; ids that occur many times are cut in order of their text
    sample = stored(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * bound).repartition(shuffle_partitions(documents.sparkSession), "doc_id"))
    rows = pick_landmarks(sample.where("text is not null"))
    if len(rows) == 0:
        return None
    each = max(1, sentences // max(1, sample.count()))
    found = sample.select("doc_id", "toxic", sentence_features(rows).alias("s"))
    # of each document the sentences nearest to any landmark, and one for all others
    strength = F.transform("s", lambda x: F.struct((-F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)).alias("k"), x.alias("x")))
    found = found.select("doc_id", "toxic", F.transform(F.slice(F.array_sort(strength), 1, each), lambda p: p["x"]).alias("s")).collect()
    found = sorted(found, key=lambda r: (r.doc_id, r.toxic, len(r.s), [tuple(x) for x in r.s[:1]]))
    texts = [np.array(r.s, np.float64).reshape(-1, len(rows)) if r.s else np.zeros((1, len(rows))) for r in found]
    w, bias, slopes, shift = fit(texts, np.array([r.toxic for r in found]))
    return Model(rows, _root(rows)[1] @ w, bias, slopes, shift)


class Scorer:
    """Values of units by a model, remembered for the units a task has met."""

    def __init__(self, model: Model):
        self.model, self.landmarks = model, Landmarks(model.landmarks)
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def unit_values(self, units: Units) -> np.ndarray:
        distinct, first, back = np.unique(units.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        values = np.zeros(len(distinct))
        values[known] = self.values[at[known]] if len(self.hashes) else 0
        new = np.flatnonzero(~known)
        values[new] = self.landmarks.kernel(units.rows[first[new]]) @ self.model.weights
        if len(self.hashes) + len(new) > REMEMBERED:
            self.hashes, self.values = distinct, values
        elif len(new):
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.values = hashes[order], np.concatenate([self.values, values[new]])[order]
        return values[back]

    def best(self, texts: pa.Array) -> np.ndarray:
        """The greatest values of the machine over the sentences of each text."""
        owners, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for units, numbers in _batches(texts):
            owner, sums = sentence_sums(units, self.unit_values(units))
            owners.append(numbers[owner])
            values.append(sums + self.model.bias)
        return greatest(np.concatenate(owners), np.concatenate(values), len(texts), self.model.bias)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.best(texts) @ self.model.slopes + self.model.shift, -50, 50)))


def score(model: Model | None, text: str | Column) -> Column:
    """Probability that a whole text is toxic, as a column.

    A null or empty text, or one without units, gets the probability of the
    bias alone; every text gets 0 if no label could be learned from. A text above
    256 KiB is read in passages cut at white space; no sentence spans a cut.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model else None
        for batch in texts:
            if scorer is None:
                yield pa.array(np.zeros(len(batch)))
                continue
            yield pa.array(scorer.probabilities(batch))

    return arrow_udf(run, "double").asNondeterministic()(text)


def grade(documents: DataFrame, model: Model | None, flag_from: float = FLAG_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of `documents`."""
    scored = documents.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score(model, "text").alias("score"))
    return scored.select("*", (F.col("score") >= flag_from).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    prepared(spark)
    documents = table(spark, sf_dir, "documents")
    return grade(documents, train(documents, table(spark, sf_dir, "labels")))
