"""Language-model scores by deleted interpolation of word n-grams (unigrams and bigrams).

The probability of word w behind h is a mixture of three estimates:

    P(w | h) = m2 * c(h, w) / c(h) + m1 * c(w) / N + m0 / (V + 1)

The weights (m2, m1, m0) depend on the bucket of c(h), its binary logarithm.
They are learned by expectation-maximisation on held-out counts: the training
documents with remainder 0 are held out, and seen with counts of the others
("kept"). The final counts are those of all training documents.

How the work is spread. Texts are cut into blocks of words. A block asks for
the counts of its distinct words and bigrams: one packed array of hashes for
each partition of the hash space. A partition adds up what the blocks know
and answers each of them. So a frequent word is one entry in each block, no
task sees more than its part of the distinct n-grams, and words are never rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.llm.common import ODD, SLICE_BYTES, fold, mixed, pieces, run_sums, shuffle_partitions, stored, table, text_buffers

#: Words of a block. A block never mixes folds.
BLOCK_WORDS = 2_000_000
#: Distinct n-grams that one partition of the hash space should hold at most, on average.
PART_ENTRIES = 2_000_000
ITERATIONS = 60
#: Folds by the remainder: held out of the weights, test, and the rest.
HELD, TEST = 0, 1
#: Hashes of the end of a text and of its beginning; a word has either with probability 2 ** -63.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
WORDS, PAIRS = 0, 1
#: Bytes of a hash that travel. The partition fixes its high bits, so a bigram's keeps about 48 + log2(partitions) bits.
WIDTHS = {WORDS: 8, PAIRS: 6}
#: Bins of the histogram that the weights are learned from, for each doubling of a ratio.
BINS = 4

_letters: list[np.ndarray] = []


def word_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """`run_sums` of each word of the texts, A-Z as a-z, the number of words of each text, and the bytes behind the last space.

    A word is a run of bytes other than the six ASCII spaces.
    """
    if not _letters:
        values = np.arange(256, dtype=np.uint64) + np.uint64(1)
        values[65:91] = values[97:123]
        values = mixed(values * ODD)
        values[[9, 10, 11, 12, 13, 32]] = 0
        _letters.append(values)
    values = _letters[0][data]
    solid = values != 0
    heads = solid.copy()
    heads[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    heads[begins] = solid[begins]
    starts = np.flatnonzero(heads)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), 0
    # behind a word only spaces (zeros) follow up to the next head
    return run_sums(values, starts), np.diff(np.searchsorted(starts, offsets)), int(len(data) - starts[-1]) if solid[-1] else 0


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each whole text. A word that the end of a passage cuts goes on in the next passage."""
    data, offsets = text_buffers(texts)
    found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    last, length = -1, 0
    for part, own, numbers in pieces(data, offsets, SLICE_BYTES):
        sums, sizes, tail = word_sums(part, own)
        if numbers[0] == last and length and part[0] not in (9, 10, 11, 12, 13, 32):
            found[last][-1][-1:] += sums[:1] * np.uint64(pow(int(ODD), length, 1 << 64))
            sums, sizes = sums[1:], sizes - 1
            length = length + tail if tail == len(part) else tail
        else:
            length = tail
        for number, some in zip(numbers, np.split(sums, np.cumsum(sizes)[:-1]), strict=True):
            if len(some):
                found[number].append(some)
        last = int(numbers[-1])
    return [mixed(np.concatenate(f)) if f else np.zeros(0, np.uint64) for f in found]


class Block:
    """Words of consecutive documents of one fold, as indexes into their sorted distinct hashes."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id, words: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(words) + 1)
        self.words += [words, np.array([END])]
        self.total += len(words) + 1


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


BLOCKS = "block string, fold int, ids binary, nulls binary, sizes binary, vocabulary binary, words binary, n bigint"


def blocks(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents as blocks: packed ids, sizes (words and the end), distinct hashes, and indexes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, waiting = TaskContext.get().partitionId(), 0, {}

        def flushed(of: int) -> pa.RecordBatch:
            nonlocal made
            block, made = waiting.pop(of), made + 1
            vocabulary, words = np.unique(np.concatenate(block.words), return_inverse=True)
            ids = np.array([0 if i is None else i for i in block.ids], np.int64)
            nulls = np.array([i is None for i in block.ids], np.uint8)
            values = [f"{task}-{made}", of, pack(ids), pack(nulls), pack(np.array(block.sizes, np.int64)), pack(vocabulary), pack(words.astype(np.int32)), block.total]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            found = words_of(batch.column(1))
            for k, (doc_id, of) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                of = of if of in (HELD, TEST) else 2
                block = waiting.setdefault(of, Block())
                block.add(doc_id, found[k])
                if block.total >= block_words:
                    yield flushed(of)
        for of in list(waiting):
            yield flushed(of)

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return documents.select("doc_id", "text", fold("doc_id").alias("fold")).mapInArrow(run, BLOCKS)


def pairs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one before it in its document, and the place of that one (-1: none)."""
    before = np.arange(len(words)) - 1
    before[np.cumsum(sizes) - sizes] = -1
    previous = np.where(before < 0, BEGIN, words[before])
    return mixed(previous * ODD + words), before


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes, word indexes and sizes of a block."""
    return unpack(row["vocabulary"], np.uint64), unpack(row["words"], np.int32), unpack(row["sizes"], np.int64)


ASKED = "part int, kind int, block string, fold int, hashes binary, counts binary"


def requests(stored_blocks: DataFrame, parts: int) -> DataFrame:
    """For each block and partition of the hash space: its distinct hashes there, and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, words, sizes = opened(row)
                grams = pairs_of(vocabulary[words], sizes)[0]
                for kind, (values, counts) in ((WORDS, (vocabulary, np.bincount(words, minlength=len(vocabulary)))), (PAIRS, np.unique(grams, return_counts=True))):
                    # the high bits of a hash say where it belongs, so sorted hashes are sorted by partition
                    edges = np.searchsorted(part_of(values, parts), np.arange(parts + 1))
                    full = np.flatnonzero(np.diff(edges))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array([row["block"]] * len(full), pa.string()),
                            pa.array(np.full(len(full), row["fold"], np.int32)), pa.array([narrow(values[edges[p] : edges[p + 1]], kind) for p in full], pa.binary()),
                            pa.array([pack(counts[edges[p] : edges[p + 1]].astype(np.uint32)) for p in full], pa.binary()),
                        ],
                        names,
                    )

    names = [c.split()[0] for c in ASKED.split(", ")]
    return stored_blocks.select("block", "fold", "sizes", "vocabulary", "words").mapInArrow(run, ASKED)


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash: its high 32 bits, scaled."""
    return (((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


ANSWERED = "block string, fold int, kind int, part int, kept binary, trained binary, types bigint, tokens bigint"


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """For each request, the counts of its hashes in the kept and in all training documents, in its order.

    `types` and `tokens` are the distinct and all training words of the partition, on one of its rows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        for kind in (WORDS, PAIRS):
            mine = [r for r in rows if r["kind"] == kind]
            if not mine:
                continue
            values = np.concatenate([widen(r["hashes"], kind) for r in mine])
            counts = np.concatenate([unpack(r["counts"], np.uint32) for r in mine]).astype(np.int64)
            folds = np.repeat([r["fold"] for r in mine], [len(r["hashes"]) // WIDTHS[kind] for r in mine])
            unique, at = np.unique(values, return_inverse=True)
            del values
            trained = np.bincount(at, np.where(folds == TEST, 0, counts), len(unique)).astype(np.int64)
            kept = np.bincount(at, np.where((folds == TEST) | (folds == HELD), 0, counts), len(unique)).astype(np.int64)
            start = 0
            for k, r in enumerate(mine):
                here = at[start : start + len(r["hashes"]) // WIDTHS[kind]]
                start += len(here)
                sums = [int((trained > 0).sum()), int(trained.sum())] if k == 0 and kind == WORDS else [0, 0]
                values_out = [r["block"], r["fold"], kind, r["part"], pack(slim(kept[here])), pack(slim(trained[here])), *sums]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values_out, types, strict=True)], names)

    names = [c.split()[0] for c in ANSWERED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return asked.repartitionById(parts, "part").mapInArrow(run, ANSWERED)


def narrow(hashes: np.ndarray, kind: int) -> bytes:
    """The low bytes of hashes."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, : WIDTHS[kind]]).tobytes()


def widen(raw: bytes, kind: int) -> np.ndarray:
    """What `narrow` kept, as numbers."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, WIDTHS[kind])
    full = np.zeros((len(low), 8), np.uint8)
    full[:, : WIDTHS[kind]] = low
    return full.view(np.uint64).ravel()


def slim(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, with 8-byte numbers behind the zeros that stand for those of 255 and more."""
    small = np.where(counts < 255, counts, 255).astype(np.uint8)
    return np.concatenate([small, counts[counts >= 255].astype("<i8").view(np.uint8)])


def widened(packed: bytes, n: int) -> np.ndarray:
    raw = unpack(packed, np.uint8)
    counts = raw[:n].astype(np.int64)
    counts[counts == 255] = raw[n:].copy().view("<i8")
    return counts


def meeting(stored_blocks: DataFrame, answered: DataFrame, run, schema: str) -> DataFrame:
    """Bring each block and its answers into one task, one block after the other, and call `run` on them."""
    empty = F.lit(None).cast("binary")
    left = stored_blocks.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("part"), empty.alias("kept"), empty.alias("trained"), "ids", "nulls", "sizes", "vocabulary", "words", "fold")
    right = answered.select("block", "kind", "part", "kept", "trained", *[empty.alias(c) for c in ("ids", "nulls", "sizes", "vocabulary", "words")], "fold")
    rows = left.unionByName(right).repartition(shuffle_partitions(left.sparkSession), "block").sortWithinPartitions("block", "kind", "part")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0]["block"] != row["block"]:
                    yield from run(group)
                    group = []
                group.append(row)
        if group:
            yield from run(group)

    return rows.mapInArrow(grouped, schema)


class Counts:
    """What a block knows of each of its words: counts of the word, of the one before it, and of both together."""

    def __init__(self, group: list[dict], which: str, parts: int):
        vocabulary, words, self.sizes = opened(group[0])
        grams, before = pairs_of(vocabulary[words], self.sizes)
        distinct, at = np.unique(grams, return_inverse=True)
        of = {}
        for kind, values in ((WORDS, vocabulary), (PAIRS, distinct)):
            edges = np.searchsorted(part_of(values, parts), np.arange(parts + 1))
            of[kind] = np.concatenate([widened(r[which], int(edges[r["part"] + 1] - edges[r["part"]])) for r in group[1:] if r["kind"] == kind])
        self.word = of[WORDS][words]
        self.pair = of[PAIRS][at]
        self.first = before < 0
        self.context = np.where(self.first, 0, self.word[before])


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, else 1 + its binary logarithm."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def histogram(stored_blocks: DataFrame, answered: DataFrame, parts: int, kept_texts: int, kept_tokens: int, kept_types: int) -> list:
    """Held-out words by context bucket and by the ratios of their two estimates to the uniform one, in bins of 1 / BINS doublings.

    The number of bins depends on the range of the logarithms alone.
    """

    def run(group: list[dict]) -> Iterator[pa.RecordBatch]:
        counts = Counts(group, "kept", parts)
        context = np.where(counts.first, kept_texts, counts.context)
        ratio = lambda x: np.where(x > 0, np.round(BINS * np.log2(np.maximum(x, 1e-300) * (kept_types + 1))).astype(np.int64), -9999)
        two, one = ratio(counts.pair / np.maximum(context, 1)), ratio(counts.word / max(kept_tokens, 1))
        cells, n = np.unique(np.stack([bucket(context), two, one]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cells, n)], ["bucket", "two", "one", "n"])

    held = meeting(stored_blocks.where(F.col("fold") == HELD), answered.where(F.col("fold") == HELD), run, "bucket bigint, two bigint, one bigint, n bigint")
    return held.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()


def learn_weights(cells: list, buckets: int = 64) -> np.ndarray:
    """(m2, m1, m0) of each bucket by expectation-maximisation; a bucket without held-out words has the next lower one's.

    Without any held-out words all buckets share the mass equally, the bigram's only where its context is known.
    """
    weights = np.full((buckets, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    by = {}
    for r in cells:
        by.setdefault(int(r.bucket), []).append((r.two, r.one, r.n))
    for b in range(buckets):
        if b not in by:
            if by and b and b > min(by):
                weights[b] = weights[b - 1]
            continue
        two, one, n = np.array(by[b], float).T
        estimates = np.stack([np.where(two > -9999, 2 ** (two / BINS), 0), np.where(one > -9999, 2 ** (one / BINS), 0), np.ones(len(n))])
        m = np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0, 0.5, 0.5])
        for _ in range(ITERATIONS):
            share = m[:, None] * estimates
            share /= share.sum(axis=0)
            m = (share * n).sum(axis=1) / n.sum()
        # no estimate may be worth nothing: an unseen word must keep some probability
        m = np.maximum(m, 1e-6) if b else np.array([0, *np.maximum(m[1:], 1e-6)])
        weights[b] = m / m.sum()
    return weights


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scores(stored_blocks: DataFrame, answered: DataFrame, parts: int, texts: int, tokens: int, types: int, weights: np.ndarray) -> DataFrame:
    def run(group: list[dict]) -> Iterator[pa.RecordBatch]:
        counts = Counts(group, "trained", parts)
        context = np.where(counts.first, texts, counts.context)
        m = weights[bucket(context)]
        p = m[:, 0] * counts.pair / np.maximum(context, 1) + m[:, 1] * counts.word / max(tokens, 1) + m[:, 2] / (types + 1)
        base = np.log10((counts.word + 0.5) / (tokens + 0.5 * (types + 1)))
        starts = np.cumsum(counts.sizes) - counts.sizes  # every text has an end, so no sum is empty
        ids, nulls = unpack(group[0]["ids"], np.int64), unpack(group[0]["nulls"], np.uint8).astype(bool)
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=nulls), pa.array(np.full(n, group[0]["fold"] == TEST)), pa.array(counts.sizes), pa.array(np.add.reduceat((counts.word > 0).astype(np.int64), starts)),
                pa.array(np.full(n, tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
            ],
            [c.split()[0] for c in SCORED.split(", ")],
        )

    return meeting(stored_blocks, answered, run, SCORED)


def score_texts(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of `documents`.

    A null text is empty: one token, the end. A null id belongs to remainder 0. If
    there is no training document, all counts are zero and every token has the uniform probability's share.
    Words are known by 64-bit hashes, bigrams by WIDTHS; a text above a MiB is read in passages, and a
    single word longer than a passage counts as several.
    """
    made = stored(blocks(documents, block_words))
    total = made.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(documents.sparkSession), -(-total // PART_ENTRIES))
    answered = stored(answers(requests(made, parts), parts))
    sums = answered.agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = sums[0] or 0, sums[1] or 0
    folds = {r[0]: (r[1], r[2]) for r in documents.groupBy(fold("doc_id").alias("f")).agg(F.count(F.lit(1)), F.lit(0)).collect()}
    texts = sum(n for f, (n, _) in folds.items() if f != TEST)
    kept_texts = sum(n for f, (n, _) in folds.items() if f not in (TEST, HELD))
    kept_tokens = made.where(~F.col("fold").isin(HELD, TEST)).agg(F.sum("n")).first()[0] or 0
    cells = histogram(made, answered, parts, kept_texts, kept_tokens, types)
    return scores(made, answered, parts, texts, tokens, types, learn_weights(cells))


def op8_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
