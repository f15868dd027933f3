"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, compared by subtraction and peeling."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import mixed, shuffle_partitions, table

#: Cells of a fingerprint; a comparison that cannot be peeled is repeated with twice as many.
CELLS = 32
HASHES = 3
#: A paragraph ends behind its punctuation or line end, or after so many characters without any.
PARAGRAPH = re.compile(r"[^.!?;:,|\n。！？；，]{1,240}[.!?;:,|\n。！？；，]*\s*|[.!?;:,|\n。！？；，]+\s*")
SALTS = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]
CHECK = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text sketched in one numpy pass.
GROUP = 1 << 21


def paragraph_digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs of a text; the k-th copy of a paragraph has a digest of its own.

    The paragraphs, put together, are the text, white space included.
    """
    digest = xxhash.xxh3_64_intdigest
    raw = np.array([digest(p) for p in PARAGRAPH.findall(text)], np.uint64)
    if len(raw) < 2:
        return raw
    order = np.argsort(raw, kind="stable")
    ranked = raw[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    copy = np.arange(len(raw)) - np.maximum.accumulate(np.where(fresh, np.arange(len(raw)), 0))
    return mixed(ranked + copy.astype(np.uint64) * CHECK)


def sketches(digests: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of digests and sums of check digests in the cells of each set, one row a set.

    The cells are HASHES equal parts; each digest goes to one cell of each part.
    """
    sizes = [len(d) for d in digests]
    counts = np.zeros(len(digests) * cells, np.int64)
    sums, checks = np.zeros(len(digests) * cells, np.uint64), np.zeros(len(digests) * cells, np.uint64)
    if sum(sizes):
        _add(counts, sums, checks, np.concatenate(digests), np.repeat(np.arange(len(digests)), sizes), np.ones(sum(sizes), np.int64), cells)
    return tuple(x.reshape(len(digests), cells) for x in (counts, sums, checks))


def _add(counts, sums, checks, digests, rows, signs, cells) -> None:
    part = cells // HASHES
    check = mixed(digests ^ CHECK)
    plus = signs.astype(np.uint64)  # -1 wraps to 2**64 - 1, so a product with it subtracts
    for k, salt in enumerate(SALTS):
        at = rows * cells + k * part + (mixed(digests ^ salt) % np.uint64(part)).astype(np.int64)
        np.add.at(counts, at, signs)
        np.add.at(sums, at, digests * plus)
        np.add.at(checks, at, check * plus)


def peel(counts: np.ndarray, sums: np.ndarray, checks: np.ndarray, mask: int = (1 << 64) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover the digests in differences of sketches (rows): (row, digest, sign) of each, and whether a row is empty at the end.

    A cell with one digest left shows it: its count is 1 or -1 and its check
    sum fits, in the bits of `mask`. What is found is taken out of its other cells, until nothing more shows.
    """
    kept = np.uint64(mask)
    rows, cells = counts.shape
    counts, sums, checks = counts.ravel().copy(), sums.ravel().copy(), checks.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(counts) == 1)
    while len(look):
        sign = counts[look]
        digest = np.where(sign == 1, sums[look], np.uint64(0) - sums[look])
        pure = (np.abs(sign) == 1) & (np.where(sign == 1, checks[look], np.uint64(0) - checks[look]) & kept == mixed(digest ^ CHECK) & kept)
        row, digest, sign = look[pure] // cells, digest[pure], sign[pure]
        if not len(row):
            break
        _, once = np.unique(np.stack([row.astype(np.uint64), digest]), axis=1, return_index=True)
        row, digest, sign = row[once], digest[once], sign[once]
        _add(counts, sums, checks, digest, row, -sign, cells)
        found.append((row, digest, sign))
        look = np.flatnonzero(np.abs(counts) == 1)
    empty = ~((counts != 0) | (sums != 0) | (checks & kept != 0)).reshape(rows, cells).any(axis=1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), empty
    return *(np.concatenate(x) for x in zip(*found, strict=True)), empty


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, int]:
    """How many digests each pair of sets does not share, and the cells that the last pair needed.

    Pairs whose difference cannot be peeled are sketched again with twice the
    cells, until the difference fits; with more cells than three times the digests that is all but certain.
    """
    out, todo = np.zeros(len(left), np.int64), np.arange(len(left))
    while len(todo):
        cells_now = cells - cells % HASHES
        a, b = sketches([left[i] for i in todo], cells_now), sketches([right[i] for i in todo], cells_now)
        row, _, _, empty = peel(a[0] - b[0], a[1] - b[1], a[2] - b[2])
        out[todo] = np.bincount(row, minlength=len(todo))
        todo = todo[~empty]
        cells *= 2
    return out, cells // 2


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Twice the shared paragraphs over all paragraphs of both texts; 1 for two texts without any."""
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)])
    apart, _ = differences(left, right)
    return np.where(both == 0, 1.0, (both - apart) / np.maximum(both, 1))


LOW = np.uint64(0xFFFFFFFF)


def fingerprints(digests: list[np.ndarray]) -> list[str]:
    """The sketch of each set as text: base64 of little-endian counts (int32), sums (uint64) and the low halves of check sums (uint32).

    Low halves subtract like the whole sums do, so `difference` can peel what two fingerprints do not share.
    """
    counts, sums, checks = sketches(digests, CELLS - CELLS % HASHES)
    packed = zip(counts.astype("<i4"), sums.astype("<u8"), (checks & LOW).astype("<u4"), strict=True)
    return [base64.b64encode(c.tobytes() + s.tobytes() + k.tobytes()).decode() for c, s, k in packed]


def difference(one: str, other: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Digests that only one of two texts has, with sign 1 for the first text, from their fingerprints alone; and whether these are all."""
    sides = []
    for text in (one, other):
        data = base64.b64decode(text)
        n = len(data) // 16
        sides.append([np.frombuffer(data, t, n, at).astype(w).reshape(1, n) for t, at, w in (("<i4", 0, np.int64), ("<u8", 4 * n, np.uint64), ("<u4", 12 * n, np.uint64))])
    _, digests, signs, empty = peel(*(a - b for a, b in zip(*sides, strict=True)), mask=int(LOW))
    return digests, signs, bool(empty[0])


#: Stands for a null id in the order: nulls come first.
NULL_ID = -(1 << 63)


def with_next(documents: DataFrame) -> DataFrame:
    """bucket, own, place, doc_id, text: ranges of ids, each followed by the first row of the next range (own false).

    A range is one partition, sorted. The ranges are cut at quantiles of the
    ids alone, so a text moves once; the borrowed rows are one for each
    partition. The last range borrows the first row of all. Null ids come first,
    rows with equal ids follow each other by text.
    """
    spark, wanted = documents.sparkSession, shuffle_partitions(documents.sparkSession)
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    # one number for each partition
    cuts = documents.agg(F.percentile_approx(place, [k / wanted for k in range(1, wanted)] or [0.5], 10_000)).first()[0]
    edges = np.unique(np.array(cuts or [0], np.int64))

    def below(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in places:
            yield pa.array(np.searchsorted(edges, batch.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    bucket_of = arrow_udf(below, "int")
    firsts = documents.select(place.alias("place")).groupBy(bucket_of("place").alias("bucket")).agg(F.min("place")).orderBy("bucket").collect()
    borrowers = [firsts[-1][0], *(r[0] for r in firsts[:-1])] if firsts else []
    lent = spark.createDataFrame([(r[1], b) for r, b in zip(firsts, borrowers, strict=True)], "place bigint, borrower int")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    rows = rows.withColumn("bucket", bucket_of("place")).join(F.broadcast(lent), "place", "left")
    targets = F.filter(F.array(F.struct(F.col("bucket"), F.lit(True).alias("own")), F.struct(F.col("borrower").alias("bucket"), F.lit(False).alias("own"))), lambda t: t.bucket.isNotNull())
    rows = rows.select("place", "doc_id", "text", F.explode(targets).alias("t")).select("t.bucket", "t.own", "place", "doc_id", "text")
    return rows.repartitionById(len(edges) + 1, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), "place", "text")


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs bigint"


def versions(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness, one row for each row of `documents`.

    The edited text has the last half of its characters replaced by the first
    ones of the next document in the order of ids, the first document after
    the last. A null text is empty; an empty text has an empty sketch. Equal texts have equal fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (doc_id, text, digests, own)
        size = 0
        for batch in batches:
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if waiting and not waiting[-1][3]:
                    continue  # a second row with the borrowed id
                waiting.append((doc_id, text, paragraph_digests(text), own))
                size += len(text)
                if size > GROUP:
                    if len(waiting) > 1:
                        yield compared(waiting)
                    waiting, size = waiting[-1:], 0
        if len(waiting) > 1:
            yield compared(waiting)

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, each with its next."""
        texts, digests = [r[1] for r in rows], [r[2] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
        changed = [paragraph_digests(e) for e in edited]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(fingerprints(digests[:-1])), pa.array(fingerprints(changed)),
                pa.array(likeness(digests[:-1], changed)), pa.array(likeness(digests[:-1], digests[1:])), pa.array([len(d) for d in digests[:-1]], pa.int64()),
            ],
            [c.split()[0] for c in RESULT.split(", ")],
        )

    return with_next(documents).select("doc_id", "text", "own").mapInArrow(run, RESULT)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return versions(table(spark, sf_dir, "documents"))
