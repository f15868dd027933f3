"""Helpers that several operators share: sessions, folds, bounded samples, text as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroll.session import reliable_checkpoint, tune

#: Bytes of text that one numpy pass looks at; a longer text is read in passages.
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prepared(spark: SparkSession) -> SparkSession:
    """Runtime settings of the operators; small Arrow batches, as one row can be a very long text."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as remainder 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % 5, F.lit(0)).cast("int")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    return reliable_checkpoint(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, about equally many of each label, picked by a hash of the key.

    Labels are counted first (one row for each label reaches the driver). Each
    label keeps the rows whose hash lies below bound / labels / count, so the
    choice depends on the data alone, not on how they are partitioned.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    draw = (F.xxhash64(F.col(key).cast("string"), F.lit(label)) / F.lit(2.0**63) + 1) / 2
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(bound / len(counts) / count)).otherwise(share)
    return rows.where(draw < share).orderBy(draw, key).limit(bound)


COUNTED = "struct<numbers:binary,counts:binary>"


def counted(lists: list[np.ndarray]) -> pa.Array:
    """The distinct numbers of each list and how often they occur, packed as 32-bit integers (a column of type COUNTED)."""
    unique = [np.unique(x, return_counts=True) for x in lists]
    return pa.StructArray.from_arrays([pa.array([u[k].astype(np.int32).tobytes() for u in unique], pa.binary()) for k in range(2)], ["numbers", "counts"])


def counted_features(rows: DataFrame, *columns: str) -> list[tuple]:
    """Rows of a bounded sample on the driver: `columns`, then the two lists of the COUNTED column `f` as arrays; no object per number."""
    return [(*(r[c] for c in columns), *(np.frombuffer(x, np.int32).astype(np.int64) for x in r["f"])) for r in rows.select(*columns, "f").collect()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for base in (ODD, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of value times ODD ** place in the run, for each run of `values` (uint64, 0 where nothing counts).

    A run of n values is continued by adding ODD ** n times the sum of what follows.
    """
    up, down = powers(len(values))
    return np.add.reduceat(values * up, starts) * down[starts]


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of `values` (uint64, 0 where nothing counts), wherever it stands."""
    return mixed(run_sums(values, starts))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; a null is an empty text."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, numbers of the texts) of at most `limit` bytes each.

    Short texts travel together; a text over the limit comes in passages, cut
    behind the last white space of each or, failing that, between characters.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        if offsets[j] - offsets[i] <= limit:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j)
        else:
            at, end = int(offsets[i]), int(offsets[j])
            while at < end:
                to = end
                if end - at > limit:
                    window = data[at : at + limit]
                    space = np.flatnonzero(window <= 32)
                    to = at + (int(space[-1]) + 1 if len(space) else limit)
                    while len(space) == 0 and (data[to] & 0xC0) == 0x80:
                        to -= 1
                yield data[at:to], np.array([0, to - at]), np.array([i])
                at = to
        i = j


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets counted in them."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, heads[offsets]


_tables: list[np.ndarray] = []
SPACE, LETTER, UPPER, DIGIT, OTHER = range(5)


def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point of the first plane; entry 65,536 stands for the rest."""
    if not _tables:
        chars = [chr(c) for c in range(0x10000)] + ["\U00020000"]
        kind = [SPACE if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LETTER if c.isalpha() else OTHER for c in chars]
        lower = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars]
        _tables.extend([np.array(kind, np.uint8), np.array(lower, np.uint32)])
    return _tables[0], _tables[1]


def sums_by(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups [starts[i], starts[i + 1]); an empty group gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
