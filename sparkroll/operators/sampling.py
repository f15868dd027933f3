"""Seeded sampling, sharding, top-k and deduplication.

All randomness is the order of md5(seed|key): the same rows on every run, on
any partitioning, in any engine. Ranks over the whole table use the digest's
leading digits as ready-made slices, so nothing is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.functions.arrays import let
from sparkroll.skew import rank_by_hash, rank_by_id, seeded, with_group_stats


def shuffled(df: DataFrame, key: Sequence[str], seed: int, name: str = "pos", first: int | None = None) -> DataFrame:
    """Position of each row in a seeded permutation of the table, or its first rows."""
    hashed = df.withColumn("__h", seeded(seed, *key))
    return rank_by_hash(hashed, "__h", key, name, first).drop("__h")


def shuffle_take(df: DataFrame, key: Sequence[str], seed: int, n: int | None = None, portion: float | None = None) -> DataFrame:
    """First n rows of a seeded permutation, with their position; n may be a share of the table."""
    if (n is None) == (portion is None):
        raise ValueError("give a count or a portion, not both")
    if n is not None and df.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return shuffled(df, key, seed, first=n if n is not None else int(df.count() * portion))


def portion(df: DataFrame, id_col: str, share: float, seed: int | None = None) -> DataFrame:
    """First int(rows * share) rows by id, or of a seeded permutation."""
    wanted = int(df.count() * share)
    if seed is not None:
        return shuffled(df, [id_col], seed, first=wanted)
    return rank_by_id(df, id_col, "pos").where(F.col("pos") < wanted)


def epoch_slice(df: DataFrame, id_col: str, seed: int, per_iteration: int, total_iterations: int, iteration: int) -> DataFrame:
    """Rows [n*i, n*i + n) of a concatenation of differently seeded permutations."""
    size = df.count()
    start, end = per_iteration * iteration, per_iteration * (iteration + 1)
    if not 0 <= iteration < total_iterations:
        raise ValueError("iteration out of range")
    # only the one or more permutations the slice touches are ranked
    repeats = range(start // size, (end - 1) // size + 1)
    parts = [
        shuffled(df, [id_col], seed + r).withColumns({"repeat": F.lit(r).cast("bigint"), "pos": F.col("pos") + r * size}) for r in repeats
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.where((F.col("pos") >= start) & (F.col("pos") < end))


def resize(df: DataFrame, key: Sequence[str], seed: int, target: int, fill_missing: bool = True) -> DataFrame:
    """Exactly `target` rows: a seeded subset, or whole-set repeats and then a seeded subset."""
    size = df.count()
    if size < target and not (fill_missing and size):
        raise ValueError(f"{size} rows cannot be resized to {target}")
    if size >= target:
        return shuffle_take(df, key, seed, n=target).withColumn("copy", F.lit(0).cast("bigint"))
    copies = target // size + 1
    repeated = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("copy", F.col("copy").cast("bigint"))
    return shuffled(repeated, [*key, "copy"], seed, first=target)


def take_and_leave(df: DataFrame, key: Sequence[str], seed: int, n: int) -> DataFrame:
    """The seeded permutation with a flag: taken now, or left for the next call."""
    ranked = shuffled(df, key, seed)
    return ranked.withColumn("taken", F.col("pos") < n)


def shard_contiguous(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """k consecutive shards by id, the first len % k of them one row longer."""
    base, longer = divmod(df.count(), shards)
    pos, border = F.col("pos"), longer * (base + 1)
    shard = F.when(pos < border, F.floor(pos / (base + 1))).otherwise(longer + F.floor((pos - border) / max(base, 1)))
    return rank_by_id(df, id_col, "pos").withColumn("shard", shard.cast("bigint"))


def shard_round_robin(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    return rank_by_id(df, id_col, "pos").withColumn("shard", F.pmod(F.col("pos"), F.lit(shards)).cast("bigint"))


def sample_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int, n: int) -> DataFrame:
    """n rows of each group without replacement.

    `row_number() <= n` lets Spark keep n rows per group and map task, so a hot
    group is cut down before the shuffle.
    """
    order = [seeded(seed, *group, *key), *[F.col(k) for k in key]]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__rn")


def first_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group in input order; -1 keeps all."""
    if n == -1:
        return df
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__rn")


def subsample_runs(df: DataFrame, id_col: str, seed: int, runs: int, n: int) -> DataFrame:
    """R independent runs of n rows without replacement, concatenated; each is cut from digest slices, none is one task."""
    parts = [shuffled(df.withColumn("run", F.lit(r).cast("bigint")), ["run", id_col], seed, first=n).drop("pos") for r in range(runs)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def evenly_spaced(df: DataFrame, id_col: str, m: int) -> DataFrame:
    """At most m items of an ordered list, at int(i * len / m)."""
    size = df.count()
    ranked = rank_by_id(df, id_col, "pos")
    if size <= m:
        return ranked
    # position p is picked iff some i has floor(i * len / m) = p
    i = F.ceil(F.col("pos") * m / F.lit(size))
    return ranked.where((F.floor(i * size / F.lit(m)) == F.col("pos")) & (i < m))


def dedupe_requests(requests: DataFrame, text: str, uid: str) -> DataFrame:
    """Every request learns the first uid with the same text; the unique ones carry their own.

    The text is grouped by its digest pair, so long texts are not shuffled.
    """
    keyed = requests.withColumns({"__h": F.sha2(text, 256), "__len": F.length(text)})
    keyed = with_group_stats(keyed, ["__h", "__len"], {"unique_uid": F.min(uid)})
    return keyed.drop("__h", "__len").withColumn("is_unique", F.col("unique_uid") == F.col(uid))


def duplicated_ids(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ids that repeat, with their count: empty when the ids are unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def union_shards(shards: Sequence[DataFrame], shard_names: Sequence[int] | None = None) -> DataFrame:
    """All shards under one schema with the shard number as a column."""
    names = shard_names or range(len(shards))
    tagged = [s.withColumn("shard", F.lit(int(i)).cast("bigint")) for i, s in zip(names, shards)]
    merged = tagged[0]
    for part in tagged[1:]:
        merged = merged.unionByName(part)
    return merged


#: Rounds of the keyed permutation, and how often a number outside the range is permuted again.
FEISTEL_ROUNDS, WALKS = 4, 64


def _permuted(x: Column, digest: Column, wide: Column, high: Column) -> Column:
    """One keyed Feistel permutation of [0, high * wide): the halves x div wide and x mod wide are shifted by hashes of each other."""

    def round_of(k: int) -> Callable[[Column], Column]:
        def shifted(h: Column) -> Column:
            other = h["right"] if k % 2 == 0 else h["left"]
            shift = F.conv(F.substring(F.md5(F.concat_ws("|", digest, F.lit(str(k)), other.cast("string"))), 1, 8), 16, 10).cast("bigint")
            left, right = ((h["left"] + shift) % high, h["right"]) if k % 2 == 0 else (h["left"], (h["right"] + shift) % wide)
            return F.struct(left.alias("left"), right.alias("right"))

        return shifted

    # each round is bound once: as plain expressions both halves would repeat all rounds before
    halves = F.struct(F.floor(x / wide).cast("bigint").alias("left"), (x % wide).alias("right"))
    for k in range(FEISTEL_ROUNDS):
        halves = let(halves, round_of(k))
    return let(halves, lambda h: h["left"] * wide + h["right"])


def permuted_picks(size: Column, wanted: int, seed: int | Column, *key: str) -> Column:
    """min(size, wanted) distinct positions of [0, size), as an array: the first of a keyed pseudo-random permutation.

    The permutation is a Feistel network over two mixed-radix halves, whose
    product is less than one half above `size`. A number outside the range is
    permuted again until it falls inside (cycle walking), which keeps it a
    permutation and needs no list. With `WALKS` steps or less outside it always
    ends; else the halves are above WALKS, and the chance of so long a walk is below 2 ** -384.
    """
    size = size.cast("bigint")
    high = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("bigint")
    bound = F.struct(size.alias("size"), F.least(size, F.lit(wanted)).cast("bigint").alias("count"), seeded(seed, *key).alias("digest"), high.alias("high"), F.floor((size + high - 1) / high).cast("bigint").alias("wide"))

    def picks(p: Column) -> Column:
        walks = F.sequence(F.lit(0), F.least(p["high"] * p["wide"] - p["size"], F.lit(WALKS)).cast("int"))

        def pick(j: Column) -> Column:
            first = _permuted(j, p["digest"], p["wide"], p["high"])
            return F.aggregate(walks, first, lambda x, _: F.when(x < p["size"], x).otherwise(_permuted(x, p["digest"], p["wide"], p["high"])))

        return F.when(p["count"] > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), p["count"] - 1), pick)).otherwise(F.array().cast("array<bigint>"))

    return let(bound, picks)
