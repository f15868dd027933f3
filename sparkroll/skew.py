"""Ranks, running aggregates and neighbours that survive a hot group.

A plain window puts one whole group into one task. That is the right plan while
groups are small and a wrong one when one key holds a third of the table. Each
function here first estimates the largest group (a count over sampled keys) and
then picks a plan:

* no group above the limit: one window over the group;
* otherwise: the group is cut into ordered slices, every slice is one window,
  and the slices are tied together by a carry table of one row per slice.

Both plans are exact, so the choice never changes a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.session import reliable_checkpoint

HOT_GROUP_ROWS = 1_000_000
SLICE_ROWS = 65_536
SAMPLED = 400
HASH_DIGITS = 4  # 16 ** 4 slices of a seeded order
ID_SLICES = 65_536

_measured: dict[tuple, bool] = {}


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sparkroll.hotGroupRows", str(HOT_GROUP_ROWS)))


def has_hot_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """True if a group of `keys` has more rows than one window task should hold.

    Measured once per session and set of source files, on a sample for large limits: the optimised plan of the count is the
    same for all frames that differ only in columns the count does not need.
    """
    limit = hot_limit(df)
    # both plans are exact, so a sample of the keys is enough to choose: a group at the limit shows about SAMPLED times
    share = min(1.0, SAMPLED / limit)
    sizes = (df if share == 1 else df.select(*keys).sample(share, seed=1)).groupBy(*keys).count()
    plan = sizes._jdf.queryExecution().optimizedPlan().semanticHash()
    memo = (df.sparkSession.sparkContext.applicationId, plan, tuple(sorted(df.inputFiles())), limit)
    if memo not in _measured:
        _measured[memo] = bool(sizes.where(F.col("count") > (limit if share == 1 else SAMPLED * 0.75)).take(1))
    return _measured[memo]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on `keys` where null equals null; the keys of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    return left.join(renamed, on, how).drop(*[f"__k_{c}" for c in keys])


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, hot: bool | None = None) -> DataFrame:
    """0-based dense position inside each group; `order` must be total inside it."""
    keys = list(keys)
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, rank.cast("bigint"))
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order).withColumn("__slice", F.spark_partition_id())
    return _rank_over_slices(reliable_checkpoint(placed), keys, order, name)


def _rank_over_slices(placed: DataFrame, keys: list[str], order: Sequence[Column], name: str) -> DataFrame:
    carry = placed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order)) - 1
    ranked = same_keys(placed.withColumn("__inside", inside), carry, [*keys, "__slice"])
    return ranked.withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__slice", "__inside", "__before")


def rank_by_hash(df: DataFrame, hash_col: str, tie: Sequence[str], name: str, first: int | None = None) -> DataFrame:
    """0-based rank of the whole table in the order of a hex digest, or of its first rows only.

    Digests spread evenly, so their leading digits are ready-made ordered
    slices; the carry has at most 16 ** HASH_DIGITS rows and is broadcast. With
    `first`, slices that start behind it are gone before anything is shuffled.
    """
    placed = df.withColumn("__slice", F.substring(hash_col, 1, HASH_DIGITS))
    ranked = _rank_with_bounded_carry(placed, [F.col(hash_col), *[F.col(c) for c in tie]], name, first)
    return ranked if first is None else ranked.where(F.col(name) < first)


def rank_by_id(df: DataFrame, col: str, name: str) -> DataFrame:
    """0-based rank of the whole table by a unique integer id; null ids come first.

    Equal-width id slices when they are balanced enough, else ranges chosen by
    Spark's range partitioner. Slices are cut in floating point, which keeps the order of ids of any size.
    """
    low, high = df.agg(F.min(col), F.max(col)).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    width = max(1, -(-(high - low + 1) // ID_SLICES))
    slice_of = F.floor((F.col(col).cast("double") - F.lit(float(low))) / F.lit(float(width))).cast("bigint")
    placed = df.withColumn("__slice", F.coalesce(slice_of, F.lit(-1).cast("bigint")))
    # ids are unique, so a slice holds at most about `width` rows
    if width > hot_limit(df) and has_hot_group(placed.select("__slice"), ["__slice"]):
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(slices, F.col(col)).withColumn("__slice", F.spark_partition_id())
        placed = reliable_checkpoint(ranged)
    return _rank_with_bounded_carry(placed, [F.col(col)], name)


def _rank_with_bounded_carry(placed: DataFrame, order: Sequence[Column], name: str, first: int | None = None) -> DataFrame:
    sizes = placed.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    # one row per slice, at most 65,536: a single task and a broadcast of about 1 MB
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if first is not None:
        carry = carry.where(F.col("__before") < first)
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    ranked = placed.join(F.broadcast(carry), "__slice").withColumn("__inside", inside)
    return ranked.withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__slice", "__inside", "__before")


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    aggs: Mapping[str, tuple[str, str]],
    reverse: bool = False,
    hot: bool | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Running `sum`, `min` or `max` along the dense position `pos`, current row included.

    `aggs` maps a new column to (function, column). `reverse` runs from the end
    as a descending order, which is linear, unlike an unbounded-following frame.
    """
    keys = list(keys)
    if hot is None:
        hot = has_hot_group(df, keys)
    functions = {"sum": F.sum, "min": F.min, "max": F.max}
    direction = F.col(pos).desc() if reverse else F.col(pos).asc()
    if not hot:
        frame = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: functions[f](c).over(frame) for new, (f, c) in aggs.items()})
    sliced = df.withColumn("__slice", F.floor(F.col(pos) / F.lit(slice_rows)))
    totals = sliced.groupBy(*keys, "__slice").agg(*[functions[f](c).alias(f"__t_{new}") for new, (f, c) in aggs.items()])
    slice_order = F.col("__slice").desc() if reverse else F.col("__slice").asc()
    before = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "__slice", *[functions[f](f"__t_{new}").over(before).alias(f"__c_{new}") for new, (f, _) in aggs.items()])
    frame = Window.partitionBy(*keys, "__slice").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({new: functions[f](c).over(frame) for new, (f, c) in aggs.items()})
    joined = same_keys(local, carry, [*keys, "__slice"])
    merged = {}
    for new, (f, _) in aggs.items():
        mine, carried = F.col(new), F.col(f"__c_{new}")
        if f == "sum":
            merged[new] = F.when(carried.isNull(), mine).when(mine.isNull(), carried).otherwise(mine + carried)
        else:
            merged[new] = F.least(mine, carried) if f == "min" else F.greatest(mine, carried)
    return joined.withColumns(merged).drop("__slice", *[f"__c_{new}" for new in aggs])


def neighbour(df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, str], offset: int = 1, hot: bool | None = None) -> DataFrame:
    """Values of the row `offset` positions later (negative: earlier) in the group, null at the border."""
    keys = list(keys)
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        frame = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({new: F.lead(c, offset).over(frame) for new, c in cols.items()})
    # (keys, pos) is unique, so this join spreads a hot group over all partitions
    other = df.select(*keys, (F.col(pos) - F.lit(offset)).alias(pos), *[F.col(c).alias(new) for new, c in cols.items()])
    return same_keys(df, other, [*keys, pos])


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], hot: bool | None = None) -> DataFrame:
    """Attach aggregates of the group to its rows."""
    keys = list(keys)
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        frame = Window.partitionBy(*keys)
        return df.withColumns({new: agg.over(frame) for new, agg in aggs.items()})
    # map-side combined totals; AQE splits the hot partition of the row side
    stats = df.groupBy(*keys).agg(*[agg.alias(new) for new, agg in aggs.items()])
    return same_keys(df, stats, keys)


def seeded(seed: int | str | Column, *keys: Column | str) -> Column:
    """The digest all sampling is ordered by: md5(seed|key|key...)."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    rest = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", first, *rest))
