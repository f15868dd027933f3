"""Variance and distance over vector tables, one row per vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.arrays import let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def covariance_trace(vectors: DataFrame, vector: str, max_norm: float | None = None) -> DataFrame:
    """Sum and mean over dimensions of the variance over vectors.

    Vectors with a NaN or infinite entry are skipped; the rest are clipped to a
    maximal norm. Partial aggregation leaves one row per dimension and task.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    broken = F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.select(v.alias("v")).where(~broken)
    if max_norm is not None:
        factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / (norm(F.col("v")) + 1e-6))
        clean = clean.select(let(factor, lambda f: F.transform("v", lambda x: x * f)).alias("v"))
    dims = clean.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("p"), F.var_samp("x").alias("s"), F.count("x").alias("n"))
    return dims.agg(
        F.sum("p").alias("trace_pop"), F.sum("s").alias("trace_samp"), F.avg("p").alias("mean_pop"), F.avg("s").alias("mean_samp"), F.max("n").alias("vectors"))


def l2_distance(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Distance of two snapshots of a keyed vector table, with the number of keys or sizes that differ."""
    a = left.select(F.col(key).alias("ka"), F.col(vector).alias("va"))
    b = right.select(F.col(key).alias("kb"), F.col(vector).alias("vb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full")
    matched = F.col("ka").isNotNull() & F.col("kb").isNotNull() & (F.size("va") == F.size("vb"))
    squares = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda acc, x: acc + x)
    return both.agg(F.sqrt(F.sum(F.when(matched, squares))).alias("l2_distance"), F.count_if(~F.coalesce(matched, F.lit(False))).alias("mismatches"))


def softmax(df: DataFrame, group: list[str], x: str, theta: float, name: str = "softmax") -> DataFrame:
    """exp(theta x - max) / sum over each group of an exploded array."""
    scaled = F.col(x) * theta
    top = df.groupBy(*group).agg(F.max(scaled).alias("__top"))
    shifted = df.join(top, group).withColumn("__e", F.exp(scaled - F.col("__top")))
    total = shifted.groupBy(*group).agg(F.sum("__e").alias("__sum"))
    return shifted.join(total, group).withColumn(name, F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def softmax_row(v: Column, theta: float) -> Column:
    """Softmax along an array column: no shuffle."""
    scaled = F.transform(v, lambda x: x.cast("double") * theta)
    exps = let(scaled, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)))
