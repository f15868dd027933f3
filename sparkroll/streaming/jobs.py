"""State carried over iterations, as micro-batches and as one batch query.

Every streaming job stores mergeable partial results in one partition per
micro-batch and overwrites that partition, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.skew import running, with_group_stats

# The state before the first update, and the bounds of one KL update.
INITIAL_COUNT, INITIAL_VARIANCE = 1e-24, 1.0
KL_CLIP = 0.2
NOW = {"availableNow": True}


def moments(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable moments of the values per key: count, mean, and summed squares around that mean."""
    x = F.col(value).cast("double")
    found = scores.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("__v"))
    return found.select(*keys, "n", "mean", (F.col("n") * F.col("__v")).alias("m2"))


def _around(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums around a value of the group's own size, `__at`: sums of small differences do not cancel."""
    at = with_group_stats(partials.where("n > 0"), keys, {"__at": F.min("mean")})
    away = F.col("mean") - F.col("__at")
    return at.withColumns({"s": F.col("n") * away, "ss": F.col("m2") + F.col("n") * away * away})


def running_moments(partials: DataFrame, run: str, iteration: str) -> DataFrame:
    """Running mean, variance and sample deviation after each iteration, next to the batch's own."""
    per_iteration = _around(partials, [run]).groupBy(run, iteration).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("__at").alias("__at"))
    total = running(per_iteration, [run], iteration, {"tn": ("sum", "n"), "ts": ("sum", "s"), "tss": ("sum", "ss")}, hot=False)  # one row per iteration
    count = F.col("tn") + INITIAL_COUNT
    mean = F.col("ts") / count
    variance = F.greatest((F.col("tss") + INITIAL_VARIANCE * INITIAL_COUNT) / count - mean * mean, F.lit(0.0))
    batch_mean = F.col("s") / F.col("n")
    spread = F.greatest(F.col("ss") - F.col("n") * batch_mean * batch_mean, F.lit(0.0))
    return total.select(
        run, iteration, F.col("tn").alias("count"), (F.col("__at") + mean).alias("mean"), variance.alias("var"), F.sqrt(F.when(F.col("tn") > 1, variance * count / (count - 1))).alias("std"),
        (F.col("__at") + batch_mean).alias("batch_mean"), F.sqrt(F.when(F.col("n") > 1, spread / (F.col("n") - 1))).alias("batch_std"))


def adaptive_kl_coef(iterations: DataFrame, run: str, iteration: str, initial: float, target: float, horizon: float) -> DataFrame:
    """The coefficient in force at each iteration: all earlier updates multiplied.

    `kl` and `n_steps` are the measured KL and the steps of an iteration. An update may be zero or
    negative, so sizes are added as logarithms, and signs and zeros are counted.
    """
    error = F.greatest(F.least(F.col("kl") / target - 1, F.lit(KL_CLIP)), F.lit(-KL_CLIP))
    factor = 1 + error * F.col("n_steps") / horizon
    parts = iterations.withColumn("__f", factor)
    parts = parts.withColumns({
        "__log": F.when(F.col("__f") != 0, F.log(F.abs("__f"))).otherwise(0.0), "__neg": (F.col("__f") < 0).cast("int"), "__zero": (F.col("__f") == 0).cast("int")})
    total = running(parts, [run], iteration, {f"__t{c}": ("sum", f"__{c}") for c in ("log", "neg", "zero")}, hot=False)  # one row per iteration
    sign = F.when(F.pmod(F.col("__tneg") - F.col("__neg"), F.lit(2)) == 1, -1.0).otherwise(1.0)
    before = F.when(F.col("__tzero") - F.col("__zero") > 0, 0.0).otherwise(initial * sign * F.exp(F.col("__tlog") - F.col("__log")))
    return total.withColumn("kl_coef", before).drop("__f", "__log", "__neg", "__zero", "__tlog", "__tneg", "__tzero")


def fixed_kl_coef(iterations: DataFrame, value: float) -> DataFrame:
    return iterations.withColumn("kl_coef", F.lit(float(value)))


def accumulate_moments(stream: DataFrame, keys: list[str], value: str, table: str, progress: str, trigger: dict | None = None):
    """Store the moments of each micro-batch; `episode_metrics` and `running_moments` merge them.

    `trigger` is what `DataStreamWriter.trigger` takes, such as {"processingTime": "1 minute"}; by default
    the job reads what is there and stops. How much a micro-batch reads is an option of the source (maxFilesPerTrigger).
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        moments(batch, keys, value).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", progress).trigger(**(trigger or NOW)).start()


def episode_metrics(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per iteration from the stored partial moments, whatever way the batches cut it."""
    total = _around(stored, keys).groupBy(*keys).agg(F.sum("n").alias("episodes"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("__at").alias("__at"))
    mean = F.col("s") / F.col("episodes")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("episodes") - mean * mean, F.lit(0.0)))
    return total.select(*keys, "episodes", (F.col("__at") + mean).alias("score_mean"), std.alias("score_std"))


def dedupe_requests(stream: DataFrame, text: str, table: str, progress: str, event_time: str | None = None, delay: str = "1 hour", trigger: dict | None = None):
    """Append each distinct request once, across micro-batches and restarts.

    Without event time the state keeps one digest per request for ever; with it
    repeats are only remembered within the watermark.
    """
    keyed = stream.withColumn("query_hash", F.sha2(text, 256))
    if event_time is None:
        unique = keyed.dropDuplicates(["query_hash"])
    else:
        unique = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["query_hash"])
    return unique.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress).outputMode("append").trigger(**(trigger or NOW)).start()
