"""Checkpoint names and the choice among checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.skew import neighbour, rank_in_group

# Fixed value: the directory name of a checkpoint.
NAME = r"^ckpt--iter_(\d+)--epoch_(\d+)--step_(\d+)$"


def parse_names(df: DataFrame, name: str = "name") -> DataFrame:
    """The numbers of each name; null for a name of another form."""
    return df.withColumns({c: F.regexp_extract(name, NAME, g).try_cast("bigint") for g, c in enumerate(["p_iter", "p_epoch", "p_step"], 1)})


def last_checkpoint(df: DataFrame, name: str = "name") -> DataFrame:
    return parse_names(df, name).where("p_iter is not null").agg(F.max_by(name, F.struct("p_iter", "p_epoch", "p_step")).alias("last_name"))


def every_nth_keep_last(df: DataFrame, n: int, name: str = "name") -> DataFrame:
    """Each n-th checkpoint in the order of its parsed name, and always the last; names of another form are no checkpoints."""
    parsed = parse_names(df, name).where("p_iter is not null")
    size = parsed.count()
    ranked = rank_in_group(parsed, [], [F.col(c) for c in ("p_iter", "p_epoch", "p_step", name)], "pos", hot=True)
    return ranked.where((F.col("pos") % n == 0) | (F.col("pos") == size - 1))


def early_stop(df: DataFrame) -> DataFrame:
    """Per iteration: the last checkpoint before accuracy first fails to rise."""
    key = ["iteration"]
    ranked = rank_in_group(df, key, [F.col("step")], "__pos")
    ranked = neighbour(ranked, key, "__pos", {"__prev": "accuracy"}, offset=-1)
    failed_at = F.when(F.col("accuracy") <= F.col("__prev"), F.col("step"))
    first_fail = ranked.groupBy(*key).agg(F.min(failed_at).alias("__stop"))
    before = ranked.join(first_fail, key).where(F.col("__stop").isNull() | (F.col("step") < F.col("__stop")))
    return before.groupBy(*key).agg(F.max_by("name", "step").alias("name"), F.max("step").alias("step"))


def choose_best(df: DataFrame) -> DataFrame:
    """Per iteration: the first checkpoint of maximal accuracy."""
    best = F.max_by(F.struct("name", "step", "accuracy"), F.struct(F.col("accuracy"), -F.col("step")))
    return df.groupBy("iteration").agg(best.alias("b")).select("iteration", "b.*")


def chosen_per_iteration(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("iteration").agg(F.count("name").alias("chosen")).withColumn("ok", F.col("chosen") == 1)
