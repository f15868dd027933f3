"""Per-question and macro-averaged evaluation of rollouts.

Everything is a tree of mergeable aggregates, first by (question, answer) and
then by question, so a question with a third of all rollouts is combined on the
map side and never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.grading import grade_exact, wald_ci_length
from sparkroll.skew import running

QUESTION = "question_id"


def answer_counts(rollouts: DataFrame, correct: Column | None = None, question: str = QUESTION) -> DataFrame:
    """One row per (question, answer): size, first position, grade of the first, number correct."""
    graded = rollouts.withColumn("__ok", grade_exact(F.col("answer"), F.col("gold")) if correct is None else correct)
    return graded.groupBy(question, "answer").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rollout_idx").alias("first_idx"),
        F.min_by("__ok", "rollout_idx").alias("first_ok"),
        F.sum(F.col("__ok").cast("bigint")).alias("n_ok"),
    )


def majority_vote(rollouts: DataFrame, correct: Column | None = None) -> DataFrame:
    """The most frequent answer, null included; a tie goes to the answer seen first."""
    best = F.struct(F.col("n"), -F.col("first_idx"))
    won = F.max_by(F.struct("answer", "n", "first_ok"), best).alias("won")
    return answer_counts(rollouts, correct).groupBy(QUESTION).agg(won).select(
        QUESTION,
        F.col("won.answer").alias("majority_answer"),
        F.col("won.n").alias("votes"),
        F.col("won.first_ok").alias("is_correct"),
    )


def question_performance(rollouts: DataFrame, correct: Column | None = None) -> DataFrame:
    total = F.sum("n")
    return answer_counts(rollouts, correct).groupBy(QUESTION).agg(
        F.max((F.col("n_ok") > 0).cast("double")).alias("once_hit"),
        (F.sum("n_ok") / total).alias("correct_frac"),
        F.max_by(F.col("first_ok").cast("double"), F.struct(F.col("n"), -F.col("first_idx"))).alias("majority_vote_acc"),
        F.count(F.lit(1)).cast("double").alias("unique_answer_count"),
        (F.sum(F.when(F.col("answer").isNull(), F.col("n")).otherwise(0)) / total).alias("none_answer_extracted_frac"),
    )


def eval_task_performance(rollouts: DataFrame, correct: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro averages over questions, with the two alias metrics."""
    metrics = ["once_hit", "correct_frac", "majority_vote_acc", "unique_answer_count", "none_answer_extracted_frac"]
    means = question_performance(rollouts, correct).groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.withColumns({"exact_match": F.col("once_hit"), "exact_match_frac": F.col("correct_frac")})


def once_hit_rate(rewarded: DataFrame, threshold: float | None = None) -> DataFrame:
    """Share of questions with a reward of exactly 1, or above `threshold` where pairs are built."""
    hit = F.col("reward") == 1.0 if threshold is None else F.col("reward") > threshold
    return rewarded.groupBy(QUESTION).agg(F.max(hit.cast("double")).alias("hit")).agg(
        F.avg("hit").alias("once_hit_rate"), F.count(F.lit(1)).alias("questions")
    )


def unique_response_count(rollouts: DataFrame, response: str) -> DataFrame:
    """Distinct responses of each question that has more than one response."""
    sizes = rollouts.groupBy(QUESTION, response).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(QUESTION).agg(
        F.count(response).alias("unique_responses"), F.sum("n").alias("responses")
    ).where(F.col("responses") > 1)


def mc_value(requests: DataFrame, rollouts: DataFrame, penalty: float = 0.0, key: str = QUESTION) -> DataFrame:
    """Mean reward of the rollouts of each request, 0.0 where there are none."""
    scored = F.when(F.col("finish_reason") == "length", float(penalty)).otherwise(F.col("reward"))
    means = rollouts.groupBy(key).agg(F.avg(scored).alias("__value"), F.count(F.lit(1)).alias("__n"))
    return requests.join(means, key, "left").select(
        *requests.columns,
        F.coalesce("__value", F.lit(0.0)).alias("value"),
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("num_rollouts"),
    )


def mc_rollout_metrics(rollouts: DataFrame) -> DataFrame:
    """Means over requests; the reward spread counts only requests with more than one rollout."""
    n = F.count(F.lit(1))
    answers = F.count_distinct("answer") + F.max(F.col("answer").isNull().cast("int"))
    per_request = rollouts.groupBy(QUESTION).agg(
        n.alias("n"), (F.count_if(F.col("finish_reason") == "length") / n).alias("trunc"), (answers / n).alias("unique"),
        F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("std"))
    mean, std = F.col("mean"), F.col("std")
    length = wald_ci_length(mean, F.col("n"))  # undefined where rewards leave [0, 1]
    return per_request.agg(
        F.avg("trunc").alias("mc_roll_trunc_frac"),
        F.avg("n").alias("mc_avg_num_rolls"),
        F.avg("unique").alias("mc_avg_unique_rolls_frac"),
        F.avg(F.when(F.col("n") > 1, std)).alias("mc_roll_std"),
        F.avg(F.when(~F.isnan(length), length)).alias("mc_ci_length"),
    )


def ci_stopping_point(rewarded: DataFrame, initial: int, step: int, maximum: int, max_length: float) -> DataFrame:
    """How many rollouts each state needs until its confidence interval is short enough.

    Counts on the schedule initial, initial + step, ... up to the maximum are
    tried in order. A state that runs out of rollouts stops at what it has.
    """
    used = running(rewarded.where(F.col("rollout_idx") < maximum), [QUESTION], "rollout_idx", {"__s": ("sum", "reward")}, hot=False)
    n = F.col("rollout_idx") + 1
    length = wald_ci_length(F.col("__s") / n, n)
    scheduled = (n >= initial) & (((n - initial) % step == 0) | (n == maximum))
    # an undefined length is not above the limit, so it stops the sampling
    stops = scheduled & (F.isnan(length) | (length <= max_length))
    return used.groupBy(QUESTION).agg(
        F.coalesce(F.min(F.when(stops, n)), F.max(n)).cast("bigint").alias("rollouts_needed"),
        F.max(stops).alias("converged"),
    )


def episode_generation_metrics(rollouts: DataFrame) -> DataFrame:
    """Rates of unfinished, empty and unparsable rollouts and the spread of the step counts."""
    steps = F.when(~F.col("parse_failed"), F.col("num_steps"))
    return rollouts.agg(
        F.avg(F.col("is_unfinished").cast("double")).alias("is_unfinished_response"),
        F.avg(F.col("is_empty").cast("double")).alias("empty_response"),
        F.avg(F.col("parse_failed").cast("double")).alias("parse_failed"),
        F.avg(steps).alias("num_reasoning_steps_mean"),
        F.max(steps).alias("num_reasoning_steps_max"),
        F.min(steps).alias("num_reasoning_steps_min"),
    )


def step_count_distribution(rollouts: DataFrame) -> DataFrame:
    """The step counts as a histogram: one row per count instead of a list."""
    return rollouts.where(~F.col("parse_failed")).groupBy("num_steps").agg(F.count(F.lit(1)).alias("episodes"))
