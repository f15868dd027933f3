"""Step and token credit: rewards, value filling, advantages, GAE, whitening.

Rows are steps or tokens with a dense position inside their trajectory, so a
trajectory of any length is a scan over (trajectory, position), never an array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroll.skew import SLICE_ROWS, has_hot_group, neighbour, running, same_keys, with_group_stats

CHAR_BUCKET = 256
TRAJ = ["traj_id"]


def step_rewards(steps: DataFrame, score: Column, unfinished: Column, penalty: float) -> DataFrame:
    """0 for every step but the last, which gets the score, or the penalty if unfinished."""
    last = F.col("step_idx") == F.col("num_steps") - 1
    return steps.withColumn("reward", F.when(last, F.when(unfinished, float(penalty)).otherwise(score)).otherwise(0.0))


def fill_missing_values_tail(steps: DataFrame, hot: bool | None = None) -> DataFrame:
    """Missing trailing values become the rewards still to come; a gap before a known value stays null."""
    if hot is None:
        hot = has_hot_group(steps, TRAJ)
    known = F.max(F.when(F.col("value_est").isNotNull(), F.col("step_idx")))
    marked = with_group_stats(steps, TRAJ, {"__known": known}, hot)
    summed = running(marked, TRAJ, "step_idx", {"__to_come": ("sum", "step_reward")}, reverse=True, hot=hot)
    tail = F.col("step_idx") > F.coalesce("__known", F.lit(-1))
    return summed.withColumn("value", F.when(tail, F.col("__to_come")).otherwise(F.col("value_est"))).drop("__known", "__to_come")


def mc_step_advantage(filled: DataFrame, hot: bool | None = None) -> DataFrame:
    """A_i = r_i + V_(i+1) - V_i with a terminal value of 0; null where a value is missing in the middle."""
    following = neighbour(filled, TRAJ, "step_idx", {"__next": "value"}, hot=hot)
    is_last = F.col("step_idx") == F.col("num_steps") - 1
    after = F.when(is_last, 0.0).otherwise(F.col("__next"))
    return following.withColumn("advantage", F.col("step_reward") + after - F.col("value")).drop("__next")


def token_step_range_join(tokens: DataFrame, steps: DataFrame, carry: Sequence[str], bucket: int = CHAR_BUCKET) -> DataFrame:
    """Each token takes the columns `carry` of the step whose [char_start, char_end) holds its start.

    Both sides are keyed by (trajectory, character bucket): a step is repeated
    for each bucket it overlaps, so the range test only meets the few steps of
    one bucket and a hot trajectory is spread over all its buckets.
    """
    spans = steps.where(F.col("char_end") > F.col("char_start")).select(
        F.col("traj_id").alias("__traj"), F.col("char_start").alias("__from"), F.col("char_end").alias("__to"), *carry,
        F.explode(F.sequence(F.floor(F.col("char_start") / bucket), F.floor((F.col("char_end") - 1) / bucket))).alias("__bucket"),
    )
    inside = (F.col("tok_start") >= F.col("__from")) & (F.col("tok_start") < F.col("__to"))
    here = (F.col("traj_id") == F.col("__traj")) & (F.floor(F.col("tok_start") / bucket) == F.col("__bucket"))
    return tokens.join(spans, here & inside).drop("__traj", "__from", "__to", "__bucket")


def mc_token_advantage(tokens: DataFrame, steps: DataFrame) -> DataFrame:
    """Step advantages on their tokens, and one end-of-text row that copies the last one."""
    on_tokens = token_step_range_join(tokens, steps.select("traj_id", "char_start", "char_end", "advantage"), ["advantage"])
    body = on_tokens.select("traj_id", "tok_start", "advantage", F.lit(False).alias("is_eos"))
    ends = body.groupBy("traj_id").agg(F.max_by("advantage", "tok_start").alias("advantage"), F.max("tok_start").alias("tok_start"))
    eos = ends.select("traj_id", (F.col("tok_start") + 1).alias("tok_start"), "advantage", F.lit(True).alias("is_eos"))
    return body.unionByName(eos)


def discounted_suffix_sum(
    df: DataFrame, keys: Sequence[str], pos: str, term: str, discount: float, name: str, slice_rows: int | None = None, depth: int = 0
) -> DataFrame:
    """S_t = term_t + discount * S_(t+1) along a dense position.

    Slices are short enough that powers of the discount neither vanish nor grow
    out of range. Slice totals form the same recurrence one level up, so a
    position of any length needs a logarithmic number of levels.
    """
    keys = list(keys)
    if discount == 0.0:
        return df.withColumn(name, F.col(term))
    width = slice_rows or SLICE_ROWS
    magnitude = abs(math.log10(abs(discount)))
    if magnitude > 0:
        width = max(2, min(width, 256, int(250 / magnitude)))
    top = df.agg(F.max(pos)).first()[0]
    if top is None or top < width:
        return _short_suffix_sum(df, keys, pos, F.col(pos), term, discount, name)
    cut, inside, total, above = (f"__{c}{depth}" for c in ("slice", "in", "total", "above"))
    sliced = df.withColumns({cut: F.floor(F.col(pos) / width), inside: F.pmod(F.col(pos), F.lit(width))})
    totals = sliced.groupBy(*keys, cut).agg(F.sum(F.pow(F.lit(discount), F.col(inside)) * F.col(term)).alias(total))
    later = discounted_suffix_sum(totals, keys, cut, total, discount**width, above, slice_rows, depth + 1)
    local = _short_suffix_sum(sliced, [*keys, cut], inside, F.col(inside), term, discount, name)
    carry = later.select(*keys, (F.col(cut) - 1).alias(cut), above)
    joined = same_keys(local, carry, [*keys, cut])
    rest = F.pow(F.lit(discount), F.lit(width) - F.col(inside)) * F.coalesce(above, F.lit(0.0))
    return joined.withColumn(name, F.col(name) + rest).drop(cut, inside, above)


def _short_suffix_sum(df: DataFrame, keys: list[str], pos: str, exponent: Column, term: str, discount: float, name: str) -> DataFrame:
    weight = F.pow(F.lit(discount), exponent)
    later = Window.partitionBy(*keys).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(weight * F.col(term)).over(later) / weight)


def gae(df: DataFrame, keys: Sequence[str], pos: str, value: str, reward: str, gamma: float, lam: float, hot: bool | None = None, slice_rows: int | None = None) -> DataFrame:
    """Generalised advantage estimates and returns, with a terminal value of 0."""
    following = neighbour(df, keys, pos, {"__next": value}, hot=hot)
    delta = F.col(reward) + gamma * F.coalesce("__next", F.lit(0.0)) - F.col(value)
    scanned = discounted_suffix_sum(following.withColumn("__delta", delta), keys, pos, "__delta", gamma * lam, "gae_advantage", slice_rows)
    return scanned.withColumn("gae_return", F.col("gae_advantage") + F.col(value)).drop("__next", "__delta")


def whiten(df: DataFrame, col: str, name: str, mask: Column | None = None, shift_mean: bool = True, unbiased: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with statistics over all masked rows; optionally the mean is put back."""
    stats = _moments(df, col, mask, unbiased)
    scaled = (F.col(col) - stats.getField("mean")) / F.sqrt(stats.getField("var") + 1e-8)
    return df.withColumn(name, scaled if shift_mean else scaled + stats.getField("mean"))


def rescale_by_std(df: DataFrame, col: str, name: str, mask: Column | None = None, unbiased: bool = False) -> DataFrame:
    stats = _moments(df, col, mask, unbiased)
    return df.withColumn(name, F.col(col) / F.sqrt(stats.getField("var") + 1e-8))


def _moments(df: DataFrame, col: str, mask: Column | None, unbiased: bool) -> Column:
    """Mean and variance of the masked rows as a one-row scalar subquery."""
    x = F.col(col) if mask is None else F.when(mask, F.col(col))
    variance = F.var_samp(x) if unbiased else F.var_pop(x)
    return df.agg(F.struct(F.avg(x).alias("mean"), variance.alias("var")).alias("stats")).scalar()


def score_normalize_clip(scores: DataFrame, col: str, name: str, shift: bool = True, scale: bool = True, clip: float | None = None) -> DataFrame:
    """Batch mean and sample deviation of the scores, then a symmetric clip."""
    x = F.col(col)
    if scale:
        stats = _moments(scores, col, None, unbiased=True)
        float32_eps = 1.1920928955078125e-07
        x = (x - stats.getField("mean") if shift else x) / (F.sqrt(stats.getField("var")) + float32_eps)
    if clip is not None:
        x = F.greatest(F.least(x, F.lit(float(clip))), F.lit(-float(clip)))
    return scores.withColumn(name, x)


def step_boundaries(token_steps: DataFrame, keys: Sequence[str], pos: str, step: str, hot: bool | None = None) -> DataFrame:
    """The last token of every run of equal step ids."""
    following = neighbour(token_steps, keys, pos, {"__next": step}, hot=hot)
    return following.where(F.col("__next").isNull() | (F.col("__next") != F.col(step))).drop("__next")
