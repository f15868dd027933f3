"""Statistics and objective diagnostics over logged token log-probabilities.

Input rows are tokens: episode_id, t, is_action, actor_lp (logged), new_lp
(current), ref_lp, value, advantage, score, batch_id. All results are sums,
counts and moments, so they combine on the map side; no episode is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.skew import with_group_stats

EPISODE = "episode_id"
CLOSE_TO_ZERO = 1e-8


def kl(logprob: Column, ref: Column, kind: str = "kl", total: Column | None = None) -> Column:
    """Per-token KL estimates; `total` is the sequence sum of ref - logprob for the last kind."""
    diff = ref - logprob
    if kind == "kl":
        return logprob - ref
    if kind == "abs":
        return F.abs(logprob - ref)
    if kind == "mse":
        return 0.5 * (logprob - ref) * (logprob - ref)
    if kind == "control_variate":
        return F.exp(diff) - diff - 1
    if kind == "seq_control_variate":
        return F.exp(total) - diff - 1
    raise ValueError(f"unknown KL estimate {kind}")


def action(x: Column) -> Column:
    """x on action tokens, null elsewhere: the mask of every mean below."""
    return F.when(F.col("is_action"), x)


def rate(condition: Column) -> Column:
    return F.avg(action(condition.cast("double")))


def last_token_value(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(EPISODE).agg(F.max_by("value", "t").alias("last_value"))


def per_episode(tokens: DataFrame) -> DataFrame:
    """One row of mergeable sums per episode: the base of all episode metrics."""
    a, r = F.col("actor_lp"), F.col("ref_lp")
    return tokens.groupBy(EPISODE).agg(
        F.max_by("score", "t").alias("score"),
        F.count_if("is_action").alias("response_len"),
        F.count(F.lit(1)).alias("len"),
        F.sum(action(a)).alias("actor_sum"),
        F.sum(action(r)).alias("ref_sum"),
        F.sum(kl(a, r)).alias("kl_sum"),
        F.sum(kl(a, r, "control_variate")).alias("cv_sum"),
        F.sum(action(kl(a, r))).alias("kl_action_sum"),
        F.count("value").alias("value_n"),
        F.avg("value").alias("value_mean"),
        F.var_pop("value").alias("value_var"),
        F.max_by("value", "t").alias("value_last"),
    )


def reward_distribution(tokens: DataFrame) -> DataFrame:
    return per_episode(tokens).agg(
        F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
        F.avg("response_len").alias("response_len_mean"), F.stddev_pop("response_len").alias("response_len_std"),
    )


def seq_logprob_stats(tokens: DataFrame) -> DataFrame:
    return per_episode(tokens).where("response_len > 0").agg(
        F.avg("actor_sum").alias("actor_logprob_sum"), F.avg(F.col("actor_sum") / F.col("response_len")).alias("actor_logprob_per_token"),
        F.avg("ref_sum").alias("ref_logprob_sum"), F.avg(F.col("ref_sum") / F.col("response_len")).alias("ref_logprob_per_token"),
    )


def episode_kl_stats(tokens: DataFrame) -> DataFrame:
    """KL over all positions of the episode, the query included."""
    return per_episode(tokens).agg(
        F.avg("kl_sum").alias("kl_mean"), F.avg("cv_sum").alias("control_variate_mean"),
        F.avg(F.col("kl_sum") / F.col("len")).alias("kl_per_token"), F.avg(F.col("cv_sum") / F.col("len")).alias("control_variate_per_token"),
    )


def critic_value_stats(tokens: DataFrame) -> DataFrame:
    """Mean and deviation of the values from the last query token to the second last position.

    The last token is taken out of the moments of its episode (a step of Welford's recurrence backwards) instead of out
    of the rows. Moments of episodes are put together by the squared distances of their means from the overall mean, so
    values far from zero lose no digits. Missing values count in `n` alone.
    """
    count, mean, last = F.col("value_n"), F.col("value_mean"), F.col("value_last")
    rest = F.when(last.isNull(), count).otherwise(count - 1)
    rest_mean = F.when(last.isNull(), mean).otherwise(mean - (last - mean) / F.when(rest > 0, rest))
    rest_m2 = F.when(last.isNull(), count * F.col("value_var")).otherwise(F.greatest(count * F.col("value_var") - (last - mean) * (last - rest_mean), F.lit(0.0)))
    episodes = per_episode(tokens).select((F.col("len") - 1).alias("positions"), rest.alias("n"), rest_mean.alias("mean"), F.when(rest > 0, rest_m2).alias("m2"))
    overall = episodes.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).scalar()
    apart = F.col("mean") - overall
    variance = F.sum(F.col("m2") + F.col("n") * apart * apart) / F.sum("n")
    return episodes.agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("value_mean"), F.sqrt(variance).alias("value_std"), F.sum("positions").alias("n"))


def pair_sums(tokens: DataFrame, accept: Column, pair: Column, actor: str = "new_lp") -> DataFrame:
    """Both sides of each pair in one aggregation; pairs with a missing side are left out."""
    sides = {"accept": accept, "reject": ~accept}
    aggs = []
    for name, side in sides.items():
        aggs += [
            F.count_if(side).alias(f"{name}_rows"),
            F.count_if(side & F.col("is_action")).alias(f"{name}_len"),
            F.sum(F.when(side & F.col("is_action"), F.col(actor)).otherwise(0.0)).alias(f"{name}_lp"),
            F.sum(F.when(side & F.col("is_action"), F.col("ref_lp")).otherwise(0.0)).alias(f"{name}_ref"),
            F.sum(F.when(side & F.col("is_action"), kl(F.col(actor), F.col("ref_lp"))).otherwise(0.0)).alias(f"{name}_kl"),
            F.max_by(F.when(side, F.col("value")), F.when(side, F.col("t"))).alias(f"{name}_value"),
        ]
    return tokens.groupBy(pair.alias("pair_id")).agg(*aggs).where("accept_rows > 0 and reject_rows > 0")


def pair_episode_metrics(pairs: DataFrame) -> DataFrame:
    both = (F.col("accept_kl") + F.col("reject_kl")) / 2
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.avg(f"{s}_{m}").alias(f"{s}_{m}") for s in ("accept", "reject") for m in ("len", "lp", "ref", "kl")],
        F.avg(both).alias("kl_mean"),
    )


def dpo_positive_diagnostics(pairs: DataFrame, beta: float, lam: float, smoothing: float = 0.0) -> DataFrame:
    chosen, rejected, chosen_ref, rejected_ref = (F.col(c) for c in ("accept_lp", "reject_lp", "accept_ref", "reject_ref"))
    logits = (chosen - rejected) - (chosen_ref - rejected_ref) - lam * F.greatest(F.lit(0.0), chosen_ref - chosen)
    loss = softplus(-beta * logits) * (1 - smoothing) + softplus(beta * logits) * smoothing
    return pairs.agg(
        F.avg(loss).alias("loss"),
        F.avg((chosen > rejected).cast("double")).alias("actor_ahr"),
        F.avg((chosen_ref > rejected_ref).cast("double")).alias("ref_ahr"),
        F.avg(chosen - chosen_ref).alias("accept_rewards"),
        F.avg(rejected - rejected_ref).alias("reject_rewards"),
    )


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) = -log(sigmoid(-x)), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pairwise_reward_loss(pairs: DataFrame) -> DataFrame:
    gap = F.col("accept_value") - F.col("reject_value")
    return pairs.agg(F.avg(-F.log(1 / (1 + F.exp(-gap)) + 1e-5)).alias("loss"), F.avg((gap > 0).cast("double")).alias("accuracy"))


def binary_logit_loss(rows: DataFrame, logit: Column, target: Column) -> DataFrame:
    loss = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    return rows.where(target.isNotNull()).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("rows"))


def ppo_clip_diagnostics(tokens: DataFrame, clip: float, ratio_threshold: float) -> DataFrame:
    diff = F.col("new_lp") - F.col("actor_lp")
    ratio = F.exp(F.when(F.col("is_action"), diff).otherwise(0.0))
    plain = -F.col("advantage") * ratio
    clipped = -F.col("advantage") * F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip))
    stats = tokens.groupBy("batch_id").agg(
        F.avg(action(F.greatest(plain, clipped))).alias("pg_loss"),
        rate(clipped > plain).alias("clip_frac"),
        (0.5 * F.avg(action(diff * diff))).alias("approx_kl"),
        F.avg(action(-diff)).alias("policy_kl"),
        F.avg(action(ratio)).alias("ratio"),
    )
    return stats.withColumn("is_skipped", F.col("ratio") > ratio_threshold)


def kl_loss_term(tokens: DataFrame, beta: float, low: float, high: float) -> DataFrame:
    masked = F.when(F.col("is_action"), kl(F.col("new_lp"), F.col("ref_lp"))).otherwise(0.0)
    bounded = F.greatest(F.least(masked, F.lit(high)), F.lit(low))
    episodes = tokens.groupBy("batch_id", EPISODE).agg(F.sum(bounded).alias("s"))
    return episodes.groupBy("batch_id").agg((beta * F.avg("s")).alias("ref_kl_loss"))


def value_clip_diagnostics(tokens: DataFrame, new_value: Column, returns: Column, clip: float) -> DataFrame:
    old = F.col("value")
    bounded = F.greatest(F.least(new_value, old + clip), old - clip)
    plain, clipped = F.pow(new_value - returns, 2), F.pow(bounded - returns, 2)
    return tokens.groupBy("batch_id").agg(
        (0.5 * F.avg(action(F.greatest(plain, clipped)))).alias("vf_loss"),
        F.avg(action(plain)).alias("mse"),
        rate(clipped > plain).alias("clip_frac"),
        F.avg(action(new_value)).alias("value"),
    )


def advantage_weighted_nll(tokens: DataFrame, advantage: str = "advantage", upscale: bool = False) -> DataFrame:
    """The three reductions of token loss times advantage, per batch."""
    weighted = F.when(F.col("is_action"), -F.col("new_lp") * F.col(advantage)).otherwise(0.0)
    episodes = tokens.groupBy("batch_id", EPISODE).agg(
        F.sum(weighted).alias("s"), F.count_if("is_action").alias("n"), F.sum(action(F.col(advantage))).alias("a")
    )
    if upscale:  # the mean advantage of an episode becomes 1; the scale is one factor per episode
        episodes = episodes.withColumn("s", F.col("s") * F.col("n") / F.when(F.col("a") != 0, F.col("a")))
    return episodes.groupBy("batch_id").agg(
        (F.sum("s") / F.sum("n")).alias("total_tokens"),
        (F.sum(F.col("s") / F.when(F.col("n") > 0, F.col("n"))) / F.count(F.lit(1))).alias("per_instance"),
        (F.sum("s") / F.count(F.lit(1))).alias("per_batch"),
    )


def token_rewards(tokens: DataFrame, beta: float) -> DataFrame:
    """-beta * KL on every action token, plus the score on the last one."""
    marked = with_group_stats(tokens, [EPISODE], {"__last": F.max("t")})
    bonus = F.when(F.col("t") == F.col("__last"), F.col("score")).otherwise(0.0)
    non_score = -beta * kl(F.col("actor_lp"), F.col("ref_lp"))
    return marked.where("is_action").withColumns({"non_score_reward": non_score, "reward": non_score + bonus}).drop("__last")


def batch_step_metrics(rewarded: DataFrame) -> DataFrame:
    """Per batch, over action tokens with their rewards; `returns` are advantage + value.

    One aggregation with merging moments; the distinct episodes of a batch, which the mean of the episodes' KL divides
    by, make Spark group partially by episode first. The deviation of a single token is 0.
    """
    k = kl(F.col("actor_lp"), F.col("ref_lp"))
    return rewarded.groupBy("batch_id").agg(
        F.avg("advantage").alias("advantage_mean"), F.coalesce(F.stddev_samp("advantage"), F.lit(0.0)).alias("advantage_std"),
        F.avg((F.abs("advantage") < CLOSE_TO_ZERO).cast("double")).alias("advantage_close_to_zero"), F.avg("reward").alias("reward_mean"),
        F.count(F.lit(1)).alias("num_tokens"), F.avg(F.col("advantage") + F.col("value")).alias("return_mean"),
        (F.sum(k) / F.count_distinct(F.when(k.isNotNull(), F.col(EPISODE)))).alias("kl_mean"))


def token_weighted_metrics(step_metrics: DataFrame, interval: Column, weighted: list[str], plain: list[str], tokens: str = "num_tokens") -> DataFrame:
    """Merge step metrics per logging interval: some weighted by tokens, the rest by steps."""
    w = F.sum(tokens)
    return step_metrics.groupBy(interval.alias("interval")).agg(
        *[(F.sum(F.col(m) * F.col(tokens)) / w).alias(m) for m in weighted], *[F.avg(m).alias(m) for m in plain], F.count(F.lit(1)).alias("steps")
    )


def kl_with_reference(tokens: DataFrame) -> DataFrame:
    return per_episode(tokens).agg(F.avg(F.coalesce("kl_action_sum", F.lit(0.0))).alias("kl_with_reference"), F.count(F.lit(1)).alias("episodes"))


def masked_mean_var(df: DataFrame, x: Column, mask: Column, unbiased: bool = True) -> DataFrame:
    """Mean and variance under a mask; an empty mask raises."""
    masked = F.when(mask, x)
    n = F.count(masked)
    variance = F.var_samp(masked) if unbiased else F.var_pop(masked)
    checked = F.when(n == 0, F.raise_error(F.lit("the mask selects no rows")).cast("double")).otherwise(F.avg(masked))
    return df.agg(checked.alias("mean"), variance.alias("variance"), n.alias("n"))


def tensor_anomalies(df: DataFrame, x: Column, mask: Column, z_threshold: float = 3.0, finite_only: bool = False) -> DataFrame:
    """Counts of NaN, infinite and far-off values under a mask.

    With NaN or infinite values the moments are undefined and no z-score
    counts, unless `finite_only` takes them from the finite values.
    """
    infinite = F.abs(x) == float("inf")
    base = F.when(mask & ~F.isnan(x) & ~infinite, x) if finite_only else F.when(mask, x)
    stats = df.agg(F.struct(F.avg(base).alias("mean"), F.stddev_pop(base).alias("std")).alias("s")).scalar()
    std = stats.getField("std")
    usable = std.isNotNull() & (std != 0) & ~F.isnan(std)
    far = usable & ~F.isnan(x) & ~infinite & (F.abs((x - stats.getField("mean")) / std) > z_threshold)
    counted = df.agg(
        F.count_if(mask & F.isnan(x)).alias("num_nan"), F.count_if(mask & infinite).alias("num_inf"), F.count_if(mask & F.coalesce(far, F.lit(False))).alias("num_high_z"))
    return counted.withColumn("total_anomalies", F.col("num_nan") + F.col("num_inf") + F.col("num_high_z"))


def close_to_zero_fraction(df: DataFrame, x: Column, mask: Column, eps: float = CLOSE_TO_ZERO) -> DataFrame:
    return df.agg(F.avg(F.when(mask, (F.abs(x) < eps).cast("double"))).alias("close_to_zero"))
