"""Log-probability, objective and vector queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r4
from sparkroll.operators import credit, vectors
from sparkroll.operators import logprobs as lp


def rounded(df, *keep, digits=4):
    return df.select(*[F.col(c) if c in keep else F.round(c, digits).alias(c) for c in df.columns])


BETA = 0.1
EP = """with e as (select episode_id, min(batch_id) as batch_id, arg_max(score, t) as score, count(*) filter (where is_action) as rl, count(*) as len, sum(actor_lp) filter (where is_action) as al,
  sum(ref_lp) filter (where is_action) as refl, sum(actor_lp - ref_lp) as kls, sum(exp(ref_lp - actor_lp) - (ref_lp - actor_lp) - 1) as cvs,
  sum(actor_lp - ref_lp) filter (where is_action) as kla, max(t) as last_t from f7 group by episode_id)
"""


@query("last_token_value", "f7", "select episode_id, arg_max(value, t) as last_value from f7 group by episode_id")
def _(spark, sf):
    return lp.last_token_value(fx.f7(spark, sf))


@query("reward_distribution", "f7", EP + "select round(avg(score), 4) as score_mean, round(stddev_pop(score), 4) as score_std, round(avg(rl::double), 4) as response_len_mean, round(stddev_pop(rl::double), 4) as response_len_std from e")
def _(spark, sf):
    return rounded(lp.reward_distribution(fx.f7(spark, sf)))


@query("seq_logprob_stats", "f7", EP + """select round(avg(al), 4) as actor_logprob_sum, round(avg(al / rl), 4) as actor_logprob_per_token,
  round(avg(refl), 4) as ref_logprob_sum, round(avg(refl / rl), 4) as ref_logprob_per_token from e where rl > 0""")
def _(spark, sf):
    return rounded(lp.seq_logprob_stats(fx.f7(spark, sf)))


@query("episode_kl_stats", "f7", EP + """select round(avg(kls), 4) as kl_mean, round(avg(cvs), 4) as control_variate_mean, round(avg(kls / len), 4) as kl_per_token, round(avg(cvs / len), 4) as control_variate_per_token from e""")
def _(spark, sf):
    return rounded(lp.episode_kl_stats(fx.f7(spark, sf)))


@query("critic_value_stats", "f7", EP + "select round(avg(value), 4) as value_mean, round(stddev_pop(value), 4) as value_std, count(*) as n from f7 join e using (episode_id) where t < last_t")
def _(spark, sf):
    return rounded(lp.critic_value_stats(fx.f7(spark, sf)), "n")


def pair_table(spark, sf):
    return lp.pair_sums(fx.f7(spark, sf), F.col("episode_id") % 2 == 0, F.floor(F.col("episode_id") / 2))


PAIRS = """with s as (select episode_id // 2 as pair_id, episode_id % 2 = 0 as acc, count(*) filter (where is_action) as n, coalesce(sum(new_lp) filter (where is_action), 0) as lp,
  coalesce(sum(ref_lp) filter (where is_action), 0) as ref, coalesce(sum(new_lp - ref_lp) filter (where is_action), 0) as kl, arg_max(value, t) as v from f7 group by episode_id),
p as (select a.n as an, a.lp as alp, a.ref as aref, a.kl as akl, a.v as av, r.n as rn, r.lp as rlp, r.ref as rref, r.kl as rkl, r.v as rv
  from s a join s r on a.pair_id = r.pair_id and a.acc and not r.acc)
"""


@query("pair_episode_metrics", "f7", PAIRS + """select count(*) as pairs, round(avg(an::double), 4) as accept_len, round(avg(alp), 4) as accept_lp, round(avg(aref), 4) as accept_ref, round(avg(akl), 4) as accept_kl,
  round(avg(rn::double), 4) as reject_len, round(avg(rlp), 4) as reject_lp, round(avg(rref), 4) as reject_ref, round(avg(rkl), 4) as reject_kl, round(avg((akl + rkl) / 2), 4) as kl_mean from p""")
def _(spark, sf):
    return rounded(lp.pair_episode_metrics(pair_table(spark, sf)), "pairs")


@query("dpo_positive_diagnostics", "f7", PAIRS + """, l as (select *, (alp - rlp) - (aref - rref) - 0.5::double * greatest(0, aref - alp) as z from p)
select round(avg((greatest(-0.3::double * z, 0) + ln(1 + exp(-abs(0.3::double * z)))) * 0.9::double + (greatest(0.3::double * z, 0) + ln(1 + exp(-abs(0.3::double * z)))) * 0.1::double), 4) as loss,
  round(avg((alp > rlp)::int::double), 4) as actor_ahr, round(avg((aref > rref)::int::double), 4) as ref_ahr, round(avg(alp - aref), 4) as accept_rewards, round(avg(rlp - rref), 4) as reject_rewards from l""")
def _(spark, sf):
    pairs = pair_table(spark, sf)
    return rounded(lp.dpo_positive_diagnostics(pairs, beta=0.3, lam=0.5, smoothing=0.1))


@query("pairwise_reward_loss", "f7", PAIRS + "select round(avg(-ln(1 / (1 + exp(-(av - rv))) + 0.00001::double)), 4) as loss, round(avg((av > rv)::int::double), 4) as accuracy from p")
def _(spark, sf):
    return rounded(lp.pairwise_reward_loss(pair_table(spark, sf)))


@query("binary_logit_loss", "f9", """with x as (select length(solution) % 11 / 2.0::double - 2 as z, target_prob as p from f9 where target_prob is not null)
select round(avg(greatest(z, 0) - z * p + ln(1 + exp(-abs(z)))), 4) as loss, count(*) as rows from x""")
def _(spark, sf):
    logit = F.length("solution") % 11 / 2.0 - 2
    return rounded(lp.binary_logit_loss(fx.f9(spark, sf), logit, F.col("target_prob")), "rows")


@query("kl_estimate", "f7", """with s as (select *, sum(ref_lp - actor_lp) over (partition by episode_id) as total from f7)
select episode_id, t, round(actor_lp - ref_lp, 4) as kl, round(abs(actor_lp - ref_lp), 4) as abs_kl, round(0.5::double * (actor_lp - ref_lp) * (actor_lp - ref_lp), 6) as mse,
  round(exp(ref_lp - actor_lp) - (ref_lp - actor_lp) - 1, 6) as control_variate, round(exp(total) - (ref_lp - actor_lp) - 1, 6) as seq_control_variate from s""")
def _(spark, sf):
    from sparkroll.skew import with_group_stats

    a, r = F.col("actor_lp"), F.col("ref_lp")
    df = with_group_stats(fx.f7(spark, sf), ["episode_id"], {"total": F.sum(r - a)})
    return df.select(
        "episode_id", "t", r4(lp.kl(a, r)).alias("kl"), r4(lp.kl(a, r, "abs")).alias("abs_kl"), F.round(lp.kl(a, r, "mse"), 6).alias("mse"),
        F.round(lp.kl(a, r, "control_variate"), 6).alias("control_variate"), F.round(lp.kl(a, r, "seq_control_variate", F.col("total")), 6).alias("seq_control_variate"))


MEANS = "with a as (select *, new_lp - actor_lp as d, exp(new_lp - actor_lp) as ratio from f7 where is_action), l as (select *, -advantage * ratio as l1, -advantage * least(greatest(ratio, 0.95::double), 1.05::double) as l2 from a)"


@query("ppo_clip_diagnostics", "f7", MEANS + """ select batch_id, round(avg(greatest(l1, l2)), 12) as pg_loss, round(avg((l2 > l1)::int::double), 12) as clip_frac, round(0.5::double * avg(d * d), 12) as approx_kl,
  round(avg(-d), 12) as policy_kl, round(avg(ratio), 12) as ratio, avg(ratio) > 0.961 as is_skipped from l group by batch_id""")
def _(spark, sf):
    return rounded(lp.ppo_clip_diagnostics(fx.f7(spark, sf), clip=0.05, ratio_threshold=0.961), "batch_id", "is_skipped", digits=12)


@query("kl_loss_term", "f7", """with s as (select batch_id, episode_id, sum(least(greatest(case when is_action then new_lp - ref_lp else 0 end, -0.05::double), 0.05::double)) as s from f7 group by batch_id, episode_id)
select batch_id, round(0.1::double * avg(s), 12) as ref_kl_loss from s group by batch_id""")
def _(spark, sf):
    return lp.kl_loss_term(fx.f7(spark, sf), BETA, -0.05, 0.05).select("batch_id", F.round("ref_kl_loss", 12).alias("ref_kl_loss"))


@query("value_clip_diagnostics", "f7", """with v as (select *, value + score * 0.3::double - 0.1::double as nv, advantage + value as ret from f7 where is_action),
c as (select *, (nv - ret) * (nv - ret) as l1, pow(least(greatest(nv, value - 0.15::double), value + 0.15::double) - ret, 2) as l2 from v)
select batch_id, round(0.5::double * avg(greatest(l1, l2)), 12) as vf_loss, round(avg(l1), 12) as mse, round(avg((l2 > l1 + 1e-9)::int::double), 12) as clip_frac, round(avg(nv), 12) as value from c group by batch_id""")
def _(spark, sf):
    new = F.col("value") + F.col("score") * 0.3 - 0.1
    return rounded(lp.value_clip_diagnostics(fx.f7(spark, sf), new, F.col("advantage") + F.col("value"), 0.15), "batch_id", digits=12)


NLL = """with e as (select batch_id, episode_id, coalesce(sum(-new_lp * {a}) filter (where is_action), 0) {s} as s, count(*) filter (where is_action) as n from f7 group by batch_id, episode_id)
select batch_id, round(sum(s) / sum(n), 12) as total_tokens, round(sum(case when n > 0 then s / n end) / count(*), 12) as per_instance, round(sum(s) / count(*), 12) as per_batch from e group by batch_id"""


@query("advantage_weighted_nll", "f7", NLL.format(a="advantage", s=""))
def _(spark, sf):
    return rounded(lp.advantage_weighted_nll(fx.f7(spark, sf)), "batch_id", digits=12)


@query("advantage_weighted_nll_upscaled", "f7", NLL.format(a="value", s="* count(*) filter (where is_action) / sum(value) filter (where is_action)"))
def _(spark, sf):
    return rounded(lp.advantage_weighted_nll(fx.f7(spark, sf), "value", upscale=True), "batch_id", digits=12)


RW = """with x as (select *, max(t) over (partition by episode_id) as last_t from f7),
r as (select *, -0.1::double * (actor_lp - ref_lp) as nsr, -0.1::double * (actor_lp - ref_lp) + case when t = last_t then score else 0 end as reward from x where is_action)
"""


@query("token_rewards", "f7", RW + "select episode_id, t, round(nsr, 5) as non_score_reward, round(reward, 5) as reward from r")
def _(spark, sf):
    df = lp.token_rewards(fx.f7(spark, sf), BETA)
    return df.select("episode_id", "t", F.round("non_score_reward", 5).alias("non_score_reward"), F.round("reward", 5).alias("reward"))


BM = RW + """, b as (select batch_id, avg(advantage) as advantage_mean, stddev_samp(advantage) as advantage_std, avg((abs(advantage) < 1e-8)::int::double) as advantage_close_to_zero,
  avg(reward) as reward_mean, count(*) as num_tokens, avg(advantage + value) as return_mean from r group by batch_id),
k as (select batch_id, avg(k) as kl_mean from (select batch_id, episode_id, sum(actor_lp - ref_lp) as k from r group by batch_id, episode_id) group by batch_id)
"""
BATCH_METRICS = ["advantage_mean", "advantage_std", "advantage_close_to_zero", "reward_mean", "return_mean", "kl_mean"]


@query("batch_step_metrics", "f7", BM + "select batch_id, num_tokens, " + ", ".join(f"round({m}, 12) as {m}" for m in BATCH_METRICS) + " from b join k using (batch_id)")
def _(spark, sf):
    return rounded(lp.batch_step_metrics(lp.token_rewards(fx.f7(spark, sf), BETA)), "batch_id", "num_tokens", digits=12)


@query("token_weighted_metrics", "f7", BM + """select batch_id // 8 as interval, round(sum(reward_mean * num_tokens) / sum(num_tokens), 12) as reward_mean, round(sum(return_mean * num_tokens) / sum(num_tokens), 12) as return_mean,
  round(avg(kl_mean), 12) as kl_mean, count(*) as steps from b join k using (batch_id) group by batch_id // 8""")
def _(spark, sf):
    steps = lp.batch_step_metrics(lp.token_rewards(fx.f7(spark, sf), BETA))
    return rounded(lp.token_weighted_metrics(steps, F.floor(F.col("batch_id") / 8), ["reward_mean", "return_mean"], ["kl_mean"]), "interval", "steps", digits=12)


@query("kl_with_reference", "f7", EP + "select round(avg(coalesce(kla, 0)), 4) as kl_with_reference, count(*) as episodes from e")
def _(spark, sf):
    return rounded(lp.kl_with_reference(fx.f7(spark, sf)), "episodes")


@query("masked_mean_var", "f7", "select round(avg(advantage), 6) as mean, round(var_samp(advantage), 6) as variance, count(*) as n from f7 where is_action")
def _(spark, sf):
    df = lp.masked_mean_var(fx.f7(spark, sf), F.col("advantage"), F.col("is_action"))
    return df.select(F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "n")


@query("tensor_anomalies", "f7", """with x as (select case when t = 5 then 'nan'::double when t = 6 then 'inf'::double else value * value * value * value end as x from f7 where is_action),
s as (select avg(x) as m, stddev_pop(x) as sd from x where x < 'inf'::double)
select count(*) filter (where isnan(x)) as num_nan, count(*) filter (where isinf(x)) as num_inf, count(*) filter (where x < 'inf'::double and abs((x - m) / sd) > 2) as num_high_z,
  count(*) filter (where isnan(x) or isinf(x) or abs((x - m) / sd) > 2) as total_anomalies from x, s""")
def _(spark, sf):
    x = F.when(F.col("t") == 5, float("nan")).when(F.col("t") == 6, float("inf")).otherwise(F.pow("value", 4))
    return lp.tensor_anomalies(fx.f7(spark, sf).withColumn("x", x), F.col("x"), F.col("is_action"), 2.0, finite_only=True)


@query("close_to_zero_fraction", "f7", "select round(avg((abs(advantage) < 1e-8)::int::double), 6) as close_to_zero from f7 where is_action")
def _(spark, sf):
    return lp.close_to_zero_fraction(fx.f7(spark, sf), F.col("advantage"), F.col("is_action")).select(F.round("close_to_zero", 6).alias("close_to_zero"))


@query("whiten", "f7", """with s as (select avg(advantage) as m, var_samp(advantage) as v from f7 where is_action)
select episode_id, t, round((advantage - m) / sqrt(v + 1e-8), 3) as whitened from f7, s where is_action""")
def _(spark, sf):
    df = credit.whiten(fx.f7(spark, sf), "advantage", "whitened", F.col("is_action"))
    return df.where("is_action").select("episode_id", "t", F.round("whitened", 3).alias("whitened"))


@query("rescale_by_std", "f7", """with s as (select var_pop(value) as v from f7 where is_action)
select episode_id, t, round(value / sqrt(v + 1e-8), 3) as rescaled from f7, s where is_action""")
def _(spark, sf):
    df = credit.rescale_by_std(fx.f7(spark, sf), "value", "rescaled", F.col("is_action"))
    return df.where("is_action").select("episode_id", "t", F.round("rescaled", 3).alias("rescaled"))


@query("score_normalize_clip", "f7", """with e as (select episode_id, sum(value) as score from f7 group by episode_id), s as (select avg(score) as m, stddev_samp(score) as sd from e)
select episode_id, round(least(greatest((score - m) / (sd + 1.1920928955078125e-07::double), -1.5::double), 1.5::double), 3) as score from e, s""")
def _(spark, sf):
    scores = fx.f7(spark, sf).groupBy("episode_id").agg(F.sum("value").alias("raw"))
    df = credit.score_normalize_clip(scores, "raw", "score", clip=1.5)
    return df.select("episode_id", F.round("score", 3).alias("score"))


@query("vector_covariance_trace", "f8", """with n as (select vec_id, least(1.0::double, 0.5::double / (sqrt(sum(x * x)) + 1e-6)) as f from f8 group by vec_id),
d as (select dim, var_pop(x * f) as p, var_samp(x * f) as s, count(*) as n from f8 join n using (vec_id) group by dim)
select round(sum(p), 4) as trace_pop, round(sum(s), 4) as trace_samp, round(avg(p), 6) as mean_pop, round(avg(s), 6) as mean_samp, max(n) as vectors from d""")
def _(spark, sf):
    df = vectors.covariance_trace(fx.table(spark, sf, "embeddings"), "embedding", max_norm=0.5)
    return df.select(r4("trace_pop").alias("trace_pop"), r4("trace_samp").alias("trace_samp"), F.round("mean_pop", 6).alias("mean_pop"), F.round("mean_samp", 6).alias("mean_samp"), "vectors")


@query("vector_table_l2_distance", "f8", "select round(sqrt(sum((x - y) * (x - y))), 4) as l2_distance, 0::bigint as mismatches from f8")
def _(spark, sf):
    first = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    second = first.withColumn("v", F.transform("v", lambda x: x + (F.col("vec_id") % 2) * 0.125))
    return vectors.l2_distance(first, second, "vec_id", "v").select(r4("l2_distance").alias("l2_distance"), "mismatches")


@query("softmax_rows", "f8", """with e as (select vec_id, dim, exp(x * 2 - max(x * 2) over (partition by vec_id)) as e from f8)
select vec_id, dim, round(e / sum(e) over (partition by vec_id), 6) as softmax from e""")
def _(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.softmax_row(F.col("embedding"), 2.0)).alias("dim", "softmax"))
    return rows.select("vec_id", big("dim").alias("dim"), F.round("softmax", 6).alias("softmax"))
