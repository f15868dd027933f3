"""Evaluation and reward queries over the rollouts."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r4
from sparkroll.functions import grading
from sparkroll.operators import bleu, evaluation
from sparkroll.skew import rank_in_group

PENALTY = -0.5


def rewarded(spark, sf, penalty=PENALTY):
    scored = fx.f2(spark, sf).withColumn("__r", grading.reward(F.col("answer"), F.col("gold"), F.col("finish_reason"), penalty))
    return scored.withColumns({"reward": F.col("__r.reward"), "is_unfinished": F.col("__r.is_unfinished")}).drop("__r")


# the oracle side of `rewarded`
REWARDED = """
with g as (
  select *, coalesce(lower(replace(trim(answer), ',', '')) = lower(trim(gold)), false) as ok from f2),
r as (
  select *, case when finish_reason = 'length' or answer is null then cast(-0.5 as double) when ok then cast(1 as double) else cast(0 as double) end as reward,
         (answer is null or finish_reason = 'length') as is_unfinished from g)
"""
GRADED_CTE = "with g as (select *, coalesce(lower(replace(trim(answer), ',', '')) = lower(trim(gold)), false) as ok from f2)"


@query("grade_exact", "f1 f2", GRADED_CTE + " select question_id, rollout_idx, ok as is_correct from g")
def _(spark, sf):
    return fx.f2(spark, sf).select("question_id", "rollout_idx", grading.grade_exact(F.col("answer"), F.col("gold")).alias("is_correct"))


@query("reward_function", "f1 f2", REWARDED + " select question_id, rollout_idx, reward, is_unfinished from r")
def _(spark, sf):
    return rewarded(spark, sf).select("question_id", "rollout_idx", "reward", "is_unfinished")


@query("unfinished_rate", "f1 f2", REWARDED + " select round(avg(case when reward = -0.5 then cast(1 as double) else cast(0 as double) end), 6) as unfinished_rate from r")
def _(spark, sf):
    return rewarded(spark, sf).agg(F.round(F.avg((F.col("reward") == PENALTY).cast("double")), 6).alias("unfinished_rate"))


VOTE = GRADED_CTE + """, c as (
  select question_id, answer, count(*) as votes, min(rollout_idx) as first_idx, arg_min(ok, rollout_idx) as is_correct
  from g group by question_id, answer),
w as (select *, row_number() over (partition by question_id order by votes desc, first_idx) as rn from c)
"""


@query("majority_vote", "f1 f2", VOTE + " select question_id, answer as majority_answer, votes, is_correct from w where rn = 1")
def _(spark, sf):
    return evaluation.majority_vote(fx.f2(spark, sf))


@query("eval_task_performance", "f1 f2", VOTE + """,
p as (select question_id, max(case when ok then 1.0::double else 0.0::double end) as once_hit, avg(case when ok then 1.0::double else 0.0::double end) as correct_frac,
             count(distinct answer) + max(case when answer is null then 1 else 0 end) as uniq, avg(case when answer is null then 1.0::double else 0.0::double end) as none_frac
      from g group by question_id)
select round(avg(once_hit), 4) as once_hit, round(avg(correct_frac), 4) as correct_frac,
       round(avg(case when w.is_correct then 1.0::double else 0.0::double end), 4) as majority_vote_acc, round(avg(uniq::double), 4) as unique_answer_count,
       round(avg(none_frac), 4) as none_answer_extracted_frac, round(avg(once_hit), 4) as exact_match, round(avg(correct_frac), 4) as exact_match_frac
from p join w using (question_id) where rn = 1""")
def _(spark, sf):
    df = evaluation.eval_task_performance(fx.f2(spark, sf))
    return df.select(*[r4(c).alias(c) for c in df.columns])


@query("once_hit_rate", "f1 f2", REWARDED + """, q as (select question_id, max(case when reward = 1 then 1.0::double else 0.0::double end) as hit from r group by question_id)
select round(avg(hit), 6) as once_hit_rate, count(*) as questions from q""")
def _(spark, sf):
    return evaluation.once_hit_rate(rewarded(spark, sf)).select(F.round("once_hit_rate", 6).alias("once_hit_rate"), "questions")


@query("unique_response_count", "f1 f2", """select question_id, count(distinct answer) as unique_responses, count(*) as responses
from f2 group by question_id having count(*) > 1""")
def _(spark, sf):
    df = evaluation.unique_response_count(fx.f2(spark, sf), "answer")
    return df.select("question_id", "unique_responses", big("responses").alias("responses"))


@query("mc_value", "f1 f2", REWARDED + """
select f1.question_id, round(coalesce(avg(r.reward), 0), 4) as value, count(r.question_id) as num_rollouts
from f1 left join r on f1.question_id = r.question_id group by f1.question_id""")
def _(spark, sf):
    requests = fx.f1(spark, sf).select("question_id")
    return evaluation.mc_value(requests, rewarded(spark, sf), PENALTY).withColumn("value", r4("value"))


@query("mc_rollout_metrics", "f1 f2", REWARDED + """,
q as (select question_id, count(*) as n, avg(case when finish_reason = 'length' then 1.0::double else 0.0::double end) as trunc,
        (count(distinct answer) + max(case when answer is null then 1 else 0 end)) / count(*)::double as uniq,
        case when count(*) > 1 then stddev_pop(reward) end as std, avg(reward) as m from r group by question_id)
select round(avg(trunc), 4) as mc_roll_trunc_frac, round(avg(n::double), 4) as mc_avg_num_rolls, round(avg(uniq), 4) as mc_avg_unique_rolls_frac,
       round(avg(std), 4) as mc_roll_std,
       round(avg(case when m * (1 - m) >= 0 then 2 * 1.96::double * sqrt(m * (1 - m) / n) end), 4) as mc_ci_length from q""")
def _(spark, sf):
    df = evaluation.mc_rollout_metrics(rewarded(spark, sf))
    return df.select(*[r4(c).alias(c) for c in df.columns])


@query("wald_ci_length", "f1 f2", GRADED_CTE + """, q as (select question_id, avg(case when ok then 1.0::double else 0.0::double end) as p, count(*) as n from g group by question_id)
select question_id, n, round(2 * 1.96::double * sqrt(p * (1 - p) / n), 4) as ci_length from q""")
def _(spark, sf):
    ok = F.when(grading.grade_exact(F.col("answer"), F.col("gold")), 1.0).otherwise(0.0)
    p = fx.f2(spark, sf).groupBy("question_id").agg(F.avg(ok).alias("p"), F.count(F.lit(1)).alias("n"))
    return p.select("question_id", "n", r4(grading.wald_ci_length(F.col("p"), F.col("n"))).alias("ci_length"))


@query("ci_stopping_point", "f1 f2", GRADED_CTE + """,
w as (select question_id, rollout_idx + 1 as n, avg(case when ok then 1.0::double else 0.0::double end) over (partition by question_id order by rollout_idx) as p from g where rollout_idx < 6),
s as (select question_id, n, n >= 2 and ((n - 2) % 2 = 0 or n = 6) and 2 * 1.96::double * sqrt(greatest(p * (1 - p) / n, 0)) <= 0.9 as stops from w)
select question_id, coalesce(min(case when stops then n end), max(n)) as rollouts_needed, bool_or(stops) as converged from s group by question_id""")
def _(spark, sf):
    ok = F.when(grading.grade_exact(F.col("answer"), F.col("gold")), 1.0).otherwise(0.0)
    return evaluation.ci_stopping_point(fx.f2(spark, sf).withColumn("reward", ok), initial=2, step=2, maximum=6, max_length=0.9)


def with_flags(spark, sf):
    return rewarded(spark, sf).withColumns(
        {"is_empty": F.col("num_tokens") <= 1, "parse_failed": F.col("answer").isNull(), "num_steps": F.col("num_tokens") % 7 + 1}
    )


FLAGS = REWARDED + ", e as (select *, num_tokens <= 1 as is_empty, answer is null as parse_failed, num_tokens % 7 + 1 as num_steps from r)"


@query("episode_generation_metrics", "f1 f2", FLAGS + """
select round(avg(is_unfinished::int::double), 4) as is_unfinished_response, round(avg(is_empty::int::double), 4) as empty_response,
       round(avg(parse_failed::int::double), 4) as parse_failed, round(avg(num_steps::double) filter (where not parse_failed), 4) as num_reasoning_steps_mean,
       max(num_steps) filter (where not parse_failed) as num_reasoning_steps_max, min(num_steps) filter (where not parse_failed) as num_reasoning_steps_min
from e""")
def _(spark, sf):
    df = evaluation.episode_generation_metrics(with_flags(spark, sf))
    keep = {"num_reasoning_steps_max", "num_reasoning_steps_min"}
    return df.select(*[F.col(c) if c in keep else r4(c).alias(c) for c in df.columns])


@query("step_count_distribution", "f1 f2", FLAGS + " select num_steps, count(*) as episodes from e where not parse_failed group by num_steps")
def _(spark, sf):
    return evaluation.step_count_distribution(with_flags(spark, sf))


@query("trajectory_metrics", "f1 f2", FLAGS + """,
q as (select question_id, max((reward = 1)::int::double) as hit, count(distinct answer) as uniq, count(*) as n from e group by question_id)
select (select round(avg((finish_reason = 'length')::int::double), 4) from e) as finish_length_rate,
       (select round(avg((num_tokens > 40)::int::double), 4) from e) as truncated_rate,
       (select round(avg(is_unfinished::int::double), 4) from e) as unfinished_rate,
       (select round(avg(parse_failed::int::double), 4) from e) as parse_failed_rate,
       round(avg(hit), 4) as once_hit, round(avg(uniq::double) filter (where n > 1), 4) as unique_responses from q""")
def _(spark, sf):
    sizes = with_flags(spark, sf).groupBy("question_id", "answer").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c.cast("bigint")).alias(k) for k, c in {
            "cut": F.col("finish_reason") == "length", "long": F.col("num_tokens") > 40, "unfinished": F.col("is_unfinished"),
            "failed": F.col("parse_failed"), "hits": F.col("reward") == 1.0}.items()],
    )
    q = sizes.groupBy("question_id").agg(*[F.sum(c).alias(c) for c in ["n", "cut", "long", "unfinished", "failed", "hits"]], F.count("answer").alias("uniq"))
    total = F.sum("n")
    # each rate keeps its own denominator: rows, questions, questions with more than one response
    return q.agg(
        r4(F.sum("cut") / total).alias("finish_length_rate"),
        r4(F.sum("long") / total).alias("truncated_rate"),
        r4(F.sum("unfinished") / total).alias("unfinished_rate"),
        r4(F.sum("failed") / total).alias("parse_failed_rate"),
        r4(F.avg((F.col("hits") > 0).cast("double"))).alias("once_hit"),
        r4(F.avg(F.when(F.col("n") > 1, F.col("uniq")))).alias("unique_responses"),
    )


@query("restem_metrics", "f1 f2", FLAGS + """,
k as (select *, row_number() over (partition by question_id order by rollout_idx) as rn from e where reward >= 1 and not is_empty)
select (select round(avg(is_unfinished::int::double), 4) from e) as is_unfinished_response, (select round(avg(parse_failed::int::double), 4) from e) as parse_failed,
       (select count(*) from e where is_empty) as empty_response, (select count(*) from k where rn > 2) as question_reached_max_response,
       (select count(*) from k where rn <= 2) as total_kept""")
def _(spark, sf):
    cap = 2
    good = (F.col("reward") >= 1.0) & ~F.col("is_empty")
    # the cap only needs counts: a question keeps min(n, cap) and drops the rest
    q = with_flags(spark, sf).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.count_if("is_unfinished").alias("u"),
        F.count_if("parse_failed").alias("p"), F.count_if("is_empty").alias("e"))
    return q.agg(
        r4(F.sum("u") / F.sum("n")).alias("is_unfinished_response"), r4(F.sum("p") / F.sum("n")).alias("parse_failed"),
        F.sum("e").alias("empty_response"),
        F.sum(F.greatest(F.col("good") - cap, F.lit(0))).cast("bigint").alias("question_reached_max_response"),
        F.sum(F.least(F.col("good"), F.lit(cap))).cast("bigint").alias("total_kept"))


# an independent brute force: every pair, every gram
BLEU_SQL = """,
w as (select gid, idx, regexp_extract_all(txt, '[^ \\t\\n\\r\\f]+') as w from m),
g as (select gid, idx, n.n as n, array_to_string(w[p.p:p.p + n.n - 1], ' ') as g
      from w, (select unnest([1, 2, 3, 4]) as n) n, lateral (select unnest(range(1, len(w) - n.n + 2)) as p) p),
c as (select gid, idx, n, g, count(*) as c from g group by all),
match as (select a.gid, a.n, sum(least(a.c, b.c)) as hit from c a join c b on a.gid = b.gid and a.n = b.n and a.g = b.g and a.idx < b.idx group by a.gid, a.n),
pairs as (select a.gid, len(a.w) as pl, len(b.w) as rl from w a join w b on a.gid = b.gid and a.idx < b.idx),
poss as (select gid, n.n as n, sum(greatest(pl - n.n + 1, 0)) as possible, sum(pl) as pl, sum(rl) as rl from pairs, (select unnest([1, 2, 3, 4]) as n) n group by gid, n.n),
prec as (select poss.gid, pl, rl, case when possible > 0 then coalesce(hit, 0) / possible::double else 0 end as p from poss left join match using (gid, n)),
bleu as (select gid, case when min(p) > 0 and max(rl) > 0 then exp(avg(ln(case when p > 0 then p end))) * (case when max(pl) > max(rl) then 1 else exp(1 - max(rl) / max(pl)::double) end) else 0 end as bleu
         from prec group by gid)
"""


@query("pairwise_bleu", "f6", """with m as (select conv_id as gid, row_number() over (partition by conv_id order by turn) - 1 as idx, response_text as txt from f6)""" + BLEU_SQL + """
select gid as conv_id, round(bleu, 4) as bleu from bleu""")
def _(spark, sf):
    members = rank_in_group(fx.f6(spark, sf), ["conv_id"], [F.col("turn")], "idx")
    return bleu.group_bleu(members, ["conv_id"], "idx", "response_text").select("conv_id", r4("bleu").alias("bleu"))


@query("unique_continuations", "f1 f2", "select question_id, count(distinct answer) as unique_continuations from f2 group by question_id")
def _(spark, sf):
    return fx.f2(spark, sf).groupBy("question_id").agg(F.count_distinct("answer").alias("unique_continuations"))
