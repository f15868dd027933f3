"""Credit-assignment queries over trajectory steps."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r4
from sparkroll.functions.text import TOKEN, token_spans
from sparkroll.operators import credit
from sparkroll.skew import running

PENALTY = -0.25
FILLED = """with k as (select *, max(case when value_est is not null then step_idx end) over (partition by traj_id) as known,
   sum(step_reward) over (partition by traj_id order by step_idx desc) as to_come from f3),
v as (select *, case when step_idx > coalesce(known, -1) then to_come else value_est end as value from k),
a as (select *, step_reward + lead(value, 1, 0) over (partition by traj_id order by step_idx) - value as adv from v)
"""


def advantages(spark, sf):
    return credit.mc_step_advantage(credit.fill_missing_values_tail(fx.f3(spark, sf)))


@query("step_rewards", "f3", """select traj_id, step_idx, case when step_idx = num_steps - 1 then case when traj_id % 5 = 0 then cast(-0.25 as double) else (traj_id % 7) / 7.0::double end else 0 end as reward from f3""")
def _(spark, sf):
    score = (F.col("traj_id") % 7) / F.lit(7.0)
    df = credit.step_rewards(fx.f3(spark, sf), score, F.col("traj_id") % 5 == 0, PENALTY)
    return df.select("traj_id", "step_idx", "reward")


@query("fill_missing_values_tail", "f3", FILLED + "select traj_id, step_idx, round(value, 4) as value from v")
def _(spark, sf):
    return credit.fill_missing_values_tail(fx.f3(spark, sf)).select("traj_id", "step_idx", r4("value").alias("value"))


@query("mc_step_advantage", "f3", FILLED + "select traj_id, step_idx, round(adv, 4) as advantage from a")
def _(spark, sf):
    return advantages(spark, sf).select("traj_id", "step_idx", r4("advantage").alias("advantage"))


GAE_SQL = FILLED + """, d as (select traj_id, step_idx, value, step_reward + 0.99::double * lead(value, 1, 0) over (partition by traj_id order by step_idx) - value as delta from v),
g as (select traj_id, step_idx, value, sum(pow(0.9405::double, step_idx) * delta) over (partition by traj_id order by step_idx desc) / pow(0.9405::double, step_idx) as adv from d)
"""


@query("gae", "f3", GAE_SQL + "select traj_id, step_idx, round(adv, 3) as gae_advantage, round(adv + value, 3) as gae_return from g")
def _(spark, sf):
    filled = credit.fill_missing_values_tail(fx.f3(spark, sf))
    df = credit.gae(filled, ["traj_id"], "step_idx", "value", "step_reward", gamma=0.99, lam=0.95)
    return df.select("traj_id", "step_idx", F.round("gae_advantage", 3).alias("gae_advantage"), F.round("gae_return", 3).alias("gae_return"))


@query("advantage_distribution", "f3", FILLED + """select traj_id, step_idx, num_steps, round(adv, 4) as advantage, round((step_idx + 1) / num_steps::double, 4) as rel_step from a where num_steps > 2""")
def _(spark, sf):
    return advantages(spark, sf).where("num_steps > 2").select(
        "traj_id", "step_idx", "num_steps", r4("advantage").alias("advantage"), r4((F.col("step_idx") + 1) / F.col("num_steps")).alias("rel_step"))


@query("export_csv_gz", "f3", FILLED + """select concat_ws(',', traj_id, step_idx, num_steps, case when adv < 0 then -1 when adv > 0 then 1 else 0 end) as line from a""")
def _(spark, sf):
    """The lines the gzip CSV export holds: `sources.writers.write_csv_gz` stores the same table."""
    sign = F.when(F.col("advantage") < 0, -1).when(F.col("advantage") > 0, 1).otherwise(0)
    return advantages(spark, sf).select(F.to_csv(F.struct("traj_id", "step_idx", "num_steps", sign.alias("sign"))).alias("line"))


def step_tokens(spark, sf):
    """Tokens of the steps with their start in the response and their rank in the trajectory."""
    steps = fx.f3(spark, sf).withColumn("toks", token_spans(F.col("step_text"))).withColumn("n", F.size("toks").cast("bigint"))
    steps = running(steps, ["traj_id"], "step_idx", {"upto": ("sum", "n")})
    exploded = steps.select("traj_id", "step_idx", "char_start", (F.col("upto") - F.col("n")).alias("before"), F.posexplode("toks").alias("p", "tok"))
    return exploded.select("traj_id", "step_idx", (F.col("char_start") + F.col("tok.start")).alias("tok_start"), (F.col("before") + F.col("p")).alias("tok_pos"))


TOKS = f"""with u as (select traj_id, step_idx, char_start, regexp_extract_all(step_text, '{TOKEN}') as toks from f3),
p as (select traj_id, step_idx, char_start, toks, unnest(range(len(toks))) as p from u),
t as (select traj_id, step_idx, char_start + coalesce(list_sum(list_transform(toks[1:p], lambda x: length(x))), 0)::bigint as tok_start from p)
"""


@query("token_step_range_join", "f3", TOKS + "select traj_id, tok_start, step_idx from t")
def _(spark, sf):
    toks = step_tokens(spark, sf).select("traj_id", "tok_start")
    return credit.token_step_range_join(toks, fx.f3(spark, sf), ["step_idx"]).select("traj_id", "tok_start", "step_idx")


@query("mc_token_advantage", "f3", TOKS.replace("with u", "with u", 1) + "," + FILLED[5:] + """, b as (select t.traj_id, tok_start, adv, false as is_eos from t join a using (traj_id, step_idx)),
e as (select traj_id, max(tok_start) + 1, arg_max(adv, tok_start), true from b group by traj_id)
select traj_id, tok_start, round(adv, 4) as advantage, is_eos from (select * from b union all select * from e)""")
def _(spark, sf):
    toks = step_tokens(spark, sf).select("traj_id", "tok_start")
    df = credit.mc_token_advantage(toks, advantages(spark, sf))
    return df.select("traj_id", "tok_start", r4("advantage").alias("advantage"), "is_eos")


@query("step_boundaries", "f3", TOKS + """, r as (select traj_id, step_idx, row_number() over (partition by traj_id order by tok_start) - 1 as tok_pos from t)
select traj_id, step_idx, max(tok_pos) as tok_pos from r group by traj_id, step_idx""")
def _(spark, sf):
    toks = step_tokens(spark, sf).select("traj_id", "tok_pos", "step_idx")
    return credit.step_boundaries(toks, ["traj_id"], "tok_pos", "step_idx").select("traj_id", "step_idx", "tok_pos")


@query("mc_value_requests", "f3", """select traj_id, step_idx, concat('T', cast(traj_id as varchar), ':', cast(step_idx as varchar)) as request_id, num_steps, step_idx = 0 as is_query_state,
  step_idx = num_steps - 1 as is_last, round(value_est, 4) as predicted from f3""")
def _(spark, sf):
    steps = fx.f3(spark, sf)
    rid = F.concat(F.lit("T"), F.col("traj_id").cast("string"), F.lit(":"), F.col("step_idx").cast("string"))
    return steps.select("traj_id", "step_idx", rid.alias("request_id"), "num_steps", (F.col("step_idx") == 0).alias("is_query_state"),
                        (F.col("step_idx") == F.col("num_steps") - 1).alias("is_last"), r4("value_est").alias("predicted"))


@query("alt_continuation_requests", "f3", """select traj_id, step_idx, char_end as state_end from f3 where not (step_idx = num_steps - 1 and traj_id % 2 = 0)""")
def _(spark, sf):
    complete = F.col("traj_id") % 2 == 0
    last = F.col("step_idx") == F.col("num_steps") - 1
    return fx.f3(spark, sf).where(~(last & complete)).select("traj_id", "step_idx", F.col("char_end").alias("state_end"))


@query("value_prediction_error", "f3", FILLED + """select step_idx = 0 as is_query_state, count(*) as states, round(avg((value_est - to_come) * (value_est - to_come)), 4) as mse,
  round(avg(case when step_idx = num_steps - 2 then (value_est - to_come) * (value_est - to_come) end), 4) as second_last_mse
from v where value_est is not null group by step_idx = 0""")
def _(spark, sf):
    steps = running(fx.f3(spark, sf), ["traj_id"], "step_idx", {"gt": ("sum", "step_reward")}, reverse=True)
    error = F.pow(F.col("value_est") - F.col("gt"), 2)
    near_end = F.when(F.col("step_idx") == F.col("num_steps") - 2, error)
    return steps.where("value_est is not null").groupBy((F.col("step_idx") == 0).alias("is_query_state")).agg(
        F.count(F.lit(1)).alias("states"), r4(F.avg(error)).alias("mse"), r4(F.avg(near_end)).alias("second_last_mse"))


REQ = "with q as (select event_type || ':' || cast(user_id % 40 as varchar) as txt, event_id as uid from events)"


@query("lookup_join", "", REQ + """, u as (select *, min(uid) over (partition by txt) as unique_uid from q)
select uid, unique_uid, (unique_uid % 11)::bigint as result, true as same_text from u""")
def _(spark, sf):
    from sparkroll.catalog.sampling import requests
    from sparkroll.operators.requests import lookup_join
    from sparkroll.operators.sampling import dedupe_requests

    asked = dedupe_requests(requests(spark, sf), "txt", "uid")
    answered = asked.where("is_unique").select("uid", "txt", (F.col("uid") % 11).alias("result"))
    return lookup_join(asked, answered, "unique_uid", "uid", "txt", ["result"]).select("uid", "unique_uid", big("result").alias("result"), "same_text")


@query("attach_trajectory_source", "", """with t as (select distinct user_id * 10 + cast(floor((day(ts) - 1) / 10) as bigint) as traj_id, user_id from events)
select traj_id, c_custkey as instance_id, c_mktsegment as segment, contains('Ask Customer#' || lpad(user_id::varchar, 9, '0') || ' now', c_name) as contained
from t join customer on c_custkey = user_id""")
def _(spark, sf):
    from sparkroll.operators.requests import attach_trajectory_source

    key = (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("bigint")
    text = F.concat(F.lit("Ask Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit(" now"))
    trajectories = fx.table(spark, sf, "events").select(key.alias("traj_id"), F.col("user_id").alias("instance_id"), text.alias("query_text")).distinct()
    instances = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("instance_id"), F.col("c_name").alias("problem"), F.col("c_mktsegment").alias("segment"))
    return attach_trajectory_source(trajectories, instances, ["segment"]).select("traj_id", "instance_id", "segment", "contained")
