"""Sampling, sharding, top-k and deduplication queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r4
from sparkroll.catalog.evaluation import REWARDED, rewarded
from sparkroll.operators import checkpoints, sampling

SEED = 17


def md5_order(key, seed=SEED):
    return f"md5(concat('{seed}', '|', {key}))"


def ranked(key, source="f1", seed=SEED, tie="question_id"):
    return f"select *, row_number() over (order by {md5_order(key, seed)}, {tie}) - 1 as pos from {source}"


Q = "cast(question_id as varchar)"
QR = "cast(question_id as varchar), '|', cast(rollout_idx as varchar)"


@query("shuffle_take", "f1", f"select * from ({ranked(Q)}) where pos < 1000")
def _(spark, sf):
    return sampling.shuffle_take(fx.f1(spark, sf), ["question_id"], SEED, n=1000)


@query("initial_subset", "f1", f"select question_id, gold, split from ({ranked(Q, seed=5)}) where pos < (select floor(count(*) * 0.25::double) from f1)")
def _(spark, sf):
    return sampling.shuffle_take(fx.f1(spark, sf), ["question_id"], 5, portion=0.25).drop("pos")


@query("epoch_slices", "f1", f"""with n as (select count(*) as size, (count(*) * 7) // 10 as per from f1),
e as (select question_id, pos, 0 as repeat from ({ranked(Q, seed=SEED)})
      union all select question_id, pos + (select size from n), 1 from ({ranked(Q, seed=SEED + 1)})
      union all select question_id, pos + 2 * (select size from n), 2 from ({ranked(Q, seed=SEED + 2)}))
select question_id, cast(repeat as bigint) as repeat, pos from e, n where pos >= per * 2 and pos < per * 3""")
def _(spark, sf):
    questions = fx.f1(spark, sf).select("question_id")
    per = questions.count() * 7 // 10
    return sampling.epoch_slice(questions, "question_id", SEED, per, 4, 2)


@query("resize_episodes", "f1", f"""with c as (select question_id, unnest(range(2)) as copy from f1),
n as (select count(*) as size from f1)
select question_id, copy, pos from ({ranked("cast(question_id as varchar), '|', cast(copy as varchar)", "c", tie="question_id, copy")}), n where pos < (size * 3) // 2""")
def _(spark, sf):
    questions = fx.f1(spark, sf).select("question_id")
    return sampling.resize(questions, ["question_id"], SEED, questions.count() * 3 // 2)


@query("leftover_cache", "f1 f2", f"""select question_id, rollout_idx, pos, pos < 5000 as taken
from ({ranked(QR, "f2", tie="question_id, rollout_idx")})""")
def _(spark, sf):
    rollouts = fx.f2(spark, sf).select("question_id", "rollout_idx")
    return sampling.take_and_leave(rollouts, ["question_id", "rollout_idx"], SEED, 5000)


@query("portion", "f1", "select * from (select *, row_number() over (order by question_id) - 1 as pos from f1) where pos < (select floor(count(*) * 0.29::double) from f1)")
def _(spark, sf):
    return sampling.portion(fx.f1(spark, sf), "question_id", 0.29)


@query("shard_contiguous", "f1", "select question_id, ntile(7) over (order by question_id) - 1 as shard from f1")
def _(spark, sf):
    return sampling.shard_contiguous(fx.f1(spark, sf), "question_id", 7).select("question_id", "shard")


@query("shard_round_robin", "f1", "select question_id, (row_number() over (order by question_id) - 1) % 7 as shard from f1")
def _(spark, sf):
    return sampling.shard_round_robin(fx.f1(spark, sf), "question_id", 7).select("question_id", "shard")


PER_Q = "row_number() over (partition by question_id order by " + md5_order(QR) + ", rollout_idx)"


@query("sample_without_replacement", "f1 f2", f"select question_id, rollout_idx, answer from f2 qualify {PER_Q} <= 2")
def _(spark, sf):
    return sampling.sample_per_group(fx.f2(spark, sf).select("question_id", "rollout_idx", "answer"), ["question_id"], ["rollout_idx"], SEED, 2)


@query("first_n_per_question", "f1 f2", REWARDED + "select question_id, rollout_idx, reward from r where reward >= 1 qualify row_number() over (partition by question_id order by rollout_idx) <= 2")
def _(spark, sf):
    good = rewarded(spark, sf).where("reward >= 1").select("question_id", "rollout_idx", "reward")
    return sampling.first_n_per_group(good, ["question_id"], ["rollout_idx"], 2)


@query("subsample_runs", "", f"""select vec_id, run from (select vec_id, unnest(range(5)) as run from embeddings)
qualify row_number() over (partition by run order by md5(concat('{SEED}', '|', cast(run as varchar), '|', cast(vec_id as varchar))), vec_id) <= 50""")
def _(spark, sf):
    return sampling.subsample_runs(fx.table(spark, sf, "embeddings").select("vec_id"), "vec_id", SEED, runs=5, n=50)


@query("mc_subsample_value", "", f"""with s as (select o_custkey as state_id, o_orderpriority as action, o_orderkey as k, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as ret from orders)
select state_id, action, round(avg(ret), 4) as value, count(*) as n from (
  select * from s qualify row_number() over (partition by state_id, action order by md5(concat('{SEED}', '|', cast(state_id as varchar), '|', action, '|', cast(k as varchar))), k) <= 2)
group by state_id, action""")
def _(spark, sf):
    returns = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("state_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("ret"))
    picked = sampling.sample_per_group(returns, ["state_id", "action"], ["k"], SEED, 2)
    return picked.groupBy("state_id", "action").agg(r4(F.avg("ret")).alias("value"), F.count(F.lit(1)).alias("n"))


CKPT = """select *, cast(regexp_extract(name, 'iter_(\\d+)', 1) as bigint) as p_iter, cast(regexp_extract(name, 'epoch_(\\d+)', 1) as bigint) as p_epoch,
  cast(regexp_extract(name, 'step_(\\d+)', 1) as bigint) as p_step from f10"""


@query("evenly_spaced", "f10", """with r as (select name, row_number() over (order by iteration, step) - 1 as pos, count(*) over () as n from f10)
select name, pos from r where pos in (select (i * n) // 9 from (select unnest(range(9)) as i), (select max(n) as n from r))""")
def _(spark, sf):
    named = fx.f10(spark, sf).select("name", (F.col("iteration") * 100 + F.col("step")).alias("k"))
    return sampling.evenly_spaced(named, "k", 9).select("name", "pos")


@query("parse_checkpoint_name", "f10", f"select name, p_iter, p_epoch, p_step from ({CKPT})")
def _(spark, sf):
    return checkpoints.parse_names(fx.f10(spark, sf)).select("name", "p_iter", "p_epoch", "p_step")


@query("last_checkpoint", "f10", f"select name as last_name from ({CKPT}) order by p_iter desc, p_epoch desc, p_step desc limit 1")
def _(spark, sf):
    return checkpoints.last_checkpoint(fx.f10(spark, sf))


@query("every_nth_keep_last", "f10", f"""select name, pos from (select name, row_number() over (order by p_iter, p_epoch, p_step) - 1 as pos, count(*) over () as n from ({CKPT}))
where pos % 6 = 0 or pos = n - 1""")
def _(spark, sf):
    return checkpoints.every_nth_keep_last(fx.f10(spark, sf), 6).select("name", "pos")


EARLY = """with l as (select *, lag(accuracy) over (partition by iteration order by step) as prev from f10),
m as (select *, max(case when accuracy > prev or prev is null then 0 else 1 end) over (partition by iteration order by step) as failed from l)
select iteration, arg_max(name, step) as name, max(step) as step from m where failed = 0 group by iteration"""


@query("checkpoint_early_stop", "f10", EARLY)
def _(spark, sf):
    return checkpoints.early_stop(fx.f10(spark, sf))


@query("checkpoint_choose_best", "f10", "select iteration, name, step from f10 qualify row_number() over (partition by iteration order by accuracy desc, step) = 1")
def _(spark, sf):
    return checkpoints.choose_best(fx.f10(spark, sf)).select("iteration", "name", "step")


@query("chosen_checkpoint_unique", "f10", """with c as (select iteration, name from f10 qualify row_number() over (partition by iteration order by accuracy desc, step) = 1)
select iteration, count(*) as chosen, count(*) = 1 as ok from c group by iteration""")
def _(spark, sf):
    return checkpoints.chosen_per_iteration(checkpoints.choose_best(fx.f10(spark, sf)))


REQ = "with q as (select event_type || ':' || cast(user_id % 40 as varchar) as txt, event_id as uid from events)"


def requests(spark, sf):
    text = F.concat("event_type", F.lit(":"), (F.col("user_id") % 40).cast("string"))
    return fx.table(spark, sf, "events").select(text.alias("txt"), F.col("event_id").alias("uid"))


@query("dedupe_requests", "", REQ + " select txt, uid, min(uid) over (partition by txt) as unique_uid, min(uid) over (partition by txt) = uid as is_unique from q")
def _(spark, sf):
    return sampling.dedupe_requests(requests(spark, sf), "txt", "uid")


@query("assert_unique_ids", "", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def _(spark, sf):
    return sampling.duplicated_ids(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("union_shards_shuffle", "", REQ + f""", u as (select txt, uid, uid % 3 as shard from q)
select txt, uid, shard, (row_number() over (order by {md5_order('cast(uid as varchar)')}, uid) - 1) % 4 as new_shard from u""")
def _(spark, sf):
    q = requests(spark, sf)
    merged = sampling.union_shards([q.where(F.col("uid") % 3 == i) for i in range(3)])
    return sampling.shuffled(merged, ["uid"], SEED).select("txt", "uid", "shard", (F.col("pos") % 4).alias("new_shard"))
