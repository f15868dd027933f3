"""End-to-end queries and extension points."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog import credit as credit_queries
from sparkroll.catalog import trees as tree_queries
from sparkroll.catalog.base import big, query, r4, r9
from sparkroll.catalog.credit import step_tokens
from sparkroll.catalog.evaluation import REWARDED, rewarded
from sparkroll.catalog.pairs import PAIRS
from sparkroll.catalog.texts import load_length_model, toks_sql
from sparkroll.functions import grading
from sparkroll.operators import credit, trees
from sparkroll.operators import paths as pp
from sparkroll.plans import composites
from sparkroll.plugins import row_generator

SEED, PENALTY, MAX_LEN = 17, -0.5, 16


def texts():
    """The rollouts carry no text; this one has as many words as the token count says, modulo 9."""
    question = F.concat(F.lit("Question "), F.col("question_id").cast("string"), F.lit("."))
    words = F.array_join(F.array_repeat(F.lit(" so"), (F.col("num_tokens") % 9).cast("int")), "")
    return question, F.concat(words, F.coalesce(F.concat(F.lit(" answer "), "answer"), F.lit("")))


def episodes(spark, sf):
    return composites.ppo_episodes(fx.f2(spark, sf), *texts(), MAX_LEN - 5, PENALTY)


EPISODES = REWARDED + f""", x as (select *, 'Question ' || question_id::varchar || '.' as q, repeat(' so', num_tokens % 9) || case when answer is null then '' else ' answer ' || answer end as resp from r),
y as (select *, len({toks_sql('q')}) as nq, len({toks_sql('resp')}) as nr from x),
ep as (select question_id, rollout_idx, q, resp, nq, case when nq + nr > 11 then greatest(11 - nq, 0) else nr end as n_response, case when nq + nr > 11 then -0.5::double else reward end as reward, is_unfinished or nq + nr > 11 as is_unfinished from y),
e as (select * from ep where n_response > 0)
"""


@query("ppo_episodes", "f1 f2", EPISODES + "select question_id, rollout_idx, nq as n_query, n_response, n_response + (case when is_unfinished then 0 else 1 end) as n_ids, reward, is_unfinished from e")
def _(spark, sf):
    df = episodes(spark, sf)
    return df.select("question_id", "rollout_idx", big("n_query").alias("n_query"), big("n_response").alias("n_response"), big(F.size("response_token_ids")).alias("n_ids"), "reward", "is_unfinished")


@query("reward_fn_episodes", "f1 f2 f4", tree_queries.oracle("""select c.tree_id, c.leaf_id, (length('Tree ' || c.tree_id::varchar || ':' || coalesce(string_agg(' then ' || node_id, '' order by pos) filter (where pos > 0), '')) % 100) / 100.0::double as score from c group by c.tree_id, c.leaf_id"""))
def _(spark, sf):
    df = composites.reward_fn_episodes(trees.tree_paths(trees.chains(tree_queries.nodes(spark, sf), 3, ["node_id"])), load_length_model)
    return df.select("tree_id", "leaf_id", "score")


@query("restem_episodes", "f1 f2", EPISODES + "select question_id, rollout_idx, n_response from e where reward >= 1 qualify row_number() over (partition by question_id order by rollout_idx) <= 2")
def _(spark, sf):
    return composites.restem_episodes(episodes(spark, sf), 1.0, 2).select("question_id", "rollout_idx", big("n_response").alias("n_response"))


DPO = EPISODES.rstrip() + PAIRS[len(REWARDED):].replace("from r)", "from e)") + " select question_id, pair, accept_idx, reject_idx, a.q as query_text, a.resp as accept_text, b.resp as reject_text from dp join e a using (question_id) join e b using (question_id) where a.rollout_idx = accept_idx and b.rollout_idx = reject_idx"


@query("dpo_episodes", "f1 f2", DPO)
def _(spark, sf):
    df = composites.dpo_episodes(episodes(spark, sf), 0.5, 4, SEED)
    return df.select("question_id", "pair", "accept_idx", "reject_idx", "query_text", "accept_text", "reject_text")


VINE = REWARDED + """, st as (select *, regexp_extract(step_text, '(\\d+)\\.$', 1)::bigint as uid, split_part(step_text, ' ', 1) || ':' || (step_idx % 5)::varchar || ':' || (traj_id % 10)::varchar as state from f3),
dd as (select *, min(uid) over (partition by state) as unique_uid from st),
v as (select question_id, avg(reward) as v from r group by question_id),
w as (select dd.*, coalesce(v.v, 0) as value from dd left join v on dd.unique_uid = v.question_id)
"""


def vine(spark, sf):
    kind = F.substring_index("step_text", " ", 1)
    state = F.concat(kind, F.lit(":"), (F.col("step_idx") % 5).cast("string"), F.lit(":"), (F.col("traj_id") % 10).cast("string"))
    uid = F.regexp_extract("step_text", r"(\d+)\.$", 1).cast("bigint")
    return composites.vine_advantages(fx.f3(spark, sf), state, uid, rewarded(spark, sf), PENALTY)


@query("vine_advantages", "f1 f2 f3", VINE + """select traj_id, step_idx, unique_uid, round(value, 4) as value, round(step_reward + lead(value, 1, 0) over (partition by traj_id order by step_idx) - value, 4) as advantage from w""")
def _(spark, sf):
    return vine(spark, sf).select("traj_id", "step_idx", "unique_uid", r4("value").alias("value"), r4("advantage").alias("advantage"))


@query("vine_token_advantages", "f1 f2 f3", credit_queries.TOKS + ", " + VINE[5:] + """, a as (select traj_id, step_idx, step_reward + lead(value, 1, 0) over (partition by traj_id order by step_idx) - value as adv from w),
b as (select t.traj_id, tok_start, adv, false as is_eos from t join a using (traj_id, step_idx)), e as (select traj_id, max(tok_start) + 1, arg_max(adv, tok_start), true from b group by traj_id)
select traj_id, tok_start, round(adv, 4) as advantage, is_eos from (select * from b union all select * from e)""")
def _(spark, sf):
    df = credit.mc_token_advantage(step_tokens(spark, sf).select("traj_id", "tok_start"), vine(spark, sf))
    return df.select("traj_id", "tok_start", r4("advantage").alias("advantage"), "is_eos")


@query("tree_episodes", "f1 f2 f4", tree_queries.oracle(tree_queries.STRATEGY + """, n as (select c.leaf_id, c.tree_id, c.node_id, c.pos, z.advantage, max(c.pos) over (partition by c.leaf_id) as last_pos from c join z on c.leaf_id = z.leaf_id and c.pos = z.pos),
x as (select *, case when pos = 0 then 0 else len(""" + toks_sql("chr(10) || 'step ' || node_id || '.'") + """) end as nt from n)
select tree_id, leaf_id, sum(nt)::bigint + 1 as num_tokens, 1.0::double as reward, round(sum(coalesce(advantage, 0) * nt) + max(advantage) filter (where pos = last_pos), 9) as advantages from x group by tree_id, leaf_id"""))
def _(spark, sf):
    df = tree_queries.multi_step_episodes(tree_queries.top_tenth(spark, sf))
    return df.select("tree_id", F.col("node_id").alias("leaf_id"), big(F.size("advantages")).alias("num_tokens"), "reward", r9(F.aggregate("advantages", F.lit(0.0), lambda acc, a: acc + a)).alias("advantages"))


@query("ppo_batches", "f7", """with x as (select *, max(t) over (partition by episode_id) as last_t from f7),
r as (select episode_id, t, value, -0.1::double * (actor_lp - ref_lp) + case when t = last_t then score else 0 end as reward from x where is_action),
d as (select *, reward + lead(value, 1, 0) over (partition by episode_id order by t) - value as delta from r),
g as (select episode_id, t, value, sum(pow(0.9613::double, t) * delta) over (partition by episode_id order by t desc) / pow(0.9613::double, t) as adv from d), s as (select avg(adv) as m, var_samp(adv) as v from g)
select episode_id, t, round(adv + value, 7) as ret, round((adv - m) / sqrt(v + 1e-8), 6) as whitened from g, s""")
def _(spark, sf):
    df = composites.ppo_batches(fx.f7(spark, sf), 0.1, 1.0, 0.9613)
    return df.select("episode_id", "t", F.round("gae_return", 7).alias("ret"), F.round("whitened", 6).alias("whitened"))


@query("action_ranking", "", f"""with s as (select o_custkey as state_id, o_orderpriority as action, o_orderkey as k, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as ret from orders),
f as (select * from s where state_id in (select state_id from s group by state_id having count(distinct action) >= 3)),
g as (select state_id, action, avg(ret) as gt from f group by all),
p as (select state_id, action, avg(ret) as pred from (select * from f qualify row_number() over (partition by state_id, action order by md5(concat('{SEED}|', state_id::varchar, '|', action, '|', k::varchar)), k) <= 1) group by all),
j as (select * from g join p using (state_id, action))
select round(avg(((a.gt - b.gt) * (a.pred - b.pred) > 0)::int::double), 6) as ranking_accuracy, count(*) as comparisons from j a join j b on a.state_id = b.state_id and a.action < b.action""")
def _(spark, sf):
    returns = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("state_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("ret"))
    df = composites.action_ranking(returns, 3, 1, SEED)
    return df.select(F.round("ranking_accuracy", 6).alias("ranking_accuracy"), "comparisons")


@query("registry", "f1 f2 f4", tree_queries.oracle(tree_queries.C9 + """, z as (select * replace (case when advantage < 0 then 0 else advantage end as advantage) from c9 where leaf_id in (select leaf_id from c9 where pos = last_pos and score = 0))
""" + tree_queries.SUMMARY.format(src="z")))
def _(spark, sf):
    """Plug-ins chosen by name, as a configuration does it."""
    chosen = {"filters": ["zero_last_step_score"], "steps": ["negative_advantages_to_zero"], "aggregators": ["identity"]}
    return tree_queries.summary(pp.path_strategy(tree_queries.rounded_paths(spark, sf), chosen["filters"], chosen["steps"], chosen["aggregators"]))


@query("generator_udtf", "", """select c_custkey as tree_id, 'N' || c_custkey::varchar || '.' || i::varchar as node_id, ' step ' || (length(c_name) % 7 + i)::varchar || '.' as text from customer, (select unnest(range(2)) as i)""")
def _(spark, sf):
    name = F.col("c_name")
    requests = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("tree_id"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("parent_id"), F.lit(1).cast("bigint").alias("depth"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("child_idx"), name.alias("prefix"))
    generator = row_generator(lambda prefix, i: f" step {len(prefix) % 7 + i}.", lambda t: t.endswith("9."))
    return requests.mapInPandas(generator, trees.OPEN_SCHEMA).select("tree_id", "node_id", "text")


@query("rollout_eval_callback", "f1 f2", "select round(avg(c), 4) as correct_frac from (select question_id, avg(case when answer in ('A', gold) then 1.0::double else 0.0::double end) as c from f2 group by question_id)")
def _(spark, sf):
    def lenient(answer, gold):
        return F.coalesce(grading.grade_exact(answer, gold) | (answer == "A"), F.lit(False))

    return composites.evaluated(fx.f2(spark, sf), lenient).select(r4("correct_frac").alias("correct_frac"))
