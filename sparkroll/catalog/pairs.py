"""Join, pair and greedy-selection queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, feistel_sql, pick_sql, query, r4
from sparkroll.catalog.evaluation import REWARDED, rewarded
from sparkroll.operators import containment, pairs
from sparkroll.operators.sampling import rank_by_hash, seeded
from sparkroll.skew import rank_in_group

SEED = 17


@query("enrich_left_join", "f12", """select question_id, bank_key, c_name as answer_value, c_mktsegment as alias, c_custkey is not null as found
from f12 left join customer on bank_key = c_custkey""")
def _(spark, sf):
    bank = fx.table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_name").alias("value"), F.array("c_mktsegment").alias("aliases")).alias("answer"))
    joined = pairs.enrich_left_join(fx.f12(spark, sf).select("question_id", "bank_key"), bank, "bank_key", "c_custkey")
    return joined.select("question_id", "bank_key", F.col("answer.value").alias("answer_value"), F.try_element_at(F.col("answer.aliases"), F.lit(1)).alias("alias"), F.col("c_custkey").isNotNull().alias("found"))


PAIRS = REWARDED + f""", s as (select question_id, rollout_idx, reward >= 0.5 as acc, row_number() over (partition by question_id, reward >= 0.5 order by rollout_idx) - 1 as p from r),
n as (select question_id, count(*) filter (where acc) as a, count(*) filter (where not acc) as b from s group by question_id having a > 0 and b > 0),
h as (select *, a * b as size, least(a * b, 4) as k, {feistel_sql(f"'{SEED}'", 'question_id', 'a * b')} from n),
i as (select question_id, b, {pick_sql('j', 'size')} as pair from (select *, unnest(range(k)) as j from h)),
dp as (select i.question_id, pair, x.rollout_idx as accept_idx, y.rollout_idx as reject_idx from i join s x on x.question_id = i.question_id and x.acc and x.p = pair // b
 join s y on y.question_id = i.question_id and not y.acc and y.p = pair % b)
"""


@query("dpo_pairs", "f1 f2", PAIRS + "select * from dp")
def _(spark, sf):
    return pairs.dpo_pairs(rewarded(spark, sf), threshold=0.5, max_pairs=4, seed=SEED)


@query("pairs_i_lt_j", "f1 f2", """select a.question_id, count(*) as pairs, count(*) filter (where a.answer = b.answer) as agreeing_pairs
from f2 a join f2 b on a.question_id = b.question_id and a.rollout_idx < b.rollout_idx group by a.question_id""")
def _(spark, sf):
    return pairs.pair_statistics(fx.f2(spark, sf), ["question_id"], "answer").where("pairs > 0")


@query("action_ranking_accuracy", "f8b", """select round(avg(((a.gt_value - b.gt_value) * (a.pred_value - b.pred_value) > 0)::int::double), 6) as ranking_accuracy, count(*) as comparisons
from f8b a join f8b b on a.state_id = b.state_id and a.action < b.action""")
def _(spark, sf):
    return pairs.action_ranking_accuracy(fx.f8b(spark, sf)).select(F.round("ranking_accuracy", 6).alias("ranking_accuracy"), "comparisons")


@query("attach_source_row", "f9", "select doc_id, min(item_id) as item_id from f9 join benchmark on contains(solution, text) group by doc_id")
def _(spark, sf):
    problems = fx.table(spark, sf, "benchmark")
    return containment.attach_source_row(fx.f9(spark, sf), "doc_id", "solution", problems, "item_id", "text")


@query("token_budget_pack", "f6", """with recursive i as (select conv_id, row_number() over (partition by conv_id order by turn) as p, turn, length(response_text) // 5 as cost from f6),
w as (select conv_id, p, turn, cost, case when cost <= 150 then cost else 0 end as used, cost <= 150 as ok from i where p = 1
  union all select i.conv_id, i.p, i.turn, i.cost, case when w.used + i.cost <= 150 then w.used + i.cost else w.used end, w.used + i.cost <= 150 from w join i on i.conv_id = w.conv_id and i.p = w.p + 1)
select conv_id, turn, cost from w where ok""")
def _(spark, sf):
    items = fx.f6(spark, sf).select("conv_id", "turn", F.floor(F.length("response_text") / 5).cast("bigint").alias("cost"))
    return pairs.token_budget_pack(items, ["conv_id"], "turn", "cost", 150)


@query("bleu_rejection_select")
def _(spark, sf):
    ranked = rank_in_group(fx.f6(spark, sf), ["conv_id"], [F.col("turn")], "idx")
    return pairs.bleu_rejection_select(ranked, "conv_id", "idx", "response_text", k=3, threshold=0.05, final=F.col("idx") >= 3).select("conv_id", "idx")


@query("distinct_next_actions", "", "select o_custkey as state_id, o_orderpriority as action, row_number() over (partition by o_custkey order by o_orderpriority) - 1 as action_idx from (select distinct o_custkey, o_orderpriority from orders)")
def _(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("state_id"), F.col("o_orderpriority").alias("action"))
    return pairs.distinct_actions(rows)


@query("min_actions_filter", "f8b", "select state_id, action from f8b where state_id in (select state_id from f8b group by state_id having count(distinct action) >= 4)")
def _(spark, sf):
    return pairs.min_actions_filter(fx.f8b(spark, sf), 4).select("state_id", "action")


@query("state_action_requests", "f8b", f"""select state_id, action, concat('S', state_id::varchar, ' -> ', action) as request_text,
  row_number() over (order by md5(concat('{SEED}|', state_id::varchar, '|', action)), state_id, action) - 1 as request_id from f8b""")
def _(spark, sf):
    rows = fx.f8b(spark, sf).select("state_id", "action", F.concat(F.lit("S"), F.col("state_id").cast("string"), F.lit(" -> "), "action").alias("request_text"))
    return rank_by_hash(rows.withColumn("__h", seeded(SEED, "state_id", "action")), "__h", ["state_id", "action"], "request_id").drop("__h")
