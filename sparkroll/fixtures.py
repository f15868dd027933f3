"""The data shapes every catalogue query starts from, as views over the given tables.

`SQL` is the text both engines run. The shapes that number rows inside a group,
and the trees that hold a negated IN, are built from joins and skew-safe ranks
instead when Spark reads them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroll.session import cut_for, tune
from sparkroll.skew import neighbour, rank_in_group, running, with_group_stats


SQL = {
    "f1": """
select o_orderkey as question_id,
       case o_orderstatus when 'F' then 'R' when 'O' then 'N' else 'A' end as gold,
       case when o_custkey % 10 = 0 then 'test' else 'train' end as split
from orders
""",
    "f2": """
select l_orderkey as question_id,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as bigint) as rollout_idx,
       case when l_quantity <= 3 then null else l_returnflag end as answer,
       case when l_tax >= 0.07 then 'length' else 'stop' end as finish_reason,
       cast(l_quantity as bigint) as num_tokens,
       -l_extendedprice / 100000 as sum_logprob,
       f1.gold as gold
from lineitem join f1 on l_orderkey = f1.question_id
""",
    "f3": """
with e as (
  select user_id * 10 + cast(floor((day(ts) - 1) / 10) as bigint) as traj_id, user_id, event_id, ts, event_type, value,
         concat(event_type, ' ', cast(event_id as string), '.') as step_text
  from events),
s as (
  select traj_id, user_id, event_type, value, step_text,
         cast(row_number() over (partition by traj_id order by ts, event_id) - 1 as bigint) as step_idx,
         cast(count(*) over (partition by traj_id) as bigint) as num_steps,
         cast(sum(length(step_text)) over (partition by traj_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as char_end
  from e)
select traj_id, step_idx, num_steps, step_text,
       char_end - cast(length(step_text) as bigint) as char_start, char_end,
       case when user_id % 3 = 0 and step_idx >= num_steps - 2 then null else value / 500 end as value_est,
       case when step_idx = num_steps - 1 and event_type = 'purchase' then cast(1 as double) else cast(0 as double) end as step_reward
from s
""",
    "f4": """
select c_custkey as tree_id, concat('C', cast(c_custkey as string)) as node_id, cast(null as string) as parent_id,
       cast(0 as bigint) as depth, true as expanded, cast(null as string) as answer, cast(null as bigint) as is_correct
from customer where c_custkey in (select o_custkey from orders)
union all
select distinct o_custkey, concat('Y', cast(o_custkey as string), '.', cast(year(o_orderdate) as string)),
       concat('C', cast(o_custkey as string)), cast(1 as bigint), true, cast(null as string), cast(null as bigint)
from orders
union all
select o_custkey, concat('O', cast(o_orderkey as string)),
       concat('Y', cast(o_custkey as string), '.', cast(year(o_orderdate) as string)), cast(2 as bigint),
       o_orderkey in (select l_orderkey from lineitem), cast(null as string), cast(null as bigint)
from orders
union all
select o_custkey, concat('L', cast(f2.question_id as string), '.', cast(f2.rollout_idx as string)),
       concat('O', cast(o_orderkey as string)), cast(3 as bigint), false, coalesce(f2.answer, ''),
       cast(case when f2.answer = f2.gold then 1 else 0 end as bigint)
from f2 join orders on f2.question_id = o_orderkey
""",
    "f6": """
select conv_id, turn, query_text, response_text, concat(query_text, response_text) as full_text
from (select conv_id, turn, role, lag(text) over (partition by conv_id order by turn) as query_text, text as response_text
      from conversations) p
where role = 'assistant' and query_text is not null
""",
    "f7": """
select l_orderkey as episode_id, t, t > 0 as is_action,
       -(l_discount + 0.01) as actor_lp, -(l_discount + l_tax + 0.01) as new_lp, -(l_tax + 0.02) as ref_lp,
       l_quantity / 50 as value, l_discount - 0.05 as advantage,
       case when l_returnflag = 'R' then cast(1 as double) else cast(0 as double) end as score,
       l_orderkey % 64 as batch_id
from (select l_orderkey, l_discount, l_tax, l_quantity, l_returnflag,
             cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as bigint) as t
      from lineitem) x
""",
    "f8": """
select vec_id, dim, x::double as x, x::double + (vec_id % 2) * 0.125::double as y
from (select vec_id, unnest(range(len(embedding))) as dim, unnest(embedding) as x from embeddings) e
""",
    "f8b": """
select o_custkey as state_id, o_orderpriority as action,
       avg(case when o_orderstatus = 'F' then cast(1 as double) else cast(0 as double) end) as gt_value,
       avg(o_totalprice) as pred_value, count(*) as n
from orders group by o_custkey, o_orderpriority
""",
    "f9": """
select documents.doc_id, documents.text as solution, documents.source, cast(labels.quality as double) as target_prob
from documents left join labels on documents.doc_id = labels.doc_id
""",
    "f10": """
select cast(year(o_orderdate) as bigint) as iteration, cast(month(o_orderdate) as bigint) as step,
       concat('ckpt--iter_', cast(year(o_orderdate) as string), '--epoch_1--step_', cast(month(o_orderdate) as string)) as name,
       avg(case when o_orderstatus = 'F' then cast(1 as double) else cast(0 as double) end) as accuracy
from orders group by year(o_orderdate), month(o_orderdate)
""",
    "f11": """
select event_id, case when event_type = 'error' then concat('ERROR worker ', cast(user_id as string))
  else concat('INFO Avg generation throughput: ', cast(cast(floor(value) as bigint) as string), '.5 tokens/s, Running: ',
              cast(user_id as string), ' reqs, Pending: ', cast(user_id % 7 as string), ' reqs, GPU KV cache usage: ',
              cast(user_id % 100 as string), '.0%') end as line
from events
""",
    "f12": """
select o_orderkey as question_id, o_custkey as bank_key,
       case when o_orderkey % 17 = 0 then null when o_orderkey % 13 = 0 then 'not a list'
            else concat('["', o_orderstatus, '","', substr(o_orderpriority, 3), '","', o_orderstatus, '"]') end as answers_str,
       case when o_orderkey % 11 = 0 then '[0.5]' when o_orderkey % 7 = 0 then '[0.25,1.5,0.75]' else '[0.25,0.5,0.75]' end as probs_str
from orders
""",
    "f13": """
select cast(day(ts) as bigint) as iteration, event_id, value as score from events
""",
}

NEEDS = {"f2": ("f1",), "f4": ("f1", "f2")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return cut_for(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _plain(name: str, *tables: str):
    """A view without ordered groups: its SQL text runs as it is."""

    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {t: table(spark, sf_dir, t) for t in tables}
        text = SQL[name]
        return spark.sql(_with_placeholders(text, tables), **named)

    return load


def _with_placeholders(text: str, tables: tuple[str, ...]) -> str:
    """`from t` and `join t` become `{t} t`, which Spark fills with the DataFrame."""
    names = "|".join(sorted(tables, key=len, reverse=True))
    return re.sub(rf"\b(from|join) ({names})\b", r"\1 {\2} \2 ", text)


f1 = _plain("f1", "orders")
f8b = _plain("f8b", "orders")
f9 = _plain("f9", "documents", "labels")
f10 = _plain("f10", "orders")
f11 = _plain("f11", "events")
f12 = _plain("f12", "orders")
f13 = _plain("f13", "events")

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def _numbered_lines(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *dict.fromkeys([*LINE_ORDER, *cols]))
    return rank_in_group(lines, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], name)


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _numbered_lines(spark, sf_dir, "rollout_idx", "l_quantity", "l_returnflag", "l_tax")
    # a merge at every size: a few compressed MB of orders are a hundred in the driver, as a broadcast
    questions = f1(spark, sf_dir).select("question_id", "gold").hint("merge")
    return lines.join(questions, lines.l_orderkey == questions.question_id).select(
        "question_id",
        "rollout_idx",
        F.when(F.col("l_quantity") > 3, F.col("l_returnflag")).alias("answer"),
        F.when(F.col("l_tax") >= 0.07, "length").otherwise("stop").alias("finish_reason"),
        F.col("l_quantity").cast("bigint").alias("num_tokens"),
        (-F.col("l_extendedprice") / 100000).alias("sum_logprob"),
        "gold",
    )


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("bigint").alias("traj_id"),
        "user_id", "event_id", "ts", "event_type", "value",
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(".")).alias("step_text"),
    )
    key = ["traj_id"]
    steps = rank_in_group(steps, key, [F.col("ts"), F.col("event_id")], "step_idx")
    steps = with_group_stats(steps, key, {"num_steps": F.count(F.lit(1))})
    steps = running(steps.withColumn("len", F.length("step_text").cast("bigint")), key, "step_idx", {"char_end": ("sum", "len")})
    last = F.col("step_idx") == F.col("num_steps") - 1
    hidden = (F.col("user_id") % 3 == 0) & (F.col("step_idx") >= F.col("num_steps") - 2)
    return steps.select(
        "traj_id", "step_idx", "num_steps", "step_text",
        (F.col("char_end") - F.col("len")).alias("char_start"), "char_end",
        F.when(~hidden, F.col("value") / 500).alias("value_est"),
        F.when(last & (F.col("event_type") == "purchase"), 1.0).otherwise(0.0).alias("step_reward"),
    )


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trees. `expanded` comes from an outer join: the negated IN of the text would send every line's key to the driver; joins ask for a merge as in `f2`."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    customer, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    year = F.concat(F.lit("Y"), customer, F.lit("."), F.year("o_orderdate").cast("string"))
    above = F.concat(F.lit("O"), order)

    def rows(df: DataFrame, tree: str, node: Column, parent: Column | None, depth: int, expanded: Column, answer: Column | None = None, correct: Column | None = None) -> DataFrame:
        empty = F.lit(None)
        return df.select(
            F.col(tree).alias("tree_id"), node.alias("node_id"), (empty if parent is None else parent).cast("string").alias("parent_id"), F.lit(depth).cast("bigint").alias("depth"),
            expanded.alias("expanded"), (empty if answer is None else answer).cast("string").alias("answer"), (empty if correct is None else correct).cast("bigint").alias("is_correct"))

    roots = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")).hint("merge"), "c_custkey", "left_semi")
    # as IN has it: unknown for a null key, and for a missing one where lines have null keys
    unknown = lines.where(F.col("l_orderkey").isNull()).agg((F.count(F.lit(1)) > 0).alias("__unknown"))
    filled = lines.where(F.col("l_orderkey").isNotNull()).distinct().withColumnRenamed("l_orderkey", "__key").hint("merge")
    marked = orders.join(filled, F.col("o_orderkey") == F.col("__key"), "left").withColumn("__unknown", unknown.scalar())
    expanded = F.when(F.col("__key").isNotNull(), True).when(F.col("o_orderkey").isNotNull() & ~F.col("__unknown"), False)
    answered = f2(spark, sf_dir).join(orders.hint("merge"), F.col("question_id") == F.col("o_orderkey"))
    leaf = F.concat(F.lit("L"), F.col("question_id").cast("string"), F.lit("."), F.col("rollout_idx").cast("string"))
    return (
        rows(roots, "c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")), None, 0, F.lit(True))
        .unionByName(rows(orders, "o_custkey", year, F.concat(F.lit("C"), customer), 1, F.lit(True)).distinct())
        .unionByName(rows(marked, "o_custkey", above, year, 2, expanded))
        .unionByName(rows(answered, "o_custkey", leaf, above, 3, F.lit(False), F.coalesce("answer", F.lit("")), F.when(F.col("answer") == F.col("gold"), 1).otherwise(0))))


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ranked = rank_in_group(turns, ["conv_id"], [F.col("turn")], "__pos")
    paired = neighbour(ranked, ["conv_id"], "__pos", {"query_text": "text"}, offset=-1)
    return paired.where((F.col("role") == "assistant") & F.col("query_text").isNotNull()).select(
        "conv_id", "turn", "query_text", F.col("text").alias("response_text"), F.concat("query_text", "text").alias("full_text")
    )


def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _numbered_lines(spark, sf_dir, "t", "l_discount", "l_tax", "l_quantity", "l_returnflag")
    return lines.select(
        F.col("l_orderkey").alias("episode_id"),
        "t",
        (F.col("t") > 0).alias("is_action"),
        (-(F.col("l_discount") + 0.01)).alias("actor_lp"),
        (-(F.col("l_discount") + F.col("l_tax") + 0.01)).alias("new_lp"),
        (-(F.col("l_tax") + 0.02)).alias("ref_lp"),
        (F.col("l_quantity") / 50).alias("value"),
        (F.col("l_discount") - 0.05).alias("advantage"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("score"),
        (F.col("l_orderkey") % 64).alias("batch_id"),
    )


def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double")
    return vectors.select("vec_id", F.col("dim").cast("bigint").alias("dim"), x.alias("x"), (x + (F.col("vec_id") % 2) * 0.125).alias("y"))


def oracle(names: tuple[str, ...], sql: str) -> str:
    """DuckDB text: the named views as common table expressions in front of `sql`."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in (*NEEDS.get(name, ()), name) if n not in ordered]
    ctes = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in ordered)
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        rest = body[5:]
        recursive = "recursive " if rest.lower().startswith("recursive ") else ""
        return f"with {recursive}{ctes},\n{rest[len(recursive):]}"
    return f"with {ctes}\n{body}"
