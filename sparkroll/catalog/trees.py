"""Reasoning-tree and path queries."""

from pyspark.sql import functions as F

from sparkroll import fixtures as fx
from sparkroll.catalog.base import big, query, r9
from sparkroll.functions.arrays import let
from sparkroll.functions.text import TOKEN, token_spans
from sparkroll.operators import paths as pp
from sparkroll.operators import trees
from sparkroll.plugins import row_generator

DEPTH, BRANCH, SEED = 3, 4, 17
FIELDS = ["node_id", "depth", "answer", "is_correct", "score"]

# the oracle side: scores by three explicit levels, ancestors by recursion
SCORES = """with recursive s3 as (select *, case when answer is not null then is_correct::double else 0 end as score from f4 where depth = 3),
s2 as (select n.*, coalesce(c.m, 0) as score from f4 n left join (select parent_id, avg(score) as m from s3 group by parent_id) c on n.node_id = c.parent_id where n.depth = 2),
s1 as (select n.*, coalesce(c.m, 0) as score from f4 n left join (select parent_id, avg(score) as m from s2 group by parent_id) c on n.node_id = c.parent_id where n.depth = 1),
s0 as (select n.*, coalesce(c.m, 0) as score from f4 n left join (select parent_id, avg(score) as m from s1 group by parent_id) c on n.node_id = c.parent_id where n.depth = 0),
s as (select * from s3 union all select * from s2 union all select * from s1 union all select * from s0),
sa as (select s.*, s.score - p.score as advantage, case when s.depth < 3 then pow(4, 3 - s.depth) else 1 end::double as weight from s left join s p on s.parent_id = p.node_id),
"""
CHAINS = SCORES + """anc as (
  select node_id as leaf_id, node_id, parent_id from sa where {which}
  union all select anc.leaf_id, sa.node_id, sa.parent_id from anc join sa on anc.parent_id = sa.node_id),
c as (select anc.leaf_id, sa.tree_id, sa.node_id, sa.depth as pos, sa.answer, sa.is_correct, sa.score, sa.advantage, sa.weight,
        max(sa.depth) over (partition by anc.leaf_id) as last_pos from anc join sa on anc.node_id = sa.node_id),
k as (select leaf_id, list(node_id order by pos) as path_key from c group by leaf_id)
"""
PATHS = CHAINS.format(which="not expanded")
NODES = CHAINS.format(which="depth > 0")
ALL_NODES = CHAINS.format(which="true")
SUMMARY = """select tree_id, leaf_id, count(*) as nodes, round(coalesce(sum(advantage), 0), 9) as advantages, round(sum(score), 9) as scores, max(pos) as end_pos from {src} group by tree_id, leaf_id"""


def oracle(sql, base=PATHS):
    # a recursive term needs the keyword on the first WITH of the statement
    return base + sql


def nodes(spark, sf):
    return fx.f4(spark, sf)


def scored(spark, sf):
    return trees.tree_score(nodes(spark, sf))


def chained(spark, sf):
    return trees.chains(scored(spark, sf), DEPTH, FIELDS, BRANCH)


def paths(spark, sf):
    return trees.chains(scored(spark, sf), DEPTH, FIELDS, BRANCH, wanted=~F.col("expanded"))


def summary(df):
    chain = F.col("chain")

    def total(field):
        return F.aggregate(chain, F.lit(0.0), lambda acc, n: acc + F.coalesce(n[field], F.lit(0.0)))

    return df.select(
        "tree_id", F.col("node_id").alias("leaf_id"), big(F.size(chain)).alias("nodes"), r9(total("advantage")).alias("advantages"),
        r9(total("score")).alias("scores"), big(F.size(chain) - 1).alias("end_pos"))


def tree_query(key, sql, base=PATHS, fixtures="f1 f2 f4"):
    return query(key, fixtures, oracle(sql, base))


@tree_query("tree_score", "select tree_id, node_id, round(score, 9) as score from s", SCORES.rstrip().rstrip(",") + " ")
def _(spark, sf):
    return scored(spark, sf).select("tree_id", "node_id", r9("score").alias("score"))


GRADED = SCORES.rstrip().rstrip(",").replace("is_correct::double", "(answer in ('A', 'R'))::int::double") + " "


@tree_query("tree_score_graded", "select tree_id, node_id, round(score, 9) as score from s", GRADED)
def _(spark, sf):
    grade = F.col("answer").isin("A", "R")
    return trees.tree_score(nodes(spark, sf), grade).select("tree_id", "node_id", r9("score").alias("score"))


@tree_query("tree_advantage", "select tree_id, node_id, round(score, 9) as score, round(advantage, 9) as advantage from sa", SCORES.rstrip().rstrip(",") + " ")
def _(spark, sf):
    df = trees.tree_advantage(chained(spark, sf))
    return df.select("tree_id", "node_id", r9("score").alias("score"), r9("advantage").alias("advantage"))


@tree_query("tree_paths", "select c.tree_id, c.leaf_id, array_to_string(min(path_key), '/') as path, count(*) as nodes from c join k using (leaf_id) group by c.tree_id, c.leaf_id")
def _(spark, sf):
    df = paths(spark, sf)
    return df.select("tree_id", F.col("node_id").alias("leaf_id"), F.array_join("path_key", "/").alias("path"), big(F.size("chain")).alias("nodes"))


@tree_query("tree_paths_repeated", "select tree_id, leaf_id, unnest(range(weight::bigint)) as copy from c where pos = last_pos")
def _(spark, sf):
    df = trees.tree_paths_repeated(paths(spark, sf), BRANCH, DEPTH)
    return df.select("tree_id", F.col("node_id").alias("leaf_id"), big("copy").alias("copy"))


@tree_query("tree_importance_weight", "select tree_id, node_id, weight from sa", SCORES.rstrip().rstrip(",") + " ")
def _(spark, sf):
    weight = trees.importance_weight(F.col("depth"), BRANCH, DEPTH)
    return fx.f4(spark, sf).select("tree_id", "node_id", weight.alias("weight"))


@tree_query("state_action_paths", "select tree_id, leaf_id, count(*) as nodes, greatest(pow(4, 3 - max(pos)), 1)::double as path_weight, round(max_by(score, pos), 9) as score from c group by tree_id, leaf_id", NODES)
def _(spark, sf):
    df = trees.state_action_paths(scored(spark, sf), DEPTH, FIELDS, BRANCH)
    return df.select("tree_id", F.col("node_id").alias("leaf_id"), big(F.size("chain")).alias("nodes"), "path_weight", r9(F.element_at("chain", -1)["score"]).alias("score"))


@tree_query("state_action_paths_sampled", f""", y as (select node_id from f4 where depth = 1 qualify row_number() over (partition by tree_id order by md5(concat('{SEED}|', tree_id::varchar, '|', node_id)), node_id) <= 2)
select tree_id, leaf_id from c where pos = 1 and node_id in (select node_id from y)""", NODES)
def _(spark, sf):
    df = trees.state_action_paths(scored(spark, sf), DEPTH, FIELDS, BRANCH, first_children=2, seed=SEED)
    return df.select("tree_id", F.col("node_id").alias("leaf_id"))


PATH_FILTERS = {
    "none": "true",
    "successful": "bool_or(pos = last_pos and answer is not null and is_correct = 1)",
    "non_zero_score": "bool_or(pos = 1 and score > 0)",
    "non_zero_last_step_score": "bool_or(pos = last_pos and score > 0)",
    "zero_last_step_score": "bool_or(pos = last_pos and score = 0)",
    "non_zero_last_step_advantage": "bool_or(pos = last_pos and advantage > 1e-9)",
}


def _register_filter(name, having):
    @tree_query(f"path_filter_{name}", f"select tree_id, leaf_id from c group by tree_id, leaf_id having {having}")
    def _(spark, sf):
        chain = paths(spark, sf)
        if name == "non_zero_last_step_advantage":
            # the two engines differ in the last bit of an advantage of 0
            rounded = F.transform("chain", lambda n: n.withField("advantage", F.round(n["advantage"], 12)))
            chain = chain.withColumn("chain", rounded)
        return chain.where(pp.filters[name](F.col("chain"))).select("tree_id", F.col("node_id").alias("leaf_id"))


for _name, _having in PATH_FILTERS.items():
    _register_filter(_name, _having)

# each rewrite as SQL over the long form `c`; advantages are rounded so that both engines see the same zeros
C9 = ", c9 as (select leaf_id, tree_id, pos, last_pos, answer, is_correct, score, round(advantage, 12) as advantage, weight from c)"
REWRITES = {
    "chop_zero_advantage_tail": "select * from c9 qualify pos <= coalesce(max(case when pos >= 1 and abs(advantage) >= 1e-6 then pos end) over (partition by leaf_id), 0)",
    "keep_first_step_only": "select * from c9 where pos < 2",
    "chop_up_to_first_negative_advantage": "select * from c9 qualify pos < coalesce(min(case when pos >= 1 and advantage < 0 then pos end) over (partition by leaf_id), 99)",
    "all_advantages_to_one": "select * replace (case when advantage is not null then 1.0::double end as advantage) from c9",
    "zero_advantages_to_epsilon": "select * replace (case when advantage = 0 then 0.05::double else advantage end as advantage) from c9",
    "negative_advantages_to_zero": "select * replace (case when advantage < 0 then 0 else advantage end as advantage) from c9",
    "non_last_nodes_score_to_zero": "select * replace (case when pos < last_pos then 0 else score end as score) from c9",
    "non_last_nodes_advantage_to_zero": "select * replace (case when pos < last_pos and advantage is not null then 0 else advantage end as advantage) from c9",
    "fill_advantage_from_score": "select * replace (case when pos >= 1 then score else advantage end as advantage) from c9",
    "apply_importance_weights": "select * replace (advantage * weight as advantage) from c",
    "last_step_advantage_to_one": "select * replace (case when pos = last_pos then 1.0::double else advantage end as advantage) from c9",
}


def rounded_paths(spark, sf):
    twelve = F.transform("chain", lambda n: n.withField("advantage", F.round(n["advantage"], 12)))
    return paths(spark, sf).withColumn("chain", twelve)


def _register_rewrite(name, sql):
    @tree_query(f"pp_{name}", C9 + f", z as ({sql}) " + SUMMARY.format(src="z"))
    def _(spark, sf):
        # weights would multiply the rounding, and no zero is tested here
        source = paths if name == "apply_importance_weights" else rounded_paths
        return summary(source(spark, sf).withColumn("chain", pp.post_processors[name](F.col("chain"))))


for _name, _sql in REWRITES.items():
    _register_rewrite(_name, _sql)


@tree_query("drop_query_only_paths", C9 + f", z as ({REWRITES['chop_zero_advantage_tail']}) select tree_id, leaf_id, count(*) as nodes from z group by all having count(*) > 1")
def _(spark, sf):
    chopped = rounded_paths(spark, sf).withColumn("chain", pp.chop_zero_advantage_tail(F.col("chain")))
    return pp.drop_query_only(chopped).select("tree_id", F.col("node_id").alias("leaf_id"), big(F.size("chain")).alias("nodes"))


@tree_query("path_unique", C9 + """, u as (select leaf_id, tree_id, list([pos::varchar, coalesce(answer, '-'), coalesce(is_correct::varchar, '-'), (round(score, 12) + 0.0::double)::varchar, coalesce((advantage + 0.0::double)::varchar, '-')] order by pos) as content from c9 group by all),
r as (select *, row_number() over (partition by tree_id, content order by path_key) as rn from u join k using (leaf_id))
select tree_id, leaf_id from r where rn = 1""")
def _(spark, sf):
    twelve = F.transform("chain", lambda n: n.withField("score", F.round(n["score"], 12)))
    return pp.unique(rounded_paths(spark, sf).withColumn("chain", twelve)).select("tree_id", F.col("node_id").alias("leaf_id"))


TOP = """, v as (select leaf_id, tree_id, round(coalesce(sum(advantage), 0) / {div}, 9) as v from c group by leaf_id, tree_id),
r as (select *, row_number() over (partition by tree_id order by v desc, path_key) as rn, count(*) over (partition by tree_id) as n from v join k using (leaf_id))
select tree_id, leaf_id from r where rn <= greatest(floor(n * 0.1::double), 1)"""


@tree_query("path_top_k_percent", TOP.format(div="count(*)"))
def _(spark, sf):
    return pp.top_k_percent(paths(spark, sf), 0.1).select("tree_id", F.col("node_id").alias("leaf_id"))


@tree_query("path_top_k_percent_sum", TOP.format(div="1"))
def _(spark, sf):
    return pp.top_k_percent(paths(spark, sf), 0.1, reduction="sum").select("tree_id", F.col("node_id").alias("leaf_id"))


@tree_query("path_max_k", f""", r as (select tree_id, c.leaf_id, row_number() over (partition by tree_id order by md5(concat('{SEED}|', tree_id::varchar, '|', array_to_string(path_key, '/'))), array_to_string(path_key, '/')) as rn
from c join k using (leaf_id) where pos = last_pos) select tree_id, leaf_id from r where rn <= 3""")
def _(spark, sf):
    return pp.max_k(paths(spark, sf), 3, SEED).select("tree_id", F.col("node_id").alias("leaf_id"))


STRATEGY = C9 + """, ok as (select leaf_id from c9 where pos = last_pos and answer is not null and is_correct = 1),
e as (select c9.leaf_id, tree_id, pos, case when advantage = 0 then 0.05::double when advantage < 0 then 0 else advantage end as advantage, score from c9 join ok using (leaf_id)),
v as (select leaf_id, tree_id, round(coalesce(sum(advantage), 0) / count(*), 9) as v from e group by leaf_id, tree_id),
r as (select *, row_number() over (partition by tree_id order by v desc, path_key) as rn, count(*) over (partition by tree_id) as n from v join k using (leaf_id)),
z as (select e.* from e join r using (leaf_id) where rn <= greatest(floor(n * 0.1::double), 1))
"""


def top_tenth(spark, sf):
    """Successful paths, epsilon and clamp, best tenth of each tree."""
    return pp.path_strategy(rounded_paths(spark, sf), ["successful"], [("zero_advantages_to_epsilon", {"epsilon": 0.05}), "negative_advantages_to_zero"], [("top_k_percent", {"top_k_percent": 0.1})])


@tree_query("path_strategy", STRATEGY + SUMMARY.format(src="z"))
def _(spark, sf):
    return summary(top_tenth(spark, sf))


@tree_query("tree_candidate_answers", "select tree_id, leaf_id as node_id, answer, row_number() over (partition by tree_id order by path_key) - 1 as pos from c join k using (leaf_id) where pos = last_pos and answer is not null", ALL_NODES)
def _(spark, sf):
    return trees.candidate_answers(chained(spark, sf)).select("tree_id", "node_id", "answer", "pos")


LP = "case when depth >= 2 then length(node_id) * -0.5::double end"


@query("tree_candidate_logprobs", "f1 f2 f4", f"""select n.tree_id, n.node_id, length(n.node_id) * -0.5::double + coalesce(length(p.node_id) * -0.5::double, 0) as sum_logprob
from f4 n join f4 p on n.parent_id = p.node_id where n.answer is not null""")
def _(spark, sf):
    logprob = F.when(F.col("depth") >= 2, F.length("node_id") * -0.5)
    priced = nodes(spark, sf).withColumn("sum_logprobs", logprob)
    return trees.candidate_logprobs(trees.chains(priced, DEPTH, ["node_id", "sum_logprobs"]), "sum_logprobs")


@query("tree_candidate_num_tokens", "f1 f2 f4", f"select tree_id, node_id, len(regexp_extract_all(node_id || ': ' || answer, '{TOKEN}')) as num_tokens from f4 where answer is not null")
def _(spark, sf):
    from sparkroll.functions.text import tokens

    answered = fx.f4(spark, sf).where("answer is not null")
    return answered.select("tree_id", "node_id", big(F.size(tokens(F.concat("node_id", F.lit(": "), "answer")))).alias("num_tokens"))


@query("branch_factor", "f1 f2 f4", """select tree_id, node_id, 5::bigint as constant, case when depth >= 2 then 1 when depth >= 1 then 3 else 8 end::bigint as by_depth, case when expanded then 6 else 1 end::bigint as by_spine from f4""")
def _(spark, sf):
    d = F.col("depth")
    return fx.f4(spark, sf).select(
        "tree_id", "node_id", big(trees.branch_factor(d, constant=5)).alias("constant"), big(trees.branch_factor(d, steps=[(0, 8), (1, 3), (2, 1)])).alias("by_depth"),
        big(trees.branch_factor(d, spine=(F.col("expanded"), 6))).alias("by_spine"))


def grown(spark, sf, steps, max_depth):
    roots = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("tree_id"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("child_idx"), F.col("c_name").alias("text"), F.col("c_name").alias("full_text"), F.lit(False).alias("closed"))
    generator = row_generator(lambda prefix, i: f" step {len(prefix) % 7 + i}.", lambda text: text.endswith("9."))
    return trees.expand_frontier(roots, generator, lambda depth: trees.branch_factor(depth, steps=steps), max_depth)


@query("expand_frontier")
def _(spark, sf):
    return grown(spark, sf, [(0, 3), (1, 2)], 2)


@query("cot_expand")
def _(spark, sf):
    return grown(spark, sf, [(0, 4), (1, 1)], 2)


@query("tree_from_json", "f1 f2 f4", "select tree_id, node_id, parent_id, depth, expanded, answer from f4")
def _(spark, sf):
    """The texts of the documents are the ids of the nodes they were made of."""
    rows = trees.tree_from_json(trees.tree_to_json(nodes(spark, sf)), "tree")
    above = rows.select("tree_id", F.col("node_id").alias("parent_id"), F.col("text").alias("above"))
    return rows.join(above, ["tree_id", "parent_id"], "left").select("tree_id", F.col("text").alias("node_id"), F.col("above").alias("parent_id"), "depth", "expanded", "answer")


def _json_level(depth):
    """SQL of the documents of one level, over those of the level below."""
    below = f"(select parent_id, '[' || string_agg(doc, ', ' order by node_id) || ']' as kids from d{depth + 1} group by parent_id)" if depth < DEPTH else "(select null::varchar as parent_id, null::varchar as kids)"
    return f"""d{depth} as (select n.tree_id, n.node_id, n.parent_id, '{{' || concat_ws(', ', '"answer": ' || to_json(n.answer)::varchar, case when n.expanded then '"children": ' || coalesce(c.kids, '[]') end,
  '"depth": {depth}', '"text": ' || to_json(n.node_id)::varchar) || '}}' as doc from f4 n left join {below} c on n.node_id = c.parent_id where n.depth = {depth})"""


@query("tree_to_json", "f1 f2 f4", "with " + ", ".join(_json_level(d) for d in range(DEPTH, -1, -1)) + " select tree_id, doc as tree from d0")
def _(spark, sf):
    return trees.tree_to_json(nodes(spark, sf))


TEXT_SQL = """case when depth = 3 then 'the answer of this step is ' || coalesce(answer, 'x') || ' with score ' || is_correct::varchar else 'step ' || substr(node_id, 1, 1) || ' of tree ' || (tree_id % 7)::varchar || ' has ' || length(node_id)::varchar || ' letters' end"""


def texted(spark, sf):
    leaf = F.concat(F.lit("the answer of this step is "), F.coalesce("answer", F.lit("x")), F.lit(" with score "), F.col("is_correct").cast("string"))
    inner = F.concat(F.lit("step "), F.substring("node_id", 1, 1), F.lit(" of tree "), (F.col("tree_id") % 7).cast("string"), F.lit(" has "), F.length("node_id").cast("string"), F.lit(" letters"))
    return nodes(spark, sf).withColumn("text", F.when(F.col("depth") == 3, leaf).otherwise(inner))


def _bleu_sql():
    from sparkroll.catalog.evaluation import BLEU_SQL

    return f"with m as (select tree_id::varchar || '|' || parent_id || '|' || depth::varchar as gid, row_number() over (partition by tree_id, parent_id order by node_id) - 1 as idx, {TEXT_SQL} as txt from f4 where parent_id is not null)" + BLEU_SQL + """
, b as (select split_part(gid, '|', 1) as tree_id, split_part(gid, '|', 3) as depth, bleu from bleu),
d as (select tree_id, depth, sum(bleu) as s, count(*) as n from b group by all), t as (select tree_id, sum(s) / sum(n) as mean, avg(s / n) as by_depth from d group by tree_id)
select round(avg(mean), 9) as avg_tree_bleu, round(avg(by_depth), 9) as avg_tree_bleu_depth_normalized, count(*) as trees from t"""


@query("tree_bleu", "f1 f2 f4", _bleu_sql())
def _(spark, sf):
    _, averages = trees.tree_bleu(texted(spark, sf), "text")
    return averages.select(r9("avg_tree_bleu").alias("avg_tree_bleu"), r9("avg_tree_bleu_depth_normalized").alias("avg_tree_bleu_depth_normalized"), "trees")


EPISODE = """, x as (select leaf_id, pos, last_pos, answer, is_correct, advantage, case when pos = 0 then '' else chr(10) || 'step ' || node_id || '.' end as txt, row_number() over () as r from c),
o as (select *, coalesce(sum(length(txt)) over (partition by leaf_id order by pos rows between unbounded preceding and 1 preceding), 0) as char_start from x),
f as (select leaf_id, string_agg(txt, '' order by pos) as response, max(last_pos) as last_pos, bool_or(pos = last_pos and is_correct = 1) as success, bool_or(pos = last_pos and answer is not null) as finished from x group by leaf_id)
select c.tree_id, f.leaf_id, length(response) as response_chars, len(regexp_extract_all(response, '{tok}')) + (case when finished then 1 else 0 end) as num_tokens, case when success then 1.0::double else 0.0::double end as reward,
  round(sum(coalesce(o.advantage, 0) * len(regexp_extract_all(o.txt, '{tok}'))) + sum(case when finished and o.pos = o.last_pos then o.advantage else 0 end), 9) as advantages
from f join o using (leaf_id) join (select distinct leaf_id, tree_id from c) c using (leaf_id) group by all""".replace("{tok}", TOKEN)


def multi_step_episodes(path_rows):
    """Tokens of the joined step texts, each with the advantage of the node that holds its first character."""
    chain = F.col("chain")
    steps = F.transform(F.slice(chain, F.lit(2), F.size(chain)), lambda n: F.struct(F.concat(F.lit("\nstep "), n["node_id"], F.lit(".")).alias("text"), n["advantage"].alias("advantage")))
    rows = path_rows.withColumn("steps", steps)
    response = F.array_join(F.transform("steps", lambda s: s["text"]), "")
    rows = rows.withColumns({"response": response, "spans": token_spans(response)})
    # at most max_depth borders: the first step whose end lies behind the token's start
    ends = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.aggregate(F.slice("steps", F.lit(1), i), F.lit(0), lambda acc, s: acc + F.length(s["text"])))
    rows = rows.withColumn("ends", ends)
    bound = F.struct("steps", "ends")
    token_advantages = let(bound, lambda b: F.transform("spans", lambda t: F.element_at(b["steps"], F.size(F.filter(b["ends"], lambda e: e <= t["start"])) + 1)["advantage"]))
    finished = F.element_at(chain, -1)["answer"].isNotNull()
    body = rows.withColumn("advantages", token_advantages)
    with_eos = F.when(finished, F.concat("advantages", F.array(F.element_at("advantages", -1)))).otherwise(F.col("advantages"))
    return body.withColumns({"advantages": with_eos, "reward": F.when(pp.successful(chain), 1.0).otherwise(0.0)})


@tree_query("tree_multi_step_episode", EPISODE)
def _(spark, sf):
    df = multi_step_episodes(paths(spark, sf))
    return df.select(
        "tree_id", F.col("node_id").alias("leaf_id"), big(F.length("response")).alias("response_chars"), big(F.size("advantages")).alias("num_tokens"), "reward",
        r9(F.aggregate("advantages", F.lit(0.0), lambda acc, a: acc + a)).alias("advantages"))


@tree_query("tree_single_hop_episode", """, z as (select tree_id, leaf_id, array_agg(node_id order by pos) as ids, bool_or(pos = 1 and answer is not null) as answered, round(max(score) filter (where pos = 1), 9) as first_score from c where pos < 2 group by all), y as (select *, case when first_score > 0.5 then ' # Answer ' else ' ' end || ids[2] as response from z)
select tree_id, leaf_id, 'from ' || ids[1] || case when first_score > 0.5 then ' # Answer ' else ' ' end || ids[2] as full_text, first_score <= 0.5 as chopped, 0.0::double as reward, len(regexp_extract_all(response, '""" + TOKEN + """')) as num_advantages from y""")
def _(spark, sf):
    two = paths(spark, sf).withColumn("chain", pp.keep_first_step_only(F.col("chain")))
    first, second = F.col("chain")[0], F.col("chain")[1]
    score = r9(second["score"])
    query_text = F.concat(F.lit("from "), first["node_id"])
    full = F.concat(query_text, F.when(score > 0.5, " # Answer ").otherwise(" "), second["node_id"])
    response = F.substring(full, F.length(query_text) + 1, F.length(full))
    from sparkroll.functions.text import tokens

    return two.select("tree_id", F.col("node_id").alias("leaf_id"), full.alias("full_text"), (~response.contains("# Answer")).alias("chopped"),
                      F.when(pp.successful(F.col("chain")), 1.0).otherwise(0.0).alias("reward"), big(F.size(F.array_repeat(F.lit(1.0), F.size(tokens(response))))).alias("num_advantages"))
