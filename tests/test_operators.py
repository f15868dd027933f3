"""Hand-made tables with the edge cases of each operator, and brute force where SQL is no help."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkroll.functions import extraction, grading, normalize, steps, text
from sparkroll.operators import bleu, checkpoints, containment, credit, episodes, evaluation, fewshot, forecasting, logprobs, pairs, paths, sampling, trees
from sparkroll.plugins import Registry, model_score_batch, row_generator
from sparkroll.skew import rank_by_id
from sparkroll.sources import committed, readers, writers
from sparkroll.streaming import jobs, state


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


# ---- evaluation

def test_majority_vote_tie_goes_to_first_seen(spark):
    rows = [(1, 0, None, "A"), (1, 1, "A", "A"), (1, 2, "A", "A"), (1, 3, None, "A"), (2, 0, "B", "A"), (2, 1, "A", "A")]
    df = spark.createDataFrame(rows, "question_id int, rollout_idx int, answer string, gold string")
    got = {r["question_id"]: (r["majority_answer"], r["is_correct"]) for r in evaluation.majority_vote(df).collect()}
    assert got == {1: (None, False), 2: ("B", False)}


def test_mc_value_without_rollouts_is_zero(spark):
    requests = spark.createDataFrame([(1,), (2,)], "question_id int")
    rollouts = spark.createDataFrame([(1, "stop", 1.0), (1, "length", 1.0)], "question_id int, finish_reason string, reward double")
    got = {r["question_id"]: (r["value"], r["num_rollouts"]) for r in evaluation.mc_value(requests, rollouts, -1.0).collect()}
    assert got == {1: (0.0, 2), 2: (0.0, 0)}


def test_ci_outside_the_unit_interval_is_nan_and_stops(spark):
    df = spark.createDataFrame([(1, i, -1.0) for i in range(6)], "question_id int, rollout_idx int, reward double")
    assert evaluation.ci_stopping_point(df, 2, 2, 6, 0.0).first()["rollouts_needed"] == 2


def test_bleu_against_all_pairs(spark):
    rng = random.Random(4)
    words = "a b c d".split()
    members = [(g, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for g in range(12) for i in range(rng.randint(1, 5))]
    df = spark.createDataFrame(members, "g int, i int, t string")
    got = {r["g"]: r["bleu"] for r in bleu.group_bleu(df, ["g"], "i", "t").collect()}
    for g in range(12):
        texts = [t.split() for gg, _, t in members if gg == g]
        if len(texts) < 2:
            assert g not in got
            continue
        both = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
        assert got[g] == pytest.approx(corpus_bleu(both), abs=1e-9)


def corpus_bleu(both):
    import math

    logs = 0.0
    for n in range(1, 5):
        hit = possible = 0
        for a, b in both:
            ca, cb = pairs._counts(a, n), pairs._counts(b, n)
            hit += sum(min(c, cb.get(k, 0)) for k, c in ca.items())
            possible += max(len(a) - n + 1, 0)
        if not hit:
            return 0.0
        logs += math.log(hit / possible)
    pred, ref = sum(len(a) for a, _ in both), sum(len(b) for _, b in both)
    return math.exp(logs / 4) * (1.0 if pred > ref else math.exp(1 - ref / pred))


# ---- credit

def test_missing_values(spark):
    rows = [("t", 0, 4, 0.5, 0.0), ("t", 1, 4, 0.25, 0.0), ("t", 2, 4, None, 0.0), ("t", 3, 4, None, 1.0), ("gap", 0, 2, None, 0.0), ("gap", 1, 2, 0.5, 1.0), ("none", 0, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "traj_id string, step_idx bigint, num_steps bigint, value_est double, step_reward double")
    got = {(r["traj_id"], r["step_idx"]): (r["value"], r["advantage"]) for r in credit.mc_step_advantage(credit.fill_missing_values_tail(df)).collect()}
    assert got["t", 2] == (1.0, 0.0) and got["t", 1] == (0.25, 0.75) and got["t", 3] == (1.0, 0.0)
    assert got["gap", 0] == (None, None) and got["none", 0] == (1.0, 0.0)


def test_token_range_join_across_buckets(spark):
    spans = spark.createDataFrame([(1, 0, 3, 0), (1, 3, 3, 1), (1, 3, 40, 2), (1, 40, 41, 3)], "traj_id int, char_start int, char_end int, step int")
    toks = spark.createDataFrame([(1, s) for s in range(41)], "traj_id int, tok_start int")
    got = {r["tok_start"]: r["step"] for r in credit.token_step_range_join(toks, spans, ["step"], bucket=8).collect()}
    assert got == {s: 0 if s < 3 else 2 if s < 40 else 3 for s in range(41)}


def test_masked_mean_of_nothing_raises(spark):
    df = spark.createDataFrame([(1.0, False)], "x double, m boolean")
    with pytest.raises(PySparkException):
        logprobs.masked_mean_var(df, F.col("x"), F.col("m")).collect()


def test_anomalies_with_nan_have_no_z_scores(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 20 + [100]] + [(float("nan"),)], "x double")
    assert logprobs.tensor_anomalies(df, F.col("x"), F.lit(True)).first()["num_high_z"] == 0
    assert logprobs.tensor_anomalies(df, F.col("x"), F.lit(True), finite_only=True).first()["num_high_z"] == 1


# ---- trees and paths

NODES = [  # an answered inner node, an expanded node without children, a leaf without answer
    (1, "r", None, 0, True, None, None), (1, "a", "r", 1, True, None, None), (1, "b", "r", 1, True, "7", 1), (1, "c", "r", 1, True, None, None), (1, "d", "r", 1, False, None, None),
    (1, "a1", "a", 2, False, "7", 1), (1, "a2", "a", 2, False, "8", 0), (1, "b1", "b", 2, False, "8", 0), (2, "s", None, 0, False, "7", 1),
]


@pytest.fixture(scope="module")
def chained(spark):
    nodes = spark.createDataFrame(NODES, "tree_id int, node_id string, parent_id string, depth int, expanded boolean, answer string, is_correct int")
    return trees.chains(trees.tree_score(nodes), 2, ["node_id", "depth", "answer", "is_correct", "score"], branch_factor=3)


def test_scores_are_means_of_means(chained):
    got = {r["node_id"]: (r["score"], r["advantage"]) for r in trees.tree_advantage(chained).collect()}
    assert got["a"] == (0.5, 0.125) and got["b"] == (1.0, 0.625) and got["c"] == (0.0, -0.375) and got["r"] == (0.375, None)
    assert got["b1"] == (0.0, None), "nothing below an answered node has an advantage"


def test_only_unexpanded_nodes_end_a_path(chained):
    assert {r["node_id"] for r in trees.tree_paths(chained).collect()} == {"a1", "a2", "b1", "d", "s"}
    copies = trees.tree_paths_repeated(trees.tree_paths(chained), 3, 2).groupBy("node_id").count()
    assert {r["node_id"]: r["count"] for r in copies.collect()} == {"a1": 1, "a2": 1, "b1": 1, "d": 3, "s": 9}


def test_path_rewrites(spark):
    chain = "array<struct<score:double,advantage:double,weight:double,answer:string,is_correct:int>>"
    nodes = [(0.5, None, 9.0, None, None), (0.6, 0.1, 3.0, None, None), (0.6, 0.0, 1.0, None, None), (0.2, -0.4, 1.0, "x", 0), (0.2, 0.0, 1.0, "x", 0)]
    df = spark.createDataFrame([(nodes,)], f"chain {chain}")

    def advantages(name, **options):
        out = df.select(paths.post_processors[name](F.col("chain"), **options).alias("c")).first()["c"]
        return [n["advantage"] for n in out]

    assert advantages("chop_zero_advantage_tail") == [None, 0.1, 0.0, -0.4]
    assert advantages("chop_up_to_first_negative_advantage") == [None, 0.1, 0.0]
    assert advantages("negative_advantages_to_zero") == [None, 0.1, 0.0, 0.0, 0.0]
    assert advantages("zero_advantages_to_epsilon", epsilon=0.05) == [None, 0.1, 0.05, -0.4, 0.05]
    assert advantages("last_step_advantage_to_one") == [None, 0.1, 0.0, -0.4, 1.0]
    assert advantages("all_advantages_to_one") == [None, 1.0, 1.0, 1.0, 1.0]
    assert advantages("apply_importance_weights")[1] == pytest.approx(0.3)
    only_root = spark.createDataFrame([(nodes[:1],)], f"chain {chain}")
    assert len(only_root.select(paths.chop_zero_advantage_tail(F.col("chain")).alias("c")).first()["c"]) == 1


def test_tree_json(spark):
    leaf = {"text": "same", "depth": 2}
    docs = [
        (1, json.dumps({"text": "r", "depth": 0, "children": [{"text": "a", "depth": 1, "answer": "7", "children": [leaf, leaf]}, {"text": "a", "depth": 1, "children": [], "finish_reason": "stop", "cost": 3}]})),
        (2, json.dumps({"text": "only", "depth": 0})), (3, "{broken"),
    ]
    rows = trees.tree_from_json(spark.createDataFrame(docs, "tree_id int, tree string"), "tree", {**trees.NODE_FIELDS, "cost": "int"}).collect()
    got = {(r["tree_id"], r["node_id"]): (r["parent_id"], r["depth"], r["text"], r["expanded"], r["answer"], r["cost"]) for r in rows}
    assert got == {
        (1, "0"): (None, 0, "r", True, None, None), (1, "0.0"): ("0", 1, "a", True, "7", None), (1, "0.1"): ("0", 1, "a", True, None, 3),
        (1, "0.0.0"): ("0.0", 2, "same", False, None, None), (1, "0.0.1"): ("0.0", 2, "same", False, None, None), (2, "0"): (None, 0, "only", False, None, None),
    }
    nodes = spark.createDataFrame(rows)
    back = {r["tree_id"]: json.loads(r["tree"]) for r in trees.tree_to_json(nodes, "text", ["answer", "finish_reason"]).collect()}
    assert back[2] == {"text": "only", "depth": 0}
    assert back[1]["children"][1] == {"text": "a", "depth": 1, "children": [], "finish_reason": "stop"} and len(back[1]["children"][0]["children"]) == 2
    # two leaves of equal text are two paths
    chains = trees.chains(nodes, 2, ["node_id", "text"])
    assert trees.tree_paths(chains).where("tree_id = 1").count() == 2


def test_trees_deeper_than_meant(spark):
    chain = [(1, f"n{d}", f"n{d - 1}" if d else None, d, d < 5, "7" if d == 5 else None, 1 if d == 5 else None) for d in range(6)]
    nodes = spark.createDataFrame(chain, "tree_id int, node_id string, parent_id string, depth int, expanded boolean, answer string, is_correct int")
    scored = trees.tree_score(nodes)
    assert {r["score"] for r in scored.collect()} == {1.0}
    paths_of = trees.tree_paths(trees.chains(scored, 2, ["node_id", "score"])).collect()
    assert [len(r["chain"]) for r in paths_of] == [6]


def test_chain_of_five_thousand(spark):
    """Thirteen rounds of doubling reach the root of a chain with a side leaf at every level."""
    deep = 5000
    spine = [(1, f"n{d}", f"n{d - 1}" if d else None, d, d < deep, "7" if d == deep else None, 1 if d == deep else None) for d in range(deep + 1)]
    sides = [(1, f"s{d}", f"n{d - 1}", d, False, "8", 0) for d in range(1, deep, 500)]
    schema = "tree_id int, node_id string, parent_id string, depth int, expanded boolean, answer string, is_correct int"
    nodes = spark.createDataFrame(spine + sides, schema)
    scores = {r["node_id"]: r["score"] for r in trees.tree_score(nodes).collect()}
    assert scores[f"n{deep}"] == 1.0 and scores["n0"] == 0.5 ** 10 and scores["n4500"] == 0.5 and scores["s1"] == 0.0 and len(scores) == len(spine) + len(sides)
    found = trees.chains(nodes, 3, ["node_id", "depth"], wanted=~F.col("expanded"))
    assert {r["node_id"]: r["n"] for r in found.select("node_id", F.size("chain").alias("n")).collect()} == {f"n{deep}": deep + 1, **{f"s{d}": d + 1 for d in range(1, deep, 500)}}


def test_chains_need_a_root(spark):
    rows = [(1, "r", None, 0, True, None, None), (1, "a", "r", 1, False, "7", 1), (1, "x", "gone", 2, False, "7", 1), (2, "a", None, 0, False, None, None)]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id string, parent_id string, depth int, expanded boolean, answer string, is_correct int")
    assert {(r["tree_id"], r["node_id"]) for r in trees.chains(nodes, 2, ["node_id"]).collect()} == {(1, "r"), (1, "a"), (2, "a")}
    assert {(r["tree_id"], r["node_id"]): r["score"] for r in trees.tree_score(nodes).collect()} == {(1, "r"): 1.0, (1, "a"): 1.0, (1, "x"): 1.0, (2, "a"): 0.0}
    assert trees.chains(nodes.limit(0), 2, ["node_id"]).count() == 0 and trees.tree_score(nodes.limit(0)).count() == 0


def test_padding_keeps_long_episodes(spark):
    rows = [(e, t, t > 0, -0.5, 0.1, 0.2) for e, n in ((1, 3), (2, 40)) for t in range(n)]
    tokens = spark.createDataFrame(rows, "episode_id bigint, t bigint, is_action boolean, actor_lp double, advantage double, value double")
    padded = episodes.pad_batches(tokens, F.col("t").cast("int"), 2).collect()
    assert {(r["episode_id"], len(r["input_ids"]), sum(r["attention_mask"])) for r in padded} == {(1, 40, 3), (2, 40, 40)}
    with pytest.raises(PySparkException):
        episodes.collect_tokens(tokens, {"ids": F.col("t")}, most=10).collect()


def test_ranks_of_null_and_wide_ids(spark):
    ids = [None, -(2**63), -5, 0, 3, 2**62, 2**63 - 1]
    ranked = rank_by_id(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", "pos").collect()
    assert sorted((r["pos"], r["id"]) for r in ranked) == list(enumerate(ids))
    assert rank_by_id(spark.createDataFrame([(None,), (None,)], "id bigint"), "id", "pos").count() == 2


def test_ragged_lists_and_odd_names_are_flattened(spark):
    df = spark.createDataFrame([(1, {"l": [1, 2, 3, 4], "eval/acc": 0.5}), (2, {"l": [], "eval/acc": None})], "id int, m struct<l:array<int>,`eval/acc`:double>")
    flat = readers.flatten_run_records(df.select("id", F.col("m").alias("c"), F.struct("id").alias("s")), "c", "s").orderBy("id").collect()
    assert [flat[0][f"cfg__l.{k}"] for k in range(4)] == [1, 2, 3, 4] and flat[1]["cfg__l.3"] is None
    metrics = readers.flatten_metrics(df.select("id", F.struct(F.col("m").getField("eval/acc").alias("eval/acc")).alias("m")), "m", ["id"]).collect()
    assert {(r["id"], r["key"], r["value"]) for r in metrics} == {(1, "eval/acc", "0.5"), (2, "eval/acc", "None")}


def test_json_records_whose_keys_and_kinds_differ(spark):
    runs = [
        (1, '{"a":{"b":1,"x.y":[1,2.5,{"z":"q"}]},"e":{},"n":null,"s":"[{"}', '{"m":1}'),
        (2, '{"a":3,"l":[],"it\'s":true}', '{"m":0.5,"k":{"t":"u\\"}{"}}'),
        (3, None, "{broken"), (4, "{}", "7"),
    ]
    df = spark.createDataFrame(runs, "id int, c string, s string")
    leaves = {(r["id"], r["key"], r["v"]) for r in readers.json_leaves(df.drop("s"), {"c": ("cfg__", ".")}).select("id", "key", F.col("leaf").cast("string").alias("v")).collect()}
    assert leaves == {(1, "cfg__a.b", "1"), (1, "cfg__a.x.y.0", "1"), (1, "cfg__a.x.y.1", "2.5"), (1, "cfg__a.x.y.2.z", "q"), (1, "cfg__e", "{}"), (1, "cfg__n", None),
                      (1, "cfg__s", "[{"), (2, "cfg__a", "3"), (2, "cfg__l", "[]"), (2, "cfg__it's", "true")}
    flat = {r["id"]: r.asDict() for r in readers.flatten_json_records(df, "c", "s").collect()}
    assert set(flat) == {1, 2, 3, 4} and len(flat[1]) == 13
    assert (flat[1]["cfg__a.b"], flat[1]["cfg__a.x.y.1"], flat[1]["cfg__a.x.y.2.z"], flat[1]["sum__m"]) == (1, 2.5, "q", 1.0)
    assert (flat[2]["cfg__a"], flat[2]["cfg__it's"], flat[2]["sum__m"], flat[2]["sum__k#t"], flat[2]["cfg__a.b"]) == (3, True, 0.5, 'u"}{', None)
    assert not [v for k in (3, 4) for c, v in flat[k].items() if c != "id" and v is not None]
    assert readers.flatten_json_records(df.where("false"), "c", "s").columns == ["id"]


def test_json_values_that_are_text_in_one_run_and_nested_in_another(spark):
    df = spark.createDataFrame([(1, '{"a":"t","b":[]}', "{}"), (2, '{"a":{"k":1},"b":[5]}', "{}"), (3, '{"a":{},"b":2}', "{}")], "id int, c string, s string")
    flat = {r["id"]: tuple(r[c] for c in ("cfg__a", "cfg__a.k", "cfg__b", "cfg__b.0")) for r in readers.flatten_json_records(df, "c", "s").collect()}
    assert flat == {1: ("t", None, "[]", None), 2: (None, 1, None, 5), 3: ("{}", None, "2", None)}


@pytest.mark.parametrize("kind", committed.KINDS)
def test_iterations_are_committed_once(spark, tmp_path, kind):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([(i % 3, f"é\n{i}" if i % 4 else None, i / 7, [i, i + 1]) for i in range(50)], "iteration bigint, t string, x double, l array<int>").repartition(4)
    first = committed.write_missing(rows.where("iteration < 2"), path, kind=kind)
    assert {tuple(map(str, r)) for r in first.drop("reused").collect()} == {tuple(map(str, r)) for r in rows.where("iteration < 2").collect()}
    again = committed.write_missing(rows.withColumn("t", F.lit("new")), path, kind=kind)
    assert {(r["iteration"], r["t"] == "new", r["reused"]) for r in again.collect()} == {(0, False, True), (1, False, True), (2, True, False)}
    assert again.count() == 50
    assert committed.write_missing(rows, path, kind=kind).where("reused").count() == 50


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "runs"
    rows = spark.range(1000).select((F.col("id") % 2).alias("iteration"), F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise("x").alias("t")).repartition(3)
    with pytest.raises(Exception, match="lost"):
        committed.write_missing(rows, str(path))
    assert not [f for f in path.rglob("*") if f.is_file()]
    nulls = spark.createDataFrame([(None, "a"), (1, "b")], "iteration bigint, t string")
    with pytest.raises(Exception, match="belong to no iteration"):
        committed.write_missing(nulls, str(path))
    assert not [f for f in path.rglob("*") if f.is_file()]
    assert committed.read_committed(spark, str(path), nulls.schema).count() == 0
    assert committed.write_missing(nulls.where("t = 'b'"), str(path)).count() == 1


def test_checkpoints_of_other_names(spark):
    names = ["ckpt--iter_0002--epoch_70000--step_1", "other", "ckpt--iter_0001--epoch_1--step_900000000", "ckpt--iter_0001--epoch_2--step_1"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r["pos"] for r in checkpoints.every_nth_keep_last(df, 1).collect()} == {names[2]: 0, names[3]: 1, names[0]: 2}
    assert checkpoints.last_checkpoint(df).first()["last_name"] == names[0]


def test_variance_far_from_zero(spark):
    scores = spark.createDataFrame([("m", i // 2, 1e9 + 0.1 * i) for i in range(5)], "run string, iteration bigint, score double")
    last = jobs.running_moments(jobs.moments(scores, ["run", "iteration"], "score"), "run", "iteration").orderBy("iteration").collect()[-1]
    assert last["var"] == pytest.approx(0.02, rel=1e-4) and last["mean"] == pytest.approx(1e9 + 0.2)
    whole = jobs.episode_metrics(jobs.moments(scores, ["run", "iteration"], "score"), ["run"]).first()
    assert whole["score_std"] == pytest.approx(0.02**0.5, rel=1e-4) and whole["episodes"] == 5


def test_kl_coefficient_with_negative_and_zero_updates(spark):
    rows = [("m", i, kl, n) for i, (kl, n) in enumerate([(0.0, 20), (0.0, 20), (0.0, 10), (1.0, 5), (1.0, 5)])]
    df = spark.createDataFrame(rows, "run string, iteration bigint, kl double, n_steps bigint")
    got = [r["kl_coef"] for r in jobs.adaptive_kl_coef(df, "run", "iteration", 0.5, 1.0, 2.0).orderBy("iteration").collect()]
    # updates: 1 - 0.2 * 20 / 2 = -1, -1, 0, 1, 1
    assert got == pytest.approx([0.5, -0.5, 0.5, 0.0, 0.0])


def test_pairs_use_both_sides(spark):
    rows = [(1, i, 1.0 if i < 4 else 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "question_id int, rollout_idx int, reward double")
    got = pairs.dpo_pairs(df, 0.5, 4, 3).collect()
    assert len(got) == 4 and len({r["reject_idx"] for r in got}) == 4


def test_expand_frontier_closes_nodes(spark):
    roots = spark.createDataFrame([(1, "n", None, 0, 0, "q", "q", False), (2, "m", None, 0, 0, "q", "q", True)], trees.OPEN_SCHEMA)
    generator = row_generator(lambda prefix, i: f"{i}", lambda t: t == "1")
    grown = trees.expand_frontier(roots, generator, lambda d: trees.branch_factor(d, steps=[(0, 2), (1, 3)]), 2)
    assert sorted(r["node_id"] for r in grown.collect()) == ["m", "n", "n.0", "n.0.0", "n.0.1", "n.0.2", "n.1"]


# ---- pairs

def test_dpo_pairs_are_valid_and_distinct(spark, split_plans):
    rows = [(q, i, float(i % 3 == 0)) for q, n in [(1, 30), (2, 2), (3, 1)] for i in range(n)]
    df = spark.createDataFrame(rows, "question_id int, rollout_idx int, reward double")
    got = pairs.dpo_pairs(df, 1.0, 12, seed=1).collect()
    assert len([r for r in got if r["question_id"] == 1]) == 12 and len([r for r in got if r["question_id"] == 2]) == 1
    assert len({(r["question_id"], r["accept_idx"], r["reject_idx"]) for r in got}) == len(got)
    assert all(r["accept_idx"] % 3 == 0 and r["reject_idx"] % 3 for r in got)
    with pytest.raises(ValueError):
        pairs.dpo_pairs(df, 1.0, -1, seed=1)


def test_containment_with_cut_words_and_short_problems(spark):
    rng = random.Random(2)
    words = ["alpha", "be", "gamma", "de", "x"]
    problems = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(30)] + [(30, "a"), (31, "lpha be gam"), (32, "\n"), (33, "")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + rng.choice(["", "\n"])) for i in range(40)]
    got = {r["q"]: r["p"] for r in containment.attach_source_row(
        spark.createDataFrame(queries, "q int, qt string"), "q", "qt", spark.createDataFrame(problems, "p int, pt string"), "p", "pt").collect()}
    want = {}
    for q, t in queries:
        hits = [p for p, s in problems if s and s in t]
        if hits:
            want[q] = min(hits)
    assert got == want


def test_containment_of_a_problem_that_stands_in_every_query(spark):
    rng = random.Random(5)
    long_word = "z" * 200
    problems = [(9, "e"), (7, "a b"), (5, long_word), (4, long_word + "y"), (3, "one two three four five"), (2, "é"), (None, "e"), (1, None), (8, "e")]
    queries = [(i, " ".join(rng.choice(["e", "a b", "one two three four five", "é", long_word, "xe"]) for _ in range(rng.randint(1, 4)))) for i in range(300)]
    queries += [(None, "e"), (400, None), (401, ""), (402, long_word + "yy")]
    want = {q: min(hits) for q, t in queries if q is not None and t and (hits := [p for p, s in problems if p is not None and s and s in t])}
    q, p = spark.createDataFrame(queries, "q int, qt string"), spark.createDataFrame(problems, "p int, pt string")
    for size in (2_000_000, 150):  # one automaton, then several
        found = containment.attach_source_row(q, "q", "qt", p, "p", "pt", automaton_bytes=size)
        assert {r["q"]: r["p"] for r in found.collect()} == want
    named = containment.attach_source_row(q, "q", "qt", p.select(F.concat(F.lit("p"), "p").alias("p"), "pt"), "p", "pt").collect()
    assert {r["q"]: r["p"] for r in named} == {k: f"p{v}" for k, v in want.items()}
    assert containment.attach_source_row(q, "q", "qt", p.where("false"), "p", "pt").count() == 0


def test_token_budget_pack_matches_the_greedy_loop(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([0, 1, 2, 3, 5, 8, 50])) for g, n in [(1, 80), (2, 5)] for i in range(n)]
    got = {(r["g"], r["i"]) for r in pairs.token_budget_pack(spark.createDataFrame(rows, "g int, i bigint, c int"), ["g"], "i", "c", 20).collect()}
    want, used = set(), {1: 0, 2: 0}
    for g, i, c in rows:
        if used[g] + c <= 20:
            used[g] += c
            want.add((g, i))
    assert got == want


def test_bleu_rejection_matches_the_greedy_loop(spark):
    texts = ["a b c d e", "a b c d e f", "v w x y z", "a b c d e", "k l m n o", "p q r s t"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, i int, t string")
    pick = lambda final: [r["i"] for r in pairs.bleu_rejection_select(df, "g", "i", "t", 3, 0.3, final).orderBy("i").collect()]
    assert pick(F.lit(False)) == [0, 2, 4]
    assert pick(F.col("i") >= 1) == [0, 1, 2]


# ---- text

@pytest.mark.parametrize("raw, indices", [
    ("\n\none\ntwo\n\n# Answer\n7", [0, 5, 21]), ("one\ntwo", [0, 3, 7]), ("\n \n", [0, 0, 2, 3]), ("\n\n# Answer\n7", [0, 12]), ("", [0, 0]), ("a\n# Answer\nb# Answer\nc", None),
])
def test_delimiter_steps(raw, indices):
    got = steps.delimiter_indices(raw, "\n", "\n# Answer\n")
    assert "".join(raw[a:b] for a, b in zip(got, got[1:])) == raw
    if indices is not None:
        assert got == indices


def test_prose_steps_cover_the_text():
    raw = "We have $a. B$ here. Then so. Next we add, and then we multiply, and after that we subtract the whole thing from the other one: done; ok.\nShort\nThe end of it."
    got = steps.prose_indices(raw)
    assert got[0] == 0 and got[-1] == len(raw) and got == sorted(set(got))
    assert not any(8 < c < 14 for c in got), "no cut inside a formula"
    assert all(p for p in steps.lossy_pieces(raw))


def test_boxed(spark):
    assert one(spark, extraction.extract_boxed(F.col("t")), t=r"\boxed{\frac{1}{2}} and \boxed{3}% and \boxed{open") == [r"\frac{1}{2}", "3}"]
    assert one(spark, extraction.extract_boxed(F.col("t")), t="boxed{}boxed{a}% boxed{b {c}}{d}") == ["", "a}", "b {c}"]


def test_formula_spans():
    raw = r"a $x$ b \(y $ z\) c $$d$$ \begin{e}f\end{e} costs \$5 and [asy] g [/asy] $ open"
    assert [raw[a:b] for a, b in steps.formula_spans(raw)] == ["$x$", r"\(y $ z\)", "$$d$$", r"\begin{e}f\end{e}", "[asy] g [/asy]"]


def test_tokens_partition_any_text(spark):
    for raw in ["", " ", "a", "  two words.. ", "tab\tnew\nline", "é,ü|x"]:
        assert one(spark, F.array_join(text.tokens(F.col("t")), ""), t=raw) == raw
        spans = one(spark, text.token_spans(F.col("t")), t=raw)
        assert "".join(s["tok"] for s in spans) == raw
    assert one(spark, text.tokens_before(text.tokens(F.lit("ab cd")), F.lit(1)), t="") == 1


def test_template_values_may_bring_placeholders(spark):
    rendered = text.render_template("{a}-{b}", {"a": F.col("a"), "b": F.col("b")})
    assert one(spark, rendered, a="{b}", b="1") == "1-1"
    with pytest.raises(ValueError):
        text.render_prompt_strict("{b}", {"b": F.col("b")}, "a")


@pytest.mark.parametrize("raw, want", [
    (r"\frac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (".5x", "0.5x"), ("k = 5", "5"), ("ab = 5 = c", "ab=5=c"), (r"\sqrt3+\sqrt{5}", r"\sqrt{3}+\sqrt{5}"), ("3/4", r"\frac{3}{4}"), ("03/4", "03/4"),
    (r"5\text{ miles}", "5"), (r"\left(1,\!000\right)", "(1,000)"), ("0.5", r"\frac{1}{2}"),
])
def test_normalize_answer(spark, raw, want):
    assert one(spark, normalize.normalize_answer(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("$5 million", "5*10^6"), ("7 3/4", "7+3/4"), ("1,234", "1234"), ("5.0", "5"), ("12 inches", "12"), ("A or B", "a,b"), ("{x}", "x"), ("-  3", "-3"), ("007", "7")])
def test_normalize_loose(spark, raw, want):
    assert one(spark, normalize.normalize_answer_loose(F.col("a")), a=raw) == want


@pytest.mark.parametrize("given, truth, ok", [(None, "1", False), (" 1,000 ", "1000", True), ("Yes", "yes", True), ("1", "2", False)])
def test_grade_exact(spark, given, truth, ok):
    assert one(spark, grading.grade_exact(F.col("g"), F.col("t")), g=given, t=truth) is ok


def test_last_number(spark):
    got = {raw: one(spark, text.extract_last_number(F.col("t")), t=raw) for raw in ["a 1,234 b", "3.5.", "-7", "none", "1e5"]}
    assert got == {"a 1,234 b": "1234", "3.5.": "3.5", "-7": "-7", "none": None, "1e5": "1e5"}


def test_few_shot_drops_the_question_and_retries(spark):
    pool = spark.createDataFrame([(i, f"ex{i}") for i in range(5)], "p int, e string")
    questions = spark.createDataFrame([(i, f"ex{i}") for i in range(5)], "q int, t string")
    for r in fewshot.few_shot_sample(questions, "q", "t", pool, "p", "e", 3, 1, 1000, "|").collect():
        examples = r["prompt"].split("|")
        assert examples[-1] == f"ex{r['q']}" and examples[-1] not in examples[:-1] and len(examples) == 4 and r["attempt"] == 0
    assert {r["attempt"] for r in fewshot.few_shot_sample(questions, "q", "t", pool, "p", "e", 3, 1, 1, "|").collect()} == {9}


def test_extraction_target_keeps_invalid_rows(spark):
    rows = [(1, '["a","b","b"]', "[0.1,0.2,0.3]"), (2, '["a"]', "[0.1]"), (3, None, "[1]"), (4, '["a","b"]', "[0.5]"), (5, "[]", "[]")]
    parsed = forecasting.parse_lists(spark.createDataFrame(rows, "k int, answers_str string, probs_str string"))
    assert {r["k"]: r["target"] for r in forecasting.extraction_target(parsed).collect()} == {1: "b", 2: "No Answer", 3: None, 4: None, 5: None}
    assert sorted((r["k"], r["idx"]) for r in forecasting.forecast_unroll(parsed, "k").collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


# ---- sampling, sources, sinks, plug-ins, streams

def test_resize_and_errors(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sampling.resize(df, ["k"], 1, 25).groupBy("k").count().agg(F.sum("count")).first()[0] == 25
    with pytest.raises(ValueError):
        sampling.resize(df, ["k"], 1, 11, fill_missing=False)
    with pytest.raises(ValueError):
        sampling.shuffle_take(df, ["k"], 1, n=11)
    assert sampling.portion(spark.range(100), "id", 0.29).count() == 28  # int(100 * 0.29)


def test_sampling_ignores_partitioning(spark):
    df = spark.range(1000)
    a = {r["id"]: r["pos"] for r in sampling.shuffled(df.repartition(7), ["id"], 3).collect()}
    b = {r["id"]: r["pos"] for r in sampling.shuffled(df.coalesce(1), ["id"], 3).collect()}
    assert a == b and sorted(a.values()) == list(range(1000))
    first = sampling.shuffle_take(df, ["id"], 3, n=17)
    assert {r["id"]: r["pos"] for r in first.collect()} == {k: v for k, v in a.items() if v < 17}


def test_columnar_json_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"query": [[1], [2], [3]],\n "response": [[4], [5], [6]],\n "reward": [0.5, 1.0, 2.0]}')
    got = readers.read_columnar_json(spark, str(tmp_path / "d.json"), {"query": "array<int>", "response": "array<int>", "reward": "double"}, first=2).orderBy("pos").collect()
    assert [(r["query"], r["reward"]) for r in got] == [([1], 0.5), ([2], 1.0)]
    df = spark.range(5)
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "id bigint").count() == 5
    writers.write_csv_gz(df, str(tmp_path / "c"))
    assert list((tmp_path / "c").glob("*.csv.gz")) and spark.read.csv(str(tmp_path / "c"), header=True).count() == 5


def test_iteration_is_written_once(spark, tmp_path):
    first = writers.write_iteration_once(spark.range(3), str(tmp_path), 1)
    again = writers.write_iteration_once(spark.range(99), str(tmp_path), 1)
    assert first.count() == again.count() == 3 and writers.write_iteration_once(spark.range(4), str(tmp_path), 2).count() == 4


def test_registry():
    registry = Registry("thing")
    registry.register("a")(1)
    assert registry["a"] == 1 and list(registry) == ["a"]
    with pytest.raises(KeyError):
        registry["b"]
    with pytest.raises(ValueError):
        registry.register("a")(2)


def test_model_keeps_existing_scores(spark):
    df = spark.createDataFrame([("q", "r", 0.5), ("q", "rr", None)], "q string, r string, score double")
    got = model_score_batch(df, "q", "r", lambda: lambda texts: [float(len(t)) for t in texts])
    assert sorted(r["score"] for r in got.collect()) == [0.5, 3.0]


def test_stream_restart_repeats_nothing(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def run():
        stream = spark.readStream.schema("iteration bigint, score double, txt string").json(str(source))
        jobs.accumulate_moments(stream, ["iteration"], "score", str(out / "m"), str(out / "mp")).awaitTermination()
        jobs.dedupe_requests(stream, "txt", str(out / "d"), str(out / "dp")).awaitTermination()
        metrics = {r["iteration"]: (r["episodes"], r["score_mean"]) for r in jobs.episode_metrics(spark.read.parquet(str(out / "m")), ["iteration"]).collect()}
        return metrics, sorted(r["txt"] for r in spark.read.parquet(str(out / "d")).collect())

    source.mkdir()
    (source / "1.json").write_text('{"iteration": 1, "score": 1.0, "txt": "a"}\n{"iteration": 1, "score": 3.0, "txt": "a"}\n')
    assert run() == ({1: (2, 2.0)}, ["a"])
    (source / "2.json").write_text('{"iteration": 1, "score": 5.0, "txt": "a"}\n{"iteration": 2, "score": 7.0, "txt": "b"}\n')
    assert run() == ({1: (3, 3.0), 2: (1, 7.0)}, ["a", "b"])
    assert run() == ({1: (3, 3.0), 2: (1, 7.0)}, ["a", "b"])


def test_folds_of_runs_equal_the_batch_forms_over_restarts(spark, tmp_path):
    rng = random.Random(8)
    scores = spark.createDataFrame([(run, i, 1e6 + rng.gauss(0, 1)) for run in ("m", "n", None) for i in range(9) for _ in range(1 + 3 * (i % 3))], "r string, i int, score double")
    rows = jobs.moments(scores, ["r", "i"], "score").withColumns({"kl": F.col("mean") - 1e6, "n_steps": F.when(F.col("i") != 4, F.col("n"))})
    rows.write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    kl, moments = state.KlCoefficient(0.5, 0.1, 20.0), state.RunningMoments()
    for part in ("i < 3", "i between 2 and 5 and r is not null", "i > 5 or (i > 2 and r is null)"):
        rows.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        for name, fold in (("kl", kl), ("m", moments)):
            stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
            state.fold_runs(stream, "r", "i", fold, str(tmp_path / name), str(tmp_path / f"{name}-progress")).awaitTermination()
    got = {(r["run"], r["iteration"]): r["kl_coef"] for r in spark.read.parquet(str(tmp_path / "kl")).collect()}
    want = {(r["r"], r["i"]): r["kl_coef"] for r in jobs.adaptive_kl_coef(rows, "r", "i", 0.5, 0.1, 20.0).collect()}
    assert len(want) == 27 and got == pytest.approx(want, rel=1e-9)
    got = {(r["run"], r["iteration"]): (r["count"], r["mean"], r["var"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    batch = jobs.running_moments(rows, "r", "i").collect()
    assert len(got) == len(batch) == 27
    for r in batch:
        count, mean, var = got[r["r"], r["i"]]
        assert count == r["count"] and mean == pytest.approx(r["mean"], rel=1e-12) and var == pytest.approx(r["var"], rel=1e-6, abs=1e-12)


def test_adaptive_kl(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 100), ("m", 2, 0.0, 100), ("m", 3, 1.0, 100)], "run string, iteration int, kl double, n_steps int")
    got = [r["kl_coef"] for r in jobs.adaptive_kl_coef(df, "run", "iteration", 1.0, 1.0, 1000.0).orderBy("iteration").collect()]
    assert got == pytest.approx([1.0, 1.02, 1.02 * 0.98])


def test_moments_of_values_far_from_zero(spark):
    """Sums of squares would lose all digits of these deviations."""
    rng = np.random.default_rng(5)
    rows = [(k, k // 4, t, True, t >= 2, 0.5, -1.0, -1.5, 1e9 + float(rng.normal()), 1e9 + float(rng.normal()), 0.1) for k in range(12) for t in range(1 + 3 * (k % 5))]
    frame = spark.createDataFrame(rows, "episode_id bigint, batch_id bigint, t bigint, used boolean, is_action boolean, score double, actor_lp double, ref_lp double, value double, advantage double, reward double")
    pdf = frame.toPandas()
    inner = pdf[pdf.t < pdf.groupby("episode_id").t.transform("max")].value.to_numpy()
    got = logprobs.critic_value_stats(frame).first()
    assert got.n == len(inner) and got.value_std == pytest.approx(inner.std(), rel=1e-5) and got.value_mean == pytest.approx(inner.mean(), rel=1e-14)
    for r in logprobs.batch_step_metrics(frame).collect():
        mine = pdf[pdf.batch_id == r.batch_id]
        assert r.advantage_std == pytest.approx(mine.advantage.std(ddof=1), rel=1e-5) and r.num_tokens == len(mine)
        assert r.kl_mean == pytest.approx(mine.groupby("episode_id").size().mean() * 0.5)
    assert logprobs.critic_value_stats(frame.limit(0)).first().value_std is None
