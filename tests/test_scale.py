"""Plans that must hold at any size: what they send to the driver, store and shuffle."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkroll import catalog, session
from sparkroll import fixtures as fx
from sparkroll.operators import bleu, fewshot, sampling, trees
from sparkroll.plans import composites
from sparkroll.skew import with_group_stats

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_need_no_null_aware_anti_join(spark):
    # Spark runs a negated IN by broadcasting every line's key
    assert "LeftAnti" not in plan(fx.f4(spark, TINY).where(~F.col("expanded")))


#: Queries that must send no table to the driver, at any size.
NO_BROADCAST = [
    "pp_non_last_nodes_score_to_zero",
    "tree_paths",
    "drop_query_only_paths",
    "path_filter_non_zero_last_step_advantage",
    "path_filter_non_zero_last_step_score",
    "path_filter_non_zero_score",
    "path_filter_none",
    "path_filter_successful",
    "path_filter_zero_last_step_score",
    "path_max_k",
    "path_strategy",
    "path_top_k_percent",
    "path_top_k_percent_sum",
    "path_unique",
    "pp_all_advantages_to_one",
    "pp_apply_importance_weights",
    "pp_chop_up_to_first_negative_advantage",
    "pp_keep_first_step_only",
    "pp_last_step_advantage_to_one",
    "pp_non_last_nodes_advantage_to_zero",
    "pp_zero_advantages_to_epsilon",
    "trajectory_metrics",
    "pairs_i_lt_j",
    "unique_response_count",
    "rollout_eval_callback",
]


@pytest.mark.parametrize("key", NO_BROADCAST)
def test_no_table_reaches_the_driver(spark, monkeypatch, key):
    frames = []

    def noted(df):
        frames.append(df)
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema)

    monkeypatch.setattr(trees, "reliable_table", noted)
    # plans are enough: nothing is stored, and no job looks for the levels of the empty table
    monkeypatch.setattr(trees, "deepest", lambda nodes: 3)
    monkeypatch.setattr(trees, "_shallow", lambda nodes, depth: True)
    frames.append(catalog.queries()[key](spark, TINY))
    assert not [df for df in frames if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]


def test_expanded_is_three_valued_as_in(spark, tmp_path):
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp"
    lines = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_returnflag string, l_tax double"
    row = (1, 1, 1, None, 1.0, 5.0, "R", 0.0)
    spark.createDataFrame([(7,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 7, "F", None), (2, 7, "F", None), (None, 7, "F", None)], orders).write.parquet(f"{tmp_path}/orders.parquet")
    for keys, expected in (((1, 1), {"O1": True, "O2": False, None: None}), ((1, None), {"O1": True, "O2": None, None: None})):
        spark.createDataFrame([(k, *row) for k in keys], lines).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        got = fx.f4(spark, str(tmp_path)).where("depth = 2").collect()
        assert {r.node_id: r.expanded for r in got} == expected and len(got) == 3


NODE_SCHEMA = "tree_id int, node_id string, parent_id string, depth int, expanded boolean, answer string, is_correct int"
FIELDS = ["node_id", "answer", "score"]


def forest():
    """Trees of four levels with answered inner nodes, empty nodes, a bare root and an orphan; `"}` ends a text."""
    rows = [(9, "alone", None, 0, False, "x", 1), (9, "lost", "gone", 2, False, "x", 1)]
    for tree in range(3):
        rows.append((tree, "r", None, 0, True, None, None))
        for a in range(3):
            rows.append((tree, f"{a}", "r", 1, a < 2, 'a"}' if a == 1 else None, 1 if a == 1 else None))
            for b in range(3 if a < 2 else 0):
                rows.append((tree, f"{a}.{b}", f"{a}", 2, b > 0, None, None))
                rows += [(tree, f"{a}.{b}.{c}", f"{a}.{b}", 3, False, "\\}" if c else None, (tree + c) % 2) for c in range(b)]
    return rows


def test_trees_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(forest(), NODE_SCHEMA).mapInArrow(counted, NODE_SCHEMA)
    for run in (lambda: trees.tree_score(source), lambda: trees.chains(source, 3, ["node_id", "answer"]), lambda: trees.tree_to_json(source)):
        before = seen.value
        run().collect()
        assert seen.value - before == len(forest())


def test_levels_equal_doubling(spark, monkeypatch):
    nodes = spark.createDataFrame(forest(), NODE_SCHEMA)

    def results():
        scored = trees.tree_score(nodes)
        paths = trees.chains(scored, 3, FIELDS, 4, wanted=~F.col("expanded"))
        whole = trees.chains(scored, 3, FIELDS, 4)
        return [sorted(df.collect(), key=str) for df in (scored.withColumn("score", F.round("score", 9)), paths.select("tree_id", "node_id", "path_key", rounded("chain").alias("c")), whole.select("tree_id", "node_id", rounded("chain").alias("c")))]

    def rounded(chain):
        return F.to_json(F.transform(chain, lambda n: n.withField("score", F.round(n["score"], 9)).withField("advantage", F.round(n["advantage"], 9) + 0.0)))

    by_level = results()
    monkeypatch.setattr(trees, "SHALLOW", 0)
    assert results() == by_level and len(by_level[0]) == len(forest())


def test_json_strings_keep_quotes_and_braces(spark):
    docs = trees.tree_to_json(spark.createDataFrame([(1, 'r"}', None, 0, False, "\\}\n}", 1)], NODE_SCHEMA))
    assert json.loads(docs.first().tree) == {"text": 'r"}', "depth": 0, "answer": "\\}\n}"}


def test_workers_take_few_rows_at_once(spark):
    rows = fx.table(spark, TINY, "lineitem").coalesce(1).select("l_orderkey")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) == rows.count() and max(r.n for r in sizes) <= 512


def test_grams_leave_in_pieces(spark, monkeypatch):
    texts = [(1, 0, "a b c d e a b c d"), (1, 1, "b c d e a b c"), (2, 0, None), (2, 1, "a b"), (3, 0, "x")]
    members = spark.createDataFrame(texts, "g int, i int, t string")
    whole = sorted(bleu._gram_rows(members, ["g"], "t").collect())
    assert len(whole) == sum(max(len((t or "").split()) - n, 0) for _, _, t in texts for n in range(4))
    monkeypatch.setattr(bleu, "GRAMS", 3)
    assert sorted(bleu._gram_rows(members, ["g"], "t").collect()) == whole
    scores = {r.g: r.bleu for r in bleu.group_bleu(members, ["g"], "i", "t").collect()}
    assert set(scores) == {1, 2} and scores[1] > 0 and scores[2] == 0


def test_whole_groups_shuffle_no_grams(spark, monkeypatch):
    texts = [(g, i, " ".join("abcab"[(g + i + k) % 5] for k in range(3 + (g * i) % 7))) for g in range(40) for i in range(1 + g % 5)] + [(None, i, "a b c d e") for i in range(3)]
    members = spark.createDataFrame(texts, "g int, i int, t string")
    sized = with_group_stats(members, ["g"], {"n": F.count(F.lit(1))})
    rows = bleu._added_up(sized, ["g"], "i", "t", "n").collect()
    assert len(rows) == 41 and all(r["__g"] is None for r in rows)

    def scores(hot=False):
        return {r.g: (r.members, round(r.bleu, 12)) for r in bleu.group_bleu(members, ["g"], "i", "t", hot).collect()}

    whole = scores()
    assert len(whole) == 33 and whole[None] == (3, 0.0) and len(set(whole.values())) > 9
    # a group that is spread over tasks, or holds too many grams, has the same score
    assert scores(hot=True) == whole
    monkeypatch.setattr(bleu, "HELD", 5)
    assert scores() == whole
    small = bleu._added_up(sized, ["g"], "i", "t", "n")
    assert small.where("__g is not null").count() > 40 and small.agg(F.sum("members")).first()[0] == len(texts)


def test_large_inputs_are_cut_finer(spark, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    lines = fx.table(spark, TINY, "lineitem")
    assert spark.conf.get(key, None) == before, "a small table keeps the session's partitions"
    monkeypatch.setattr(session, "INPUT_BYTES", 1024)
    try:
        lines = fx.table(spark, TINY, "lineitem").groupBy("l_orderkey").count()
        wanted = int(spark.conf.get(key))
        assert wanted > 50 and "hashpartitioning(l_orderkey#" in (text := lines._jdf.queryExecution().executedPlan().toString()) and f", {wanted})" in text
        assert lines.count() == fx.table(spark, TINY, "lineitem").select("l_orderkey").distinct().count()
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_tokens_are_cut_once(spark):
    rows = spark.createDataFrame([(1, 0, "A", "stop", 3, "A"), (1, 1, None, "stop", 0, "A")], "question_id int, rollout_idx int, answer string, finish_reason string, num_tokens int, gold string")
    response = F.concat(F.array_join(F.array_repeat(F.lit(" so"), F.col("num_tokens")), ""), F.coalesce("answer", F.lit("")))
    made = composites.ppo_episodes(rows, F.lit("Q?"), response, 6, -0.5)
    assert plan(made).count("regexp_extract_all") == 1
    assert [(r.rollout_idx, r.n_query, r.n_response, len(r.response_token_ids)) for r in made.collect()] == [(0, 2, 3, 4)]
    # texts alone need no token ids
    assert "md5" not in plan(made.select("question_id", "response_text"))


def test_picks_hash_each_round_once(spark):
    text = plan(spark.range(5).select(sampling.permuted_picks(F.col("id"), 4, 3, "id").alias("p")))
    assert text.count("md5(") == 1 + 2 * sampling.FEISTEL_ROUNDS


def test_attempts_ruled_out_by_length_are_not_made(spark, monkeypatch):
    made = spark.createDataFrame([(0, 5), (1, 20), (2, 31), (3, None)], "q int, n int").select("q", fewshot.attempts_to_make(F.col("n"), 12, 30).alias("a"))
    assert {r.q: r.a for r in made.collect()} == {0: [0], 1: list(range(10)), 2: [9], 3: list(range(10))}
    pool = [(i, "x" * (i % 13)) for i in range(26)]
    questions = spark.createDataFrame([(i, "x" * i) for i in range(60)] + [(60, None)], "q int, t string")
    # copies and nulls may take all picks of an attempt: then every attempt counts
    for rows in (pool, pool + [(30 + i, "x" * 3) for i in range(60)], pool[:1], [(1, None), (2, "xx"), (3, None)], []):
        bank = spark.createDataFrame(rows, "p int, e string")

        def picked():
            return sorted(fewshot.few_shot_sample(questions, "q", "t", bank, "p", "e", 3, 1, 50, "|").collect())

        with monkeypatch.context() as patched:
            patched.setattr(fewshot, "attempts_to_make", lambda *_: F.sequence(F.lit(0), F.lit(9)))
            whole = picked()
        assert picked() == whole
        assert rows != pool or len({r.attempt for r in whole}) > 2
