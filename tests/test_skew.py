"""The split plans give exactly what the plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from sparkroll import skew
from sparkroll.operators import credit, pairs, sampling


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(3)
    rows = []
    for key, n in [("hot", 200), ("a", 1), ("b", 7), (None, 5)]:
        rows += [(key, i, rng.choice([None, rng.random()]), rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, pos bigint, x double, y double").repartition(5)


def same(a, b):
    cols = a.columns

    def rows(df):
        return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*cols).collect())

    assert rows(a) == rows(b)


def test_rank(steps):
    order = [F.col("y").desc(), F.col("pos")]
    same(skew.rank_in_group(steps, ["k"], order, "rn", hot=False), skew.rank_in_group(steps, ["k"], order, "rn", hot=True))


@pytest.mark.parametrize("reverse", [False, True])
def test_running(steps, reverse):
    aggs = {"s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "y")}
    same(skew.running(steps, ["k"], "pos", aggs, reverse, hot=False), skew.running(steps, ["k"], "pos", aggs, reverse, hot=True, slice_rows=16))


@pytest.mark.parametrize("offset", [1, -1, 3])
def test_neighbour(steps, offset):
    same(skew.neighbour(steps, ["k"], "pos", {"n": "x"}, offset, hot=False), skew.neighbour(steps, ["k"], "pos", {"n": "x"}, offset, hot=True))


def test_group_stats(steps):
    aggs = {"n": F.count(F.lit(1)), "m": F.avg("y")}
    same(skew.with_group_stats(steps, ["k"], aggs, hot=False), skew.with_group_stats(steps, ["k"], aggs, hot=True))


def test_hot_group_is_measured(spark, steps, split_plans):
    assert skew.has_hot_group(steps, ["k"])
    assert not skew.has_hot_group(steps, ["k", "pos"])


def test_rank_by_id_with_uneven_ids(spark, split_plans):
    ids = [1, 2, 3, 4, 5, 6, 10**12, 10**12 + 7, 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert sorted(r["pos"] for r in skew.rank_by_id(df, "id", "pos").collect()) == list(range(len(ids)))
    assert [r["id"] for r in skew.rank_by_id(df, "id", "pos").orderBy("pos").collect()] == ids


def test_rank_by_id_empty(spark):
    assert skew.rank_by_id(spark.createDataFrame([], "id bigint"), "id", "pos").count() == 0


@pytest.mark.parametrize("discount", [0.0, 0.5, 0.95, 1.0])
def test_discounted_suffix_sum(spark, discount):
    rng = random.Random(5)
    values = {k: [rng.uniform(-1, 1) for _ in range(n)] for k, n in [("long", 300), ("short", 3)]}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, pos bigint, d double")
    got = {(r["k"], r["pos"]): r["s"] for r in credit.discounted_suffix_sum(df, ["k"], "pos", "d", discount, "s", slice_rows=8).collect()}
    for k, vs in values.items():
        acc = 0.0
        for i in reversed(range(len(vs))):
            acc = vs[i] + discount * acc
            assert got[k, i] == pytest.approx(acc, abs=1e-9)


def test_gae_matches_the_recursion(spark):
    rng = random.Random(9)
    rows = [("t", i, rng.random(), rng.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v double, r double")
    got = {r["pos"]: r["gae_advantage"] for r in credit.gae(df, ["k"], "pos", "v", "r", 0.9, 0.8, hot=True, slice_rows=4).collect()}
    acc = 0.0
    for i in reversed(range(50)):
        following = rows[i + 1][2] if i < 49 else 0.0
        acc = rows[i][3] + 0.9 * following - rows[i][2] + 0.72 * acc
        assert got[i] == pytest.approx(acc, abs=1e-9)


@pytest.mark.parametrize("hot", [False, True])
def test_concordant_pairs_with_ties(spark, hot):
    rng = random.Random(1)
    rows = [(s, f"a{i:02d}", float(rng.randint(0, 4)), float(rng.randint(0, 4))) for s, n in [(1, 37), (2, 2), (3, 1), (4, 16)] for i in range(n)]
    df = spark.createDataFrame(rows, "s int, a string, g double, p double")
    got = {r["s"]: (r["pairs"], r["concordant"]) for r in pairs.concordant_pairs(df, ["s"], "a", "g", "p", hot=hot).collect()}
    for s in (1, 2, 4):
        mine = [r for r in rows if r[0] == s]
        want = [(x[2] - y[2]) * (x[3] - y[3]) > 0 for i, x in enumerate(mine) for y in mine[i + 1 :]]
        assert got[s] == (len(want), sum(want))
    assert 3 not in got


def test_permuted_picks_are_distinct_and_complete(spark):
    df = spark.range(1, 60).select("id", sampling.permuted_picks(F.col("id"), 7, 3, "id").alias("p"))
    for r in df.collect():
        assert len(set(r["p"])) == len(r["p"]) == min(7, r["id"])
        assert all(0 <= x < r["id"] for x in r["p"])


def test_permuted_picks_are_a_permutation(spark):
    df = spark.range(1, 80).select("id", sampling.permuted_picks(F.col("id"), 100, 3, "id").alias("p"))
    assert all(sorted(r["p"]) == list(range(r["id"])) for r in df.collect())


@pytest.mark.parametrize("side", [100, 1000])
def test_permuted_pairs_spread_on_both_sides(spark, side):
    """Four pairs of side x side: their halves differ about as often as those of independent draws do."""
    df = spark.range(400).select(sampling.permuted_picks(F.lit(side * side), 4, 3, "id").alias("p"))
    picks = [r["p"] for r in df.collect()]
    for half in (lambda x: x // side, lambda x: x % side):
        assert sum(len({half(x) for x in p}) == 4 for p in picks) > 0.88 * len(picks)
        assert len({half(x) for p in picks for x in p}) > min(0.9 * side, 700)
