"""Hard negatives against a plain comparison of all rows."""

import math
import random

import numpy as np
import pytest

from sparkroll.llm import negatives
from sparkroll.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, number int, part int"


def plain(rows, every, positives=5, negatives_=5):
    """All results, by scoring every row for every anchor with Python's whole numbers."""
    used = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(x)) for x in vector]))
    out = []
    for anchor, label, v in used:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), other, kind) for other, kind, w in used)
        best = [(other, -s) for s, other, kind in scored if kind == label and other != anchor][:positives]
        for positive, top in best:
            hard = [(other, -s) for s, other, kind in scored if kind != label and 80 * top <= 100 * -s <= 100 * top][:negatives_]
            out += [(anchor, positive, rank, other, top, s) for rank, (other, s) in enumerate(hard, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


@pytest.mark.parametrize("block_rows,pack_queries", [(negatives.BLOCK_ROWS, negatives.PACK_QUERIES), (23, 2)])
def test_table_equals_plain_comparison(spark, block_rows, pack_queries):
    frame = table(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id < 400")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert rows_of(negatives.hard_negatives(frame, every=50, block_rows=block_rows, pack_queries=pack_queries)) == plain(rows, 50)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k % 60, [rng.choice([-1.0, -0.25, 0.0, 0.3, 0.9]) for _ in range(rng.choice([0, 3, 11]))], k % 3) for k in range(150)]
    rows += [(None, [1.0], 1), (100, None, 1), (101, [1.0], None), (102, [None, 1.0], 1), (103, [float("nan")], 1), (104, [float("inf")], 1), (0, [1.0] * 20, 0), (0, [1.0] * 20, 0), (5, [900.0, -70000.5], 2), (10, [40000.0, 2.0], 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    # a float holds fewer digits than Python's numbers
    seen = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert rows_of(negatives.hard_negatives(frame, every=10, block_rows=40, pack_queries=3)) == plain(seen, 10)
    assert negatives.hard_negatives(frame.limit(0)).count() == 0
    assert negatives.hard_negatives(frame.where("label is null")).count() == 0


def test_index_gives_all_rows_above_a_threshold():
    rng = np.random.default_rng(4)
    for scale in (3, 200, 90_000, 3_000_000_000):
        # a few strong dimensions, so suffixes are covered
        vectors = np.floor(rng.normal(size=(300, 30)) * scale / np.arange(1, 31) ** 1.5).astype(np.int64)
        index = negatives.BlockIndex(vectors)
        queries = vectors[:9]
        truth = queries @ vectors.T
        for share in (0.9, 0.5, 0.1, -1.0):
            least = np.ceil(share * truth.max(axis=1).astype(np.float64))
            for q, (rows, scores) in enumerate(index.reaching(queries, least)):
                assert sorted(rows) == np.flatnonzero(truth[q] >= least[q]).tolist()
                assert (truth[q][rows] == scores).all()
        tails = index.suffix_norms(queries[:, index.order])
        assert index.lengths(tails, 0.9 * truth.max(axis=1)).mean() < len(index.starts)


def test_windows_fill_from_the_top():
    vectors = np.array([[100], [90], [80], [79], [50], [100]], np.int64)
    index, ids, labels = negatives.BlockIndex(vectors), np.arange(6), np.array([0, 1, 1, 1, 1, 0])
    anchor = negatives.Anchor(0, 0, [(7, 7_900, 9_000), (8, 8_000, 8_500), (9, 1, 2)])
    assert negatives.best_in_windows(index, ids, labels, [anchor], vectors[:1], 2, same=False) == [(7, 1, 9000), (7, 2, 8000), (8, 2, 8000)]
    assert negatives.best_in_windows(index, ids, labels, [negatives.Anchor(0, 0, [(1, negatives.BOTTOM, negatives.TOP)])], vectors[:1], 5, same=True) == [(1, 5, 10_000)]
