"""The near-duplicate stage of the pipeline against brute force on shingle sets."""

import random

import pytest

import corpus_pipeline
from sparkroll.llm import shingles, simhash
from sparkroll.llm.common import prepared, table

STEP = dict(corpus_pipeline.STAGES)["near_duplicates"]


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """Least (no id, id) of each group of (doc_id, text) that links at Jaccard 0.8."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b) if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 else 0
            if a == b or (both and 5 * both >= 4 * (len(a) + len(b) - both)):
                group[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(least.values())


def kept(frame, spark):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in STEP(spark, frame, "").collect())


@pytest.mark.parametrize("block,load", [(2048, 1_000_000), (3, 300)])
def test_stage_equals_brute_force(spark, monkeypatch, block, load):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "BLOCK_SHINGLES", load)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng, vocabulary = random.Random(5), [f"w{k}" for k in range(3000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(40):
        base = rng.choices(vocabulary, k=rng.choice((3, 6, 30, 200)))
        for c in range(rng.choice((2, 5))):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((100_000 + 10 * k + c, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert kept(frame, spark) == plain_kept(rows)


def test_repeated_ids_with_other_texts_lose_no_group(spark):
    prepared(spark)
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a), (3, b), (7, b + " more"), (3, b), (None, a + " more"), (None, "alone"), (9, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r.doc_id, r.text) for r in STEP(spark, frame, "").collect()]
    assert sorted(found, key=str) == sorted([(3, a), (3, b), (None, "alone"), (8, "")], key=str)


def test_stage_takes_what_simhash_links(spark, monkeypatch):
    """Without the prefix-filter join SimHash still finds candidates, and those that are far apart by their sets stay."""
    whole = shingles._blockwise
    monkeypatch.setattr(shingles, "_blockwise", lambda members, key, blocks, what, tree: whole(members, key, blocks, what, tree).where("a is null" if what == "sketch" else "true"))
    long = [f"w{k}" for k in range(2000)]
    cycle = " ".join(f"c{k}" for k in range(9))
    tails = [" ".join([cycle] * 60 + [f"{c}{k}" for k in range(20)]) for c in "ab"]
    rows = [(1, " ".join(long)), (2, " ".join([*long, "more"])), (3, tails[0]), (4, tails[1]), (5, "alone"), (6, ""), (7, None)]
    bits = {k: simhash.fingerprint_bits((t or "").encode()) for k, t in rows}
    assert (bits[1] ^ bits[2]).bit_count() <= 3 and (bits[3] ^ bits[4]).bit_count() <= 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert kept(frame, spark) == plain_kept(rows) == [(False, k) for k in (1, 3, 4, 5, 6)]


def test_simhash_links_of_all_texts_of_a_set(spark, monkeypatch):
    """Texts of one shingle set can have far fingerprints; whatever links with any of them is compared with the set."""
    whole = shingles._blockwise
    monkeypatch.setattr(shingles, "_blockwise", lambda members, key, blocks, what, tree: whole(members, key, blocks, what, tree).where("a is null" if what == "sketch" else "true"))
    cycle, long = [f"c{k}" for k in range(9)], [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(cycle * 3 + long)), (2, " ".join(cycle * 300 + long)), (3, " ".join(cycle * 300 + long + ["more"])), (4, "alone")]
    bits = {k: simhash.fingerprint_bits(t.encode()) for k, t in rows}
    assert plain_set(rows[0][1]) == plain_set(rows[1][1]) and (bits[2] ^ bits[3]).bit_count() <= 3 and min((bits[1] ^ bits[k]).bit_count() for k in (2, 3)) > 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert kept(frame, spark) == plain_kept(rows) == [(False, 1), (False, 4)]
