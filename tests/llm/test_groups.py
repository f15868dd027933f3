"""Near-duplicates, shards and the pipeline against plain versions."""

import collections
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from test_shingles import plain_kept
from sparkroll.llm import language, quality, sharding, simhash
from sparkroll.llm.common import table
from sparkroll.llm.components import components
from sparkroll.llm.registry import QUERIES


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable for each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        root = find(k)
        least[root] = min(x for x in (least.get(root), doc_id) if x is not None) if doc_id is not None or least.get(root) is not None else None
    return [least[find(k)] for k in range(len(prints))]


def test_simhash_of_documents(docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = [(r.doc_id, plain_print(texts[r.doc_id])) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for _, p in prints]
    assert [r.component_id for r in rows] == plain_components(prints)


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_dense_groups(spark, block):
    rng, prints = random.Random(4), set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), block=block)
    rooted = {r.node: r.root for r in components(edges).collect()}
    got = [rooted.get(s, s) for s in signed]
    expected = plain_components([(s, p) for s, p in zip(signed, prints, strict=True)])
    assert got == expected


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(100)] + [(k, 1000 + k) for k in range(300, 330)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    rows = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(rows[k] == 0 for k in range(1, 101)) and all(rows[1000 + k] == k for k in range(300, 330))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9 and {(r.fingerprint, r.component_id) for r in rows if r.doc_id == 5} == {("0" * 16, 1)}
    assert simhash.near_duplicates(empty).count() == 0


def check_shards(documents, rows, shards=40):
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in documents
    )
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    rows, texts = sharding.assign_shards(documents).collect(), documents.collect()
    check_shards(texts, rows)
    total = collections.Counter()
    for r in rows:
        total[r.shard] += r.size
    mean = sum(total.values()) / 40
    longest = max(r.size for r in rows)
    assert max(total.values()) <= mean + longest and min(total.values()) >= mean - longest
    # groups of equal texts stay together
    shard, groups = {r.doc_id: r.shard for r in rows}, collections.defaultdict(set)
    for d in texts:
        groups[d.text].add(shard[d.doc_id])
    assert sum(len(g) > 1 for g in groups.values()) <= 2


def test_shards_split_a_heavy_group(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('t', id)) as text", "'en' as lang", "'s' as source")
    total = collections.Counter()
    for r in sharding.assign_shards(rows).collect():
        total[r.shard] += r.size
    assert len(total) == 40 and max(total.values()) < 1.02 * min(total.values())


def test_shards_odd_rows(odd, empty):
    check_shards(odd.collect(), sharding.assign_shards(odd).collect())
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_native(docs):
    plan = sharding.assign_shards(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "decontamination", "encode"]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, sf)
    scored = {r.doc_id: r.predicted for r in quality.grade(docs, quality.train(docs, labels)).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {k for k, v in scored.items() if v == 1}

    spoken = steps["language"](spark, docs, sf)
    accepted = {r.doc_id for r in language.identify(docs, language.train(docs)).collect() if r.accepted}
    assert spoken.columns == columns and {r.doc_id for r in spoken.collect()} == accepted

    first = steps["near_duplicates"](spark, docs, sf)
    assert first.columns == columns and sorted((False, r.doc_id) for r in first.collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])

    clean = steps["decontamination"](spark, docs, sf)
    leaked = {r.doc_id for r in QUERIES["op9_decontamination"](spark, sf).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked

    coded = {r.doc_id: r.ids_sha256 for r in steps["encode"](spark, docs, sf).collect()}
    assert coded == {r.doc_id: r.ids_sha256 for r in QUERIES["op10_bpe"](spark, sf).collect()}


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_odd_rows(spark, odd, empty, stage):
    step, sf = dict(corpus_pipeline.STAGES)[stage], "/root/testdata/sf0.001"
    kept = step(spark, odd, sf).collect()
    assert len(kept) <= 9 and step(spark, empty, sf).count() == 0
    if stage == "near_duplicates":
        # the wordless rows are one group, the copies another, and the row without an id has a text of its own
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == plain_kept([(r.doc_id, r.text) for r in odd.collect()])


def test_block_pairs_of_a_hot_anchor_are_dealt_out(spark):
    """Between the blocks of an anchor and their lists stands a shuffle on the block pair."""
    prints = spark.range(5000).selectExpr("(id % 64) * 7 + id as fp")
    plan = simhash.links(prints, block=16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+L?, low#\d+, high#\d+", plan)


def test_simhash_broadcasts_nothing(spark, docs, monkeypatch):
    """Spark expects 34 anchors of a fingerprint to take the room of one, so no join may be left to its sizes."""
    plans = []
    for module in (simhash, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "stored", lambda df, whole=module.stored: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df))[1])
    plans.append(simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n for n in names if re.match(r"op\d+_", n)} == set(QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14))
