"""Alignment against a plain search over all pairs of tokens, with counts by a dictionary."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkroll.llm import alignment

PAIR = alignment.tokenizers()
STRANGE = [
    "", "<|endoftext|>a<s>b</s><unk>", "ΑΣ é café", " lead", "two  blanks ", "tab\tline\n\n", "日本語 テキスト", "👍🏽 ok", "a" * 400, "\u0000x", "▁x ▁", "<0x41>", "ﬁ ½ Å", " x", "x́ é",
]


def plain(text):
    """Ids, groups and links of one text, by comparing every token of A with every token of B."""
    a_tool = Tokenizer.from_file(PAIR.path_a)
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=PAIR.path_b)
    alphabet = {v: k for k, v in _alphabet().items()}
    raw = b" " + (text or "").encode()
    if not text:
        return [], [], [], []
    a, b = a_tool.encode(" " + text, add_special_tokens=False), b_tool.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a_tool.id_to_token(i)) for i in a.ids]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tool.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    spans = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        spans.append(out)
    links = [(x, y) for x, (s, e) in zip(a.ids, spans[0]) for y, (u, v) in zip(b, spans[1]) if max(s, u) < min(e, v)]
    groups, start = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        groups.append(([i for i, (s, e) in zip(a.ids, spans[0]) if start <= s and e <= end], [i for i, (s, e) in zip(b, spans[1]) if start <= s and e <= end]))
        start = end
    return a.ids, b, groups, links


def _alphabet():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + n)
            n += 1
    return table


@pytest.mark.parametrize("block_links", [alignment.BLOCK_LINKS, 40])
def test_digests_equal_plain_search(spark, docs, block_links):
    texts = [r.text for r in docs.where("n_chars < 900").limit(25).collect()] + STRANGE + [None, STRANGE[2], STRANGE[2]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    truth = [plain(t) for t in texts]
    counts = collections.Counter(link for t in truth for link in t[3])
    most = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = alignment.alignment_digests(frame, PAIR, block_links).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert sum(1 for t in truth if t[0]) > 25
    for r in rows:
        a, b, groups, links = truth[r.doc_id]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)), texts[r.doc_id]
        assert r.groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if a else "")
        assert r.count_sum == sum(counts[x] for x in links)
        assert r.n_best == sum(counts[x] == most[x[1]] for x in links)


def test_run_skipping_equals_intersection():
    rng = random.Random(5)
    for trial in range(300):
        size = rng.choice([1, 2, 5, 40, 300])
        share = rng.choice([0.0, 0.02, 0.3, 0.9])
        a = {k for k in range(1, size) if rng.random() < 0.6}
        b = {k for k in range(1, size) if rng.random() < share} ^ a
        a, b = sorted(a | {size}), sorted(b | {size})
        cuts_a, cuts_b = alignment.common_cuts(a, b)
        common = sorted(set(a) & set(b))
        assert cuts_a.tolist() == [a.index(c) + 1 for c in common] and cuts_b.tolist() == [b.index(c) + 1 for c in common], trial
    assert [len(c) for c in alignment.common_cuts([], [])] == [0, 0]


def test_groups_carry_ids_and_bytes(spark):
    frame = spark.createDataFrame([(1, "hello tokenizers"), (None, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in alignment.aligned_groups(frame, PAIR).collect()}
    assert rows[None].a == [] and rows[None].ends == []
    assert rows[1].ends[-1] == len(" hello tokenizers") and rows[1].cuts_a[-1] == len(rows[1].a) and rows[1].cuts_b[-1] == len(rows[1].b)
    assert np.all(np.diff(rows[1].ends) > 0)


def test_alignment_odd_rows(odd, empty):
    rows = alignment.alignment_digests(odd, PAIR, 10).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert sorted((r.n_a, r.groups_sha256) for r in rows)[:2] == [(0, ""), (0, "")]
    assert alignment.alignment_digests(empty, PAIR).count() == 0
    assert alignment.alignment_digests(odd.where("text is null"), PAIR).first().n_links == 0
