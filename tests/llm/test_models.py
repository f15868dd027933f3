"""Language identification, quality and language-model scores: held-out accuracy and plain counts."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkroll.llm import language, lm, quality
from sparkroll.llm.common import bounded_sample, pieces, table, text_buffers

SF = "/root/testdata/sf0.01"


def fold_of(doc_id) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = language.op2_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold_of(r.doc_id) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    # rejection leaves clean documents alone, and confidence means something
    assert sum(r.accepted for r in held) / len(held) > 0.97
    wrong = [r.score for r in rows if r.lang_pred != truth[r.doc_id]]
    assert not wrong or np.mean(wrong) < np.mean([r.score for r in rows])


def test_language_ignores_everything_but_text(spark):
    documents = table(spark, SF, "documents")
    model = language.train(documents)
    shifted = documents.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang", "'y' as source")
    a = {r.text: r.p for r in documents.select("text", language.language(model, "text").alias("p")).collect()}
    b = {r.text: r.p for r in shifted.select("text", language.language(model, "text").alias("p")).collect()}
    assert a == b


@pytest.mark.parametrize("n_langs", [1, 2, 4])
def test_language_rejects_what_it_has_not_learned(spark, n_langs):
    documents = table(spark, SF, "documents")
    langs = sorted(r.lang for r in documents.select("lang").distinct().collect())[:n_langs]
    documents = documents.where(documents.lang.isin(langs))
    rng = np.random.default_rng(6)
    random_letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (40, 100, 500, 2000)]
    other = ["これは日本語の文章です。" * 9, "Это русский текст о погоде и о людях. " * 5, "αυτό είναι ένα κείμενο " * 8]
    model = language.train(documents)
    assert not language.predict(model, pa.array(random_letters + other))[2].any()
    held = [r for r in language.identify(documents, model).collect() if r.held_out]
    assert sum(r.accepted for r in held) / len(held) > 0.97


def test_language_stage_without_a_model_keeps_all(spark, docs):
    frame = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert language.keep_identified(spark, frame, "").count() == docs.count()


def test_language_odd_rows(odd, empty):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == 9 and {r.lang_pred for r in rows if r.doc_id == 6} == {"und"}
    assert all((r.lang_pred == "und") == (r.score == 0 and not r.accepted) for r in rows)
    assert language.identify(empty, model).count() == 0 and language.train(empty) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


def test_subwords_do_not_cross_texts_or_depend_on_passages():
    texts = ["ab cd", "", "x"]
    data, offsets = text_buffers(pa.array(texts))
    together = collections.Counter()
    for part, own, numbers in pieces(data, offsets):
        for buckets, owner in language.subwords(*lm_points(part, own)):
            together.update(zip(numbers[owner].tolist(), buckets.tolist(), strict=True))
    for k, text in enumerate(texts):
        data, offsets = text_buffers(pa.array([text]))
        alone = collections.Counter()
        for part, own, _ in pieces(data, offsets):
            for buckets, _ in language.subwords(*lm_points(part, own)):
                alone.update(buckets.tolist())
        assert alone == collections.Counter({b: n for (i, b), n in together.items() if i == k})


def lm_points(part, own):
    from sparkroll.llm.common import code_points

    return code_points(part, own)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = quality.op7_quality(spark, SF).collect()
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (fold_of(r.doc_id) == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    wins = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert wins > 0.97 and np.mean(np.array(good) >= 0.3) > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.grade(odd, model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.grade(odd, None).collect()} == {0.5}
    assert quality.grade(empty, model).count() == 0 and quality.train(empty, labels) is None


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 2, 400).astype(float)
    samples = [(np.array([3 if y else 4, 100 + int(rng.integers(50))]), np.array([1.0, 1.0])) for y in target]
    model = quality.fit(samples, target, 0)
    z = [model.bias + quality.SCALE / 2 * model.weights[numbers].sum() for numbers, _ in samples]
    assert ((np.array(z) > 1) == (target == 1)).all() and ((np.array(z) < -1) == (target == 0)).all()
    assert model.weights[3] > 0 > model.weights[4] and np.count_nonzero(model.weights) <= 52


def test_bounded_sample(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'a', 'b') as label")
    got = bounded_sample(rows, "label", "id", 100).collect()
    count = collections.Counter(r.label for r in got)
    assert len(got) <= 100 and 30 <= count["a"] <= 70 and 30 <= count["b"] <= 70
    assert sorted(map(tuple, got)) == sorted(map(tuple, bounded_sample(rows.repartition(7), "label", "id", 100).collect()))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")) + ["\0end"]


def plain_scores(documents):
    """The model of sparkroll.llm.lm by dictionaries of words."""
    rows = [(r.doc_id, words_of(r.text), fold_of(r.doc_id)) for r in documents.collect()]

    def counted(folds):
        word, pair, texts = collections.Counter(), collections.Counter(), 0
        for _, words, f in rows:
            if f in folds:
                texts += 1
                word.update(words)
                pair.update(zip([None, *words], words, strict=False))
        return word, pair, texts

    word, pair, texts = counted({0, 2, 3, 4})
    kept_word, kept_pair, kept_texts = counted({2, 3, 4})
    total, types, kept_total = sum(word.values()), len(word), sum(kept_word.values())

    def bucket(n):
        return int(math.log2(n)) + 1 if n else 0

    def ratio(x):
        return int(np.round(lm.BINS * np.log2(x * (types + 1)))) if x > 0 else -9999

    cells = collections.Counter()
    for _, words, f in rows:
        if f == 0:
            for h, w in zip([None, *words], words, strict=False):
                c = kept_texts if h is None else kept_word[h]
                cells[bucket(c), ratio(kept_pair[h, w] / max(c, 1)), ratio(kept_word[w] / max(kept_total, 1))] += 1
    cell = collections.namedtuple("cell", "bucket two one n")
    weights = lm.learn_weights([cell(*k, n) for k, n in cells.items()])
    out = []
    for doc_id, words, f in rows:
        score = base = 0.0
        for h, w in zip([None, *words], words, strict=False):
            c = texts if h is None else word[h]
            m = weights[bucket(c)]
            score += math.log10(m[0] * pair[h, w] / max(c, 1) + m[1] * word[w] / max(total, 1) + m[2] / (types + 1))
            base += math.log10((word[w] + 0.5) / (total + 0.5 * (types + 1)))
        out.append((doc_id, f == 1, len(words), sum(word[w] > 0 for w in words), total, base, score))
    return out


@pytest.mark.parametrize("block_words", [3000, 2_000_000])
def test_lm_scores(docs, block_words):
    got = sorted(map(tuple, lm.score_texts(docs, block_words).collect()))
    expected = sorted(plain_scores(docs))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9)
    # the mixture beats the base where it has not seen the text
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_lm_odd_rows(odd, empty):
    got = lm.score_texts(odd).collect()
    expected = plain_scores(odd)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert np.allclose([r[5:] for r in sorted(map(tuple, got), key=key)], [r[5:] for r in sorted(expected, key=key)])
    assert lm.score_texts(empty).count() == 0


def test_slim_counts():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (lm.widened(lm.pack(lm.slim(counts)), len(counts)) == counts).all()


def test_em_finds_the_mixture():
    rng = np.random.default_rng(5)
    cell = collections.namedtuple("cell", "bucket two one n")
    # words seen by the bigram alone in 7 of 10 cases, by the unigram alone in 2, by neither in 1
    cells = [cell(5, 40, -9999, 7000), cell(5, -9999, 40, 2000), cell(5, -9999, -9999, 1000)]
    assert np.allclose(lm.learn_weights(cells)[5], (0.7, 0.2, 0.1), atol=0.02), rng


@pytest.mark.parametrize("limit", [8, 64])
def test_lm_words_do_not_depend_on_passages(monkeypatch, limit):
    rng = np.random.default_rng(3)
    texts = ["", "a" * 500, "a" * 64 + " " + "a" * 64, "日本語" * 90 + " x", None, "ab", "".join(rng.choice(list("aB\x01\x1f\x00 \n\t\x0b\x1cé"), 700))]
    texts += ["".join(rng.choice(list("ab\x01 "), rng.integers(200))) for _ in range(200)]
    whole = lm.words_of(pa.array(texts, pa.string()))
    assert [len(w) for w in whole] == [len(words_of(t)) - 1 for t in texts]
    monkeypatch.setattr(lm, "SLICE_BYTES", limit)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, lm.words_of(pa.array(texts, pa.string())), strict=True))
