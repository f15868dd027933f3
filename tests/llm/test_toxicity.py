"""The kernel against a plain count of subsequences, the score against dictionaries, and held-out accuracy."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkroll.llm import toxicity
from sparkroll.llm.common import table


def letters_of(word):
    return [ord(c) - 96 for c in word]


def plain_kernel(one, other):
    """The kernel of two words of a-z, by listing all their subsequences."""

    def counts(word):
        found = {}
        for places in itertools.combinations(range(len(word)), toxicity.ORDER):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = "".join(word[p] for p in places)
                found[key] = found.get(key, 0) + toxicity.LAMBDA ** (span - toxicity.ORDER)
        return found

    a, b = counts(one), counts(other)
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    cosine = sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0
    return cosine**toxicity.POWER if cosine >= toxicity.FLOOR else 0.0


def rows(words):
    out = np.zeros((len(words), toxicity.WIDTH), np.uint8)
    for k, w in enumerate(words):
        out[k, : len(w)] = letters_of(w)
    return out


WORDS = ["idiot", "idixot", "idoit", "moron", "mormon", "worthless", "worth", "banana", "aaaaaa", "abc", "the", "closer", "loser", "zzz"]


def test_kernel_equals_plain_count():
    found = toxicity.Landmarks(rows(WORDS)).kernel(rows(WORDS))
    assert np.allclose(found, [[plain_kernel(a, b) for b in WORDS] for a in WORDS], atol=1e-4)
    assert toxicity.Landmarks(rows(WORDS)).kernel(rows([])).shape == (0, len(WORDS))


def said(text):
    return [["".join(chr(96 + c) for c in r if c) for r, s in zip(u.rows, u.sentence) if s == k] for u, _ in toxicity._batches(pa.array([text], pa.string())) for k in dict.fromkeys(u.sentence)]


@pytest.mark.parametrize(
    "text,sentences",
    [
        ("You i.d.i.o.t go. Be off now!\nx", [["you", "idiot"], ["off", "now"]]),
        ("an i d i o t he", [["anidiothe"]]),
        ("1d10t $tupid", [["idiot", "stupid"]]),
        ("Été été ETE", [["ete"]]),
        (None, []), ("", []), ("a. b! ?", []), ("12 34", []),
    ],
)
def test_units(text, sentences):
    assert said(text) == sentences


def test_long_units_are_read_in_windows():
    word = "abcdefghij" * 9
    found = said(word)[0]
    assert found[0] == word[: toxicity.WIDTH] and found[-1][-3:] == word[-3:] and len(found) > 2


def model():
    marks = rows(["idiot", "moron", "the"])
    return toxicity.Model(marks, np.array([2.0, 1.5, -0.1]), -1.0, np.array([1.5, 0.5, 0.2]), 0.3)


def plain_score(m, text):
    """Score of a text of plain words, sentence by sentence."""
    marks = ["idiot", "moron", "the"]
    values = []
    for sentence in re.split(r"[.!?](?=\s|$)|\n", (text or "").lower()):
        words = {w for w in sentence.split() if len(w) >= 3}
        if words:
            values.append(sum(w * plain_kernel(u, k) for u in words for w, k in zip(m.weights, marks)) + m.bias)
    best = sorted((max(v, m.bias) for v in values), reverse=True)[: toxicity.TOP]
    best += [m.bias] * (toxicity.TOP - len(best))
    return 1 / (1 + math.exp(-(float(np.dot(best, m.slopes)) + m.shift)))


def test_score_equals_plain_words(spark, odd, empty):
    texts = ["idiot moron idiot the other", "the idiots. another morons\nidioot thing", "nothing here. really", "Moron! Idiot? theme", None, "", "word " * 80_000 + "idiot."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.grade(frame, model()).collect():
        assert r.score == pytest.approx(plain_score(model(), texts[r.doc_id]), abs=1e-4), texts[r.doc_id]
        assert r.predicted == (r.score >= 0.5)
    assert toxicity.grade(odd, model()).count() == odd.count()
    assert toxicity.grade(empty, model()).count() == 0
    assert {r.score for r in toxicity.grade(odd, None).collect()} == {0.0}


def test_learns_disguised_insults(spark):
    clean = ["the quick brown fox walks over a green hill near water", "we read about rivers and towns in the north", "she paints a small house with a red door"]
    bad = ["you are a blorkit and a snarfle", "what a snarfle he is", "go away blorkit"]
    documents = [(k, ". ".join([clean[k % 3], clean[(k + 1) % 3], bad[k % 3] if k % 2 else clean[(k + 2) % 3]])) for k in range(240)]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    m = toxicity.train(frame, labels)
    asked = ["a b.l.o.r.k.i.t indeed", "such a snarffle and a bloorkit", "s n a r f l e", "bl0rkit", "the red door", "a green town by the water"]
    scores = [r.score for r in toxicity.grade(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), m).orderBy("doc_id").collect()]
    assert min(scores[0], *scores[2:4]) > 0.5 > max(scores[4:]), scores
    # inserted letters make an insult weaker, not harmless
    assert scores[1] > 8 * max(scores[4:]), scores
    assert toxicity.train(frame, labels.where("doc_id is null")) is None


def test_held_out_documents(spark):
    documents, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    m = toxicity.train(documents, labels)
    seen = toxicity.grade(documents, m).join(labels, "doc_id").join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    found = {(r.toxic, r.lang == "en"): (r.caught, r.n) for r in seen.groupBy("toxic", "lang").agg(F.sum("predicted").alias("caught"), F.count("*").alias("n")).collect() if r.lang == "en"}
    assert found[1, True][0] >= 0.88 * found[1, True][1]
    clean = seen.where("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert clean < 0.03
