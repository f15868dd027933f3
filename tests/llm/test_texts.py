"""Tokenizers against their library, HTML against known pages, leaks and fingerprints against plain searches."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkroll.llm import bpe, decontaminate, html, sketch, tokens
from sparkroll.llm.common import table

STRANGE = [
    "", "<|endoftext|>a<|startoftext|> b", "ΑΣ ΣΑΣ", "İI", "é café", "a" * 5000, "th" * 300 + "ing", "don't I'LL 'S o'clock", " \t\n\x1c\x85 a᠎b", "a\x1db\x1ec",
    "x<|endoftext|", "ab" * 33, "ab" * 300 + "\U00031350", "日本語 テキスト 12345", "👍🏽 ok 👍", "՘Ᲊ x", " " * 300 + "b", "a  \n  'll " * 50,
]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def test_bpe_equals_library(spark, docs, odd, word_library):
    frame = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = [r.text or "" for r in frame.collect()] + STRANGE
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in bpe.coded_digests(frame, bpe.vocabulary_path()).collect():
        ids = word_library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = bpe.vocabulary_path()
    rows = frame.select("doc_id", bpe.encode(path, "text").alias("ids")).select("doc_id", "ids", bpe.decode(path, "ids").alias("back")).collect()
    assert all(r.back == word_library.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_bpe_scan_and_heap_agree():
    words, rng = bpe.WordPairs(bpe.vocabulary_path()), random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"aehinorstl") for _ in range(rng.randint(1, 90)))
        parts = [words.inner[b] for b in raw[:-1]] + [words.last[raw[-1]]]
        assert words.scan(list(parts)) == words.heap(list(parts))


def test_bpe_empty(empty):
    assert bpe.coded_digests(empty, bpe.vocabulary_path()).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(tokens.CHUNK, tokens.OVERLAP), (64, 40), (300, 64)])
def test_token_counts_equal_library(spark, docs, byte_library, chunk, overlap):
    texts = [r.text for r in docs.limit(60).collect()] + STRANGE + [None, "x<|endoftext|>" * 40, STRANGE[5], "ab  \n  'll <|endoftext|>" * 60]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = tokens.count_tokens(frame, tokens.vocabulary_path(), chunk=chunk, overlap=overlap).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(byte_library.encode(text, add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024), text[:60]


def test_token_counts_odd_rows(odd, empty):
    rows = tokens.count_tokens(odd, tokens.vocabulary_path()).collect()
    assert len(rows) == 9 and [r.n_tokens for r in rows if r.n_bytes == 0] == [0, 0]
    assert tokens.count_tokens(empty, tokens.vocabulary_path()).count() == 0


def test_html_of_the_table(spark):
    import html as references

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    truth = {r.page_id: r for r in pages.collect()}
    for r in html.main_texts(pages).collect():
        article = re.search(r"<article>(.*?)</article>", truth[r.page_id].html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", references.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p)>|<br>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == truth[r.page_id].url


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<", "<"), ("a<b", "a<b"), ("<p>hi", "hi"), ("<!-- x", ""), ("<script>a</p>", ""), ("<p>a&nbsp;&amp;\n b", "a & b"),
        ("<nav>open <article><header><h1>T</h1></header><p>1<2 &lt;x&gt;</p><aside>no</aside><form>f</form><p>z", "T\n\n1<2 <x>\n\nz"),
        ("<article><p>x</p><div class='user-comments'><article><p>c</p></article></div><p>y</p></article><footer>f</footer>", "x\n\ny"),
        ("<body><div class=cookie-notice>We use</div><article><p>x<br>y</p><ul><li>1</li><li>2</li></ul></article>", "x y\n\n1\n\n2"),
        ('<div class="ad"><div>in</div>out</div><main><div><p>a</p><div class="sidebar">s</div></div></main>', "a"),
    ],
)
def test_html_cases(page, text):
    assert html.main_text(page) == text


LONG = "running text of the page " * 12


@pytest.mark.parametrize(
    "page,text",
    [
        ('<body class="has-sidebar"><p>{0}</p><div class="sidebar">s</div>', "{0}"),
        ('<body><main class="site-main with-sidebar"><p>{0}</p></main><p>no</p>', "{0}"),
        ('<article class="post comments-open"><p>{0}</p></article><p>no</p>', "{0}"),
        ('<body><form id="form1"><nav>menu</nav><p>{0}</p><p>{0}</p><button>go</button></form>', "{0}\n\n{0}"),
        ('<article><form><p>{0}</p></form><p>{0}</p><p>{0}</p><form>mail <input></form></article>', "{0}\n\n{0}\n\n{0}"),
        ('<article><h2 id="related-work">Related work</h2><p>{0}</p><section id="social-history"><p>short</p></section></article>', "Related work\n\n{0}\n\nshort"),
        ('<p>{0}<svg class="i"/> after</p><p>{0}</p>', "{0} after\n\n{0}"),
        ('<p>{0}</p><nav><a href=/>Home</a><p>{0}</p><p>{0}</p>', "{0}\n\n{0}\n\n{0}"),
        ("<nav><p>{0}</p></nav>", "{0}"),
        ('<div class="sidebar-layout"><p>{0}</p><div class="comments"><p>me too</p></div></div>', "{0}"),
        ("<p>{0}</p><p>{0} <span class=ad>buy</span> x</p>", "{0}\n\n{0} x"),
    ],
)
def test_html_class_words_do_not_drop_the_page(page, text):
    assert html.main_text(page.format(LONG.strip())) == text.format(LONG.strip())


def test_html_without_marked_article():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(9)) + "</ul>"
    body = ["word " * 50, "short one", "more text here " * 20]
    page = f"<html><head><title>t</title></head><body>{menu}{''.join(f'<p>{b}</p>' for b in body)}<div id=comments>first!</div>{menu}</body>"
    assert html.main_text(page) == "\n\n".join(b.strip() for b in body)


@pytest.mark.parametrize("elements", ["article|main", "article|main|nav|footer|header|aside"])
def test_html_finds_the_article_without_marks(spark, elements):
    """Marks of articles, classes and ids only help: the windows alone find the same text."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    plain = lambda h: re.sub(rf"(</?)(?:{elements})\b", r"\1div", re.sub(r' (?:class|id)="[^"]*"', "", h))
    same = sum(html.main_text(plain(h)) == html.main_text(h) for h in pages)
    assert same >= (len(pages) if elements == "article|main" else 0.97 * len(pages))


@pytest.mark.parametrize(
    "page,text",
    [
        # only a menu
        ("<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>", ""),
        # an advert before the title and a line below the last paragraph
        ("<div>Buy now.</div><h1>T</h1><p>{0}</p><p>short</p><div>(c) us</div>", "T\n\n{0}\n\nshort"),
        # bare lines between paragraphs stay; a notice before the title goes
        ("<p>We use cookies</p><h1>T</h1><p>{0}</p><div>bare</div><p>{0}</p>", "T\n\n{0}\n\nbare\n\n{0}"),
        # two surges with a dive between them
        ("<p>{0}</p><ul><li><a>1</a></li><li><a>2</a></li><li><a>3</a></li><li><a>4</a></li></ul><p>{0}</p>", "{0}\n\n{0}"),
        # no running text but in bare elements
        ("<div>{0}</div><div>more</div>", "{0}\n\nmore"),
        ("<div>one</div><p>two</p>", "two"),
    ],
)
def test_html_windows(page, text):
    assert html.main_text(page.format(LONG.strip())) == text.format(LONG.strip())


def test_html_odd_tables(spark):
    rows = [(1, "u", "<p>a", 5, "x"), (1, "u", "<p>a", 5, "x"), (None, None, None, None, None), (2, "v", "", 6, "y"), (3, None, "<p>" + "long text " * 300_000, 7, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars bigint, text string")
    got = sorted(((r.page_id, r.url, r.text[:4], r.n_chars) for r in html.main_texts(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0), (3, None, "long", 2_999_999)], key=str)
    assert html.main_texts(pages.limit(0)).collect() == []


def test_surge_and_dive():
    keep = html.dense_lines(np.array([0, 5, 0, 0, 0, 80, 20, 90, 0, 0, 0, 4]), 100)
    assert np.flatnonzero(keep).tolist() == [5, 6, 7]


def test_leaks_equal_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in table(spark, sf, "benchmark").collect()]
    expected = {(r.doc_id, i) for r in table(spark, sf, "documents").collect() for t in [plain(r.text)] for i, x in items if x in t}
    rows = decontaminate.op9_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)


def test_leaks_of_other_parameters():
    question = "If Anna has 12 apples and gives 5 apples to Bob then how many apples does Anna have after 3 days?"
    items = decontaminate.read_items([Row(item_id=1, text=question), Row(item_id=2, text="too short"), Row(item_id=3, text="")])
    other = "Well. if Maria has 40,5 apples and gives 7 apples to Tom then how many apples does {} have after 9 weeks? ok"
    found = decontaminate.leaks(items, pa.array([other.format("Maria"), other.format("Kim"), question.upper(), None, "", "too short", "he has 12 apples and gives 5 apples to her"]))
    # two numbers, two names, Anna again, the days and their number: a second filling for Anna is not consistent
    assert [(f[0], f[1]) for f in found] == [(0, 1), (1, 1), (2, 1)]
    assert found[0][4] == found[0][5] == found[1][4] and found[1][5] == found[1][4] - 1


def test_leaks_in_parts_of_the_benchmark(spark, docs, monkeypatch):
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 500)
    assert len(decontaminate.benchmark_passes(benchmark)) > 1
    assert sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == whole != []


def test_one_part_of_the_benchmark_at_a_time(spark, docs, monkeypatch):
    sf, most = "/root/testdata/sf0.001", []
    benchmark = table(spark, sf, "benchmark")
    clean = sorted(r.doc_id for r in decontaminate.keep_clean(spark, docs, sf).collect())
    find = decontaminate.find_leaks

    def one(passes, text):
        most.append(len(passes))
        return find(passes, text)

    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 500)
    monkeypatch.setattr(decontaminate, "find_leaks", one)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(spark, docs, sf).collect()) == clean
    decontaminate.contaminated(docs, benchmark).collect()
    assert max(most) == 1 and len(most) > 2


def test_leaks_of_items_without_template_windows(spark):
    items = ["What is 17 * 23 + 4 * 9?", "Calculate 12 + 15 * 3", "2, 3, 5, 7, 11, 13, 17, 19, 23, 29", "Pride Prejudice", "Zanzibar?", "3 km + 4 m + 5 cm + 6 mm + 7 km + 8 m", "An Introduction To Quantum Mechanics", "++"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [f"some words before. {t} and some after" for t in items[:-1]] + ["What is 18 * 23 + 4 * 9? Calculate 12 + 15. 2, 3, 5, 7 3 km and 4 m; pride, and prejudice"]
    rows = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(k, k) for k in range(7)] and all(r.coverage == 1 for r in rows)


def test_leaks_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e")], "item_id bigint, text string")
    rows = decontaminate.contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 3), (1, 3), (2, 3)]
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def plain_likeness(a, b):
    x, y = (collections.Counter(sketch.PARAGRAPH.findall(t)) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 1.0 if n == 0 else 2 * sum((x & y).values()) / n


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_versions(spark, docs, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = {r.doc_id: r for r in sketch.versions(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == len(texts)
    for (doc_id, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        edited, r = text[: len(text) - len(text) // 2] + after[: len(text) // 2], rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (plain_likeness(text, edited), plain_likeness(text, after))
    by = {}
    for doc_id, text in texts:
        assert by.setdefault(text, rows[doc_id].fingerprint) == rows[doc_id].fingerprint
    assert len(set(by.values())) == len(by)


def test_versions_odd_rows(odd, empty):
    rows = sketch.versions(odd).collect()
    assert len(rows) == 9 and len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert sketch.versions(empty).count() == 0
    one = odd.where("doc_id = 2")
    assert [(r.near_next, r.n_chars) for r in sketch.versions(one).collect()] == [(1.0, 10)]


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(2)
    common, mine, theirs = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 5, 6))
    a, b = (sketch.sketches([np.concatenate([common, x])], 30) for x in (mine, theirs))
    _, digest, sign, empty = sketch.peel(a[0] - b[0], a[1] - b[1], a[2] - b[2])
    assert empty.all() and set(digest[sign == 1]) == set(mine) and set(digest[sign == -1]) == set(theirs)
    # ten times the cells' worth of differences fails first and is repeated larger
    many = rng.integers(0, 2**63, 300).astype(np.uint64)
    apart, cells = sketch.differences([many], [common])
    assert apart[0] == 700 and cells > sketch.CELLS


def test_encoding_stage_decodes(spark, docs):
    stage = {r.doc_id: r for r in bpe.encoded(spark, docs, "").collect()}
    for row in bpe.coded_digests(docs, bpe.vocabulary_path()).collect():
        r = stage[row.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (row.n_tokens, row.ids_sha256, row.decoded_sha256) and len(r.ids) == r.n_tokens


def test_hot_long_text_is_encoded_once(spark, byte_library):
    text = "a long text, again " * 3000
    frame = spark.createDataFrame([(k % 40, text) for k in range(60)] + [(None, text), (7, text + "!")], "doc_id bigint, text string").repartition(6)
    long = frame.withColumn("digest", F.sha2("text", 256))
    assert tokens.cut(tokens.one_of_each(long), tokens.CHUNK, tokens.OVERLAP).groupBy("digest").agg(F.count_distinct("idx").alias("chunks")).count() == 2
    assert tokens.one_of_each(long.where("doc_id is null or doc_id < 40").dropDuplicates(["doc_id", "text"])).count() == 2
    n = {t: len(byte_library.encode(t, add_special_tokens=False)) for t in (text, text + "!")}
    rows = tokens.count_tokens(frame, tokens.vocabulary_path()).collect()
    assert sorted(r.n_tokens for r in rows) == sorted([n[text]] * 61 + [n[text + "!"]])


def test_ids_fall_back_to_the_library(byte_library):
    tool = tokens.counter(tokens.vocabulary_path())
    for text in (" " * 1_100_000 + "x", "͸a <|endoftext|>", "\U00031350"):
        assert tool.ids(text, special=True).tolist() == byte_library.encode(text, add_special_tokens=False).ids
    assert 50256 not in tool.ids("a<|endoftext|>", special=False).tolist() and tool.fast is not None


def test_returned_fingerprints_subtract_and_peel():
    rng = random.Random(8)
    for trial in range(60):
        shared = [f"line {rng.getrandbits(60)}\n" for _ in range(rng.randint(0, 40))]
        mine, yours = ([f"{side} {rng.getrandbits(60)}\n" for _ in range(rng.randint(0, 4))] for side in "ab")
        sets = [sketch.paragraph_digests("".join(shared + part)) for part in (mine, yours)]
        digests, signs, whole = sketch.difference(*sketch.fingerprints(sets))
        assert whole, trial
        assert {int(d) for d, s in zip(digests, signs) if s == 1} == set(map(int, sets[0])) - set(map(int, sets[1]))
        assert {int(d) for d, s in zip(digests, signs) if s == -1} == set(map(int, sets[1])) - set(map(int, sets[0]))
    few, many = ([sketch.paragraph_digests("".join(f"x {k}\n" for k in range(n)))] for n in (1, 400))
    assert not sketch.difference(sketch.fingerprints(few)[0], sketch.fingerprints(many)[0])[2]
