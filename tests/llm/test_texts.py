"""Repetition, SentencePiece, toxicity, HTML and secrets: operators that look at each text by itself."""

from __future__ import annotations

import functools
import random
import struct
from html.parser import HTMLParser

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import arrays as A
from lodestone.llm import op01_repetition as rep
from lodestone.llm import op02_sentencepiece as sp
from lodestone.llm import op03_toxicity as tox
from lodestone.llm.op05_html import extract, render
from lodestone.llm.op07_secrets import scan, score, secrets

few = st.lists(st.text("ab \né", max_size=60), max_size=6)


# repetition


@given(few)
@settings(max_examples=60, deadline=None)
def test_repeats_are_those_of_brute_force(texts):
    data, off = A.utf8(pa.array(texts, pa.string()))
    if len(texts):
        n, covered, longest = rep.measure(data, off, 4)
        assert n.tolist() == [len(t) for t in texts]
        assert list(zip(covered.tolist(), longest.tolist())) == [brute.repeats(t, 4) for t in texts]


def test_suffix_array():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 7, 60):
        s = rng.integers(0, 3, size).tolist()
        order, lcp = rep.suffix_array(np.array(s, np.int64))
        assert order.tolist() == sorted(range(size), key=lambda i: s[i:])
        for k in range(1, size):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repetition_rules(spark, awkward, empty):
    block = "".join(random.Random(1).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, block), (2, block * 10), (3, block + "x" * 5 + block)], "doc_id long, text string")
    got = {r.doc_id: (r.covered_chars, r.longest_repeat, r.keep) for r in rep.repetition(df).collect()}
    assert got == {1: (0, 0, True), 2: (3000, 2700, False), 3: (600, 300, False)}
    rows = rep.repetition(awkward).collect()
    assert len(rows) == awkward.count() and rep.repetition(empty).count() == 0
    assert {r.doc_id for r in rows if not r.keep} == {4, 8}


# SentencePiece


@functools.cache
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_ids_are_the_librarys(texts):
    m = sp.Model(sp._read(sp.MODEL))
    data, off = A.utf8(pa.array(texts, pa.string()))
    ids, first = m.encode(data, off)
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [lib().encode(t) for t in texts] if texts else got == []


def test_documents_round_trip(spark, documents, awkward, empty):
    rows = sp.encode(documents, keep=("doc_id", "text")).collect()
    assert all(r.exact for r in rows)
    assert [r.ids for r in rows] == lib().encode([r.text for r in rows])
    coded = sp.encode(documents)
    back = {r.doc_id: r.text for r in sp.decode(coded).collect()}
    assert back == {r.doc_id: r.text for r in rows}
    odd = sp.encode(awkward, keep=("doc_id", "text", "ids", "n_tokens")).collect()
    assert len(odd) == awkward.count() and sp.encode(empty).count() == 0
    for r in odd:
        assert (r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) and (r.text is None or "▁" in r.text or r.exact)
    with pytest.raises(Exception, match="no such id"):
        sp.decode(spark.createDataFrame([(1, [32000])], "doc_id long, ids array<int>")).collect()


def _field(n: int, value: bytes) -> bytes:
    return bytes([n << 3 | 2, len(value)]) + value


def unigram_model() -> bytes:
    """A hand-made unigram vocabulary."""
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(p, -rng.uniform(1, 9), 1) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bcab", "▁▁", "▁▁b", "aa", "aaa")]
    raw = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    return raw + _field(2, bytes([3 << 3, 1])) + _field(3, _field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


def test_viterbi_is_the_librarys():
    raw = unigram_model()
    m, theirs = sp.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc x", k=rng.randint(0, 25))) for _ in range(400)]
    data, off = A.utf8(pa.array(texts))
    ids, first = m.encode(data, off)
    scores = m.scores
    for t, a, b in zip(texts, first[:-1], first[1:]):
        got, want = ids[a:b].tolist(), theirs.encode(t)
        # runs of unknown characters are one id in the library; equal totals are as good
        squeezed = [x for i, x in enumerate(got) if not (x == 0 and i and got[i - 1] == 0)]
        assert squeezed == want or scores[got].sum() == pytest.approx(scores[want].sum())


# toxicity

LEX = {"idiot": 1.0, "moron": 1.0, "worthless": 1.0, "scum": 1.0, "pathetic": 0.5}


@given(st.lists(st.sampled_from([w[:i] + c + w[j:] for w in LEX for i in range(len(w) + 1) for j in range(i, min(len(w), i + 3) + 1) for c in ("", "x", "é", "zz", "1")]), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_automaton_accepts_what_the_distance_allows(ws):
    m = tox.automaton(tuple(LEX))
    data, off = A.utf8(pa.array([" ".join(ws)]))
    classes, start, end, _ = tox.split(data, off)
    which, term, edits = m.run(classes, start, end)
    got = {int(w): (int(e)) for w, e in zip(which, edits)}
    parts = " ".join(ws).split()
    assert len(start) == len(parts)
    for k, w in enumerate(parts):
        want = brute.accepted(w, LEX)
        assert (k in got) == (want is not None) and (want is None or got[k] == want[1])


def judged(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in tox.toxicity(df, **kw).collect()}


def test_toxic_and_quoted(spark):
    texts = ["You are an idiot.", 'He wrote "you idiot" in the letter.', "the word idiot means a fool", "an id1ot and a m0ron", "IDIOT!!", "a fine day, you said", "the id*ot you know, worthles scum", "an idiot", "clown school opens"]
    got = judged(spark, *texts)
    assert [i for i, r in got.items() if r.toxic] == [0, 3, 4, 6, 7, 8]
    assert got[1].n_quoted == 1 and got[2].n_quoted == 1 and got[3].n_misspelled == 2


def test_a_frequent_form_is_a_word_of_its_own(spark):
    got = judged(spark, "whre whre whre", "whre", "moorn and moorn, moron", "moron", "moron again")
    assert got[0].n_hits == 0 and got[2].n_hits == 1  # moorn is two edits away


def test_scores_are_those_of_brute_force(spark, documents, awkward, empty):
    rows = documents.select("doc_id", "text").collect()
    for lexicon in (tox.weighted(), tox.lexicon_of(documents, "/root/testdata/sf0.001"), tox.weighted({"über": 1.0, "éèrê": 0.7, "achlichzu": 1.0, "idiot": 0.4})):
        got = {r.doc_id: r.score for r in tox.toxicity(documents, lexicon=lexicon).collect()}
        assert got == {r.doc_id: s for r, s in zip(rows, brute.toxic([r.text for r in rows], lexicon, tox.ALLOWED))}
        assert sum(s >= tox.THRESHOLD for s in got.values()) > 0
    odd = ["IDİOT ıdiot", "ÜBER über ubér", "\u0130idiot", "x*idiot id*ot*", "«idiot»", "idiot\nyou", "𝕚diot 😀idiot", "e\u0301idiot", None, ""]
    got = judged(spark, *odd, lexicon={"idiot": 1.0, "über": 1.0})
    assert [got[i].score for i in range(len(odd))] == brute.toxic(odd, tox.weighted({"idiot": 1.0, "über": 1.0}), tox.ALLOWED)
    out = tox.toxicity(awkward, keep=("doc_id", "score", "text"))
    assert out.columns.count("score") == 1 and out.count() == awkward.count() and tox.toxicity(empty).count() == 0
    assert {r.doc_id for r in out.filter("toxic").collect()} == {1}


def test_labels_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    lexicon = tox.lexicon_of(docs.select("doc_id", "text"), folder)  # as the query has it
    rows = tox.toxicity(docs.withColumnRenamed("toxic", "label"), keep=("doc_id", "label", "quality"), lexicon=lexicon).collect()
    flagged = [r for r in rows if r.toxic]
    assert len(flagged) > 200 and sum(r.label for r in flagged) / len(flagged) > 0.99


def test_terms_are_learned_from_labels(spark):
    """Half of the labels teach, the other half judge; copies of one toxic text teach nothing, and another table's rows change no verdict."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    lexicon = tox.learn(docs, labels.filter("doc_id % 4 < 2"))
    rows = tox.toxicity(docs.join(labels.filter("doc_id % 4 >= 2").withColumnRenamed("toxic", "label"), "doc_id"), keep=("label", "lang"), lexicon=lexicon).collect()
    bad, flagged = [r for r in rows if r.label], [r for r in rows if r.toxic]
    assert sum(r.toxic for r in bad) / len(bad) >= 0.85 and sum(r.label for r in flagged) / len(flagged) >= 0.97
    assert {r.lang for r in flagged if r.label} == {"en", "de", "fr", "es"}
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("bcdfg", k=2)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("lmn", k=2))
    rows = []
    for i in range(300):
        w = [word() for _ in range(40)]
        if i % 10 == 0:
            w[5] = w[20] = "grässlik"
        rows.append((i, " ".join(w), int(i % 10 == 0)))
    rows += [(1000 + i, rows[0][1].replace("grässlik", "zzyzzy") + f" edit{i}", 1) for i in range(60)]
    rows += [(2000, None, 1), (2001, "", 0), (None, "grässlik", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = tox.learn(df, df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (5000, 1), (3, 0)], "doc_id long, toxic int")))
    assert set(learned) - set(tox.LEXICON) == {"grässlik"}
    assert tox.learn(df, df.select("doc_id", "toxic").limit(0)) == tox.weighted() == tox.learn(df.limit(0), df.select("doc_id", "toxic"))
    assert [r.toxic for r in judged(spark, "der grässlik da, grässlik", "der grasslik du, grässlik", "grässlik", lexicon=learned).values()] == [True, True, False]


# HTML


@pytest.mark.parametrize(
    "page, want",
    [
        (None, None),
        ("", ""),
        ("just text", "just text"),
        ("a < b & c &lt; d &amp; e", "a < b & c < d & e"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a <b>bold</b>,  <i> it </i>x", "a bold, it x"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ('<ol start="9"><li>a<li value=20>b<li>c</ol>', "9. a\n20. b\n21. c"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><th>Name<th>Q<tr><td>Apple<td>3</table>", "Name  | Q\nApple | 3"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td colspan=2>w<td>x</table>", "r | a\n  | b\nw |   | x"),
        ("<table><tr><td><p>one<p>two</table>after", "one\n\ntwo\n\nafter"),
        ("<td>stray", "stray"),
        ("<head><title>t</title></head>body", "body"),
        ("<script>var a='</p>';</script>x<style>p{}</style>", "x"),
        ("<script>never closed", ""),
        ("a<!-- c > d -->b<!---->c", "abc"),
        ("<p hidden>no</p><p style='display: none'>no<p>yes", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<pre>\n a\n\n  b</pre>", " a\n\n  b"),
        ("<textarea>\n a &amp; b</textarea>", " a & b"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("</p>a</div>", "a"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ('<a title="a>b" href=x>t</a>', "t"),
        ("<p class='never>closed", "closed"),
        ("&copy;&nbsp;2&#x41;", "© 2A"),
        ("<noscript>no</noscript><iframe>no</iframe>y", "y"),
        ("<h1>a<h2>b", "a\n\nb"),
        ("<!-- c --!>x<!-->y<!--->z", "xyz"),
        ("<p title=it's>Hello world, don't panic</p>", "Hello world, don't panic"),
        ("<a b='x>y' c=d'e>t</a>", "t"),
        ("<style>.h, p#i{display:none} b.k { visibility:hidden }</style><p class='a h'>no<p id=i>no<p class=k>yes<b class=k>no</b>", "yes"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>yes<div class=h>no", "yes"),
        ("<style>@media print{.h{display:none}} /* .h{display:none} */</style><style media=print>p{display:none}</style><p class=h>yes", "yes"),
        ("<table><tr><td>a<ul><li>one<li>two</ul><td>b<tr><td>c<td>d<br>e</table>", "a     | b\n- one\n- two\nc     | d\n      | e"),
    ],
)
def test_rendering(page, want):
    assert render(page) == want


@given(st.text("<>/!-\"'= abpdivtrlscn&;\n", max_size=120))
@settings(max_examples=150, deadline=None)
def test_any_page_renders(page):
    assert isinstance(render(page), str)


class _Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract(pages, keep=("page_id", "html")).collect():
        p = _Words()
        p.feed(r.html)
        shown = [w for w in r.text.replace("|", " ").split() if w != "-"]
        assert "".join(shown) == "".join("".join(p.out).replace("|", " ").replace("\xa0", " ").split())


def test_long_and_deep_pages(spark):
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<a " * 50_000) != ""
    assert render("<a \"" * 2000 + ">") is not None
    wide = "<table>" + "<tr><td>" + "w" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 1000 + "</table>"
    assert len(render(wide)) < 200_000  # one wide cell doesn't pad all the others
    assert render('<a x="' + '><b "x="' * 3000 + ">") is not None
    odd = spark.createDataFrame([(1, "<p>a", 5, "u")] * 3, "page_id long, html string, text int, `a.b` string").withColumnsRenamed({"page_id": "k0"})
    assert [tuple(r) for r in extract(odd, keep=("k0", "text", "a.b")).collect()] == [(1, "u", "a")] * 3
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (1, "", "z")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), str(r.text)) for r in extract(df, keep=("page_id", "text")).collect()) == [("1", ""), ("1", "None"), ("None", "a")]
    assert extract(df.limit(0)).count() == 0


# secrets


@pytest.mark.parametrize(
    "text, want",
    [
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]),
        ('a = "sk9f8A7d"\npassword = a + "Zx81Qw"', ["sk9f8A7dZx81Qw"]),
        ("config['db_password'] = 'hunter2!x'", ["hunter2!x"]),
        ('{"apiKey": "A1b2C3d4E5f6G7h8", "token_type": "bearer_abc123xyz"}', ["A1b2C3d4E5f6G7h8"]),
        ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzzKEY", ["wJalrXUtnFEMIK7MDENGbPxRfiCYzzKEY"]),
        ("BASE=ab12cd34\nDB_PASSWORD=${BASE}xyz9", ["ab12cd34xyz9"]),
        ("password: swordfish9", ["swordfish9"]),
        ("<password>corr3cth0rse</password>", ["corr3cth0rse"]),
        ("mysql --password s3cr3tpw12 db", ["s3cr3tpw12"]),
        ("define('DB_PASSWORD', 'q8w7e6r5t4');", ["q8w7e6r5t4"]),
        ('secret = env.SECRET || "fallbackS3cret99"', ["fallbackS3cret99"]),
        ('token: str = "9f8e7d6c5b4a39281706"', ["9f8e7d6c5b4a39281706"]),
        ('String clientSecret = new Secret("zz9988yyXX77");', ["zz9988yyXX77"]),
        ('password == "nope12345"', []),
        ('token = getenv("MY_TOKEN_NAME_123")', []),
        ('api_key = "your_api_key_here"', []),
        ('password = "changeme"', []),
        ('password_field = "x8Kd72mPq0"', []),
        ('colour = "x8Kd72mPq0Lz83"', []),
        ("see http://x.y/z at 12:30: nothing", []),
        (None, []),
        ("", []),
        ('password = "unterminated', []),
    ],
)
def test_secrets(text, want):
    import hashlib

    assert [s[6] for s in scan(text)] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_sensitive_names_score_higher():
    text = "q8W7e6R5t4Y3u2"
    assert score("db.password", text) == 1.0 > score("session_key", text) > score("keyboard", text) == 0 == score("passwordLabel", text)


def test_every_planted_secret_is_found(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = sorted((r.doc_id, m.start() + 8) for r in docs.select("doc_id", "text").collect() for m in re.finditer(r'token = "[0-9a-f]{40}"', r.text, re.I))
    assert len(want) > 100 and sorted((r.doc_id, r.start) for r in secrets(docs).collect()) == want


def test_awkward_secrets(spark, awkward, empty):
    assert secrets(awkward).count() == 0 == secrets(empty).count()
    df = spark.createDataFrame([(None, 'pwd="aB3$kk99Zq"'), (None, 'pwd="aB3$kk99Zq"')], "doc_id long, text string")
    assert secrets(df).count() == 2


@given(st.text("ab\"'=:+ \n(){}<>tokenpwd[]$", max_size=100))
@settings(max_examples=150, deadline=None)
def test_any_text_lexes(text):
    scan(text)
