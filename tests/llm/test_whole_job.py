"""Operators and stages that must not lose what they are for."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest

from lodestone.llm import op03_toxicity as tox
from lodestone.llm import op07_secrets as sec

LITERAL = "Xk29!fQz81"
GLUED = [s.replace("_?", "") for s in sec.GLUED.pattern.strip("()").split("|")]
NAMES = [*sec.PARTS, *("_".join(p) for p in sec.PAIRS), *GLUED, *(f"{s[:2]}_{s[2:]}" for s in GLUED), *("_".join(s) for s in GLUED), "DB_PASS", "userPass", "PassCode"]


@pytest.mark.parametrize("name", NAMES)
def test_every_name_of_some_weight_passes_the_filter(name):
    assert sec.name_weight(name) > 0 and re.search(sec.STEMS, f'{name} = "{LITERAL}"')


def test_secrets_finds_what_scan_finds(spark):
    texts = [f'{n} = "{LITERAL}"' for n in NAMES] + [f'DB_PASS = "{LITERAL}"', f'passcode: "{LITERAL}"']
    want = [(i, s[1]) for i, t in enumerate(texts) for s in sec.scan(t)]
    got = sec.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start) for r in got) == want and {len(texts) - 1, len(texts) - 2} <= {i for i, _ in want}


def test_copies_of_a_misspelling_do_not_excuse_it(spark):
    texts = ["you morron, you morron"] * 5 + ["a moron", "moron again"]
    got = {r.doc_id: r for r in tox.toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].n_misspelled == 2 and got[i].toxic for i in range(5))


def test_near_copies_keep_their_text_through_line_dedup(spark):
    """50 copies of a text of several lines, each with one edited line, are one document in the end, with all its lines; boilerplate goes."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lines = [words(12) for _ in range(10)]
    rows = []
    for i in range(50):
        own = list(lines)
        own[i % 10] = own[i % 10].rsplit(" ", 1)[0] + f" e{i}"
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, f"All rights reserved\n{words(40)}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["minhash_near_dedup"](spark, stages["line_dedup"](spark, docs, ""), "").collect()
    texts = dict(rows)
    assert {r.doc_id: r.text for r in out} == {0: texts[0]} | {i: t.split("\n")[1] for i, t in rows if i >= 100}


WAYS = ['{n} = "{x}"', "{n}: '{x}'", '"{n}": "{x}"', "conf['{n}'] = '{x}'", "conf[a][ '{n}' ] = \"{x}\"", "{n}={x}", "export {n}={x}", "- {n}: {x}", "<{n}>{x}</{n}>", 'put("{n}", "{x}")', "run --{n} {x} on", '{n} = get({pad}) or "{x}"', '{n}: str = "{x}"', 'k1 = "{x}"\n{pad}\n{n} = k1']


@pytest.mark.parametrize("way", WAYS)
def test_every_way_of_assignment_at_any_length(way):
    """Each literal is the one secret of its text, however long names, calls and indents are."""
    for name in ("password", "a_" * 200 + "secret_key", "dbPass"):
        for indent in ("", " " * 60, "\t" * 900):
            for pad in ("x", "y " * 600):
                if "\t" in indent and way.startswith(("k1", "export", "- ")):
                    continue
                text = "first line\n" + indent + way.format(n=name, x=LITERAL, pad=pad if "get" in way else f"z{pad}".replace(" ", "\n")) + "\nlast"
                found = sec.scan(text)
                place = text.rindex(LITERAL) if "k1" not in way else None
                assert [(s[0].strip("-"), s[3]) for s in found] == [(name, len(LITERAL))], (text, found)
                assert place is None or text[found[0][1] : found[0][2]].strip("\"' ") == LITERAL


def test_secrets_are_those_of_scanning_every_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    odd = ["x" * 300_000 + '\npassword = "' + LITERAL + '"', "a=" * 60_000 + f'"{LITERAL}"', "]=" * 60_000, " " * 400_000 + "token", "-" * 300_000 + " password", 'p = "ab"\n' + "p = p + p\n" * 60 + "password = p", "[" + " " * 100_000 + "]=" * 20_000 + "secret", '{"a":"b",' * 40_000 + '"api_key":"' + LITERAL + '"']
    docs = [(r.doc_id, r.text) for r in rows] + [(10**6 + i, t) for i, t in enumerate(odd)]
    got = [tuple(r) for r in sec.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted((i, *s) for i, t in docs for s in sec.scan(t)) and {10**6, 10**6 + 7} <= {r[0] for r in got}
