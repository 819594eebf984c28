"""Near copies and holders: no pair that meets the threshold is left out, whatever the sizes."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from lodestone.llm import op10_minhash as mh


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def found(df, **kw):
    return {r.doc_id: (r.group_id, r.container_id) for r in mh.duplicates(df, **kw).collect()}


def expected(docs) -> dict[int, tuple]:
    """By comparing all pairs: groups, and the largest document (of equal ones the lowest id) of more than RATIO times the size that holds it."""
    sets: dict[int, set] = {}
    for i, t in docs:
        if i is not None and brute.shingle_set(t):
            sets.setdefault(i, set()).add(brute.shingle_set(t))
    first: dict[frozenset, int] = {}
    for i in sorted(sets):
        for s in sets[i]:
            first.setdefault(s, i)
    groups, out = brute.near_groups(docs), {}
    for i, own in sets.items():
        over = [(len(y), -j) for y, j in first.items() for x in own if j != i and len(y) > mh.RATIO * len(x) and len(x & y) >= mh.CONTAINMENT * len(x)]
        if i in groups or over:
            out[i] = (groups.get(i, i), -max(over)[1] if over else None)
    return out


def text(rng, n: int) -> list[str]:
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def barely():
    """Pairs that just meet the threshold, where bands find least, and pairs that just don't."""
    rng, docs = random.Random(3), []
    for k in range(120):
        x = text(rng, 54)
        docs += [" ".join(x), " ".join(x[: 34 - k % 2] + text(rng, 45 + k % 2))]  # 50 and 75 shingles, 30 or 29 in common
    return list(enumerate(docs))


def test_every_pair_at_the_threshold(spark, barely):
    got = found(table(spark, barely))
    assert got == expected(barely) and len(got) == 120


def test_holders_of_any_size(spark):
    rng, docs = random.Random(4), []
    passage = text(rng, 12)
    for k in range(30):
        docs.append(passage[:10] + text(rng, 60 + 9 * k))  # a short text's holders
    docs += [passage[:11], passage]
    x = text(rng, 100)
    docs += [x, x + text(rng, 60), x + text(rng, 200), text(rng, 1500) + x + text(rng, 1500), x[:64] + text(rng, 800), x[:62] + text(rng, 5000), x + text(rng, 5000)]
    docs += [docs[-1], x[:63] + text(rng, 6000), x[::-1]]
    y = text(rng, 7)
    docs += [y, y[:6], y[:5], y[:4], ["a"] * 200, ["a"] * 5, ["a"] * 4]
    rng.shuffle(docs)
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    docs += [(0, docs[5][1]), (None, docs[1][1]), (90, None), (91, " "), docs[3]]
    want, got = expected(docs), found(table(spark, docs))
    assert got == want and sum(c is not None for _, c in want.values()) >= 5
    assert found(table(spark, docs).repartition(7)) == want
    assert {i: g for i, (g, _) in found(table(spark, docs), held=None).items()} == brute.near_groups(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_and_excerpts(spark, seed):
    rng, docs = random.Random(seed), []
    for _ in range(25):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((3, 8, 40, 150, 600)))]
        docs.append(" ".join(w))
        for _ in range(rng.choice((0, 1, 3, 8))):
            share, at = rng.choice((0.02, 0.1)), rng.randrange(len(w))
            copy = [x if rng.random() > share else "edited" for x in w]
            docs.append(" ".join(copy[:at] if rng.random() < 0.3 else copy + text(rng, rng.choice((0, 5, len(w), 4 * len(w))))))
    docs = list(enumerate(docs))
    want = expected(docs)
    assert found(table(spark, docs)) == want and any(c is not None for _, c in want.values())


def test_of_documents(spark, documents, awkward, empty):
    for df in (documents, awkward):
        assert found(df) == expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert found(empty) == {}


def test_no_two_documents_that_stay_meet_the_threshold(spark, barely):
    """Of a group the lowest id stays, of a text and one that holds it the larger; a group of which others hold members stays."""
    rng, texts = random.Random(6), [t for _, t in barely]
    x, y, z = text(rng, 60), text(rng, 100), text(rng, 70)
    nested = [x, x + text(rng, 60), x + text(rng, 2000), x + ["end"]]
    # the group of y reaches by steps of ratio 1.4 a text that holds its first, which is no holder from another group
    steps = [y, y + (more := text(rng, 38)), y + more + text(rng, 50)]
    # only a later member of the group of z is held, its first isn't
    later = [z, z[:50] + (own := text(rng, 32)), z[:15] + text(rng, 40) + z[15:50] + own + text(rng, 200)]
    texts += [" ".join(t) for t in nested + steps + later]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: brute.shingle_set(r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    group = brute.near_groups(docs)
    firsts = {i: brute.shingle_set(t) for i, t in docs if group.get(i, i) == i}
    holds = lambda a, b: len(b) > mh.RATIO * len(a) and len(a & b) >= mh.CONTAINMENT * len(a)
    assert set(kept) == {i for i, a in firsts.items() if not any(holds(a, b) for b in firsts.values())}
    assert not any(i != j and len(a) <= len(b) and len(a & b) >= mh.CONTAINMENT * len(a) for i, a in kept.items() for j, b in kept.items())
    n = len(barely)
    assert n + 2 in kept and n not in kept and n + 4 in kept and n + 5 not in kept and n + 6 not in kept


def test_an_id_with_several_texts_joins_the_groups_of_all(spark):
    """And holds nothing if it goes, so what only it holds stays."""
    rng = random.Random(8)
    a, b, c = text(rng, 80), text(rng, 150), text(rng, 60)
    docs = [(1, a), (2, a), (2, b + c), (3, b + c + ["end"]), (4, c), (5, text(rng, 30))]
    docs = [(i, " ".join(t)) for i, t in docs]
    assert mh.near_copies(table(spark, docs)).count() == 3
    assert {i: g for i, (g, _) in found(table(spark, docs)).items() if i != 4} == brute.near_groups(docs) == {1: 1, 2: 1, 3: 1}
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {1, 4, 5}
