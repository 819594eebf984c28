"""Line dedup, neighbours, substrings, mixing and near copies: operators that compare rows; the registry; the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
import sentencepiece
from compare import same
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import op02_sentencepiece as sp
from lodestone.llm import op03_toxicity as tox
from lodestone.llm import op04_line_dedup as ld
from lodestone.llm import op06_ann as ann
from lodestone.llm import op08_substring as sub
from lodestone.llm import op09_mixing as mx
from lodestone.llm import op10_minhash as mh
from lodestone.llm import registry

DATA = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# line dedup


@pytest.mark.parametrize("keep_whole", [False, True])
def test_lines_are_those_of_brute_force(spark, documents, awkward, empty, keep_whole):
    mixed = table(spark, [(i % 7, f"Same  line\nown {i}\n\n same LINE ") for i in range(9)] + [(None, "same line"), (None, "same line\nx"), (20, None), (21, ""), (22, "Same line")])
    for df, threshold in ((documents, 3), (mixed, 5), (mixed, 8), (awkward, 1)):
        want = brute.lines(pairs(df), threshold, keep_whole)
        out = ld.line_dedup(df, threshold, keep_whole=keep_whole)
        assert Counter(pairs(out)) == Counter((i, t) for (i, _), t in zip(pairs(df), want))
        assert len(out.columns) == len(set(out.columns))
    assert ld.line_dedup(empty).count() == 0


def test_line_sql_takes_nulls(spark, tmp_path):
    rows = [(i, f"Boiler plate\nown {i}\n") for i in range(12)] + [(100, None), (101, ""), (102, "BOILER  plate")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(registry.queries()["op4_line_dedup"](spark, str(tmp_path)), registry.oracle_sql()["op4_line_dedup"], str(tmp_path))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], DATA)


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)]


def test_a_document_that_would_lose_all_lines_can_stay(spark):
    df = table(spark, [(i, "a\nb") for i in range(12)] + [(50, "a\nmine")])
    assert {t for _, t in pairs(ld.line_dedup(df))} == {"", "mine"}
    assert {t for _, t in pairs(ld.line_dedup(df, keep_whole=True))} == {"a\nb", "mine"}


# nearest neighbours


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    g = x @ x.T
    np.fill_diagonal(g, -9)
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in np.argsort(-g[i], kind="stable")[:10]}
    for block, batch in ((128, 1 << 16), (8192, 200)):
        got = ann.neighbours(df, block=block, batch=batch).collect()
        assert len(got) == 10 * len(x) and all(abs(r.score - x[ids == r.vec_id][0] @ x[ids == r.neighbour_id][0]) < 1e-9 for r in got[:200])
        assert len(want & {(r.vec_id, r.neighbour_id) for r in got}) / len(want) > 0.99


def test_query_against_brute_force(spark):
    """Every fiftieth embedding against all: the very rows of a sort of all products."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got: dict[int, list[int]] = {}
    for r in ann.op6_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    want = {i: [int(j) for j in ids[np.lexsort((ids, -(x @ v)))] if j != i][:10] for i, v in zip(ids.tolist(), x) if i % 50 == 0}
    assert got.keys() == want.keys() and sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.99 * 10 * len(want)


def test_recall_with_clusters_and_other_sizes():
    rng = np.random.default_rng(3)
    for n, dim, k in ((700, 100, 10), (300, 7, 5), (12, 3, 20), (1, 4, 3)):
        x = (rng.standard_normal((8, dim))[rng.integers(8, size=n)] * 3 + rng.standard_normal((n, dim))).astype(np.float32)
        ids, mean = np.arange(n), x.astype(np.float64).mean(0)
        turn = ann.rotation(dim)
        q, c, s = ann.search(x, ids, x, ids, *ann.codes(x, mean, turn), mean, turn, k)
        g = x.astype(np.float64) @ x.T.astype(np.float64)
        np.fill_diagonal(g, -np.inf)
        want = {(i, j) for i in range(n) for j in np.argsort(-g[i], kind="stable")[: min(k, n - 1)]}
        assert len(set(zip(q.tolist(), c.tolist()))) == len(q) == n * min(k, n - 1)
        assert not want or len(want & set(zip(q.tolist(), c.tolist()))) / len(want) > 0.97


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 96)).astype(np.float32)
    mean, turn = x.astype(np.float64).mean(0), ann.rotation(96)
    packed, length, own = ann.codes(x, mean, turn)
    side = ann.Side(x[:50], mean, turn)
    ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
    guess = ann.products(side, slice(0, 50), packed, ones, 96) * (length / own)[None] * side.length[:, None]
    true = (x[:50] - mean) @ (x - mean).T
    width = ann.EPSILON * length[None] * side.length[:, None] * np.sqrt(1 - own**2)[None] / own[None] / np.sqrt(95)
    off = ~np.eye(50, 500, dtype=bool)
    assert (np.abs(guess - true) <= width)[off].mean() > 0.93 and abs((guess - true)[off].mean()) < 0.2


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [nan, 0.0]), (5, None), (6, [1.0]), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = [(r.vec_id, r.neighbour_id, r["rank"]) for r in ann.neighbours(df, 2).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 2, 1), (3, 1, 2), (8, 1, 1), (8, 2, 2)]
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 8")).count() == 0 == ann.neighbours(df, queries=F.col("vec_id") > 100).count()
    assert [r.neighbour_id for r in ann.neighbours(df, 2, queries=F.col("vec_id") == 8, batch=1).orderBy("rank").collect()] == [1, 2]


# substrings


def windows(df, length):
    out = set()
    for r in sub.factors(df, length).collect():
        assert r.end_word - r.start_word >= length
        out |= {(r.doc_id, i, r.ref_doc_id, r.ref_start_word + i - r.start_word) for i in range(r.start_word, r.end_word - length + 1)}
    return out


def test_factors_are_those_of_brute_force(spark, awkward, empty):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=25)
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            at, a = rng.randint(0, len(w)), rng.randint(0, 8)
            w[at:at] = passage[a : rng.randint(a + 5, 25)]
        docs.append((i, " ".join(w)))
    docs += [(70, docs[0][1]), (70, docs[0][1]), (71, "a " * 40), (72, "a " * 33), (None, docs[0][1]), (73, None), (74, "")]
    for length in (5, 8, 11):
        assert windows(table(spark, docs), length) == brute.factors(docs, length)
    rows = pairs(awkward)
    assert windows(awkward, 10) == brute.factors(rows, 10) and sub.factors(empty).count() == 0


def factor_rows(df, length):
    return sorted((r.doc_id, r.start_word, r.end_word, r.ref_doc_id, r.ref_start_word) for r in sub.factors(df, length).collect())


def test_parse_is_the_greedy_one(spark):
    """Factor by factor what a word-by-word parse against every reference block finds."""
    rng = random.Random(11)
    for length, vocabulary in ((4, "abcdef"), (6, "abc")):
        passages = [rng.choices(vocabulary, k=30) for _ in range(3)]
        docs = []
        for i in range(40):
            w = rng.choices([f"w{k}" for k in range(400)], k=rng.randint(0, 30))
            for _ in range(rng.randint(0, 3)):
                p, at = rng.choice(passages), rng.randint(0, len(w))
                a = rng.randint(0, 20)
                w[at:at] = p[a : a + rng.randint(3, 12)]
            docs.append((i, " ".join(w)))
        assert factor_rows(table(spark, docs), length) == sorted(brute.parse(docs, length))
    head, tail = " ".join(f"h{i}" for i in range(50)), " ".join(f"t{i}" for i in range(50))
    docs = [(1, f"{head} other"), (2, f"{head} {tail}"), (3, f"{head} {tail}")]
    assert factor_rows(table(spark, docs), 50) == sorted(brute.parse(docs, 50)) == [(2, 0, 50, 1, 0), (3, 0, 50, 1, 0), (3, 1, 100, 2, 1)]


def test_factors_of_documents(spark, documents):
    assert windows(documents, sub.LENGTH) == brute.factors(pairs(documents), sub.LENGTH)
    assert windows(documents.repartition(37), sub.LENGTH) == windows(documents, sub.LENGTH)


def test_factors_are_maximal(spark):
    words = [f"x{i}" for i in range(200)]
    df = table(spark, [(1, " ".join(words)), (2, " ".join(["new"] * 3 + words[20:120] + ["end"]))])
    assert [tuple(r) for r in sub.factors(df).collect()] == [(2, 3, 103, 1, 20)]


# mixing


def test_schedule_keeps_to_the_weights(spark):
    df = spark.createDataFrame([(i, "a b c d", f"s{i % 10 // 3}") for i in range(3000)], "doc_id long, text string, source string")
    weights = {"s0": 5, "s1": 3, "s2": 2}
    out = mx.mix(df, weights, block=8).collect()
    slots = {r.slot: r.source for r in out}
    order = [slots[s] for s in sorted(slots)]
    assert sorted(slots) == list(range(len(slots)))  # two documents a block: no slot is empty
    for n in (10, 50, 100, len(order)):
        for s, w in weights.items():
            assert abs(order[:n].count(s) - n * w / 10) <= 3
    assert len({r.doc_id for r in out}) == len(out) and {r.source for r in out} == set(weights)
    left = Counter(r.source for r in out)
    assert max(left.values()) == 900 or min(900 - left["s0"], 900 - left["s1"]) == 0  # one source is used up


def test_sources_begin_again(spark):
    df = spark.createDataFrame([(i, "a b", "x" if i < 4 else "y") for i in range(20)], "doc_id long, text string, source string")
    out = mx.mix(df, {"x": 1, "y": 1}, block=2, slots=40).collect()
    assert max(r.epoch for r in out if r.source == "x") >= 3 and max(r.epoch for r in out if r.source == "y") <= 1
    assert Counter(r.slot for r in out) == Counter(range(40))


def test_mixing_awkward(spark, awkward, empty, tmp_path):
    out = mx.mix(awkward).collect()
    assert {r.source for r in out} <= {"", "src0", "src1"} and all(r.epoch == 0 for r in out)
    assert mx.mix(empty).count() == 0
    awkward.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    same(mx.op9_mixing(spark, str(tmp_path)), mx.sql(), str(tmp_path))


# near copies


def groups(df, **kw):
    return {r.doc_id: r.group_id for r in mh.near_copies(df, **kw).collect()}


def test_tuning_finds_what_it_promises():
    for j in (0.05, 0.3, 0.5, 0.9, 1.0):
        bands, rows = mh.tune(j)
        assert bands * rows <= mh.PERMUTATIONS and (j < 0.1 or 1 - (1 - min(j, 0.9999) ** rows) ** bands >= mh.RECALL - 1e-9)
    edges = mh.bounds(1.5)
    assert (np.diff(edges) > 0).all() and edges[0] == 1
    assert mh.tune(mh.index_threshold(9, 0, edges, 0.9, 1.5))[1] > mh.tune(mh.index_threshold(9, 1, edges, 0.5, 1.5))[1]


def synthetic(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = []
    for base in range(25):
        w = rng.choices(vocabulary, k=rng.choice((3, 8, 40, 150, 600)))
        docs.append(" ".join(w))
        for _ in range(rng.choice((0, 1, 3, 8))):
            copy = [x if rng.random() > 0.02 else rng.choice(vocabulary) for x in w]
            docs.append(" ".join(copy[: len(copy) - rng.randint(0, len(copy) // 20)]))
        if base % 5 == 0:
            docs.append(" ".join(w))
            docs.append(" ".join(w + rng.choices(vocabulary, k=len(w) * 2)))  # holds a shorter one: no copy
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    docs = synthetic(seed)
    want, got = brute.near_groups(docs), groups(table(spark, docs))
    together = lambda g: {(a, b) for a in g for b in g if a < b and g[a] == g[b]}
    assert together(got) <= together(want)
    assert len(together(got)) >= 0.9 * len(together(want)) > 0


def test_groups_of_documents(spark, documents, awkward, empty):
    assert groups(documents) == brute.near_groups(pairs(documents))
    assert groups(documents.repartition(37)) == groups(documents)  # however the texts come in batches
    assert groups(awkward) == brute.near_groups(pairs(awkward)) and groups(empty) == {}


def test_bucket_of_many_strangers(spark):
    """Documents that share a passage meet in a bucket; only the real copies among them are found, and all of them."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    docs = [(i, common + " " + " ".join(f"z{rng.randrange(10**9)}" for _ in range(60))) for i in range(40)]
    docs += [(100 + i, t + " tail") for i, t in docs[::4]]
    assert groups(table(spark, docs)) == brute.near_groups(docs)


# the pipeline


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    """(input, output) of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        out.append((docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_stage_against_brute_force(spark, stages, documents, tmp_path):
    for before, after in stages[:-1]:
        assert before.columns == after.columns == documents.columns and before.schema == after.schema
    docs, out = stages[0]
    have = docs.collect()
    scored = brute.toxic([r.text for r in have], tox.lexicon_of(docs, DATA), tox.ALLOWED)
    assert rows(out) == Counter(tuple(r) for r, s in zip(have, scored) if s < tox.THRESHOLD)
    assert 0 < out.count() < docs.count()
    docs, out = stages[1]
    have = docs.collect()
    texts = brute.lines([(r.doc_id, r.text) for r in have], ld.THRESHOLD, True)
    assert rows(out) == Counter((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(have, texts))
    docs, out = stages[2]
    group = brute.near_groups(pairs(docs))
    assert rows(out) == Counter(tuple(r) for r in docs.collect() if group.get(r.doc_id, r.doc_id) == r.doc_id)
    docs, out = stages[3]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from compare import views

    kept = {(r[0], r[1]) for r in views(str(tmp_path)).sql(f"SELECT doc_id, source FROM ({mx.sql()})").fetchall()}
    assert rows(out) == Counter(tuple(r) for r in docs.collect() if (r.doc_id, r.source) in kept)
    docs, out = stages[4]
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    text = dict(pairs(docs))
    got = out.collect()
    assert len(got) == docs.count() and all(r.ids == lib.encode(text[r.doc_id]) and r.exact and r.n_tokens == len(r.ids) for r in got)


def test_run_is_the_stages_one_after_another(spark, stages):
    plain = lambda df: Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in df.collect())
    assert plain(corpus_pipeline.run(spark, DATA)) == plain(stages[-1][1])


def test_stages_take_awkward_documents(spark, awkward, empty, tmp_path):
    for kind, docs in (("awkward", awkward), ("empty", empty)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{kind}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}{k}")
        assert (docs.count() > 0) == (kind == "awkward")
