import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, kmeans, oplog, search
from lodestone.operators.filters import And, Contains, DocIds, Ids, NotContains, Or, Schema, condition, matches, restrict
from lodestone.operators.terms import postings, terms_of

NINE = [(0, 0), (40, 40), (90, 90), (1, 1), (41, 41), (91, 91), (2, 2), (42, 42), (92, 92)]


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "doc_id long, vector array<double>")


def groups(df, centroids, **kw):
    out = {}
    for r in kmeans.labels(df, centroids, **kw).collect():
        out.setdefault(r.label, set()).add(r.doc_id)
    return {frozenset(g) for g in out.values()}


def test_top_k(spark):
    rows = [(i, [float(i)] * 4) for i in range(1000)] + [(1000, [1.2, 2.2, 3.2, 4.2])]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    assert [r.doc_id for r in search.top_k(df, [1.4, 2.4, 3.4, 4.4], 3).collect()] == [1000, 3, 2]
    plan = search.top_k(df, [1.4, 2.4, 3.4, 4.4], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_order_of_results(spark):
    rows = [(float("nan"), 5), (1.0, 2), (1.0, 1), (3.0, 0), (float("nan"), 4), (2.0, 1)]
    df = spark.createDataFrame(rows, "score double, doc_id long")
    got = search.gather([df, df.limit(0)], 10).collect()
    assert [(r.doc_id) for r in got] == [1, 2, 1, 0, 4, 5] and [r.score for r in got[:4]] == [1, 1, 2, 3]


@pytest.mark.parametrize("metric", ["l2", "negdot"])
def test_batch_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 5))  # many ties
    df = points(spark, x)
    queries = df.limit(40).select(F.col("doc_id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.top_k_batch(df, queries, 7, metric).collect()}
    for q in {k[0] for k in got}:
        d = -(x @ x[q]) if metric == "negdot" else ((x - x[q]) ** 2).sum(1)
        want = np.lexsort((np.arange(300), d))[:7].tolist()
        assert [got[q, r] for r in range(1, 8)] == want
    assert search.top_k_batch(df, queries.limit(0), 7, metric).count() == 0


def test_users(spark):
    df = spark.createDataFrame([(u, d, [float(d)]) for u in (1, 2) for d in range(5)], "user_id long, doc_id long, vector array<double>")
    assert [r.doc_id for r in search.top_k_users(df, [0.0], 3, [1, 2]).collect()] == [0, 1, 2]
    assert search.top_k_users(df, [0.0], 3, [9]).count() == 0
    assert search.top_k_each_user(df, [0.0], 2).count() == 4


def test_kmeans_groups(spark):
    df = points(spark, NINE)
    assert groups(df, kmeans.kmeans(df, 3, initial=[NINE[i] for i in range(3)], penalty=1e-4)) == {frozenset(g) for g in ((0, 3, 6), (1, 4, 7), (2, 5, 8))}
    moved = NINE[:7] + [(5, 5)] + NINE[8:]
    df = points(spark, moved)
    assert groups(df, kmeans.kmeans(df, 3, initial=moved[:3])) == {frozenset(g) for g in ((0, 3, 6, 7), (1, 4), (2, 5, 8))}
    assert len(groups(df, kmeans.kmeans(df, 10))) == 9


def test_kmeans_repairs_empty_clusters(spark):
    df = points(spark, NINE)
    assert len(groups(df, kmeans.kmeans(df, 3, initial=[(0, 0), (500, 500), (900, 900)]))) == 3


def test_kmeans_penalty_balances(spark):
    df = points(spark, [(0, 0)] * 20 + [(1, 1)] * 2)
    sizes = sorted(len(g) for g in groups(df, kmeans.kmeans(df, 2, initial=[(0, 0), (1, 1)])))
    assert sizes == [2, 20]


def test_lists_are_split(spark):
    rng = np.random.default_rng(2)
    df = points(spark, rng.standard_normal((200, 3)))
    c = kmeans.build_centroids(df, 2, 40, max_iterations=20)
    sizes = [r["count"] for r in kmeans.labels(df, c).groupBy("label").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 200
    same = points(spark, [(1, 1)] * 50)  # equal vectors can't be split
    assert len(kmeans.build_centroids(same, 2, 10)) >= 1


def test_cluster_count():
    assert [ann.cluster_count(*a) for a in ((0, 5), (100, 10), (101, 10), (1000, 10, 20), (3, 10), (10, 1, None))] == [0, 10, 10, 50, 3, 1]


def test_assignment_to_several_centroids(spark):
    df = points(spark, [(0.0,), (1.0,), (2.0,)])
    c = spark.createDataFrame([(0, [0.0]), (1, [2.0])], "centroid_id int, centroid array<double>")
    got = {(r.doc_id, r.centroid_id) for r in ann.assign(df, c, (), 2, 0.1).collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 1)}
    assert {(r.doc_id, r.centroid_id) for r in ann.assign(df, c).collect()} == {(0, 0), (1, 0), (2, 1)}  # ties: the lower one


def test_search_by_lists_counts_documents_once(spark):
    df = points(spark, [(0.0,), (1.0,), (2.0,)])
    c = spark.createDataFrame([(0, [0.0]), (1, [2.0])], "centroid_id int, centroid array<double>")
    lists = ann.assign(df, c, (), 2, 0.1)
    q = spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>")
    assert [r.doc_id for r in ann.search(q, c, lists, 5, 2).orderBy("rank").collect()] == [1, 0, 2]
    assert [r.doc_id for r in ann.search(q, c, lists, 5, 2, dedup=False).orderBy("rank").collect()].count(1) == 2
    only = spark.createDataFrame([(2,)], "doc_id long")
    assert [r.doc_id for r in ann.search(q, c, lists, 5, 2, matched=only).collect()] == [2]
    assert ann.probe(q, c, 2, 0.0).count() == 2  # both equally near


DOCS = [(1, "run connect", "Even"), (2, "run", "odd"), (3, "walk", None)]


@pytest.fixture(scope="module")
def indexed(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, kind string").withColumn("point_id", F.col("doc_id").cast("int") - 1)
    return terms_of(terms_of(df, "text", "english"), "kind", None)


SCHEMA = Schema(frozenset(("kind",)), {"text": "english"})


@pytest.mark.parametrize(
    "f, want",
    [
        (Contains("text", "running connections"), {1}),
        (Contains("text", "RUN"), {1, 2}),
        (Contains("text", "nonexistent"), set()),
        (Contains("text", "  "), set()),
        (Contains("kind", "Even"), {1}),
        (Contains("kind", "even"), set()),
        (Contains("nothere", "x"), None),
        (NotContains("text", "run"), {3}),
        (NotContains("kind", "Even"), {2, 3}),
        (And(()), set()),
        (Or(()), set()),
        (None, set()),
        (And((Contains("text", "run"), NotContains("text", "connect"))), {2}),
        (Or((Contains("text", "connect"), Contains("text", "walk"))), {1, 3}),
        (Ids((0, 2)), {1, 3}),
        (DocIds((2, 99)), {2}),
        (And((DocIds((1, 2)), Contains("text", "connect"))), {1}),
        (Ids(()), set()),
    ],
)
def test_filters(indexed, f, want):
    if want is not None:
        assert {r.doc_id for r in indexed.filter(condition(f, SCHEMA)).collect()} == want
    index = postings(indexed, ["text", "kind"])
    assert {r.doc_id for r in matches(f, index, indexed.select("doc_id", "point_id"), SCHEMA).collect()} == (want or set())


def docs(*ids):
    return DocIds(ids)


@pytest.mark.parametrize(
    "f, want",
    [
        (Or((And((docs(*range(1, 6)), docs(*range(3, 8)))), docs(*range(4, 9)))), range(3, 9)),
        (And((Or((docs(*range(1, 6)), docs(*range(3, 8)))), docs(*range(4, 9)))), range(4, 8)),
        (And((Or((docs(1, 2, 3), docs(2, 3, 4))), Or((docs(2, 3, 5), docs(3, 5, 6))))), (2, 3)),
        (Or((And((docs(1, 2, 3), docs(2, 3, 4))), And((docs(2, 3, 5), docs(3, 5, 6))))), (2, 3, 5)),
    ],
)
def test_algebra_of_ids(spark, f, want):
    assert [r.doc_id for r in spark.range(10).toDF("doc_id").filter(condition(f)).orderBy("doc_id").collect()] == list(want)


def test_candidates(spark):
    some = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id for r in restrict([2, 3, 4, 5], some).collect()} == {2, 3}
    assert restrict([], some).count() == 3 and restrict([10, 11, 12], some).count() == 0


def test_limit(spark):
    some = spark.createDataFrame([(3,), (1,), (3,), (2,)], "doc_id long")
    assert [r.doc_id for r in search.term_search(some, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.term_search(some, 0)


def test_log_against_a_model(spark):
    rng = np.random.default_rng(5)
    ops = [(s, "delete" if rng.random() < 0.3 else "insert", int(rng.integers(3)), int(rng.integers(6)), float(s)) for s in range(200)]
    state, live = {}, []
    for s, op, u, d, v in ops:
        if op == "delete":
            state.pop((u, d), None)
            live = [x for x in live if (x[0], x[1]) != (u, d)]
        else:
            state[u, d] = v
            live.append((u, d, s))
    shuffled = [ops[i] for i in rng.permutation(len(ops))]
    df = spark.createDataFrame(shuffled, "seq long, op string, user_id long, doc_id long, value double")
    assert {(r.user_id, r.doc_id): r.value for r in oplog.latest(df).collect()} == state
    assert sorted((r.user_id, r.doc_id, r.seq) for r in oplog.live(df).collect()) == sorted(live)
    stats = oplog.segment_stats(df, 50).collect()
    assert len(stats) == 4 and all(0 <= r.live <= r.docs for r in stats)
    assert oplog.merge_candidates(oplog.segment_stats(df, 50), 4).count() == 0
    assert oplog.merge_candidates(oplog.segment_stats(df, 50), 3).count() == 2


def test_histogram(spark):
    df = spark.createDataFrame([(0.0005,), (0.003,), (5.0,), (None,)], "v double")
    assert [(r.bound, r.n) for r in oplog.histogram(df, "v", 0.001, 2, 3).collect()] == [(0.001, 1), (0.002, 1), (0.004, 2), (None, 3)]


@pytest.mark.parametrize("metric", ["l2", "negdot"])
def test_batch_memory_is_that_of_a_block(spark, metric, monkeypatch):
    """In blocks of queries, with copies, zeros, NaN and ids of text: the rows of comparing all, and no product of all queries with a batch."""
    from lodestone.functions import nearest

    monkeypatch.setattr(search, "BLOCK", 100)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((200, 6)), rng.integers(-1, 2, (200, 6)), np.zeros((20, 6)), np.full((2, 6), np.nan)])
    x = np.concatenate([x, x[:50]])
    df = spark.createDataFrame([(f"{i:04}", [float(v) for v in r]) for i, r in enumerate(x)], "doc_id string, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.top_k_batch(df, df.select(F.col("doc_id").alias("query_id"), "vector"), 7, metric).collect()}
    assert len(got) == 7 * len(x)
    for q in range(len(x)):
        d = np.zeros(len(x))
        for j in range(6):
            d += x[q, j] * x[:, j] if metric == "negdot" else (x[q, j] - x[:, j]) ** 2
        d = -d if metric == "negdot" else np.sqrt(d)
        want = np.lexsort((np.arange(len(x)), d))[:7]
        assert [got[f"{q:04}", r][0] for r in range(1, 8)] == [f"{i:04}" for i in want]
        assert np.array_equal([got[f"{q:04}", r][1] for r in range(1, 8)], d[want], equal_nan=True)
    near = nearest.Nearest(rng.standard_normal((5000, 4)), 3, metric)
    assert len(near.parts) == 5 and nearest.ROWS * nearest.COLUMNS * 4 <= 64 << 20


def test_lists_meet_queries_in_blocks(spark, monkeypatch):
    """Lists that many queries probe, in blocks of 100 queries, give what the pairs of a join give."""
    monkeypatch.setattr(search, "BLOCK", 100)
    rng = np.random.default_rng(5)
    df = points(spark, rng.integers(-2, 3, (700, 4)))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((4, 4)))], "centroid_id int, centroid array<double>")
    lists, q = ann.assign(df, c, (), 2, 0.5), df.select(F.col("doc_id").alias("query_id"), "vector")
    a, b = ({tuple(r) for r in ann.search(q, c, lists, 5, 3, None, many=many).collect()} for many in (True, False))
    assert a == b and len(a) > 3000


def test_centroids_of_documents_that_share_an_id(spark):
    """Each user's document counts once in the sizes of lists, whoever else has one of its id."""
    df = points(spark, np.random.default_rng(6).standard_normal((60, 3))).withColumn("doc_id", F.lit(1).cast("long"))
    assert len(kmeans.build_centroids(df, 2, 60)) == 2


def test_labels_are_those_of_all_costs(spark):
    rng = np.random.default_rng(7)
    x, c = rng.integers(-2, 3, (3000, 3)).astype(float), rng.integers(-2, 3, (900, 3)).astype(float)
    sizes = rng.integers(0, 3, 900)
    cost = kmeans.costs(x, c, sizes, 0.5)
    got = {r.doc_id: (r.label, r.cost) for r in kmeans.labels(points(spark, x), c, sizes, 0.5).collect()}
    assert [got[i] for i in range(3000)] == list(zip(cost.argmin(1).tolist(), cost.min(1).tolist()))
    from lodestone.functions.nearest import nearest_label

    assert np.array_equal(nearest_label(x, c)[0], kmeans.costs(x, c, np.zeros(900), 0.0).argmin(1))


def test_postings_shuffle_only_what_shares_its_keys(spark):
    def index(rows):
        return postings(terms_of(spark.createDataFrame(rows, "doc_id long, text string"), "text"), ["text"])

    once, twice = index([(1, "a b a"), (2, "a")]), index([(1, "a b a"), (1, "b c")])
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.term) for r in once.collect()) == [(1, "text:a"), (1, "text:b"), (2, "text:a")]
    assert sorted((r.doc_id, r.term) for r in twice.collect()) == [(1, "text:a"), (1, "text:b"), (1, "text:c")]
