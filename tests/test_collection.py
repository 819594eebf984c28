import numpy as np
import pytest

from lodestone.operators.filters import Contains, NotContains
from lodestone.sources.collection import AlreadyExists, Catalog, Collection, CollectionConfig, NotFound, ShardDirectory
from lodestone.streaming.ingest import apply_batch

SCHEMA = "user_id long, doc_id long, vector array<float>, attributes map<string,string>"
THREE = [
    (0, 1, [1.0, 2.0, 3.0, 4.0], {"title": "apple banana cherry", "category": "Fruit"}),
    (0, 2, [5.0, 6.0, 7.0, 8.0], {"title": "banana orange", "category": "citrus"}),
    (0, 3, [9.0, 10.0, 11.0, 12.0], {"title": "dog cat mouse", "category": "animal"}),
]
Q = [5.0, 6.0, 7.0, 8.0]


def config(**kw):
    return CollectionConfig(num_features=4, attributes={"title": "text:english", "category": "keyword"}, initial_num_centroids=1, **kw)


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_lifecycle(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    c = catalog.create("c", config())
    assert c.flush() == "" and c.snapshot().docs().count() == 0 and c.snapshot().probe_search(Q, 3, [0]).count() == 0
    assert c.snapshot().term_search(Contains("title", "apple"), 5, [0]).count() == 0
    c.insert(spark.createDataFrame(THREE, SCHEMA))
    assert c.snapshot().docs().count() == 0  # seen after the flush
    first = c.flush()
    s = c.snapshot()
    assert ids(s.search(Q, 10, [0])) == [2, 1, 3] and ids(s.probe_search(Q, 10, [0])) == [2, 1, 3]
    for word, want in (("apple", [1]), ("orange", [2]), ("dogs", [3]), ("bananas", [2, 1]), ("nothing", [])):
        assert ids(s.search(Q, 10, [0], Contains("title", word))) == want == ids(s.probe_search(Q, 10, [0], where=Contains("title", word)))
    assert ids(s.search(Q, 10, [0], Contains("category", "Fruit"))) == [1] and ids(s.search(Q, 10, [0], Contains("category", "fruit"))) == []
    assert ids(s.search(Q, 10, [0], NotContains("title", "banana"))) == [3] and ids(s.search(Q, 10, [0], None)) == []
    assert s.search(Q, 10, [7]).count() == 0 and s.search(Q, 10, [7], Contains("title", "apple")).count() == 0
    # deletes at once, but not in a snapshot taken before
    c.remove([0, 8], [2, 99])
    assert ids(c.snapshot().search(Q, 10, [0])) == [1, 3] and ids(s.search(Q, 10, [0])) == [2, 1, 3]
    assert ids(c.snapshot().term_search(Contains("title", "banana"), 5, [0])) == [1]
    # inserted again: live again
    c.insert(spark.createDataFrame([(0, 2, [0.0, 0.0, 0.0, 0.0], {"title": "new banana"})], SCHEMA))
    second = c.flush()
    assert ids(c.snapshot().term_search(Contains("title", "banana"), 5, [0])) == [1, 2]
    before = {(r.doc_id, r.score) for r in c.snapshot().search(Q, 10, [0]).collect()}
    merged = c.merge([first, second])
    assert {(r.doc_id, r.score) for r in c.snapshot().search(Q, 10, [0]).collect()} == before
    assert ids(c.snapshot().term_search(Contains("title", "banana"), 5, [0])) == [1, 2]
    assert [(r.name, r.docs, r.live) for r in c.segments().collect()] == [(merged, 3, 3)]
    # reopened, with what the log has beyond the last flush
    c.remove([0], [1])
    again = catalog.get("c")
    assert ids(again.snapshot().search(Q, 10, [0])) == [3, 2]
    again.flush()
    vacuumed = again.auto_optimize()
    assert len(vacuumed) == 1 and [(r.docs, r.live) for r in again.segments().collect()] == [(2, 2)]
    assert ids(again.snapshot().term_search(Contains("title", "banana"), 5, [0])) == [2]  # terms survive a vacuum
    assert ids(again.snapshot(1).search(Q, 10, [0])) == [2, 1, 3]
    assert catalog.names() == ["c"]


def test_errors(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    c = catalog.create("c", config())
    with pytest.raises(AlreadyExists):
        catalog.create("c", config())
    with pytest.raises(NotFound):
        catalog.get("d")
    with pytest.raises(NotFound):
        c.merge(["x", "y"])
    with pytest.raises(NotFound):
        c.vacuum("x")
    with pytest.raises(NotFound):
        c.snapshot(5)
    with pytest.raises(ValueError):
        CollectionConfig(num_features=0)
    with pytest.raises(Exception, match="4 numbers"):
        c.insert(spark.createDataFrame([(0, 1, [1.0], {})], SCHEMA))
    assert c.flush() == ""


def test_copies_within_and_across_segments(spark, tmp_path):
    rows = [(0, 1, [1.0] * 4, {}), (0, 1, [2.0] * 4, {})]
    for dedup, want in (("segment", 2), ("latest", 1)):
        c = Collection.create(spark, f"{tmp_path}/{dedup}", config(dedup=dedup))
        c.insert(spark.createDataFrame(rows[:1], SCHEMA))
        c.insert(spark.createDataFrame(rows[1:], SCHEMA))
        c.flush()
        assert [r.vector for r in c.snapshot().docs().collect()] == [[2.0] * 4]
        c.insert(spark.createDataFrame([(0, 1, [3.0] * 4, {})], SCHEMA))
        c.flush()
        assert c.snapshot().docs().count() == want


def test_users_and_segments_are_searched_apart(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", config(max_number_of_segments=2))
    for k in range(3):
        docs = spark.createDataFrame([(10 * k + i, [float(10 * k + i)] * 4, [1, 2]) for i in range(3)], "doc_id long, vector array<float>, user_ids array<long>")
        c.insert(docs)
        c.flush()
    assert c.snapshot().docs().count() == 18
    assert ids(c.snapshot().probe_search([0.0] * 4, 4, [1], probes=1, ratio=None)) == [0, 1, 2, 10]
    assert len(c.auto_optimize()) == 1 and c.segments().count() == 2
    assert ids(c.snapshot().search([0.0] * 4, 4, [1])) == [0, 1, 2, 10]


def test_flush_when_due(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", config(max_pending_ops=3, max_time_to_flush_ms=10**9))
    c.insert(spark.createDataFrame(THREE[:2], SCHEMA))
    assert c.auto_flush() == ""
    c.insert(spark.createDataFrame(THREE[2:], SCHEMA))
    assert c.auto_flush() != ""
    c.remove([0], [1])
    assert c.auto_flush(now=10**12) == "" and c.snapshot().docs().count() == 2  # flushed for its age; only a delete


def test_replayed_batch_counts_once(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", config())
    ops = spark.createDataFrame([(1, "insert", 0, 1, [1.0] * 4, None), (0, "delete", 0, 1, None, None)], "order long, op string, user_id long, doc_id long, vector array<float>, attributes map<string,string>")
    apply_batch(c, ops, 0)
    apply_batch(c, ops, 0)
    assert c.last_seq() == 1 and c.snapshot().docs().count() == 1  # the delete came first


def test_string_ids(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", config(id_type="string"))
    c.insert(spark.createDataFrame([("u", "0" * 31 + "1", [1.0] * 4)], "user_id string, doc_id string, vector array<float>"))
    c.flush()
    assert ids(c.snapshot().search([0.0] * 4, 3, ["u"])) == ["0" * 31 + "1"]


def test_shard_directory(spark, tmp_path):
    d = ShardDirectory(spark, f"{tmp_path}/shards")
    with pytest.raises(NotFound):
        d.shards("a")
    d.publish({"a": [(0, 1)]}, [(1, "h1", 90)])
    d.publish({"a": [(0, 1), (1, 2)]}, [(1, "h1", 90), (2, "h2", 91)])
    assert d.shards("a") == [("a--0", 1, "h1", 90), ("a--1", 2, "h2", 91)]
    with pytest.raises(NotFound):
        d.shards("b")


def test_product_codes_in_the_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {i: [float(np.float32(v)) for v in rng.normal(size=4)] for i in range(60)}
    rows = [(i % 2, i, v, {}) for i, v in x.items()]
    c = Collection.create(spark, f"{tmp_path}/pq", config(quantization="pq", pq_subvector=2, pq_bits=3))
    for part in (rows[:40], rows[40:]):
        c.insert(spark.createDataFrame(part, SCHEMA))
        c.flush()
    c.remove([0], [4])
    for _ in range(2):
        s, want = c.snapshot(), []
        for r in s.docs().collect():
            pq = c.quantiser(r.segment)
            a, b = ([pq.codebook[i, j] for i, j in enumerate(pq.encode_array(np.array([v]))[0])] for v in (r.vector, Q))
            want.append((sum(float(((p - q) ** 2).sum()) for p, q in zip(a, b)), r.doc_id))
        got = [(r.score, r.doc_id) for r in s.probe_search(Q, 60, [0, 1], probes=60, ratio=None).collect()]
        assert len(got) == 59 and "vector" not in spark.read.parquet(f"{c.root}/segments/{s.segments[0]}/postings").columns
        assert sorted(d for _, d in got) == sorted(d for _, d in want)
        assert [p for p, _ in got] == pytest.approx(sorted(p for p, _ in want))
        c.merge(list(s.segments)) if len(s.segments) > 1 else None  # codes are trained again on the merged segment
    with pytest.raises(ValueError):
        config(quantization="other")
    with pytest.raises(ValueError):
        config(quantization="pq", pq_subvector=3)


def test_packed_rows(spark, tmp_path):
    schema = "user_ids array<long>, doc_ids array<long>, vectors binary"
    c = Collection.create(spark, f"{tmp_path}/packed", config())
    raw = bytearray(np.array([r[2] for r in THREE], "<f4").tobytes())
    c.insert_packed(spark.createDataFrame([([0, 7], [1, 2, 3], raw), ([7], [], bytearray())], schema))
    c.flush()
    got = {(r.user_id, r.doc_id, tuple(r.vector)) for r in c.snapshot().docs().collect()}
    assert got == {(u, d, tuple(v)) for u in (0, 7) for _, d, v, _ in THREE}
    with pytest.raises(Exception, match="a vector and a map"):
        c.insert_packed(spark.createDataFrame([([0], [1, 2], raw)], schema))
    c.remove_rows(spark.createDataFrame([(7, 1), (7, 99)], "user_id long, doc_id long"))
    assert c.snapshot().docs().count() == 5
