import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import codecs, ids
from lodestone.functions.distance import checked, l2, l2_squared, negdot
from lodestone.functions.packed import pack_floats, split_vectors, unpack_floats
from lodestone.functions.quantise import NoQuantiser, ProductQuantiser, one_bit_codes
from lodestone.functions.stemmers import MISSING, WRITTEN, language_name, stemmer
from lodestone.functions.text import lower_tokens, query_terms, text_terms, tokens


def stems(language, text):
    return [stemmer(language)(w) for w in text.lower().split()]


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("english", "running connections happily", "run connect happili"),
        ("english", "  fast   faster    fastest  ", "fast faster fastest"),
        ("english", "Running CONNECTIONS", "run connect"),
        ("english", "skies dying news proceed relational conditional rational digitizer sensibilities hopefulness", "sky die news proceed relat condit ration digit sensibl hope"),
        ("english", "generate generously consistency knightly knackeries roll", "generat generous consist knight knackeri roll"),
        ("french", "les chevaux courent", "le cheval courent"),
        ("french", "continuait continuellement majestueusement maladie mains", "continu continuel majestu malad main"),
        ("german", "aufeinanderfolge kategorien häuser jährlich freundlichkeit", "aufeinanderfolg kategori haus jahrlich freundlich"),
        ("spanish", "chicas torneo toreado comprendiendo gritándole cheque", "chic torne tor comprend grit chequ"),
        ("swedish", "jaktkarlarne klokaste", "jaktkarl klok"),
        ("danish", "undersøgelserne opmærksomheden", "undersøg opmærksom"),
        ("norwegian", "havnedistriktene opningene", "havnedistrikt opning"),
        ("italian", "abbandonata pronto propaga", "abbandon pront propag"),
        ("portuguese", "quilométricas química quinta", "quilométr químic quint"),
        ("dutch", "lichaamszieken opheffen lichamelijkheden", "lichaamsziek opheff licham"),
        ("russian", "вавиловка вагнера важная важнейшие падать", "вавиловк вагнер важн важн пада"),
        ("vietnamese", "running tests", "run test"),
        ("none", "running tests", "running tests"),
    ],
)
def test_stems(language, text, want):
    assert stems(language, text) == want.split()


@given(st.text("abcdeilnorstuyáéñçèü", max_size=14))
@settings(max_examples=300, deadline=None)
def test_stemmers_take_any_word(word):
    for language in WRITTEN:
        assert len(stemmer(language)(word)) <= len(word) + 2


def test_languages():
    assert language_name("DE") == "german" and language_name("italy") == "italian" and language_name("klingon") == language_name(None) == "english"
    for name in MISSING:
        with pytest.raises(NotImplementedError):
            stemmer(name)


def test_tokens(spark):
    df = spark.createDataFrame([("   .  happy      new  year ",), ("a b　C",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens("t")).collect()] == [[".", "happy", "new", "year"], ["a", "b", "C"], [], []]
    assert df.select(lower_tokens("t")).collect()[1][0] == ["a", "b", "c"]
    two = spark.createDataFrame([("Running dogs run", "en"), ("Häuser", "de"), (None, None)], "t string, lang string")
    assert [r[0] for r in two.select(text_terms("t", "lang")).collect()] == [["dog", "run"], ["haus"], []]
    assert query_terms("Running run", "english") == ["run"]


def test_ids(spark):
    rows = [(1, 0), (-1, 2**62), (0, -(2**63))]
    df = spark.createDataFrame(rows, "low long, high long").withColumn("id", ids.from_halves("low", "high"))
    out = df.select("id", ids.low_half("id"), ids.high_half("id"), ids.from_bytes(ids.to_bytes("id")), ids.from_uuid(ids.to_uuid("id")), ids.to_bytes("id")).collect()
    for (low, high), r in zip(rows, out):
        value = (high % 2**64) << 64 | low % 2**64
        assert r[0] == f"{value:032x}" == r[3] == r[4] and (r[1], r[2]) == (low, high) and bytes(r[5]) == value.to_bytes(16, "little")
    bad = spark.createDataFrame([("zz", None, 5)], "uuid string, low long, high long")
    assert bad.select(ids.from_uuid("uuid"), ids.resolve("uuid", "low", "high")).first() == (None, None)
    both = spark.createDataFrame([("0123456789ABCDEF-0123456789abcdef", 7, 7)], "uuid string, low long, high long")
    assert both.select(ids.resolve("uuid", "low", "high")).first()[0] == "0123456789abcdef" * 2


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    assert tuple(df.select(l2("a", "b"), l2_squared("a", "b"), negdot("a", "b")).first()) == (5.0, 25.0, -16.0)
    with pytest.raises(Exception, match="a vector of 3"):
        df.select(checked("a", 3)).collect()


def test_packed(spark):
    df = spark.createDataFrame([([1.5, -2.0, 3.0, 4.0],), ([],)], "v array<float>")
    back = df.select(pack_floats("v").alias("raw")).select("raw", unpack_floats("raw").alias("v")).select("v", split_vectors("v", 2).alias("rows")).collect()
    assert back[0].rows == [[1.5, -2.0], [3.0, 4.0]] and back[1].rows == []
    with pytest.raises(Exception, match="multiple of 3"):
        df.select(split_vectors("v", 3)).collect()


def test_product_quantiser(spark):
    # subspace s, code i: (2s + i, 2s + i)
    pq = ProductQuantiser(np.array([[[2 * s + i] * 2 for i in range(2)] for s in range(5)]))
    x = np.array([[1, 1, 3, 3, 5, 5, 7, 7, 9, 9.0]])
    assert pq.encode_array(x).tolist() == [[1] * 5]
    assert pq.encode_array(x - 0.5).tolist() == [[0] * 5]  # a tie: the first wins
    df = spark.createDataFrame([(x[0].tolist(), (x[0] - 1).tolist())], "a array<double>, b array<double>")
    a, b = pq.quantise("a"), pq.quantise("b")
    r = df.select(pq.original(a).alias("back"), pq.distance(a, b).alias("d")).first()
    assert r.back == x[0].tolist() and r.d == 10.0  # squared, without a root
    assert df.select(NoQuantiser().original(NoQuantiser().quantise("a"))).first()[0] == x[0].tolist()
    with pytest.raises(ValueError):
        ProductQuantiser(np.zeros((1, 257, 2)))


def test_one_bit_codes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 16)))], "doc_id long, vector array<double>")
    rows = one_bit_codes(df, 16).collect()
    assert all(len(r.code) == 2 and 0.5 < r.dot <= 1 + 1e-9 and r.length > 0 for r in rows)


@given(st.lists(st.integers(0, 2**40), max_size=200))
@settings(max_examples=100, deadline=None)
def test_lists_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    for codec in ("plain", "elias_fano"):
        put, take = codecs._CODECS[codec]
        assert take(put(v)).tolist() == v.tolist()


def test_elias_fano_is_small_and_strict():
    v = np.arange(0, 100_000, 10, dtype=np.uint64)
    assert len(codecs.encode_elias_fano(v)) < len(codecs.encode_plain(v)) / 8
    with pytest.raises(ValueError):
        codecs.encode_elias_fano(np.array([3, 1], np.uint64))


def test_bloom_filter():
    f = codecs.BloomFilter(1000, 0.01)
    f.add(np.arange(1000))
    assert f.may_contain(np.arange(1000)).all()
    assert f.may_contain(np.arange(10_000, 20_000)).mean() < 0.03


def test_columns_are_null_safe(spark):
    df = spark.createDataFrame([(None, None)], "id string, raw binary")
    assert tuple(df.select(ids.to_uuid("id").isNull() | (ids.to_uuid("id") == ""), ids.from_bytes("raw"), unpack_floats("raw")).first())[1:] == (None, None)
    assert df.select(F.lit(1)).count() == 1


def test_stems_by_batch():
    """Each different word of a language is stemmed once, and no list of a batch becomes Python objects."""
    import pyarrow as pa

    from lodestone.functions.stemmers import stemmer
    from lodestone.functions.text import stem_lists

    words = [["running", "connections", "running"], None, [], ["einheiten"], ["running", "der"], ["Der"]]
    languages = ["en", "de", None, "de", None, "none"]
    got = stem_lists(pa.array(words, pa.list_(pa.string())), pa.array(languages, pa.string()))
    assert got.to_pylist() == [None if w is None else [stemmer(n)(x) for x in w] for w, n in zip(words, languages)]
    assert stem_lists(got.slice(3, 2), pa.array(["none", "none"])).to_pylist() == got.to_pylist()[3:5]
    assert stem_lists(got.slice(0, 0), pa.array([], pa.string())).to_pylist() == []


def test_short_lists_have_the_same_code(monkeypatch):
    from lodestone.functions import codecs

    rng = np.random.default_rng(4)
    lists = [np.sort(rng.integers(0, 10**int(e), n)).astype(np.uint64) for n in range(1, 17) for e in rng.integers(1, 19, 20)] + [np.array([0], np.uint64), np.array([2**64 - 1], np.uint64)]
    short = [codecs.encode_elias_fano(v) for v in lists]
    assert all(np.array_equal(codecs.decode_elias_fano(b), v) and codecs._decode_short(b, len(v), b[8], -(-len(v) * b[8] // 8)).dtype == np.uint64 for b, v in zip(short, lists))
    with pytest.raises(ValueError):
        codecs.encode_elias_fano(np.array([2, 1]))
    monkeypatch.setattr(codecs, "SHORT", 0)
    assert short == [codecs.encode_elias_fano(v) for v in lists]
