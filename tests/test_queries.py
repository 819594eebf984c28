"""Every registered query of the engine against its SQL."""

import numpy as np
import pytest
from compare import DATA, same

from lodestone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_without_the_llm_folders(tmp_path):
    """The entry module imports and keeps the other queries where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'l2_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_probed_lists_find_nine_of_ten(spark):
    """Recall of the registered parameters, every vector a query, against exact distances."""
    from lodestone.plans import index

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    number = {r.vec_id: i for i, r in enumerate(rows)}
    x = np.array([r.embedding for r in rows], np.float64)
    far = (x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :]
    exact = np.argpartition(far, index.K - 1, axis=1)[:, : index.K]
    near = {(number[r.query_id], number[r.doc_id]) for r in index.spann_topk_fixed_centroids(spark, sf).collect()}
    assert sum((i, j) in near for i, found in enumerate(exact.tolist()) for j in found) >= 0.9 * exact.size


def test_every_event_in_order_and_nan_last(spark):
    from lodestone.plans import vector

    sf = "/root/testdata/sf0.001"
    got = [(r.score, r.doc_id) for r in vector.result_ordering(spark, sf).collect()]
    last = [d for s, d in got if s == -1.0]
    assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count() and last
    assert got[-len(last) :] == [(-1.0, d) for d in sorted(last)] and got[: -len(last)] == sorted(got[: -len(last)])


@pytest.mark.parametrize("name", ["tokenize_ws_lower", "term_index", "postings_codec", "term_search_limit", "collection_merged_terms"])
def test_texts_without_tokens_and_shared_ids(spark, tmp_path, name):
    """Empty, blank and null texts have no tokens; that is no error. Two documents of one id are one in an index."""
    rows = [(1, "", "en", "src3", 0), (2, None, "en", "src1", 0), (3, " \t\n ", "de", None, 4), (4, "The of One the", "en", "src3", 14), (5, "x", "fr", "src7", 1)]
    rows += [] if name in ("tokenize_ws_lower", "collection_merged_terms") else [(4, "the one", "en", "src3", 7), (5, "x", "fr", "src7", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    if name == "tokenize_ws_lower":
        assert [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).orderBy("doc_id").collect()] == [(1, 0, None, None), (2, 0, None, None), (3, 0, None, None), (4, 4, "the", "the"), (5, 1, "x", "x")]
    same(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], str(tmp_path))
