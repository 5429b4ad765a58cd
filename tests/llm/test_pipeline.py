"""The pipeline and all registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from motif_engine.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
        rows[name] = docs.count()
    assert 0 < rows["simhash_dedup"] <= rows["exact_dedup"] <= rows["toxicity"] <= 200
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = sorted(set(r.doc_id for r in docs.select("doc_id").collect()))
    assert sorted({r.doc_id for r in pieces.collect()}) == want
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, key string, tokens long, score double, epoch int"


def test_run_on_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """The whole pipeline gives what its stages, written out plainly, leave of a small table; an empty one gives nothing."""
    words = [f"w{i}" for i in range(40)]
    texts = {k: " ".join(words[(i * 7 + k * 11) % 40] + str(k) for i in range(30)) for k in range(6)}
    rows = [(k, t, "en", f"src{k % 2}", len(t), "r", "d", "k", 1, 0.5, 0) for k, t in texts.items()]
    rows += [rows[0], (10, texts[1] + " ", None, None, 1, "r", None, "k", 1, 0.5, 0), (11, texts[2] + " tail", "de", "src1", 1, "r", "d", "k", 1, 0.5, 0)]
    rows += [(12, None, "en", "src1", 0, None, None, None, None, None, None), (13, "", None, "src1", 0, "r", "d", "k", 1, 0.5, 0), (None, "alone and new", "en", None, 1, "r", "d", "k", 1, 0.5, 0), (14, "word " * 3000, "en", "src1", 1, "r", "d", "k", 1, 0.5, 0)]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, f"{tmp_path}/a").write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == spark.read.parquet(f"{tmp_path}/a/documents.parquet").columns
    # 0 once, 10 equals none but is close to 1, 11 to 2; null and empty texts are equal
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 12, None, 14], key=str)
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert pieces and {r.doc_id for r in pieces} <= {0, 1, 2, 3, 4, 5, 12, None, 14} and all(len(r.ids) == 4 * r.length for r in pieces)
    for n in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/a/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_a_row_for_each_input_row(spark, name):
    table = {"op1": "embeddings", "op6": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, SF).count()
    assert got > 0 if name.split("_")[0] in ("op2", "op9") else got == n
