import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm.tables import materialize

from .data import odd_rows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_on_odd_rows_and_extra_columns(spark, tmp_path):
    rows = [(d, t, "en", None if d is None else "s", None) for d, t in odd_rows()]
    rows += [(i, " ".join(f"word{i * 50 + k}" for k in range(40)), None, f"s{i % 2}", 1) for i in range(30)]
    rows += [(100 + i, rows[-1][1], "en", "s1", 1) for i in range(3)]  # copies of document 29
    passage = " ".join(f"bench{k}" for k in range(15))
    rows += [(200, " ".join(f"w{k}" for k in range(30)) + " " + passage + " tail", "en", "s", 1), (201, passage, "en", "s", 1)]
    rows += [(300, " ".join(f"p{k}" for k in range(30)) + " mail me at a.b@example.com", "en", "s", 1)]
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"my {c}") for c in ("id", "fp", "_x", "key", "spans")})
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in seen["personal_data"].collect()}
    assert set(range(30)) <= set(texts) and not {100, 101, 102, 201} & set(texts)
    assert "bench" not in texts[200] and texts[200].endswith("tail")
    assert texts[300].endswith("mail me at [email]")
    assert {r.doc_id for r in docs.collect()} == set(texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_is_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert ids < all_ids and len(ids) > 0.7 * len(all_ids)
