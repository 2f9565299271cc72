"""The registered queries and the pipeline."""

import corpus_pipeline
from tissuelake.llm import queries


def test_queries_and_sql_agree(spark, data):
    assert sorted(queries.queries()) == sorted(f"op{k}_{n}" for k, n in enumerate("ann license_scan suffix_dedup html_extract language_id mixing simhash packing exact_dedup lm_score".split(), 1))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_exact_dedup_equals_its_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql(queries.OP9_SQL).fetchall())
    found = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in queries.op9_exact_dedup(spark, data).collect())
    assert found == want


def test_stages(spark, data, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] == 200 and counts[1] < counts[0] and counts[2] <= counts[1]
    per_doc = docs.groupBy("doc_id").count()
    assert per_doc.count() <= counts[2]
    whole = corpus_pipeline.run(spark, data)
    assert whole.count() == counts[4]
    assert whole.drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).count() == 0
