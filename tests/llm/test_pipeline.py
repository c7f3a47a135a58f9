import corpus_pipeline
from webdelta.llm import queries


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries()} - {"pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_run(spark, tmp_path):
    """Small tables through all stages: each stage's decisions show in the next one's rows."""
    words = [f"w{i}" for i in range(400)]
    text = lambda i, n=40: " ".join(words[(i * 37 + j * (i % 7 + 1)) % 400] for j in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200, text(3), "en", "s0", 1), (201, text(4) + " extra", "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s2", 0)]
    rows += [(300 + i, text(i + 50) + " stinker stinker vilething", "en", "s0", 1) for i in range(0, 90, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 300)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        kept.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert {i for i in kept[0] if i >= 300} == set() and {0, 3, 200, 201, 202, 203} <= kept[0]
    assert kept[0] - kept[1] == {200, 203} and 201 in kept[1] - kept[2] and {3, 4, 202} <= kept[2]
    assert kept[3] < kept[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {r["doc_id"] for r in out.collect()} == kept[3]


def test_empty_tables_give_empty_results(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
