import corpus_pipeline
from millrace.llm import neardup
from tests.llm.helpers import components


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, data)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "neardup":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            found = components([t for _, t in rows], 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == [rows[c][0] for k, c in enumerate(found) if k == c]
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < spark.read.parquet(f"{data}/documents.parquet").count()
    whole = corpus_pipeline.run(spark, data)
    key = ["doc_id", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert neardup.keep_one(before.limit(0)).count() == 0


def test_stages_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_sql(spark, data):
    from millrace.llm.queries import ORACLE_SQL, QUERIES
    from tests import oracle

    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, data), oracle.connect(data).sql(sql)
        assert oracle.rows(df.columns, df.collect()) == oracle.rows(list(want.columns), want.fetchall())
