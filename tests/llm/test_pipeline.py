import duckdb
import pytest

import corpus_pipeline
from seamline.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(sql.statements()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)

    def rounded(rows):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)

    assert rounded(tuple(r[c] for c in names) for r in got.collect()) == rounded(want.fetchall())


def test_each_query_answers_every_row(spark):
    sizes = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    for name in ("op2_language", "op6_quality", "op7_pii", "op8_toxicity"):
        got = queries.queries()[name](spark, FOLDER)
        assert got.count() == sizes["documents"], name
    packed = queries.queries()["op1_packing"](spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == sizes["documents"]


def test_stages_follow_one_another(spark, tmp_path):
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2]
    run = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_stages_take_clashing_columns_and_odd_rows(spark):
    rows = [
        (1, "word " * 30 + "one two three", "en", "a", 5, "x", 1),
        (1, "word " * 30 + "one two three", "en", "a", 5, "x", 1),
        (None, " ".join(f"w{i}" for i in range(40)), None, None, None, None, None),
        (2, None, "en", "a", 0, "x", 1),
        (3, " ".join(f"v{i}" for i in range(40)) + " a@b.example.com", "en", "b", 5, "x", 1),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept int"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == schema.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"] for r in docs.collect()} <= {1, 3, None}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
