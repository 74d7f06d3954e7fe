"""The registered queries against their SQL, and each pipeline stage against its operator's own scores."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidelog.llm import decontaminate, quality_model, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, tmp_path, name):
    queries.queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db.sql(f"CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    db.sql(f"CREATE OR REPLACE TEMP TABLE b AS {queries.oracle_sql()[name]}")
    columns = sorted(r[0] for r in db.sql("DESCRIBE a").fetchall())
    assert columns == sorted(r[0] for r in db.sql("DESCRIBE b").fetchall())
    for x, y in (("a", "b"), ("b", "a")):
        assert not db.sql(f"SELECT {', '.join(columns)} FROM {x} EXCEPT ALL SELECT {', '.join(columns)} FROM {y}").fetchall()


def test_all_queries_are_registered(spark):
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    for name in ("op2_license_scan", "op3_toxicity_pu", "op4_simhash", "op5_quality_qda", "op8_language_ranks", "op9_spaced_seeds"):
        assert names[name](spark, SF).columns[0] == "doc_id"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    """Each stage keeps exactly what its operator's own scores say, and the columns of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights"]
    rules, model, dedup, clean, mixed = (f for _, f in corpus_pipeline.STAGES)
    for stage in (rules, model, dedup, clean):
        assert stage(spark, docs, SF).schema == docs.schema
    assert ids(rules(spark, docs, SF)) == ids(quality_rules.score_rules(docs).where("kept").select("row.doc_id"))
    scored = quality_model.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(model(spark, docs, SF)) == ids(scored.where("score >= 0.3"))
    found = simhash.near_duplicates(docs)
    assert ids(dedup(spark, docs, SF)) == sorted({r["component_id"] for r in found.collect()})
    leaks = ids(decontaminate.find_overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))  # items of any length
    assert leaks and ids(clean(spark, docs, SF)) == [i for i in ids(docs) if i not in set(leaks)]
    result = mixed(spark, docs, SF)
    assert set(docs.columns) < set(result.columns) and set(ids(result)) <= set(ids(docs))


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_write_small_row_groups(spark, tmp_path, k):
    """A task of the next stage reads a row group whole: 40 MB in one file are several, whoever writes a stage's result."""
    own = spark.newSession()
    corpus_pipeline.STAGES[k][1](own, own.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    own.range(0, 600_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(f"{tmp_path}/out")
    meta = [pq.read_metadata(f) for f in tmp_path.glob("out/*.parquet")]
    assert max(m.row_group(g).total_byte_size for m in meta for g in range(m.num_row_groups)) < 20 << 20


def test_run(spark):
    """The whole pipeline, against its stages one after the other on tables in memory."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    found = sorted(tuple(r) for r in got.select("doc_id", "replica", "shuffle_key").collect())
    assert found and found == sorted(tuple(r) for r in want.select("doc_id", "replica", "shuffle_key").collect())
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)
