"""The registered queries on the sample tables: SQL where there is any, plans, and the pipeline by stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ndspark.llm import neardup
from ndspark.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.mark.parametrize("name", list(q.ORACLE))
def test_against_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    want, have = con.sql(q.ORACLE[name]), con.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert dict(zip(want.columns, map(str, want.types), strict=True)) == dict(zip(have.columns, map(str, have.types), strict=True))
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    rows = lambda r: sorted(map(str, con.sql(f"SELECT {columns} FROM r").fetchall()))
    assert rows(want) == rows(have)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLE])
def test_one_row_per_document(spark, name):
    out = q.QUERIES[name](spark, SF)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_fingerprints_stay_in_the_jvm(spark):
    plan = q.QUERIES["op7_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    assert before.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).isEmpty()
    assert neardup.near_duplicates(before).where(~F.col("kept")).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_on_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and repeated texts, and columns named like those of the operators: without labels nothing is
    rejected, copies go, rows without an id or text stay, and of one id texts that aren't alike all stay."""
    text = [f"{w} " + " ".join(f"{w}{k}" for k in range(30)) for w in ("oak", "elm", "ash")]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (3, None), (4, ""), (None, text[2]), (None, text[2]), (5, f"{text[2]} password: hunter2hunter2")]
    names = ("score", "node", "digest", "group", "sig", "extra", "size", "bucket", "kept", "held_out", "n_chars")
    docs = spark.createDataFrame([(*r, *[k] * len(names)) for k, r in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns and at.schema.simpleString() == docs.schema.simpleString(), name
    want = [(1, text[0]), (2, text[1]), (3, None), (4, ""), (None, text[2]), (None, text[2]), (5, f"{text[2]} [SECRET]")]
    assert sorted(((r.doc_id, r.text) for r in at.collect()), key=str) == sorted(want, key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((i for i, _ in want), key=str)
