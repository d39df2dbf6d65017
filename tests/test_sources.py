import pytest
from pyspark.sql import functions as F

from anchorline.plans import constants as k
from anchorline.sources import codelists as cl, tables as tb
from tests.support import rows


def test_codelist_from_csv(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('code,coding_system,term\n'
                    'I21.0,ICD10 codes,"Infarction, anterior"\nI252,ICD10 codes,Old\nI21.0,ICD10 codes,again\n'
                    '0042,Other,leading zero\n 1.98E+14 ,SNOMED,damaged\n22298006,SNOMED,"say ""MI"""\n,SNOMED,none\n')
    codes = cl.load_codelist(spark, str(path), "code", "coding_system", keep=["term"])
    assert [r[0] for r in rows(codes.select("code"))] == ["0042", "1.98E+14", "22298006", "I21.0", "I21.0", "I252"]
    assert rows(codes.where("code = '22298006'").select("term")) == [('say "MI"',)]
    clean = cl.clean_codelist(codes, "ICD10 codes", exclude={k.MI_EXCLUDED_CODE})
    assert rows(clean.select("code")) == [("I210",)]
    assert rows(cl.damaged_codes(codes).select("code")) == [("1.98E+14",)]


def test_fixed_lists_expand():
    falls, stroke = k.FALL_CODES, k.STROKE_CODES
    assert len(falls) == len(set(falls)) == 31 and falls[:2] == ["W00", "W01"] and "T14.2" in falls
    assert len(stroke) == len(set(stroke)) == 36 and {"I60", "I609", "I616", "I64"} <= set(stroke)
    assert "I617" not in stroke and "I607" in stroke


def test_publish_replaces(spark, tmp_path):
    root = str(tmp_path)
    tb.publish(spark.range(5).withColumn("y", F.col("id") % 2), "t", root, partition_by=["y"])
    tb.publish(spark.range(3).withColumn("y", F.col("id") % 2), "t", root, partition_by=["y"])
    assert tb.load(spark, "t", root).count() == 3
    schema = tb.load(spark, "t", root).schema
    assert tb.load(spark, "t", root, schema).count() == 3
    with pytest.raises(ValueError):
        tb.publish(spark.range(1), "t", root, bucket_by="id", buckets=2)


def test_failed_publish_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    assert tb.publish(spark.range(5), "t", root) == 5
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(
        F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        tb.publish(broken, "t", root)
    with pytest.raises(ValueError, match="fewer than 3"):
        tb.publish(spark.range(2), "t", root, at_least=3)
    assert tb.load(spark, "t", root).count() == 5
    # refreshed from itself
    assert tb.publish(tb.load(spark, "t", root).where("id > 1"), "t", root, at_least=3) == 3
    assert rows(tb.load(spark, "t", root)) == [(2,), (3,), (4,)]
    assert [p.name for p in tmp_path.iterdir() if "old" in p.name] == []


def test_catalog_table_refreshed_from_itself(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS renewed LOCATION '{tmp_path}/renewed'")
    try:
        tb.publish(spark.range(10), "renewed.t")
        with pytest.raises(ValueError):
            tb.publish(spark.range(1), "spark_catalog.renewed.t", at_least=2)
        assert tb.publish(tb.load(spark, "renewed.t").where("id < 4"), "renewed.t") == 4
        spark.catalog.refreshTable("renewed.t")
        assert tb.load(spark, "spark_catalog.renewed.t").count() == 4
        assert [r["tableName"] for r in spark.sql("SHOW TABLES IN renewed").collect()] == ["t"]
    finally:
        spark.sql("DROP DATABASE renewed CASCADE")


def test_catalog_table_bucketed_by_person(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS study LOCATION '{tmp_path}/study'")
    try:
        df = spark.range(100).select((F.col("id") % 10).alias("person_id"), F.col("id").alias("v"))
        tb.publish(df, "study.events", bucket_by="person_id", buckets=4)
        tb.publish(df.where("v < 50"), "study.events", bucket_by="person_id", buckets=4)
        back = tb.load(spark, "study.events")
        assert back.count() == 50
        plan = back.groupBy("person_id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP DATABASE study CASCADE")
