"""Plan shape: what keeps the operators usable when one key owns a third of the rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from anchorline.catalogue import QUERIES
from anchorline.functions.dates import after
from anchorline.functions import dates as d
from anchorline.operators.codes import any_code_in, any_code_joined, code_in, map_codes
from anchorline.operators import joins as j, select as s, tabulate as t
from anchorline.operators.joins import anchored_window
from anchorline.plans import outcome as o
from anchorline.sources.codelists import code_frame
from anchorline.sources.tables import publish
from tests.support import SF, rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_unbounded_single_task(spark, name):
    if name.startswith("cox_"):
        pytest.skip("builds its result on the driver from p x p sums")
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A single-partition exchange may only carry rows that were aggregated below it.
    for block in re.split(r"Exchange SinglePartition", plan)[1:]:
        following = block.split("\n")[1:4]
        assert any("Aggregate" in line for line in following), (name, following)


@pytest.fixture(scope="module")
def skewed(spark):
    """Events of which one person owns a third, and a cohort too wide to broadcast."""
    base = spark.range(240_000)
    person = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 4000).cast("long")
    events = base.select(person.alias("person_id"),
                         (F.lit("2018-01-01").cast("timestamp_ntz")
                          + F.make_dt_interval((F.col("id") % 900).cast("int"))).alias("event_time"),
                         F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("code"),
                         F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    cohort = spark.range(4000).select(F.col("id").alias("person_id"), F.lit("2018-03-01").cast("date").alias("index_date"),
                                      F.lit(None).cast("date").alias("dod"))
    return events, cohort


@pytest.fixture
def tight(spark):
    """Thresholds small enough that test data count as skewed."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.shuffle.partitions": "8"}
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_hot_person_is_split_in_the_anchored_join(spark, skewed, tight):
    events, cohort = skewed
    events = events.repartition(8)
    met = j.anchored_window(events, cohort, after(365))
    assert "skew=true" in final_plan(met)
    # also with an aggregate on the same key right above the join
    per_person = met.groupBy("person_id").agg(F.min("event_time").alias("t"), F.max("payload").alias("p"))
    assert "skew=true" in final_plan(per_person)
    kept = j.restrict_to(events, cohort)
    assert "skew=true" in final_plan(kept.groupBy("person_id").agg(F.max("payload")))


def test_hot_person_is_split_when_the_cohort_is_an_aggregate(spark, skewed, tight):
    """Neither a cohort laid out by person nor an aggregate above stops the split."""
    events, _ = skewed
    events = events.repartition(8)
    cohort = events.groupBy("person_id").agg(F.to_date(F.min("event_time")).alias("index_date"))
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    try:
        met = j.anchored_window(events, cohort, after(365))
        per_person = met.groupBy("person_id").agg(F.max("payload").alias("p"))
        assert "skew=true" in final_plan(per_person)
        plain = events.join(cohort, "person_id").groupBy("person_id").agg(F.max("payload").alias("p"))
        assert "skew=true" not in final_plan(plain)
        coded = events.withColumn("code", F.when(F.col("code") < "c5", "c1").otherwise(F.col("code")))
        listed = spark.createDataFrame([("c1",), ("c6",)], "code string")
        assert "skew=true" in final_plan(code_in(coded, "code", listed))
    finally:
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def test_hot_person_results_are_whole(spark, skewed):
    events, cohort = skewed
    met = j.anchored_window(events, cohort, after(365))
    want = events.where((F.col("event_time") > F.lit("2018-03-01").cast("timestamp_ntz"))
                        & (F.col("event_time") < F.lit("2019-03-02").cast("timestamp_ntz"))).count()
    assert met.count() == want
    first = o.events_after(events, cohort, ["c3", "c4"]).groupBy("person_id").agg(F.min("event_time").alias("m"))
    brute = met.where("code in ('c3', 'c4')").groupBy("person_id").agg(F.min("event_time").alias("m"))
    assert rows(first) == rows(brute)


def test_top_k_is_limited_below_the_shuffle(skewed):
    events, _ = skewed
    plan = plan_of(s.first_per(events, "person_id", [F.col("event_time"), F.col("payload")]))
    head, _, below = plan.partition("Exchange hashpartitioning(person_id")
    assert "WindowGroupLimit" in head and "WindowGroupLimit" in below and "Partial" in below


def test_counting_operators_combine_before_the_shuffle(skewed):
    events, _ = skewed
    frames = [s.keep_unique(events.select("person_id", "code"), "person_id"),
              s.drop_exact_duplicates(events, ["person_id", "code"]),
              s.sample_one_per(events, "person_id", "code", 1),
              t.pct_within(events, ["code"], ["person_id"]), t.crosstab(events, "person_id", "code", ["c1", "c2"])]
    for df in frames:
        below = plan_of(df).split("Exchange")[1]
        assert re.search(r"partial_|Aggregate", below)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["first_event_after"](spark, SF))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line)
    assert "EqualTo(l_linenumber,1)" in scan
    read = scan.split("ReadSchema: ")[1]
    assert "l_extendedprice" not in read and "l_comment" not in read
    plan = plan_of(entry.queries()["two_reading_rule"](spark, SF))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "value" in line.split("Batched")[0])
    assert "In(event_type" in scan and "GreaterThan(value,1.0)" in scan


def test_code_list_is_a_literal_or_one_join(spark, skewed):
    events, _ = skewed
    listed = code_frame(spark, ["c1", "c2"])
    wide = events.withColumn("code2", F.reverse("code"))
    got = any_code_in(wide, ["code", "code2"], listed)
    assert "Join" not in plan_of(got)
    joined = any_code_joined(wide, ["code", "code2"], listed)
    assert joined.count() == got.count() > 0
    assert plan_of(joined).count("LeftSemi") == 1


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS scale")
    events = spark.range(4000).select((F.col("id") % 90).alias("person_id"), F.timestamp_seconds(F.col("id") * 9999).alias("event_time"))
    people = spark.range(90).select(F.col("id").alias("person_id"), F.lit("1970-02-01").cast("date").alias("index_date"))
    publish(events, "scale.bucketed_events", bucket_by="person_id", buckets=4)
    publish(people, "scale.bucketed_people", bucket_by="person_id", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = anchored_window(spark.table("scale.bucketed_events"), spark.table("scale.bucketed_people"), after(365))
        assert plan_of(near).count("Exchange") == 0
        assert plan_of(near.groupBy("person_id").agg(F.count(F.lit(1)))).count("Exchange") == 0
        fresh = anchored_window(events, spark.table("scale.bucketed_people"), after(365))
        assert plan_of(fresh).count("Exchange") == 2 and fresh.count() == near.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE scale CASCADE")


@pytest.fixture
def plain(spark):
    """No adaptive execution, no broadcasts, eight tasks."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in old.items():
        spark.conf.set(n, value)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_person_is_dealt_out_by_time(spark, plain, skewed):
    events, cohort = skewed
    for bounds in (after(365), d.before(200), d.around(30), d.month_range(-3, 2), d.years_before(0)):
        whole = anchored_window(events, cohort, bounds)
        binned = anchored_window(events, cohort, bounds, bin_days=7)
        assert binned.columns == whole.columns
        assert binned.groupBy("person_id", "event_time").count().exceptAll(whole.groupBy("person_id", "event_time").count()).isEmpty()
        assert binned.count() == whole.count() > 0
    assert largest_share(anchored_window(events, cohort, after(365))) > 0.33
    assert largest_share(anchored_window(events, cohort, after(365), bin_days=7)) < 0.25
    with pytest.raises(ValueError):
        anchored_window(events, cohort, d.ever_before(), bin_days=7)
    with pytest.raises(ValueError):
        anchored_window(events, cohort, lambda t, i: t > i, bin_days=7)


def test_only_years_in_reach_are_read(spark, tmp_path, frame):
    rows_ = [(p, f"{y}-06-01") for y in range(2010, 2021) for p in (1, 2)]
    events = frame("person_id long, event_time timestamp_ntz", *rows_).withColumn("year", F.year("event_time"))
    events.write.partitionBy("year").parquet(f"{tmp_path}/events")
    for year in (2010, 2013, 2019, 2020):   # unreadable: a scan of them would fail
        for part in (tmp_path / "events" / f"year={year}").glob("*.parquet"):
            part.write_bytes(b"broken")
            crc = part.with_name(f".{part.name}.crc")
            if crc.exists():
                crc.unlink()
    stored = spark.read.schema(events.schema).parquet(f"{tmp_path}/events")
    cohort = frame("person_id long, index_date date", (1, "2016-03-01"), (2, "2017-09-01"))
    met = anchored_window(stored, cohort, after(365), year_column="year")
    assert rows(met.select("person_id", "event_time")) == [(1, "2016-06-01 00:00:00"), (2, "2018-06-01 00:00:00")]
    met = anchored_window(stored, cohort, d.years_before(1), year_column="year")
    assert rows(met.select("person_id", "event_time")) == [
        (1, "2015-06-01 00:00:00"), (2, "2016-06-01 00:00:00"), (2, "2017-06-01 00:00:00")]
    with pytest.raises(Exception):
        anchored_window(stored, cohort, after(365)).collect()


def test_hot_code_is_split_without_adaptive_execution(spark, plain):
    rows_ = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("c"), (F.col("id") % 2000).cast("string"))).alias("code"))
    lookup = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("listed"), F.col("id").alias("chapter"))
    lookup = lookup.unionByName(spark.createDataFrame([("hot", -1)], "listed string, chapter long"))
    assert j.hot_keys(rows_, "code").first()["hot"] == ["hot"]
    mapped, whole = (map_codes(rows_, lookup, "code", "listed", "chapter", measured=m) for m in (True, False))
    assert mapped.exceptAll(whole).isEmpty() and mapped.count() == 60_000
    assert largest_share(whole) > 0.33 and largest_share(mapped) < 0.25
    wanted = code_frame(spark, ["hot", "hot", "c7"])
    assert code_in(rows_, "code", wanted, measured=True).count() == code_in(rows_, "code", wanted).count() == 20_000 + 20
    assert map_codes(rows_.limit(0), lookup, "code", "listed", "chapter", measured=True).count() == 0
