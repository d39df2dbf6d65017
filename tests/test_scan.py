"""Running aggregates and neighbours over ranges of rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from anchorline.operators import scan, select as s


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    """A key owning a third of the rows, one without rows of its own name (NULL), others with few."""
    rows = [(None if i % 50 == 1 else 7 if i % 3 == 0 else i % 11, i * 37 % 3001, (i * 13 % 17) - 8.0) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k long, x long, v double")


@pytest.mark.parametrize("size", [200, 10 ** 6])
@pytest.mark.parametrize("by", [["k"], []])
def test_prefix_scan_against_plain_loops(table, size, by):
    rows, df = table
    cut = scan.ranges(df, by, [F.col("x")], size)
    assert cut.parts == (15 if size == 200 else 1)
    out = scan.prefix_scan(cut, whole={"all": "total"}, total=("sum", F.col("v")), low=("min", F.col("v")), high=("max", F.col("v")),
                           n=("sum", F.lit(1)), times=("product", 1 + F.col("v") / 1000))
    before = scan.prefix_scan(cut, before=True, total=("sum", F.col("v")))
    got = {(r["k"], r["x"]): r for r in out.collect()}
    first = {(r["k"], r["x"]): r["total"] for r in before.collect()}
    state = {}
    sums = {}
    for k, _, v in rows:
        sums[k if by else 0] = sums.get(k if by else 0, 0) + v
    for k, x, v in sorted(rows, key=lambda r: r[1]):
        key = k if by else 0
        total, low, high, n, times = state.get(key, (None, v, v, 0, 1.0))
        r = got[k, x]
        assert first[k, x] == total
        state[key] = now = ((total or 0) + v, min(low, v), max(high, v), n + 1, times * (1 + v / 1000))
        assert (r["total"], r["low"], r["high"], r["n"], r["all"]) == (*now[:4], sums[key])
        assert r["times"] == pytest.approx(now[4])


@pytest.mark.parametrize("size", [200, 10 ** 6])
def test_neighbours_against_plain_loops(table, size):
    rows, df = table
    cut = scan.ranges(df, ["k"], [F.col("x")], size)
    back = {(r["k"], r["x"]): r["b"] for r in scan.neighbour(cut, F.col("x"), "b").collect()}
    on = {(r["k"], r["x"]): r["b"] for r in scan.neighbour(cut, F.col("x"), "b", ahead=True).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted(r[1] for r in rows if r[0] == k)
        for a, b, c in zip([None, *mine], mine, [*mine[1:], None]):
            assert (back[k, b], on[k, b]) == (a, c)


def test_gaps_in_seconds_when_one_person_owns_a_third(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_RANGE", 500)
    start = dt.datetime(2020, 1, 1)
    rows = [(7 if i % 3 == 0 else i, start + dt.timedelta(seconds=i * 4000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "person_id long, at timestamp_ntz")
    got = {(r["person_id"], r["at"]): r["gap_days"] for r in s.gap_to_previous(df, "person_id", "at").collect()}
    mine = sorted(t for p, t in rows if p == 7)
    assert len(got) == 6000
    assert [got[7, t] for t in mine] == [None] + [(b.date() - a.date()).days for a, b in zip(mine, mine[1:])]
    assert all(v is None for (p, _), v in got.items() if p != 7)


def test_running_total_of_a_whole_table_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_RANGE", 1000)
    df = spark.range(10_000).select("id")
    out = s.cumulative(df, [], [F.col("id")], total=("sum", F.col("id")))
    assert all(r["total"] == r["id"] * (r["id"] + 1) // 2 for r in out.collect())
    small = s.cumulative(df.limit(10), [], [F.col("id")], total=("sum", F.col("id")))
    assert "SinglePartition" not in plan_of(small)


def test_empty_table(spark):
    cut = scan.ranges(spark.createDataFrame([], "k long, x long"), ["k"], [F.col("x")])
    assert cut.parts == 1 and not scan.prefix_scan(cut, n=("sum", F.col("x"))).count()
    assert not scan.neighbour(cut, F.col("x"), "b").count()
