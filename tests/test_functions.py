import math

import pytest
from pyspark.sql import functions as F

from anchorline.functions import dates as d, special as sp, text as x, values as v
from tests.support import rows


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def day(text):
    return F.lit(text).cast("date")


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


def test_differences_count_boundaries(spark):
    assert one(spark, d.years_between(day("2019-12-31"), day("2020-01-01")),
               d.years_between(day("1950-12-31"), day("2019-01-01")),
               d.months_between_calendar(day("2020-01-31"), day("2020-02-01")),
               d.months_between_calendar(day("2020-03-01"), day("2019-12-31")),
               d.days_between(moment("2020-01-01 23:59:00"), moment("2020-01-02 00:01:00"))
               ) == (1, 69, 1, -3, 1)


def test_month_shift_clamps(spark):
    got = one(spark, d.shift_months(day("2019-08-31"), -6).cast("string"),
              d.shift_months(moment("2020-08-31 10:00:00"), -6).cast("string"),
              d.shift_days(day("2020-02-28"), 2).cast("string"))
    assert got == ("2019-02-28", "2020-02-29 10:00:00", "2020-03-01 00:00:00")


def test_parse_date_takes_the_first_format_that_fits(spark):
    got = one(spark, *[d.parse_date(F.lit(t), "dd/MM/yyyy", "yyyy-MM-dd").cast("string")
                       for t in ("20/03/2019", "2019-03-20", "March")])
    assert got == ("2019-03-20", "2019-03-20", None)


@pytest.mark.parametrize("bounds,event,inside", [
    (d.after(365), "2020-12-31", True), (d.after(365), "2021-01-01", False),
    (d.after(365), "2020-01-01", False), (d.before(365), "2019-01-01", True),
    (d.before(365), "2018-12-31", False), (d.before(365), "2020-01-01", False),
    (d.around(14), "2019-12-18", True), (d.around(14), "2020-01-15", True),
    (d.around(14), "2019-12-17", False), (d.month_range(-6, -5), "2019-07-01", True),
    (d.month_range(-6, -5), "2019-08-01", True), (d.month_range(-6, -5), "2019-08-02", False),
    (d.years_before(2), "2018-01-01", True), (d.years_before(2), "2017-12-31", False),
    (d.ever_before(), "1970-01-01", True), (d.ever_after(), "2090-01-01", True),
])
def test_window_edges(spark, bounds, event, inside):
    assert one(spark, bounds(moment(event), day("2020-01-01"))) == (inside,)


def test_text(spark):
    got = one(spark, x.strip_filler(F.lit("I21XX")), x.strip_filler(F.lit("XIX1")),
              x.up_to_delimiter(F.lit("R55^W19"), "^"), x.up_to_delimiter(F.lit("R55"), "^"),
              x.up_to_delimiter(F.lit("R55^W19"), "^", keep=False),
              x.code_prefix(F.lit("I639"), 3), x.remove_dots(F.lit("T14.2")))
    assert got == ("I21", "XIX1", "R55^", "", "R55", "I63", "T142")


def test_values(spark, frame):
    df = frame("x double", (0.0,), (0.0857,), (0.09,), (0.999,), (1.2,), (None,))
    band = v.bin_right_closed(F.col("x"), [0, 0.0857, 0.999], ["fit", "frail"])
    assert [r[0] for r in df.select(band).collect()] == ["fit", "fit", "frail", "frail", None, None]
    got = one(spark, v.safe_cast(F.lit("abc"), "decimal(38,9)"), v.truthy(F.lit("yes")),
              v.truthy(F.lit("false")), v.truthy(F.lit("maybe")), v.truthy(F.lit(1)),
              v.null_outside(F.lit(70), 10, 70), v.null_outside(F.lit(71), 10, 70),
              v.cap_level(F.lit(5), 4), v.cap_level(F.lit(3), 4),
              v.recode(F.lit("a"), {"a": "b"}), v.recode(F.lit("z"), {"a": "b"}),
              v.level_order(F.lit(None), ["x"]), v.in_open_range(F.lit(10), 10, None))
    assert got == (None, True, False, None, True, 70, None, "4+", "3", "b", "z", 1, False)
    with pytest.raises(ValueError):
        v.bin_right_closed(F.lit(1), [0, 1], ["a", "b"])


def test_stable_id_depends_on_the_key_only(spark):
    ids = spark.range(100).select(v.stable_id(F.col("id"), F.lit("d")).alias("s"))
    again = spark.range(100).repartition(7).select(v.stable_id(F.col("id"), F.lit("d")).alias("s"))
    assert rows(ids) == rows(again) and ids.distinct().count() == 100


# Reference values: published tables and R's documented examples.
def test_exact_intervals():
    assert sp.poisson_interval(10) == pytest.approx((4.795389, 18.390356), abs=1e-5)
    assert sp.poisson_interval(0) == pytest.approx((0, 3.688879), abs=1e-5)
    assert sp.binomial_interval(682, 925) == pytest.approx((0.7076683, 0.7654066), abs=1e-6)
    assert sp.binomial_interval(0, 10)[0] == 0 and sp.binomial_interval(10, 10)[1] == 1
    assert sp.binomial_interval(2025, 2774) == pytest.approx((0.713054, 0.746445), abs=1e-5)


def test_two_sided_binomial_against_enumeration():
    for n, p in ((7, 0.3), (12, 0.5), (925, 0.75), (40, 0.02)):
        mass = [math.exp(sp._binomial_log_pmf(i, n, p)) for i in range(n + 1)]
        for k in range(0, n + 1, max(1, n // 11)):
            want = sum(m for m in mass if m <= mass[k] * (1 + 1e-7))
            assert sp.binomial_two_sided(k, n, p) == pytest.approx(min(1, want), rel=1e-7, abs=1e-12)
    assert sp.binomial_two_sided(682, 925, 0.75) == pytest.approx(0.3824916, abs=1e-6)


def test_tails():
    assert sp.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert sp.chi2_upper(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert sp.chi2_upper(34.71, 1) == pytest.approx(math.erfc(math.sqrt(34.71 / 2)), rel=1e-9)
    assert sp.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert sp.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    low, high = sp.poisson_interval(1e7)
    assert low == pytest.approx(1e7 - 1.96 * 1e7 ** 0.5, rel=1e-5) and high > 1e7
