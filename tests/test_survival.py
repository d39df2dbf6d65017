import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.operators import scan
from anchorline.plans import stats as st, survival as sv

# Acute myelogenous leukaemia, maintained / non-maintained arms (Miller 1981).
MAINTAINED = [(9, 1), (13, 1), (13, 0), (18, 1), (23, 1), (28, 0), (31, 1), (34, 1), (45, 0), (48, 1), (161, 0)]
CONTROL = [(5, 1), (5, 1), (8, 1), (8, 1), (12, 1), (16, 0), (23, 1), (27, 1), (30, 1), (33, 1), (43, 1), (45, 1)]


@pytest.fixture(scope="module")
def aml(spark):
    data = [("Maintained", t, bool(e)) for t, e in MAINTAINED] + [("Nonmaintained", t, bool(e)) for t, e in CONTROL]
    return spark.createDataFrame(data, "arm string, t int, e boolean")


def test_kaplan_meier_published_curve(aml):
    curve = sv.kaplan_meier(aml, "t", "e", ["arm"])
    got = {(r["arm"], r["time"]): r for r in curve.collect()}
    for t, s in ((9, 0.909), (13, 0.818), (18, 0.716), (23, 0.614), (31, 0.491), (34, 0.368), (48, 0.184)):
        assert got["Maintained", t]["survival"] == pytest.approx(s, abs=5e-4)
    r = got["Maintained", 13]
    assert (r["at_risk"], r["events"], r["censored"]) == (10, 1, 1)
    assert (r["std_err"], r["lower"], r["upper"]) == pytest.approx((0.1163, 0.6192, 1.0), abs=5e-4)
    last = got["Nonmaintained", 45]
    assert last["survival"] == 0 and last["lower"] is None and last["std_err"] is None
    med = {r["arm"]: r for r in sv.median_survival(curve, ["arm"]).collect()}
    assert med["Maintained"]["median"] == 31 and med["Maintained"]["median_lower"] == 18
    assert med["Maintained"]["median_upper"] is None
    assert med["Nonmaintained"]["median"] == 23 and med["Nonmaintained"]["events"] == 11
    overall = sv.kaplan_meier(aml, "t", "e")
    s = [r["survival"] for r in overall.orderBy("time").collect()]
    assert all(0 <= b <= a <= 1 for a, b in zip(s, s[1:]))
    assert sv.median_survival(overall).first()["median"] == 27


def test_flat_half_and_all_censored(spark):
    df = spark.createDataFrame([("h", t, True) for t in (1, 2, 4, 9)] + [("c", 3, False), ("c", None, True)],
                               "g string, t int, e boolean")
    curve = sv.kaplan_meier(df, "t", "e", ["g"])
    med = {r["g"]: r["median"] for r in sv.median_survival(curve, ["g"]).collect()}
    assert med == {"h": 3.0, "c": None}
    at = sv.km_at(curve, [0, 2, 3, 20], ["g"])
    got = {(r["g"], r["time"]): (r["at_risk"], r["survival"]) for r in at.collect()}
    assert got == {("h", 0): (4, 1.0), ("h", 2): (3, 0.5), ("h", 3): (2, 0.5), ("h", 20): (0, 0.0),
                   ("c", 0): (1, 1.0), ("c", 2): (1, 1.0), ("c", 3): (1, 1.0), ("c", 20): (0, 1.0)}


def test_log_rank_published(aml):
    got = {r["arm"]: r for r in sv.log_rank(aml, "t", "e", "arm").collect()}
    assert got["Maintained"]["observed"] == 7 and got["Nonmaintained"]["observed"] == 11
    assert got["Maintained"]["expected"] == pytest.approx(10.69, abs=0.005)
    assert got["Maintained"]["chi_square"] == pytest.approx(3.4, abs=0.05)
    assert got["Maintained"]["p_value"] == pytest.approx(0.0653, abs=5e-4)
    with pytest.raises(ValueError):
        sv.log_rank(aml, "t", "e", "arm", ["Maintained"])


def _log_rank_brute(data):
    groups = sorted({g for g, _, _ in data})
    o, e, v = np.zeros(len(groups)), np.zeros(len(groups)), np.zeros((len(groups),) * 2)
    for t in sorted({t for _, t, d in data if d}):
        n = np.array([sum(g == h and x >= t for g, x, _ in data) for h in groups], float)
        d = np.array([sum(g == h and x == t and z for g, x, z in data) for h in groups], float)
        o, e = o + d, e + d.sum() * n / n.sum()
        if n.sum() > 1:
            q = n / n.sum()
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(q) - np.outer(q, q))
    z = (o - e)[:-1]
    return dict(zip(groups, zip(o, e))), float(z @ np.linalg.solve(v[:-1, :-1], z))


def _random_people(seed, n=160):
    rng = np.random.default_rng(seed)
    return [(str(rng.choice(["a", "b", "c"])), str(rng.choice(["f", "m"])), int(rng.integers(1, 25)),
             bool(rng.random() < 0.6)) for _ in range(n)]


def test_log_rank_three_groups_against_brute_force(spark):
    data = [(g, t, e) for g, _, t, e in _random_people(3)]
    got = {r["g"]: r for r in sv.log_rank(spark.createDataFrame(data, "g string, t int, e boolean"), "t", "e", "g").collect()}
    want, chi = _log_rank_brute(data)
    for g, (o, e) in want.items():
        assert (got[g]["observed"], got[g]["expected"]) == pytest.approx((o, e))
    assert got["a"]["chi_square"] == pytest.approx(chi) and got["a"]["df"] == 2


def _efron_brute(beta, x, t, e):
    """Person-level Efron log likelihood, score and information."""
    w = np.exp(x @ beta)
    ll, grad, info = 0.0, np.zeros(len(beta)), np.zeros((len(beta),) * 2)
    for at in sorted(set(t[e])):
        risk, dead = t >= at, (t == at) & e
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        grad = grad + x[dead].sum(axis=0)
        for k in range(d):
            weight = w * (risk - k / d * dead)
            s0 = weight.sum()
            mean = (weight[:, None] * x).sum(axis=0) / s0
            ll -= math.log(s0)
            grad = grad - mean
            info = info + (x * weight[:, None]).T @ x / s0 - np.outer(mean, mean)
    return ll, grad, info


def test_cox_against_brute_force(spark):
    people = _random_people(11)
    df = spark.createDataFrame(people, "g string, sex string, t int, e boolean")
    got = {r["term"]: r for r in sv.cox_ph(df, "t", "e", {"g": None, "sex": ["m", "f"]}).collect()}
    assert set(got) == {"g=b", "g=c", "sex=f"}
    x = np.array([[g == "b", g == "c", s == "f"] for g, s, _, _ in people], float)
    t, e = np.array([p[2] for p in people]), np.array([p[3] for p in people])
    beta = np.array([got[k]["coef"] for k in ("g=b", "g=c", "sex=f")])
    _, grad, info = _efron_brute(beta, x, t, e)
    assert np.abs(grad).max() < 1e-4
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    assert [got[k]["std_err"] for k in ("g=b", "g=c", "sex=f")] == pytest.approx(list(se), rel=1e-4)
    r = got["sex=f"]
    assert r["hazard_ratio"] == pytest.approx(math.exp(r["coef"])) and r["lower"] < r["hazard_ratio"] < r["upper"]


def test_cox_published(aml):
    # R documentation: coxph(Surv(time, status) ~ x, aml): 0.9155 (0.5119)
    r = sv.cox_ph(aml, "t", "e", {"arm": ["Maintained", "Nonmaintained"]}).first()
    assert (r["coef"], r["std_err"], r["p_value"]) == pytest.approx((0.9155, 0.5119, 0.0737), abs=2e-4)


def test_cox_covariate_with_one_level_has_no_term(spark):
    df = spark.createDataFrame([("a", "x", 1, True), ("a", "y", 2, False), ("a", "x", 3, True), ("a", "y", 4, True)],
                               "g string, h string, t int, e boolean")
    assert sv.cox_ph(df, "t", "e", {"g": None}).count() == 0
    assert [r["term"] for r in sv.cox_ph(df, "t", "e", {"g": None, "h": None}).collect()] == ["h=y"]


def test_cox_level_without_events_has_infinite_limits(spark):
    rows = [("a", t, t % 2 == 0) for t in range(1, 30)] + [("b", t, t % 3 == 0) for t in range(1, 30)]
    rows += [("c", t, False) for t in range(1, 30)]
    got = {r["term"]: r for r in sv.cox_ph(spark.createDataFrame(rows, "g string, t int, e boolean"), "t", "e", {"g": None}).collect()}
    assert got["g=b"]["converged"] and 0 < got["g=b"]["lower"] < got["g=b"]["upper"] < 10
    assert not got["g=c"]["converged"] and (got["g=c"]["lower"], got["g=c"]["upper"]) == (0.0, math.inf)
    two = {r["term"]: r for r in sv.cox_ph(spark.createDataFrame([r for r in rows if r[0] != "c"], "g string, t int, e boolean"),
                                           "t", "e", {"g": None}).collect()}
    assert got["g=b"]["coef"] == pytest.approx(two["g=b"]["coef"], abs=1e-3)


def test_many_deaths_at_one_time_are_summed_exactly():
    d, s0, t0 = np.array([5000, 3000, 4000]), np.array([9000.0, 3000.0, 1e7]), np.array([5000.0, 3000.0, 4000.0])
    got = sv._tied(d, s0, t0)
    for i in range(3):
        f = np.arange(d[i]) / d[i]
        u = s0[i] - f * t0[i]
        want = [np.log(u), 1 / u, f / u, 1 / u ** 2, f / u ** 2, f * f / u ** 2]
        assert list(got[:, i]) == pytest.approx([w.sum() for w in want], rel=1e-7)


def test_log_rank_many_groups_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(sv, "ROWS_PER_RANGE", 400)
    data = [(f"g{i % 300:03d}", (i * 7919) % 5003, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, t int, e boolean")
    assert scan.ranges(sv._collapse(df, "t", "e", ["g"]), [], [F.col("time")], 400).parts > 5
    got = {r["g"]: r for r in sv.log_rank(df, "t", "e", "g").collect()}
    want, chi = _log_rank_brute(data)
    assert len(got) == 300 and sum(r["persons"] for r in got.values()) == 3000
    for g, (o, e) in want.items():
        assert (got[g]["observed"], got[g]["expected"]) == pytest.approx((o, e))
    assert got["g000"]["chi_square"] == pytest.approx(chi, rel=1e-6)


def test_log_rank_of_two_thousand_groups_in_little_memory():
    groups, n = 2_000, 60_000
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.r_[rng.integers(0, groups, n), np.arange(groups)], "exits": 1,
                        "time": np.r_[rng.integers(0, 10 ** 6, n).astype(float), np.full(groups, np.nan)],
                        "events": np.r_[(rng.random(n) < 0.05).astype(int), np.zeros(groups, int)]})
    tracemalloc.start()
    out = sv._log_rank_part(groups)(pdf)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    v = np.stack(out["v"].to_list())
    assert np.abs(v.sum(0)).max() < 1e-6 and np.allclose(v, v.T)
    assert out["observed"].sum() == pytest.approx(out["expected"].sum()) == pdf["events"].sum()


def test_curve_in_seconds_of_one_stratum_goes_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(sv, "ROWS_PER_RANGE", 500)
    data = [("a", (i * 7919) % 86_413, i % 4 == 0) for i in range(4000)] + [("b", 10 * i, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(data, "g string, t long, e boolean")
    seen = []
    whole = scan.ranges
    monkeypatch.setattr(scan, "ranges", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    for by in (["g"], []):
        curve = sv.kaplan_meier(df, "t", "e", by)
        got = {(r["g"] if by else "", r["time"]): r for r in curve.collect()}
        for g in ("a", "b") if by else ("",):
            mine = sorted((t, e) for x, t, e in data if x == g or not by)
            n, s, var, i = len(mine), 1.0, 0.0, 0
            while i < len(mine):
                t = mine[i][0]
                same = [e for x, e in mine[i:i + 8] if x == t]
                d = sum(same)
                s *= 1 - d / n
                var += d / (n * (n - d)) if d and n > d else 0
                r = got[g, t]
                assert (r["at_risk"], r["events"], r["censored"]) == (n, d, len(same) - d)
                assert r["survival"] == pytest.approx(s, rel=1e-9, abs=1e-12)
                if s > 0:
                    assert r["std_err"] == pytest.approx(s * math.sqrt(var), rel=1e-7)
                n, i = n - len(same), i + len(same)
        # no window has only the stratum as its key but those over one row per range
        parts = seen[-1]
        assert parts.parts >= 8
        assert max(r["count"] for r in parts.rows.groupBy(scan.PART).count().collect()) < 1500
        assert parts.totals(n=F.count(F.lit(1))).count() <= 2 * parts.parts


def test_levels_are_counted_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(sv, "MOST_LEVELS", 10)
    assert sv.levels_of(spark.range(10), "id") == list(range(10))
    with pytest.raises(ValueError, match="levels"):
        sv.levels_of(spark.range(11), "id")


def test_levels_without_a_finite_fit_are_told_by_their_likelihood(spark):
    people = [("a", s, t, e) for _, s, t, e in _random_people(5, 60)] + [("b", s, t, e) for _, s, t, e in _random_people(6, 60)]
    never = [("c", s, t, False) for _, s, t, _ in _random_people(7, 30)]
    first = [("d", "f", 0, True)] * 3     # the level's events all precede the others'
    make = lambda data: spark.createDataFrame(data, "g string, sex string, t int, e boolean")
    fit = lambda data, levels: {r["term"]: r for r in sv.cox_ph(make(data), "t", "e", {"g": levels, "sex": ["f", "m"]}).collect()}
    plain = fit(people, ["a", "b"])
    got = fit(people + never, ["a", "b", "c"])
    assert got["g=c"]["coef"] == -math.inf and got["g=c"]["hazard_ratio"] == 0 and not got["g=c"]["converged"]
    for term in plain:      # as if the level were not there
        assert got[term]["converged"] and got[term]["coef"] == pytest.approx(plain[term]["coef"], abs=1e-6)
        assert got[term]["std_err"] == pytest.approx(plain[term]["std_err"], rel=1e-5)
    got = fit(people + first, ["a", "b", "d"])
    assert got["g=d"]["coef"] == math.inf and not got["g=d"]["converged"]
    assert got["g=b"]["coef"] == pytest.approx(plain["g=b"]["coef"], abs=1e-6)
    got = fit(people + never, ["c", "a", "b"])      # the reference has no events: all others are endless against it
    assert got["g=a"]["coef"] == got["g=b"]["coef"] == math.inf and got["sex=m"]["converged"]
    assert got["sex=m"]["coef"] == pytest.approx(plain["sex=m"]["coef"], abs=1e-6)


def test_cox_over_several_ranges(spark, monkeypatch):
    people = _random_people(11)
    df = spark.createDataFrame(people, "g string, sex string, t int, e boolean")
    whole = [tuple(r) for r in sv.cox_ph(df, "t", "e", {"g": None, "sex": None}).collect()]
    monkeypatch.setattr(sv, "ROWS_PER_RANGE", 10)
    parts = [tuple(r) for r in sv.cox_ph(df, "t", "e", {"g": None, "sex": None}).collect()]
    for a, b in zip(whole, parts):
        assert a[0] == b[0] and a[1:8] == pytest.approx(b[1:8], rel=1e-6)


# --- tests -------------------------------------------------------------------

# Student's sleep data (R's `sleep`).
SLEEP = [(0.7, 1.9), (-1.6, 0.8), (-0.2, 1.1), (-1.2, 0.1), (-0.1, -0.1), (3.4, 4.4), (3.7, 5.5), (0.8, 1.6),
         (0.0, 4.6), (2.0, 3.4)]


def test_t_tests_published(spark):
    long = spark.createDataFrame([(g, v) for a, b in SLEEP for g, v in (("1", a), ("2", b))], "g string, x double")
    r = st.welch_t(long, "x", "g", ("1", "2")).first()
    assert (r["t"], r["df"], r["p_value"]) == pytest.approx((-1.8608, 17.776, 0.07939), abs=1e-3)
    wide = spark.createDataFrame([*SLEEP, (1.0, None)], "a double, b double")
    r = st.paired_t(wide, "a", "b").first()
    assert (r["n"], r["t"], r["df"], r["p_value"]) == pytest.approx((10, -4.0621, 9, 0.002833), abs=1e-4)


def test_mcnemar_published(spark):
    # Agresti's approval ratings: discordant 150 and 86.
    df = spark.range(1600).select((F.col("id") < 944).alias("a"),
                                  ((F.col("id") < 794) | ((F.col("id") >= 944) & (F.col("id") < 1030))).alias("b"))
    r = st.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (r["only_before"], r["only_after"]) == (150, 86)
    assert r["chi_square"] == pytest.approx(16.8178, abs=1e-3)
    assert r["p_value"] == pytest.approx(4.115e-05, rel=1e-3)


def test_rates_published(spark):
    # R documentation of poisson.test: malignant lymphoma, 11 in 800 against 23 in 3000.
    rates = spark.createDataFrame([("a", 11, 800.0), ("b", 23, 3000.0)], "g string, events long, person_years double")
    r = st.poisson_compare(rates, "g", ("a", "b")).first()
    assert r["rate_ratio"] == pytest.approx(1.793478, abs=1e-5)
    assert 0 < r["lower"] < r["rate_ratio"] < r["upper"]
    ci = {x["g"]: x for x in st.poisson_rate_ci(rates, per=1000).collect()}
    assert ci["a"]["lower"] == pytest.approx(5.491 / 0.8, abs=2e-3)
    assert ci["a"]["upper"] == pytest.approx(19.682 / 0.8, abs=2e-3)
    props = spark.createDataFrame([(2025, 2774)], "k long, n long")
    b = st.binomial_ci(props, "k", "n").first()
    assert (b["proportion"], b["lower"], b["upper"]) == pytest.approx((0.729993, 0.713054, 0.746445), abs=1e-5)
