"""M1: moments, regressors (J5), plan shape, and the Holt-Winters backtest."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import forecast as FC

START = dt.date(2025, 1, 1)


def frame(spark, values, extra=None, key="c1"):
    rows = [(key, START + dt.timedelta(days=i), float(v), *[None if x[i] is None else float(x[i]) for x in (extra or {}).values()]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "campaign_id string, date date, value double" + "".join(
        f", {c} double" for c in extra or {}))


def by_numpy(y, xs, dows):
    """Coefficients, weekday means of residuals and their spread, by numpy's least squares."""
    a = np.column_stack([*xs, np.ones(len(y))])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    res = y - a @ coef
    eff = {d: res[[i for i, e in enumerate(dows) if e == d]].mean() for d in set(dows)}
    return coef, eff, np.std(res - np.array([eff[d] for d in dows]))


def series(n=60, seed=1):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    ads, price = 50 + 10 * np.sin(t / 3) + r.normal(size=n), 5 + r.normal(size=n)
    y = 200 + 2 * t + 3 * ads - 8 * price + 20 * (t % 7 == 2) + r.normal(size=n)
    return t, ads, price, y


def test_two_regressors_equal_numpy(spark):
    t, ads, price, y = series()
    got = FC.linear_weekly(frame(spark, y, {"ads": ads, "price": price}), "campaign_id", regressors=["ads", "price"])
    dows = [(START + dt.timedelta(days=int(i))).strftime("%A") for i in t]
    coef, eff, sd = by_numpy(y, [t, ads, price], dows)
    p = got["params"].first()
    assert [p["b_0"], p["b_1"], p["b_2"], p["icpt"]] == pytest.approx(coef.tolist(), rel=1e-9)
    assert p["sd"] == pytest.approx(sd, rel=1e-9)
    fc = {r["date"]: r for r in got["forecast"].collect()}
    assert len(fc) == 74
    for i in (0, 30, 59):
        want = np.array([t[i], ads[i], price[i], 1]) @ coef + eff[dows[i]]
        assert fc[START + dt.timedelta(days=i)]["predicted"] == pytest.approx(want, abs=1e-3)
    ahead = START + dt.timedelta(days=70)       # regressors of the last day go on
    want = np.array([70, ads[59], price[59], 1]) @ coef + eff[ahead.strftime("%A")]
    assert fc[ahead]["predicted"] == pytest.approx(want, abs=1e-3) and fc[ahead]["is_forecast"]
    # the backtest: fitted on the first 45 days, whose last regressor values go on
    coef, eff, sd = by_numpy(y[:45], [t[:45], ads[:45], price[:45]], dows[:45])
    bt = {r["date"]: r for r in got["backtest"].collect()}
    assert len(bt) == 15
    for i in (45, 59):
        want = np.array([t[i], ads[44], price[44], 1]) @ coef + eff[dows[i]]
        row = bt[START + dt.timedelta(days=i)]
        assert row["predicted"] == pytest.approx(want, abs=1e-3) and row["upper"] - row["predicted"] == pytest.approx(1.28 * sd, abs=1e-3)


def test_a_regressor_that_adds_nothing_changes_nothing(spark):
    t, ads, _, y = series()
    plain = FC.linear_weekly(frame(spark, y), "campaign_id")["forecast"].orderBy("date").collect()
    for useless in ([7.0] * 60, (3.0 * t + 1).tolist(), [None] * 60):
        got = FC.linear_weekly(frame(spark, y, {"x": useless}), "campaign_id", regressors=["x"])
        assert got["params"].first()["b_1"] == 0.0
        rows = got["forecast"].orderBy("date").collect()
        assert all(a["predicted"] == pytest.approx(b["predicted"], abs=1e-3) for a, b in zip(plain, rows))
    twice = FC.linear_weekly(frame(spark, y, {"a": ads, "b": ads}), "campaign_id", regressors=["a", "b"])["params"].first()
    assert twice["b_2"] == 0.0 and twice["b_1"] != 0.0


def test_solver_on_random_positive_matrices(spark):
    r = np.random.default_rng(4)
    for k in (1, 2, 3, 4):
        x = r.normal(size=(30, k + 1))
        g = x.T @ x
        names = {(i, j): f"g{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)}
        df = spark.createDataFrame([[float(g[i, j]) for i, j in names]], list(names.values()))
        row = FC.solve_gram(df, k, lambda i, j: F.col(names[i, j]), "b").first()
        assert [row[f"b_{i}"] for i in range(k)] == pytest.approx(np.linalg.solve(g[:k, :k], g[:k, k]).tolist(), rel=1e-8)
        assert set(row.asDict()) == set(names.values()) | {f"b_{i}" for i in range(k)}


def test_the_series_is_scanned_twice_at_most(spark, tmp_path):
    _, ads, _, y = series()
    frame(spark, y, {"ads": ads}).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    for out, most in (("forecast", 2), ("backtest", 2), ("params", 1), ("weekly", 1), ("trend", 1)):
        for regressors in ([], ["ads"]):
            df = FC.linear_weekly(s, "campaign_id", regressors=regressors)[out]
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert 1 <= plan.count("FileScan parquet") <= most, (out, plan)
            # all windows and aggregates follow one exchange of the scan, on the series
            assert plan.count("Exchange hashpartitioning") <= most


def test_regressor_frame_feeds_the_fit(spark):
    """J5 into M1: two series of one campaign share its keywords; another has none that match."""
    t, ads, _, y = series()
    days = [START + dt.timedelta(days=int(i)) for i in t]
    s = spark.createDataFrame([(c, m, d, float(v)) for c, m in (("c1", "clicks"), ("c1", "spend"), ("c2", "clicks"))
                               for d, v in zip(days, y)], "campaign_id string, metric string, date date, value double")
    kw = spark.createDataFrame([("c1", "laptop"), ("c1", "monitor"), ("c2", "lamp")], "campaign_id string, keyword string")
    tr = spark.createDataFrame([(k, d, int(v) + add) for k, add in (("laptop", 0), ("monitor", 4)) for d, v in zip(days, ads)],
                               "keyword string, date date, interest bigint")
    rows = FC.with_trend_regressor(s, kw, tr, ["campaign_id", "metric"], 14)
    assert rows.columns == ["campaign_id", "metric", "date", "value", "is_forecast", "search_trend"]
    assert rows.count() == 3 * 74 and rows.where("campaign_id = 'c2' and search_trend is not null").isEmpty()
    p = {(r["campaign_id"], r["metric"]): r for r in FC.linear_weekly(
        rows.where("not is_forecast"), ["campaign_id", "metric"], regressors=["search_trend"])["params"].collect()}
    assert p["c1", "clicks"]["b_1"] == pytest.approx(p["c1", "spend"]["b_1"]) and p["c1", "clicks"]["b_1"] > 1
    assert p["c2", "clicks"]["b_1"] == 0.0


# ── Holt-Winters ─────────────────────────────────────────────────────

def test_holt_winters_on_a_series_worked_by_hand(spark):
    """A line plus a weekly pattern, without noise: the start values are wrong by the
    slope inside the week only, the state is updated as written out here, and the tail is
    scored with the head's state."""
    pattern = [0.0, 5.0, -3.0, 8.0, 2.0, -6.0, -6.0]
    y = [100.0 + pattern[i % 7] for i in range(42)]           # level 100, no slope: fitted exactly
    out = FC.holt_winters(frame(spark, y), "campaign_id")
    fc = out["forecast"].orderBy("date").collect()
    assert [r["predicted"] for r in fc] == pytest.approx([100.0 + pattern[i % 7] for i in range(56)], abs=1e-9)
    bt = out["backtest"].orderBy("date").collect()
    assert len(bt) == 10                                      # 42 div 4
    assert [r["predicted"] for r in bt] == pytest.approx(y[32:], abs=1e-9) and bt[0]["date"] == START + dt.timedelta(days=32)
    ev = out["evaluation"].first()
    assert (ev["mape"], ev["mae"], ev["rmse"], ev["test_days"]) == (0.0, 0.0, 0.0, 10)
    # a jump in the tail is not seen by the head: every error is the jump
    y2 = y[:32] + [v + 50 for v in y[32:]]
    ev = FC.holt_winters(frame(spark, y2), "campaign_id")["evaluation"].first()
    assert (ev["mae"], ev["rmse"], ev["coverage"]) == (50.0, 50.0, 0.0)


def test_holt_winters_state_by_its_recursion():
    r = np.random.default_rng(3)
    y = 50 + np.arange(40) + 10 * np.sin(np.arange(40) * 2 * math.pi / 7) + r.normal(size=40)
    fitted, fwd, (a, b, g) = FC._hw_forecast(y, 5)
    level, trend = y[:7].mean(), (y[7:14].mean() - y[:7].mean()) / 7
    season = [v - y[:7].mean() for v in y[:7]]
    for i, v in enumerate(y):
        assert fitted[i] == pytest.approx(level + trend + season[i % 7])
        before = level
        level = a * (v - season[i % 7]) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        season[i % 7] = g * (v - level) + (1 - g) * season[i % 7]
    assert fwd.tolist() == pytest.approx([level + (h + 1) * trend + season[(40 + h) % 7] for h in range(5)])


def test_holt_winters_short_null_and_zero(spark):
    short = frame(spark, [3.0] * 29, key="a")
    odd = frame(spark, [0.0, 7.0, -4.0, 2.0, 9.0] * 8, key="b")
    odd = odd.withColumn("value", F.when(F.col("value") != 7.0, F.col("value")))
    out = FC.holt_winters(short.unionByName(odd), "campaign_id")
    assert [r["campaign_id"] for r in out["evaluation"].collect()] == ["b"]
    assert out["backtest"].where("actual = 0").count() > 0       # actuals are not clipped
    assert FC.holt_winters(short.limit(0), "campaign_id")["forecast"].collect() == []
