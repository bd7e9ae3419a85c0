"""Forecast: U1, U3, M1, A19, A20, J5, J7.

M1 has two engines over one long series table (U3, one row per series key
and date):

* ``linear_weekly`` — native Spark only.  Per series: least squares on the
  day number and any regressors, mean residual per weekday, and a band of ±1.28
  population standard deviations of the residuals; one fit on all rows and one on
  the head, for the backtest.  All of it comes from moments per (series,
  weekday), one small table of parameters that the rows are joined with once.
* ``holt_winters`` — additive trend and period-7 season, fitted per series
  with ``groupBy(series).applyInArrow`` (NumPy grid search of the smoothing
  constants).  One group is one daily series, bounded by its number of days.

Series with fewer than 30 rows are rejected (returned by ``rejected_series``).
Training values are clipped at 1; backtest actuals are not.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from adlens.functions.formatting import weekday_name
from adlens.functions.ratios import round_half_up
from adlens.operators.trends import WEEKDAYS, fill_forward_backward, tail_split

HORIZON = 14
TEST_CAP = 15
Z = 1.28            # ~80 % band, fixed
MIN_ROWS = 30
METRICS = ("clicks", "conversions", "spend", "revenue")

# J7 fixed values: campaign-name trigger -> trend keyword.
TREND_TRIGGERS = (
    ("laptop", "laptop"),
    ("headphone", "headphones"),
    ("monitor", "computer monitor"),
    ("earbud", "wireless earbuds"),
    ("keyboard", "gaming keyboard"),
)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ── U3 / U1 ──────────────────────────────────────────────────────────

def metric_series(daily: DataFrame, metrics=METRICS, key: str = "campaign_id") -> DataFrame:
    """Campaigns x metrics as one long series table (key, metric, date, value)."""
    d = daily.select(key, "date", *[F.col(m).cast("double").alias(m) for m in metrics])
    return d.unpivot([key, "date"], list(metrics), "metric", "value")


def rejected_series(series: DataFrame, keys, min_rows: int = MIN_ROWS) -> DataFrame:
    """Series that are too short to forecast, with their row counts."""
    return (series.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") < min_rows))


def _prepare(series: DataFrame, keys, value: str, min_rows: int, test_cap: int, regressors) -> DataFrame:
    """Rows of the series that are long enough, with the day number t, the
    clipped training value, and every variable less its mean over the series (so
    that sums of squares lose no digits).  One exchange, on the series key."""
    k = _keys(keys)
    whole = Window.partitionBy(*k)
    s = series.select(*k, "date", F.col(value).cast("double").alias("y"),
                      *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in regressors])
    s = tail_split(s, k, test_cap)                       # n_rows, test_days, is_test
    s = s.where(F.col("n_rows") >= min_rows)
    newest = Window.partitionBy(*k).orderBy(F.col("date").desc())
    s = s.select("*", F.datediff(F.col("date"), F.min("date").over(whole)).cast("double").alias("t"),
                 F.greatest(F.col("y"), F.lit(1.0)).alias("y_fit"), weekday_name("date").alias("dow"),
                 (F.row_number().over(newest) == 1).alias("is_last"))
    v = ["t", *regressors, "y_fit"]
    s = s.select("*", *[F.avg(c).over(whole).alias(f"m_{c}") for c in v])
    return s.select("*", *[(F.col(c) - F.col(f"m_{c}")).alias(f"c_{c}") for c in v])


def solve_gram(df: DataFrame, k: int, gram, name: str, tol: float = 1e-9) -> DataFrame:
    """Least squares in columns: adds ``name``_0 .. ``name``_k-1 to a table that has
    the centred Gram matrix, ``gram(i, j)`` for 0 <= i <= j <= k (k is the target).

    Elimination without exchange of rows, the matrix being positive semidefinite; a
    variable that (nearly) follows from those before it gets the coefficient 0."""
    made = []

    def keep(frame, col, label):
        made.append(f"_{name}_{label}")
        return frame.withColumn(made[-1], col)

    at = {(i, j): gram(i, j) for i in range(k) for j in range(i, k + 1)}
    for i in range(k):
        least = gram(i, i) * tol
        df = keep(df, F.when(at[i, i] > least, at[i, i]), f"p{i}")
        at[i, i] = F.col(made[-1])
        for r in range(i + 1, k):
            factor = F.coalesce(at[i, r] / at[i, i], F.lit(0.0))
            for j in range(r, k + 1):
                df = keep(df, at[r, j] - factor * at[i, j], f"{i}_{r}_{j}")
                at[r, j] = F.col(made[-1])
    for i in reversed(range(k)):
        rest = at[i, k]
        for j in range(i + 1, k):
            rest = rest - at[i, j] * F.col(f"{name}_{j}")
        df = df.withColumn(f"{name}_{i}", F.coalesce(rest / at[i, i], F.lit(0.0)))
    return df.drop(*made)


def _solve_series(fit: DataFrame, v: list[str], pre: str) -> DataFrame:
    """Adds the coefficients, intercept, weekday effects and residual spread that follow
    from the moments with prefix ``pre`` (target last in ``v``)."""
    x = len(v) - 1
    col = lambda c: F.col(f"{pre}{c}")
    total = lambda terms: reduce(lambda a, b: a + b, terms)

    def gram(i, j):
        i, j = min(i, j), max(i, j)
        return col(f"g{i}_{j}") - col(f"s{i}") * col(f"s{j}") / col("n")

    def effect(d):  # mean residual of a weekday
        rest = d[f"{pre}s{x}"] - total(col(f"b_{i}") * d[f"{pre}s{i}"] for i in range(x))
        return F.struct(d["dow"], F.coalesce(F.try_divide(rest, d[f"{pre}n"]) - col("_a"), F.lit(0.0)))

    def of_day(acc, d):
        return acc + d[f"{pre}n"] * F.pow(F.element_at(col("eff"), d["dow"]), F.lit(2.0))

    fit = solve_gram(fit, x, gram, f"{pre}b")
    # the intercept in centred variables, then of the variables themselves
    fit = fit.withColumn(f"{pre}_a", (col(f"s{x}") - total(col(f"b_{i}") * col(f"s{i}") for i in range(x))) / col("n"))
    fit = fit.withColumn(f"{pre}icpt", F.col(f"m_{v[x]}") + col("_a") - total(
        col(f"b_{i}") * F.col(f"m_{v[i]}") for i in range(x)))
    fit = fit.withColumn(f"{pre}eff", F.map_from_entries(F.transform("days", effect)))
    square = gram(x, x) + total(col(f"b_{i}") * (total(col(f"b_{j}") * gram(i, j) for j in range(x)) - 2 * gram(i, x))
                                for i in range(x))
    spread = (square - F.aggregate("days", F.lit(0.0), of_day)) / col("n")
    return fit.withColumn(f"{pre}sd", F.sqrt(F.greatest(spread, F.lit(0.0))))


def _fit_parameters(p: DataFrame, keys, regressors) -> DataFrame:
    """One row per series: coefficients, intercept, weekday effects and residual spread of the
    fit on all rows and of the fit on the head (prefix bt_).

    Everything comes from moments per (series, weekday), of all rows and of the head,
    which merge by addition; residuals and their squares follow from them."""
    k = _keys(keys)
    v = ["t", *regressors, "y_fit"]
    x = len(v) - 1
    cells, totals = [], []
    for pre, rows in (("", F.lit(True)), ("bt_", ~F.col("is_test"))):
        cells.append(F.count_if(rows).alias(f"{pre}n"))
        cells += [F.sum(F.when(rows, F.col(f"c_{c}"))).alias(f"{pre}s{i}") for i, c in enumerate(v)]
        cells += [F.sum(F.when(rows, F.col(f"c_{v[i]}") * F.col(f"c_{v[j]}"))).alias(f"{pre}g{i}_{j}")
                  for i in range(x + 1) for j in range(i, x + 1)]
        totals += [f"{pre}n", *[f"{pre}s{i}" for i in range(x + 1)],
                   *[f"{pre}g{i}_{j}" for i in range(x + 1) for j in range(i, x + 1)]]
    day_cols = [f"{pre}{c}" for pre in ("", "bt_") for c in ("n", *[f"s{i}" for i in range(x + 1)])]
    days = p.groupBy(*k, "dow").agg(
        *cells, *[F.max(f"m_{c}").alias(f"m_{c}") for c in v], F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.max("t").alias("last_t"))
    fit = days.groupBy(*k).agg(
        *[F.sum(c).alias(c) for c in totals], *[F.max(f"m_{c}").alias(f"m_{c}") for c in v],
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("last_t").alias("last_t"),
        F.collect_list(F.struct("dow", *day_cols)).alias("days"))               # seven at most
    for pre in ("", "bt_"):
        fit = _solve_series(fit, v, pre)
    return fit.select(*k, "first_date", "last_date", "last_t", *[f"m_{c}" for c in v], *[
        f"{pre}{c}" for pre in ("", "bt_") for c in ("icpt", "eff", "sd", *[f"b_{i}" for i in range(x)])])


def linear_weekly(series: DataFrame, keys, value: str = "value", horizon: int = HORIZON,
                  test_cap: int = TEST_CAP, z: float = Z, min_rows: int = MIN_ROWS,
                  regressors=()) -> dict[str, DataFrame]:
    """M1 linear+weekly engine.  Returns forecast (U1), backtest, evaluation (A20),
    weekly (A19), trend (A19) and params DataFrames.

    ``regressors`` are columns of ``series``, fitted beside the trend (null counts as
    0).  Days ahead take a regressor's value of the last day, and so do the test days of the
    backtest, from the last day of its head.  A regressor that does not vary, or
    follows from the others, has no effect."""
    k, regressors = _keys(keys), list(regressors)
    p = _prepare(series, k, value, min_rows, test_cap, regressors)
    params = _fit_parameters(p, k, regressors)
    x = ["t", *regressors]
    rows = p.select(*k, "date", "y", "dow", "is_test", "is_last", "n_rows", "test_days", *x)
    if regressors:      # the value that the backtest knows of its test days
        head = Window.partitionBy(*k).orderBy(F.col("is_test"), F.col("date").desc())
        rows = rows.select("*", *[F.first(c).over(head).alias(f"head_{c}") for c in regressors])
    rows = rows.join(params, k)
    at = lambda pre, dow: F.coalesce(F.element_at(F.col(f"{pre}eff"), dow), F.lit(0.0))
    slope = lambda pre, get: reduce(lambda u, w: u + w, [F.col(f"{pre}icpt"), *[
        F.col(f"{pre}b_{i}") * get(c) for i, c in enumerate(x)]])
    band = lambda pred, sd: [round_half_up(pred, 4).alias("predicted"), round_half_up(pred - z * sd, 4).alias("lower"),
                             round_half_up(pred + z * sd, 4).alias("upper")]

    tested = slope("bt_", lambda c: F.col(f"head_{c}") if c in regressors else F.col(c)) + at("bt_", F.col("dow"))
    backtest = rows.where("is_test").select(*k, "date", F.col("y").alias("actual"), *band(tested, F.col("bt_sd")))
    # the newest row of a series also gives the days ahead
    ahead = rows.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("is_last"), F.lit(horizon)).otherwise(
        F.lit(0)))).alias("h"))
    ahead = ahead.select("*", F.date_add("date", F.col("h")).alias("day"))
    fitted = slope("", lambda c: F.col("t") + F.col("h") if c == "t" else F.col(c)) + at("", weekday_name("day"))
    forecast = ahead.select(*k, F.col("day").alias("date"), F.when(F.col("h") == 0, F.col("y")).alias("actual"),
                            *band(fitted, F.col("sd")), (F.col("h") > 0).alias("is_forecast"))   # U1
    # the trend line, other regressors at their mean
    level = reduce(lambda u, w: u + w, [F.col("icpt"), *[F.col(f"b_{i}") * F.col(f"m_{c}") for i, c in enumerate(x) if i]])
    days = F.col("last_t") + horizon
    trend = params.select(
        *k, round_half_up(level, 2).alias("trend_start"), round_half_up(level + F.col("b_0") * days, 2).alias("trend_end"),
        F.when(F.col("b_0") * days > 0, "up").otherwise("down").alias("direction"))
    return {"forecast": forecast, "backtest": backtest, "evaluation": evaluate(backtest, k),
            "weekly": weekly_profile(params, k), "trend": trend, "params": params}


def weekly_profile(params: DataFrame, keys) -> DataFrame:
    """Seasonal effect per weekday (Mon..Sun), 0 for a missing weekday."""
    week = F.array(*[F.struct(F.lit(d).alias("dow"), F.lit(i).alias("dow_index")) for i, d in enumerate(WEEKDAYS)])
    out = params.select(*_keys(keys), "eff", F.explode(week).alias("w"))
    return out.select(*_keys(keys), "w.dow", "w.dow_index",
                      round_half_up(F.coalesce(F.element_at("eff", F.col("w.dow")), F.lit(0.0)), 2).alias("effect"))


def evaluate(backtest: DataFrame, keys) -> DataFrame:
    """MAPE (actual = 0 skipped; 0.0 if none), MAE, RMSE, coverage, pass flags."""
    k = _keys(keys)
    a, pr = F.col("actual"), F.col("predicted")
    e = backtest.groupBy(*k).agg(
        F.avg(F.when(a != 0, F.abs((a - pr) / a))).alias("_mape"),
        F.avg(F.abs(a - pr)).alias("_mae"),
        F.sqrt(F.avg((a - pr) * (a - pr))).alias("_rmse"),
        F.avg(((a >= F.col("lower")) & (a <= F.col("upper"))).cast("double")).alias("_cov"),
        F.count(F.lit(1)).alias("test_days"))
    e = e.select(*k, "test_days",
                 round_half_up(F.coalesce(F.col("_mape") * 100, F.lit(0.0)), 2).alias("mape"),
                 round_half_up("_mae", 2).alias("mae"), round_half_up("_rmse", 2).alias("rmse"),
                 round_half_up("_cov", 4).alias("coverage"))
    return e.select("*", (F.col("mape") < 20).alias("mape_good"), (F.col("coverage") >= 0.70).alias("coverage_good"))


# ── Holt-Winters (applyInArrow) ──────────────────────────────────────

_ALPHAS = np.linspace(0.05, 0.95, 10)
_BETAS = np.array([0.0, 0.01, 0.05, 0.1, 0.2, 0.3])
_GAMMAS = np.array([0.0, 0.05, 0.1, 0.2, 0.3, 0.5])


def _hw_fit(y: np.ndarray, m: int = 7):
    """Additive Holt-Winters, grid search of (alpha, beta, gamma) by one-step SSE."""
    A, B, G = np.meshgrid(_ALPHAS, _BETAS, _GAMMAS, indexing="ij")
    a, b, g = A.ravel(), B.ravel(), G.ravel()
    lvl = np.full(a.shape, y[:m].mean())
    trd = np.full(a.shape, (y[m:2 * m].mean() - y[:m].mean()) / m)
    sea = np.tile(y[:m] - y[:m].mean(), (a.size, 1))
    fitted = np.empty((a.size, y.size))
    for t in range(y.size):
        s = sea[:, t % m]
        fitted[:, t] = lvl + trd + s
        new_lvl = a * (y[t] - s) + (1 - a) * (lvl + trd)
        trd = b * (new_lvl - lvl) + (1 - b) * trd
        sea[:, t % m] = g * (y[t] - new_lvl) + (1 - g) * s
        lvl = new_lvl
    sse = ((fitted - y) ** 2).sum(axis=1)
    i = int(np.argmin(sse))
    return fitted[i], lvl[i], trd[i], sea[i], (a[i], b[i], g[i])


def _hw_forecast(y, horizon, m=7):
    fitted, lvl, trd, sea, params = _hw_fit(y, m)
    n = y.size
    fwd = np.array([lvl + h * trd + sea[(n + h - 1) % m] for h in range(1, horizon + 1)])
    return fitted, fwd, params


def holt_winters(series: DataFrame, keys, value: str = "value", horizon: int = HORIZON, test_cap: int = TEST_CAP,
                 z: float = Z, min_rows: int = MIN_ROWS) -> dict[str, DataFrame]:
    """M1 Holt-Winters engine.  Returns forecast (history + future), backtest and evaluation.

    One grouped function gives both: the state fitted on the whole series runs
    ``horizon`` days ahead, and the state fitted on its head (all but the last
    min(``test_cap``, n div 4) rows) is scored on the tail.  Training values are clipped at 1, the
    backtest's actuals are not; a null value counts as 0.  A group is one daily series,
    bounded by its days."""
    k = _keys(keys)
    key_fields = [f for f in series.schema.fields if f.name in k]
    schema = TT.StructType(key_fields + [
        TT.StructField("part", TT.StringType()),
        TT.StructField("date", TT.DateType()), TT.StructField("actual", TT.DoubleType()),
        TT.StructField("predicted", TT.DoubleType()), TT.StructField("lower", TT.DoubleType()),
        TT.StructField("upper", TT.DoubleType()), TT.StructField("is_forecast", TT.BooleanType()),
        TT.StructField("alpha", TT.DoubleType()), TT.StructField("beta", TT.DoubleType()),
        TT.StructField("gamma", TT.DoubleType())])

    def per_series(table: pa.Table) -> pa.Table:
        table = table.sort_by([("date", "ascending")])
        dates = table["date"].cast(pa.int32()).to_numpy()       # days
        actual = np.nan_to_num(table["_value"].cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
        n = len(actual) if len(actual) >= min_rows else 0
        test = min(test_cap, n // 4)
        cols = {c: [] for c in ("part", "date", "actual", "predicted", "lower", "upper", "is_forecast", "alpha", "beta", "gamma")}

        def put(part, days, values, pred, sd, ahead, fit):
            m = len(days)
            for c, x in zip(cols, (np.full(m, part, dtype=object), days, values, pred, pred - z * sd, pred + z * sd, ahead,
                                   *[np.full(m, f) for f in fit])):
                cols[c].append(x)

        if n:
            y = np.clip(actual, 1, None)
            fitted, fwd, fit = _hw_forecast(y, horizon)
            put("forecast", np.concatenate([dates, dates[-1] + np.arange(1, horizon + 1, dtype=np.int32)]),
                np.concatenate([actual, np.full(horizon, np.nan)]), np.concatenate([fitted, fwd]), float(np.std(y - fitted)),
                np.arange(n + horizon) >= n, fit)
            fitted, fwd, fit = _hw_forecast(y[:n - test], test)
            put("backtest", dates[n - test:], actual[n - test:], fwd, float(np.std(y[:n - test] - fitted)), np.ones(test, dtype=bool), fit)
        joined = {c: np.concatenate(v) if v else np.zeros(0) for c, v in cols.items()}
        size = len(joined["date"])
        out = [pa.array([table[c][0].as_py()] * size, table.schema.field(c).type) if size else pa.array([], table.schema.field(c).type)
               for c in (f.name for f in key_fields)]
        out += [pa.array(joined["part"].tolist(), pa.string()), pa.array(joined["date"].astype(np.int32)).cast(pa.date32()),
                pa.array(joined["actual"], pa.float64(), from_pandas=True)]
        out += [pa.array(joined["is_forecast"].astype(bool)) if c == "is_forecast" else pa.array(joined[c].astype(float))
                for c in ("predicted", "lower", "upper", "is_forecast", "alpha", "beta", "gamma")]
        return pa.Table.from_arrays(out, [f.name for f in schema.fields])

    _ship_by_value()
    s = series.select(*[f.name for f in key_fields], "date", F.col(value).cast("double").alias("_value"))
    both = s.groupBy(*k).applyInArrow(per_series, schema)
    backtest = both.where("part = 'backtest'").select(*k, "date", "actual", "predicted", "lower", "upper")
    return {"forecast": both.where("part = 'forecast'").drop("part"), "backtest": backtest, "evaluation": evaluate(backtest, k)}


def _ship_by_value() -> None:
    """Serialise this module's helpers with the function (by value), so Python
    workers need only NumPy and Arrow, not this package on their path."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ── J7 / J5: trend regressor ─────────────────────────────────────────

def match_trend_keywords(campaigns: DataFrame, trends: DataFrame, n_default: int = 3) -> DataFrame:
    """(campaign_id, keyword) pairs by name trigger; unmatched campaigns
    get the first three keywords.  The trigger table is a literal array
    filtered per row (no join); only keywords present in ``trends`` survive."""
    pairs = F.array(*[F.struct(F.lit(t).alias("trigger"), F.lit(kw).alias("keyword"))
                      for t, kw in TREND_TRIGGERS])
    name = F.lower(F.col("campaign_name"))
    hit = F.transform(F.filter(pairs, lambda p: F.contains(name, p["trigger"])), lambda p: p["keyword"])
    default = (trends.select("keyword").distinct().orderBy("keyword").limit(n_default)
               .select(F.sort_array(F.collect_list("keyword"))).scalar())
    kw = F.when(F.size(hit) > 0, hit).otherwise(default)
    m = campaigns.select("campaign_id", F.explode(F.array_distinct(kw)).alias("keyword"))
    known = trends.select("keyword").distinct()
    return m.join(known, "keyword", "left_semi").select("campaign_id", "keyword")


def with_trend_regressor(series: DataFrame, keyword_map: DataFrame, trends: DataFrame,
                         key="campaign_id", horizon: int = HORIZON) -> DataFrame:
    """J5 + W4: each series (plus ``horizon`` future days) joined with the mean
    interest of its matched keywords by date, carried forward then backward.

    ``keyword_map`` has the keyword and one or more of the key columns.  Series that share a
    keyword set share one regressor: the mean is computed per distinct set and
    date (a few sets x days), then joined to the series on (set, date) — never
    series x keywords x days rows.  A regressor without any value is dropped.
    """
    k = _keys(key)
    mapped = [c for c in keyword_map.columns if c != "keyword"]
    sets = keyword_map.groupBy(*mapped).agg(F.array_sort(F.collect_set("keyword")).alias("kw_set"))
    set_reg = (sets.select("kw_set").distinct()
               .select("kw_set", F.explode("kw_set").alias("keyword"))
               .join(trends, "keyword")
               .groupBy("kw_set", "date").agg(F.avg(F.col("interest").cast("double")).alias("search_trend")))
    last = series.groupBy(*k).agg(F.max("date").alias("_last"))
    fut = last.select(*k, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"), "_last") \
        .select(*k, F.date_add("_last", F.col("_h")).alias("date"))
    cols = [c for c in series.columns if c not in (*k, "date")]
    fut = fut.select(*k, "date", *[F.lit(None).cast(series.schema[c].dataType).alias(c) for c in cols],
                     F.lit(True).alias("is_forecast"))
    allrows = series.withColumn("is_forecast", F.lit(False)).unionByName(fut)
    j = allrows.join(sets, mapped, "left").join(set_reg, ["kw_set", "date"], "left").drop("kw_set")
    out = fill_forward_backward(j, k, "search_trend").select(*k, "date", *cols, "is_forecast", "search_trend")
    # no keyword has a value on any day: the regressor is dropped (probed on the trends alone)
    seen = trends.where("interest is not null").join(keyword_map.select("keyword"), "keyword", "left_semi")
    return out.drop("search_trend") if seen.isEmpty() else out
