"""P5 ratio family, money sums and rounding (decision D1: keep all three rules).

Rounding: ``round_half_up`` goes through DECIMAL(38,12) so that a value whose
decimal text ends in 5 rounds up, the same in Spark and in any SQL engine that
rounds decimals half away from zero.  Rounding a DOUBLE directly differs
between engines at ties (1.005 -> 1.01 vs 1.0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, k: int) -> Column:
    """Round a numeric column to ``k`` places, ties away from zero, as DOUBLE."""
    return F.round(_c(x).cast("decimal(38,12)"), k).cast("double")


def money_sum(x) -> Column:
    """Exact sum of a two-decimal money column, returned as DOUBLE."""
    return F.coalesce(F.sum(_c(x).cast(MONEY)), F.lit(0).cast(MONEY)).cast("double")


def count_sum(x) -> Column:
    """Sum of a count column as BIGINT, 0 when there are no rows."""
    return F.coalesce(F.sum(_c(x).cast("bigint")), F.lit(0).cast("bigint"))


def ratio_zero(n, d, k: int) -> Column:
    """Rule (a): round(n/d, k); 0.0 when d is zero (stored daily ratios)."""
    n, d = _c(n), _c(d)
    return F.when(d == 0, F.lit(0.0)).otherwise(
        round_half_up(n.cast("double") / d.cast("double"), k))


def ratio_null(n, d, k: int) -> Column:
    """Rule (b): round(n / NULLIF(d, 0), k); NULL when d is zero (summary)."""
    n, d = _c(n), _c(d)
    return round_half_up(F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0))), k)


def ratio_case(n, d, k: int) -> Column:
    """Rule (c): CASE WHEN d > 0 THEN round(n/d, k) ELSE 0 END (KPIs, daily ROAS)."""
    n, d = _c(n), _c(d)
    return F.when(d > 0, round_half_up(n.cast("double") / d.cast("double"), k)).otherwise(F.lit(0.0))


def safe_div(n, d, default: float | None = None) -> Column:
    """n/d as DOUBLE; ``default`` (or NULL) when d is zero or NULL."""
    n, d = _c(n), _c(d)
    q = F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))
    return q if default is None else F.coalesce(q, F.lit(float(default)))
