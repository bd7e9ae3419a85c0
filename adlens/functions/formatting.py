"""Text helpers as built-in column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.functions.ratios import round_half_up


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sign_char(x) -> Column:
    """'+' for x >= 0, '-' otherwise (Python's ``+`` format flag)."""
    return F.when(_c(x) < 0, F.lit("-")).otherwise(F.lit("+"))


def thousands(x, decimals: int = 0) -> Column:
    """1234567.8 -> '1,234,568' (ties away from zero, then grouped)."""
    r = round_half_up(F.abs(_c(x)), decimals)
    body = F.format_number(r, decimals)
    return F.when(_c(x) < 0, F.concat(F.lit("-"), body)).otherwise(body)


def signed_money_delta(x) -> Column:
    """'$+1,234 vs prior' — the sign goes after the dollar sign."""
    r = round_half_up(F.abs(_c(x)), 0).cast("bigint")
    return F.concat(F.lit("$"), sign_char(x), F.format_number(r, 0), F.lit(" vs prior"))


def signed_pct(x, decimals: int = 1) -> Column:
    """'+12.3%' with one decimal."""
    r = round_half_up(F.abs(_c(x)), decimals)
    return F.concat(sign_char(x), F.format_string(f"%.{decimals}f", r), F.lit("%"))


def fixed(x, decimals: int = 1) -> Column:
    """'%.<d>f' of a value rounded half away from zero (keeps the sign)."""
    r = round_half_up(_c(x), decimals)
    return F.format_string(f"%.{decimals}f", r)


def money(x, decimals: int = 0) -> Column:
    """'$1,234'."""
    return F.concat(F.lit("$"), thousands(x, decimals))


def multiple(x, decimals: int = 1) -> Column:
    """ROAS as '4.2x'."""
    return F.concat(fixed(x, decimals), F.lit("x"))


def parse_multiple(x) -> Column:
    """'4.2x' -> 4.2 (NULL when not a number)."""
    return F.replace(_c(x), F.lit("x"), F.lit("")).try_cast("double")


def capitalize(x) -> Column:
    """first letter upper, the rest lower ('GOOGLE' -> 'Google')."""
    s = _c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2147483647)))


def title_case(x) -> Column:
    """every word capitalised."""
    return F.initcap(_c(x))


def shorten_name(x) -> Column:
    """drop the platform prefix of a campaign name for chart labels."""
    s = _c(x)
    for prefix in ("Google - ", "Meta - ", "Amazon - "):
        s = F.replace(s, F.lit(prefix), F.lit(""))
    return s


def join_first(arr, n: int, sep: str = ", ") -> Column:
    """join the first n elements of an array column."""
    return F.array_join(F.slice(_c(arr), 1, n), sep)


def strip_code_fence(x) -> Column:
    """F8: remove a leading ```json / ``` fence and a trailing ``` from a reply."""
    s = F.trim(_c(x))
    s = F.regexp_replace(s, r"^```[A-Za-z]*\s*", "")
    s = F.regexp_replace(s, r"\s*```$", "")
    return F.trim(s)


def weekday_name(d) -> Column:
    """'Monday' .. 'Sunday' (names, so no engine-specific numbering)."""
    return F.date_format(_c(d), "EEEE")


def monday_week_start(d) -> Column:
    """the Monday on or before the date, as DATE."""
    return F.date_trunc("week", _c(d)).cast("date")


def month_day_label(d) -> Column:
    """'Jan 01'."""
    return F.date_format(_c(d), "MMM dd")


def weekday_index(d) -> Column:
    """Monday = 0 .. Sunday = 6, from Spark's Sunday = 1 numbering."""
    return ((F.dayofweek(_c(d)) + 5) % 7).cast("int")
