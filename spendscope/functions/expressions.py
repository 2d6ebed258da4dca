"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.registry import AnalysisWindow

# ---- fixed values -------------------------------------------------------------
# Clusters that a job run starts for itself.
JOB_CLUSTER_NAME = r"^job-[0-9]+-run-[0-9]+"
# Availability values that mean spot capacity, per cloud.
SPOT_VALUES = {
    "aws_attributes": ("SPOT", "SPOT_WITH_FALLBACK"),
    "azure_attributes": ("SPOT_AZURE", "SPOT_WITH_FALLBACK_AZURE"),
    "gcp_attributes": ("PREEMPTIBLE_GCP", "PREEMPTIBLE_WITH_FALLBACK_GCP"),
}
# Price of a DBU when no usage gives one.
DEFAULT_DBU_PRICE = 0.50
# Effort texts: unit, minutes per unit, minutes when the number cannot be read.
EFFORT_UNITS = (("second", 1 / 60, 0.5), ("minute", 1.0, 2.0), ("hour", 60.0, 120.0))
EFFORT_DEFAULT_MINUTES = 30.0
# -------------------------------------------------------------------------------

GIB = 1024**3
# Amounts have 12 digits. They are added in two whole numbers, millionths and the millionths of
# these, so that the sum is the same in any order and no decimal is in the way.
AMOUNT = "decimal(28,12)"
_MILLION = 10**6
_FEW_DIGITS = 1e15


# ---- numbers ------------------------------------------------------------------
def settled(col: Column) -> Column:
    """Drop the last digits of a float result."""
    return F.round(col, 6)


def _split(col: Column) -> tuple[Column, Column]:
    """An amount's millionths, cut off, and what is left of it, in millionths of these.

    Doubles of up to 15 digits, six of them after the point, are whole millionths and need no
    decimal: no other number of so few digits has the same double.
    """
    scaled = col.cast(AMOUNT) * F.lit(_MILLION)
    high = scaled.cast("bigint")
    low = ((scaled - high) * F.lit(_MILLION)).cast("bigint")
    near = F.rint(col.cast("double") * F.lit(float(_MILLION)))
    plain = (F.typeof(col) == "double") & (F.abs(near) < _FEW_DIGITS) & (near / F.lit(float(_MILLION)) == col.cast("double"))
    return F.when(plain, near.cast("bigint")).otherwise(high), F.when(plain, F.lit(0).cast("bigint")).otherwise(low)


def _joined(high: Column, low: Column) -> Column:
    """The sum that two summed parts stand for, at six digits as a double; NULL counts as zero."""
    unit = F.lit(Decimal(1).scaleb(-6))
    whole = "decimal(20,0)"
    exact = high.cast(whole) * unit + low.cast(whole) * unit * unit
    return F.coalesce(F.round(exact, 6).cast("double"), F.lit(0.0))


def total(col: Column | str) -> Column:
    """Exact sum of amounts, at six digits as a double; no rows and NULLs count as zero.

    Each amount counts with 12 digits. Amounts and sums stay below 9.2e12: beyond, the session's
    ANSI mode raises an error.
    """
    high, low = _split(F.col(col) if isinstance(col, str) else col)
    return _joined(F.sum(high), F.sum(low))


def amount_parts(*names: str) -> list[Column]:
    """The parts of amounts, ``<name>_high`` and ``<name>_low``, to be added by ``part_sums``."""
    return [
        part.alias(f"{name}_{side}") for name in names for side, part in zip(("high", "low"), _split(F.col(name)))
    ]


def part_sums(*names: str) -> list[Column]:
    """Sums of parts, which are parts again."""
    return [F.sum(f"{name}_{side}").alias(f"{name}_{side}") for name in names for side in ("high", "low")]


def amount(name: str) -> Column:
    """The amount that one row's parts stand for."""
    return _joined(F.col(f"{name}_high"), F.col(f"{name}_low"))


def total_parts(name: str, condition: Column | None = None) -> Column:
    """What ``total`` gives, from the parts."""
    sides = [F.col(f"{name}_{side}") for side in ("high", "low")]
    return _joined(*[F.sum(s if condition is None else F.when(condition, s)) for s in sides])


def total_if(condition: Column, col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return total(F.when(condition, col))


def rounded(col: Column, digits: int) -> Column:
    """Round half up, after dropping float noise."""
    return F.round(settled(col), digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def gigabytes(col: Column) -> Column:
    return col.cast("double") / F.lit(float(GIB))


def seconds(milliseconds: Column) -> Column:
    return milliseconds.cast("double") / F.lit(1000.0)


# ---- text ---------------------------------------------------------------------
def known(col: Column) -> Column:
    """A dimension value as text; missing ones are UNKNOWN."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit("UNKNOWN"))


def is_job_cluster(name: Column, ignore_case: bool = False) -> Column:
    pattern = ("(?i)" if ignore_case else "") + JOB_CLUSTER_NAME
    return F.coalesce(name, F.lit("")).rlike(pattern)


def is_starter(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).contains("starter")


def user_display(user: Column) -> Column:
    return F.substring_index(user, "@", 1)


def row_id(prefix: str, resource_id: Column) -> Column:
    """An id of a recommendation: whole, so that no two resources share one."""
    return F.concat(F.lit(prefix + "_"), resource_id)


def effort_minutes(effort: Column) -> Column:
    """Minutes named by an effort text such as ``5 minutes to test``."""
    text = F.lower(effort)
    result = F.lit(EFFORT_DEFAULT_MINUTES)
    for unit, factor, fallback in reversed(EFFORT_UNITS):
        number = F.regexp_extract(text, rf"(\S+)\s+\S*{unit}", 1).try_cast("double")
        minutes = F.coalesce(number * F.lit(factor), F.lit(fallback))
        result = F.when(text.contains(unit), minutes).otherwise(result)
    return result


def preview(text: Column | str, chars: int) -> Column:
    return F.substring(text, 1, chars)


def tag_count(tags: Column) -> Column:
    """Tags of a line; NULL without a map."""
    return F.when(tags.isNotNull(), F.size(tags))


# ---- query text ---------------------------------------------------------------
def _statement(text: Column) -> Column:
    return F.upper(F.coalesce(text, F.lit("")))


def selects_star(text: Column) -> Column:
    return _statement(text).rlike(r"(?U)SELECT\s+\*")


def lacks_filter(text: Column) -> Column:
    statement = _statement(text)
    return ~statement.contains("WHERE") & ~statement.contains("JOIN")


def join_count(text: Column) -> Column:
    return F.regexp_count(_statement(text), F.lit(r"(?U)\bJOIN\b"))


# ---- time ---------------------------------------------------------------------
def moment(value: date | datetime) -> Column:
    """A zone-free time stamp literal; a date stands for its midnight."""
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_period(day: Column, window: AnalysisWindow) -> Column:
    """Dates of the period, both ends included."""
    return day.between(F.lit(window.start), F.lit(window.end))


def in_period_times(at: Column, window: AnalysisWindow) -> Column:
    """Time stamps from the first midnight to the last, both included."""
    return (at >= moment(window.start)) & (at <= moment(window.end))


def day_of(at: Column) -> Column:
    return F.to_date(at)


def hour_of(at: Column) -> Column:
    return F.hour(at)


def weekday_of(day: Column) -> Column:
    """The day of the week, from 1 for Sunday."""
    return F.dayofweek(day)


def since(at: Column, start: datetime) -> Column:
    return at >= moment(start)


def whole_units(unit: str, start: Column, end: Column) -> Column:
    """Complete units between two time stamps."""
    return F.timestamp_diff(unit, start, end)


def hours_running(start: Column, as_of: datetime) -> Column:
    """Hours since ``start``, from whole minutes."""
    return whole_units("MINUTE", start, moment(as_of)) / F.lit(60.0)


# ---- compute ------------------------------------------------------------------
def worker_span() -> Column:
    """Workers between the limits of autoscaling; NULL where there is nothing to scale."""
    return F.nullif(F.col("max_autoscale_workers") - F.col("min_autoscale_workers"), F.lit(0))


def is_classic(serverless: Column) -> Column:
    """Not serverless; unknown counts as classic."""
    return (serverless == F.lit(False)) | serverless.isNull()


def availability() -> Column:
    return F.coalesce(*[F.col(f"{cloud}.availability") for cloud in SPOT_VALUES])


def uses_spot() -> Column:
    flag = F.lit(False)
    for cloud, values in reversed(SPOT_VALUES.items()):
        flag = F.when(F.col(f"{cloud}.availability").isin(*values), F.lit(True)).otherwise(flag)
    return flag
