"""Percentiles per group by radix selection.

A floating value maps to a signed 64-bit integer of the same order (its IEEE-754 bits; negative
values mirrored).  The bits are cut into digits, most significant first.  A level counts the rows
per (group, digit), a running sum over at most 2**width digits finds the digit that holds each
target rank, and the next level looks only at the rows that share the digits found so far.

* ``radix_histogram`` is the mergeable part: counts per (group, part, first two digits).  Parts
  are days, files, clusters; histograms of different parts are added by concatenating rows.
* ``percentiles_from_histogram`` selects from any union of such histograms; the value is known to
  a relative error of ``relative_error(digits)``.
* ``radix_percentiles`` follows all four digits and is exact.

A hot group is spread over (group, digit) keys, and counts are combined before they are shuffled;
no task receives the rows of a group as such.  All steps are JVM expressions.

Defined results: null, NaN and (with ``least=0``) negative values are left out; a group without a
value left gives no row; null group columns form a group of their own; -0.0 counts as 0.0; infinite
values are ordered at the ends; ties share a value, so any of them is right.  Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import key_value, order_key
from .common import cut, null_safe

DIGITS = (12, 12, 20, 20)
QUANTILES = {"median": 0.5, "p95": 0.95}


def relative_error(digits: tuple[int, ...], levels: int) -> float:
    """Of a value known by its first ``levels`` digits (sign and exponent take 12 bits)."""
    return 2.0 ** -(sum(digits[:levels]) - 12) if levels < len(digits) else 0.0


def _digit(key: Column, digits: tuple[int, ...], level: int) -> Column:
    shift = 64 - sum(digits[: level + 1])
    d = F.shiftright(key, shift) if shift else key
    return d if level == 0 else d.bitwiseAND(F.lit((1 << digits[level]) - 1))


def _prefix(key: Column, digits: tuple[int, ...], levels: int) -> Column:
    shift = 64 - sum(digits[:levels])
    return F.shiftright(key, shift) if shift else key


def usable(value: Column, least: float | None) -> Column:
    ok = value.isNotNull() & ~F.isnan(value)
    return ok & (value >= least) if least is not None else ok


def radix_histogram(
    df: DataFrame,
    by: list[str],
    value: str,
    part: list[str] | None = None,
    weight: str | None = None,
    least: float | None = None,
    digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """Mergeable counts: (by..., part..., __d0, __d1, __n)."""
    k = order_key(F.col(value).cast("double"))
    w = F.col(weight) if weight else F.lit(1)
    keys = df.filter(usable(F.col(value).cast("double"), least)).select(*by, *(part or []), k.alias("__k"), w.cast("bigint").alias("__w"))
    return keys.groupBy(
        *by, *(part or []), _digit(F.col("__k"), digits, 0).alias("__d0"), _digit(F.col("__k"), digits, 1).alias("__d1"),
    ).agg(F.sum("__w").alias("__n"))


def _select(hist: DataFrame, by: list[str], digit: str) -> DataFrame:
    """hist: (by, __q, __rank, digit, __n) -> the digit with the rank, and the rank inside it."""
    w = Window.partitionBy(*by, "__q").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("__cum", F.sum("__n").over(w))
    hit = (F.col("__cum") > F.col("__rank")) & (F.col("__cum") - F.col("__n") <= F.col("__rank"))
    return run.filter(hit).withColumn("__rank", F.col("__rank") - (F.col("__cum") - F.col("__n"))).drop("__cum", "__n")


def _ranks(first: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """first: (by, __d0, __n) -> one row per quantile too, with the target rank floor(q * n)."""
    total = first.withColumn("__total", F.sum("__n").over(Window.partitionBy(*by)))
    qs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])
    each = total.withColumn("__e", F.explode(qs))
    rank = F.least(F.floor(F.col("__e.q") * F.col("__total").cast("double")), F.col("__total") - 1).cast("bigint")
    return each.select(*by, F.col("__e.name").alias("__q"), "__total", rank.alias("__rank"), "__d0", "__n")


def _first_two(hist: DataFrame, by: list[str], quantiles: dict[str, float], digits: tuple[int, ...]) -> DataFrame:
    """(by, __q, __total, __rank, __prefix) after two digits."""
    first = hist.groupBy(*by, "__d0").agg(F.sum("__n").alias("__n"))
    at0 = _select(_ranks(first, by, quantiles), by, "__d0")
    second = null_safe(hist.select(*by, "__d0", "__d1", "__n"), at0, [*by, "__d0"])
    second = second.groupBy(*by, "__q", "__d0", "__d1").agg(
        F.sum("__n").alias("__n"), F.max("__total").alias("__total"), F.max("__rank").alias("__rank"),
    )
    at1 = _select(second, by, "__d1")
    return at1.select(*by, "__q", "__total", "__rank", (F.shiftleft(F.col("__d0"), digits[1]) + F.col("__d1")).alias("__prefix"))


def _wide(at: DataFrame, by: list[str], quantiles: dict[str, float], columns: dict[str, Column]) -> DataFrame:
    aggs = [F.max("__total").alias("n")]
    for q in quantiles:
        aggs += [F.max(F.when(F.col("__q") == q, c)).alias(q + suffix) for suffix, c in columns.items()]
    return at.groupBy(*by).agg(*aggs)


def percentiles_from_histogram(
    hist: DataFrame, by: list[str], quantiles: dict[str, float] | None = None, digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """From the histograms of any parts, added up: (by..., n, and for each quantile its
    estimate, low and high bound: NAME, NAME_low, NAME_high).  The true value is in
    [low, high]; the estimate is the middle, within relative_error(digits, 2)."""
    quantiles = quantiles or QUANTILES
    rest = 64 - sum(digits[:2])
    at = _first_two(hist, by, quantiles, digits)
    at = at.withColumn("__low", key_value(F.shiftleft(F.col("__prefix"), rest)))
    at = at.withColumn("__high", key_value(F.shiftleft(F.col("__prefix"), rest) + F.lit((1 << rest) - 1)))
    mid = F.col("__low") + (F.col("__high") - F.col("__low")) / 2
    mid = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(mid)
    return _wide(at, by, quantiles, {"": mid, "_low": F.col("__low"), "_high": F.col("__high")})


def radix_percentiles(
    df: DataFrame,
    by: list[str],
    value: str,
    quantiles: dict[str, float] | None = None,
    weight: str | None = None,
    least: float | None = None,
    digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """Exact percentiles v[floor(q * n)] of the sorted values: (by..., n, NAME...)."""
    quantiles = quantiles or QUANTILES
    x = F.col(value).cast("double")
    w = F.col(weight) if weight else F.lit(1)
    keys = df.filter(usable(x, least)).select(*by, order_key(x).alias("__k"), w.cast("bigint").alias("__w"))
    first = keys.groupBy(*by, _digit(F.col("__k"), digits, 0).alias("__d0")).agg(F.sum("__w").alias("__n"))
    at = _select(_ranks(first, by, quantiles), by, "__d0").withColumnRenamed("__d0", "__prefix")
    for level in range(1, len(digits)):
        # of the rows, only those that share the digits found so far go on; they are written while they are many
        same = keys.withColumn("__prefix", _prefix(F.col("__k"), digits, level))
        keys = null_safe(same, at.select(*by, "__prefix").distinct(), [*by, "__prefix"]).groupBy(*by, "__k").agg(F.sum("__w").alias("__w"))
        keys = cut(keys) if level == 1 else keys
        rows = keys.groupBy(
            *by, _prefix(F.col("__k"), digits, level).alias("__prefix"), _digit(F.col("__k"), digits, level).alias("__d"),
        ).agg(F.sum("__w").alias("__n"))
        chosen = _select(null_safe(rows, at, [*by, "__prefix"]), by, "__d")
        at = chosen.select(*by, "__q", "__total", "__rank", (F.shiftleft(F.col("__prefix"), digits[level]) + F.col("__d")).alias("__prefix"))
        at = cut(at) if level < len(digits) - 1 else at  # a row per group and quantile
    return _wide(at, by, quantiles, {"": key_value(F.col("__prefix"))})


GROUP = ["run_id", "option_name", "workload"]


def latency_observations(routes: DataFrame) -> DataFrame:
    """One row per request and latency: (run_id, option_name, workload, day, latency_ms, w).  A
    request delivered again repeats its latency and the time it was requested at, so it counts once
    on the day of that time, however late it is delivered: the observations of a day come from that
    day's rows alone, and its histogram is made once and kept.  A row without a request_id can
    repeat no other, so each such row counts."""
    rows = routes.filter(usable(F.col("latency_ms"), 0.0)).withColumn("day", F.to_date("requested_at"))
    one = rows.groupBy("day", "request_id", *GROUP, "latency_ms").agg(F.count(F.lit(1)).alias("rows"))
    return one.select(*GROUP, "day", "latency_ms", F.when(F.col("request_id").isNull(), F.col("rows")).otherwise(1).alias("w"))


def latency_percentiles(routes: DataFrame) -> DataFrame:
    """Exact n, median and p95 per run, option and workload."""
    return radix_percentiles(cut(latency_observations(routes).drop("day")), GROUP, "latency_ms", weight="w", least=0.0)


def daily_histograms(routes: DataFrame) -> DataFrame:
    return radix_histogram(latency_observations(routes), GROUP, "latency_ms", part=["day"], weight="w", least=0.0)


def wrong_reports(routes: DataFrame, evals: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Groups with a reported median or p95 that is off the true value by more than ``tolerance``
    of it.  True values are combined from daily histograms; their relative error is 2**-13."""
    true = percentiles_from_histogram(daily_histograms(routes), GROUP)
    said = evals.select(
        *GROUP, F.col("latency_ms_median").alias("__m"), F.col("latency_ms_p95").alias("__p"),
    ).filter(usable(F.col("__m"), None) | usable(F.col("__p"), None))
    both = null_safe(said, true, GROUP)
    off = lambda r, t: F.coalesce(usable(F.col(r), None) & (F.abs(F.col(r) - F.col(t)) > tolerance * F.abs(F.col(t))), F.lit(False))
    return both.filter(off("__m", "median") | off("__p", "p95")).select(*GROUP).distinct()
