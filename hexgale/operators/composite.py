"""Period composites of high-frequency observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexgale.functions.scalar import nan_to_null, wind_from_direction
from hexgale.operators.ordered import MAX_GROUP, chunk_series, quantiles

PERIOD_DAYS = 16


def period_number(day: Column, origin: str, days: int = PERIOD_DAYS) -> Column:
    """Number of the period a day falls in, counted from an origin date (H14d)."""
    return F.floor(F.date_diff(day, F.lit(origin).cast("date")) / F.lit(days)).cast("int")


def period_start(number: Column, origin: str, days: int = PERIOD_DAYS) -> Column:
    return F.date_add(F.lit(origin).cast("date"), (number * F.lit(days)).cast("int"))


def chunk_calendar(spark: SparkSession, start: str, end: str, days: int = PERIOD_DAYS) -> DataFrame:
    """Consecutive periods between two dates, the last one clipped."""
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))
    return (
        spark.range(1)
        .select(F.posexplode(dates).alias("period_no", "chunk_start"))
        .withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")))
    )


def chunk_calendar_of(df: DataFrame, day: str, days: int = PERIOD_DAYS) -> DataFrame:
    """Chunk calendar over the date range of a table."""
    bounds = df.agg(F.min(day).alias("_s"), F.max(day).alias("_e"))
    return (
        bounds.select(
            F.posexplode(F.sequence("_s", "_e", F.expr(f"interval {days} days"))).alias("period_no", "chunk_start"), "_e"
        )
        .select("period_no", "chunk_start", F.least(F.date_add("chunk_start", days - 1), F.col("_e")).alias("chunk_end"))
    )


def align_inner(left: DataFrame, right: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """Keep the coordinates both cubes have (C4)."""
    return left.join(right, list(coordinates), "inner")


def period_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Maximum per cell and period; cells and periods without any value are dropped."""
    return (
        df.groupBy(*keys)
        .agg(F.max(nan_to_null(F.col(value))).alias("max_value"), F.count(nan_to_null(F.col(value))).alias("n_values"))
        .where(F.col("n_values") > 0)
    )


def period_median(df: DataFrame, keys: Sequence[str], value: str, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Median composite (D3)."""
    return quantiles(df, keys, value, {"median_value": 0.5}, max_group=max_group)


def value_at_peak(
    df: DataFrame, keys: Sequence[str], value: str, time: str, carried: Sequence[str], ties: Sequence[str] = ()
) -> DataFrame:
    """Other columns at the time of the maximum: earliest time wins, then ``ties`` ascending.

    ``max_by`` over an ordering struct is a normal aggregate, so a hot cell is combined map-side and no
    group is sorted. The second step resolves ties among the few rows of the peak time.
    """
    x = nan_to_null(F.col(value))
    known = df.where(x.isNotNull())
    epoch = -F.unix_micros(F.col(time).cast("timestamp"))
    order = F.struct(x.alias("v"), epoch.alias("t"), *[(-F.col(c)).alias(f"k{i}") for i, c in enumerate(ties)])
    payload = F.struct(F.col(value), F.col(time), *[F.col(c) for c in carried])
    return (
        known.groupBy(*keys)
        .agg(F.max_by(payload, order).alias("_p"))
        .select(*keys, F.col(f"_p.{value}").alias("peak_value"), F.col(f"_p.{time}").alias("peak_time"),
                *[F.col(f"_p.{c}").alias(c) for c in carried])
    )


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    half: int = 1,
    suffix: str = "_smooth",
    ties: Sequence[str] = (),
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Centred rolling mean over 2*half+1 rows, one valid value is enough (E1); ``ties`` order equal times."""
    parts, _ = chunk_series(df, keys, order, back=half, ahead=half, ties=ties, max_group=max_group)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties).rowsBetween(-half, half)
    return (
        parts.withColumns({f"{v}{suffix}": F.avg(nan_to_null(F.col(v))).over(w) for v in values})
        .where("_home")
        .drop("_chunk", "_home")
    )


def wind_composite(
    obs: DataFrame,
    keys: Sequence[str],
    *,
    time: str = "ts",
    gust: str = "fg10",
    u: str = "u10",
    v: str = "v10",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Peak gust per cell and period and the smoothed wind direction at its time (D1, D2, E1, H1m)."""
    timed = obs.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    # Equal times are ordered by the values, so that the result does not hang on the partitioning.
    smooth = rolling_mean(timed, keys, "_t", [u, v], ties=[gust, u, v], max_group=max_group)
    peak = value_at_peak(smooth, keys, gust, time, [f"{u}_smooth", f"{v}_smooth"])
    return peak.select(
        *keys,
        F.col("peak_value").cast("float").alias("max_wind_speed"),
        wind_from_direction(F.col(f"{u}_smooth"), F.col(f"{v}_smooth")).cast("float").alias("wind_direction"),
        "peak_time",
    )
