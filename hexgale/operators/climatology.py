"""Climatology, standardised anomalies and anomaly events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.operators.ordered import MAX_GROUP, ordinal_index, quantiles
from hexgale.operators.profile import timing_from_profile

STD_FLOOR = 1.0
Z_EVENT = 2.0
MIN_TIMING_EVENTS = 3


def climatology(
    df: DataFrame, keys: Sequence[str], value: str, *, floor: float = STD_FLOOR, max_group: int = MAX_GROUP
) -> DataFrame:
    """Per-cell maximum, q95, mean and floored population std."""
    stats = moments(df, keys, value, floor=floor)
    return stats.join(quantiles(df, keys, value, {"q95": 0.95}, max_group=max_group), list(keys), "left")


def moments(df: DataFrame, keys: Sequence[str], value: str, *, floor: float = STD_FLOOR) -> DataFrame:
    """Mean, population std, floored std, maximum and count per key; pass (cell, month) for D16."""
    return df.groupBy(*keys).agg(
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("std_value"),
        F.greatest(F.stddev_pop(value), F.lit(float(floor))).alias("std_safe"),
        F.count(value).alias("n_values"),
    )


def grid_z(df: DataFrame, keys: Sequence[str], value: str, *, floor: float = STD_FLOOR) -> DataFrame:
    """Grid z-score: population std with a floor.

    The statistics have one row per key. Spark broadcasts them while they are small and otherwise
    splits a skewed cell across tasks in the sort-merge join.
    """
    stats = moments(df, keys, value, floor=floor).select(*keys, "mean_value", "std_safe")
    return df.join(stats, list(keys)).withColumn("z", (F.col(value) - F.col("mean_value")) / F.col("std_safe"))


def hex_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Hex z-score: sample std without floor, NULL where the std is 0 or undefined."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return (
        df.join(stats, list(keys))
        .withColumn("z", F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd")))
        .drop("_mu", "_sd")
    )


def span_years(df: DataFrame, day: str) -> Column:
    """Length of the record in years of 365.25 days, a scalar-subquery column."""
    days = F.date_diff(F.max(day), F.min(day))
    return df.agg(F.nullif(days / F.lit(365.25), F.lit(0.0)).alias("years")).scalar()


def anomaly_events(
    df: DataFrame,
    cell: Sequence[str],
    day: str,
    value: str,
    *,
    same_month: bool = False,
    threshold: float = Z_EVENT,
    floor: float = STD_FLOOR,
) -> DataFrame:
    """Strongest anomaly, event count (z > threshold) and events per year of each cell."""
    work = df.withColumn("month", F.month(day))
    keys = [*cell, "month"] if same_month else list(cell)
    z = grid_z(work, keys, value, floor=floor)
    return (
        z.groupBy(*cell)
        .agg(F.max("z").alias("max_z"), F.count_if(F.col("z") > threshold).alias("n_events"))
        .withColumn("events_per_year", F.col("n_events") / span_years(df, day))
    )


def event_timing(
    df: DataFrame,
    cell: str,
    day: str,
    value: str,
    *,
    same_month: bool = False,
    threshold: float = Z_EVENT,
    floor: float = STD_FLOOR,
    min_count: int = MIN_TIMING_EVENTS,
) -> DataFrame:
    """Monthly timing of anomaly events, masked below ``min_count`` events."""
    work = df.withColumn("month", F.month(day))
    z = grid_z(work, [cell, "month"] if same_month else [cell], value, floor=floor)
    monthly = z.groupBy(cell, "month").agg(F.count_if(F.col("z") > threshold).cast("double").alias("n"))
    timing = timing_from_profile(monthly, cell, "month", "n")
    enough = F.col("total") >= min_count
    return timing.select(
        cell,
        F.col("total").cast("long").alias("n_events"),
        F.when(enough, F.col("peak_month")).alias("peak_month"),
        F.when(enough, F.col("peak_share")).alias("peak_share"),
        F.when(enough, F.col("effective_months")).alias("effective_months"),
    )


def contrast_score(
    df: DataFrame, key: str, intensity: str, frequency: str, *, max_group: int = MAX_GROUP
) -> DataFrame:
    """Ordinal percentile ranks (0-1) of two columns and their difference."""
    i = ordinal_percentile(df, intensity, key, name="pct_intensity", max_group=max_group)
    both = ordinal_percentile(i, frequency, key, name="pct_frequency", max_group=max_group)
    return both.withColumn("score", F.col("pct_intensity") - F.col("pct_frequency"))


def ordinal_percentile(
    df: DataFrame, value: str, tie: str, *, name: str = "pct", max_group: int = MAX_GROUP
) -> DataFrame:
    """(position - 1) / (n - 1) among the rows with a value, ties ordered by ``tie``."""
    known = df.where(F.col(value).isNotNull())
    n = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ordinal_index(known, [], value, tie, name="_i", max_group=max_group)
    out = ranked.withColumn(name, (F.col("_i") - 1) / F.greatest(n - F.lit(1), F.lit(1))).drop("_i")
    missing = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
    return out.unionByName(missing)


def background_overlay(long_term: DataFrame, same_month: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Intensity and frequency of both backgrounds in one long table."""

    def pick(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *cell,
            F.lit(name).alias("background"),
            F.col("max_z").cast("float").alias("z_value"),
            F.col("events_per_year").cast("float").alias("freq_value"),
        )

    return pick(long_term, "long_term").unionByName(pick(same_month, "same_month"))


def month_anomaly_profile(
    df: DataFrame, cell: str, day: str, z: str, *, threshold: float = Z_EVENT, sampled: bool = False
) -> DataFrame:
    """Share of events (z >= threshold) and mean positive z per cell and month.

    ``sampled=True`` is for z-scores computed from sampled values: an undefined z then counts as no event
    in the frequency and is skipped in the intensity (T3). Otherwise undefined rows are dropped first.
    """
    work = df.withColumn("month", F.month(day))
    if not sampled:
        work = work.where(F.col(z).isNotNull())
    event = F.when(F.col(z) >= threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    positive = F.when(F.col(z).isNotNull(), F.greatest(F.col(z), F.lit(0.0)))
    return work.groupBy(cell, "month").agg(
        F.avg(event).alias("anomaly_frequency"),
        F.avg(positive).alias("anomaly_intensity"),
        F.count(z).alias("n_anomaly_periods"),
    )
