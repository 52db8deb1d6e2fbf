"""Monthly profiles and timing metrics (C3, D9-D14, D21, E7, H4m-H7m)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.functions.scalar import MONTHS, circular_month_distance, clip, month_name
from hexgale.operators.ordered import MAX_GROUP, column_quantiles, finite, quantiles, settle


def dense_grid(df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[int], fill: Sequence[str]) -> DataFrame:
    """Every key with every value of a fixed axis, missing measures as 0.

    The axis is a literal list, so the completion is one ``explode`` per key, not a join of two tables.
    """
    full = df.select(*keys).distinct().withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    return full.join(df, [*keys, axis], "left").fillna(0, subset=list(fill))


def clip_counts(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """How many values lie outside the range."""
    return df.agg(
        F.count_if(F.col(value) < low).alias("n_below"),
        F.count_if(F.col(value) > high).alias("n_above"),
        F.count(value).alias("n_values"),
    )


def prepared_predictions(
    df: DataFrame, day: str, value: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Valid rows with clipped prediction, year and month in a year range."""
    out = df.where(F.col(day).isNotNull() & finite(value)).withColumns(
        {value: clip(F.col(value).cast("double"), 0.0, 1.0), "year": F.year(day), "month": F.month(day)}
    )
    if first_year is not None:
        out = out.where(F.col("year") >= first_year)
    if last_year is not None:
        out = out.where(F.col("year") <= last_year)
    return out


def cell_totals(
    df: DataFrame, cell: str, value: str, active: str | None = None, *, max_group: int = MAX_GROUP
) -> DataFrame:
    """Mass, mean, median, maximum and count per cell, and its active periods."""
    df = settle(df)
    aggs = [
        F.sum(value).alias("total_pred_mass"),
        F.avg(value).alias("mean_pred_longterm"),
        F.max(value).alias("max_pred"),
        F.count(F.lit(1)).alias("n_periods"),
    ]
    if active:
        aggs += [F.sum(F.col(active).cast("long")).alias("n_active_periods"),
                 F.avg(F.col(active).cast("double")).alias("active_fraction")]
    else:
        aggs += [F.count(F.lit(1)).alias("n_active_periods"), F.lit(1.0).alias("active_fraction")]
    medians = quantiles(df, [cell], value, {"median_pred_longterm": 0.5}, max_group=max_group)
    return df.groupBy(cell).agg(*aggs).join(medians, cell, "left")


def month_profile(df: DataFrame, cell: str, value: str, basis: str = "mean") -> DataFrame:
    """Dense cell x month table with mass, mean, count and both shares."""
    if basis not in ("mean", "sum"):
        raise ValueError("basis must be 'mean' or 'sum'")
    monthly = df.groupBy(cell, "month").agg(
        F.sum(value).alias("monthly_pred_sum"),
        F.avg(value).alias("monthly_pred_mean"),
        F.count(F.lit(1)).alias("n_periods_month"),
    )
    measures = ["monthly_pred_sum", "monthly_pred_mean", "n_periods_month"]
    dense = dense_grid(monthly, [cell], "month", MONTHS, measures)
    # At most 12 rows per cell from here on.
    per_cell = Window.partitionBy(cell)
    dense = dense.withColumns(
        {
            "total_pred_sum_by_months": F.sum("monthly_pred_sum").over(per_cell),
            "total_pred_mean_profile": F.sum("monthly_pred_mean").over(per_cell),
        }
    ).withColumns(
        {
            "monthly_mass_share": F.when(
                F.col("total_pred_sum_by_months") > 0, F.col("monthly_pred_sum") / F.col("total_pred_sum_by_months")
            ),
            "monthly_intensity_share": F.when(
                F.col("total_pred_mean_profile") > 0, F.col("monthly_pred_mean") / F.col("total_pred_mean_profile")
            ),
        }
    )
    share = "monthly_intensity_share" if basis == "mean" else "monthly_mass_share"
    return dense.withColumn("monthly_share", F.col(share))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value over its group total (E7): totals by aggregate and joined back, no window over the group."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return (
        df.join(totals, list(keys))
        .withColumn(name, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")))
        .drop("_total")
    )


def month_profile_wide(profile: DataFrame, cell: str) -> DataFrame:
    """One row per cell with 12 columns for share, mean and mass each."""
    aggs = []
    for m in MONTHS:
        at = F.col("month") == m
        aggs += [
            F.max(F.when(at, F.col("monthly_share"))).alias(f"m{m:02d}_share"),
            F.max(F.when(at, F.col("monthly_pred_mean"))).alias(f"m{m:02d}_mean_pred"),
            F.max(F.when(at, F.col("monthly_pred_sum"))).alias(f"m{m:02d}_sum_pred"),
        ]
    return profile.groupBy(cell).agg(*aggs)


def timing_from_profile(monthly: DataFrame, cell: str, month: str, value: str) -> DataFrame:
    """Timing metrics of a month profile in one aggregate (D12, D21, H4m, H5m, H7m).

    Missing and negative values count as 0 and absent months add nothing, so the profile need not be
    dense. The first month wins equal peaks. A profile without mass has NULL metrics.
    """
    v = F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    angle = F.lit(2 * math.pi / 12.0) * (F.col(month) - F.lit(1))
    sums = monthly.groupBy(cell).agg(
        F.sum(v).alias("total"),
        F.sum(v * v).alias("_sq"),
        F.sum(v * F.cos(angle)).alias("_c"),
        F.sum(v * F.sin(angle)).alias("_s"),
        F.max(F.struct(v.alias("v"), (-F.col(month)).alias("m"))).alias("_peak"),
    )
    t = F.col("total")
    has = t > 0
    hhi = F.col("_sq") / (t * t)
    r = F.hypot(F.col("_c"), F.col("_s")) / t
    angle_mean = F.atan2(F.col("_s"), F.col("_c"))
    angle_mean = F.when(angle_mean < 0, angle_mean + F.lit(2 * math.pi)).otherwise(angle_mean)
    return sums.select(
        cell,
        "total",
        F.when(has, -F.col("_peak.m")).cast("int").alias("peak_month"),
        F.when(has, F.col("_peak.v") / t).alias("peak_share"),
        F.when(has, hhi).alias("hhi"),
        F.when(has, F.lit(1.0) / hhi).alias("effective_months"),
        F.when(has & (r > 0), angle_mean / F.lit(2 * math.pi) * 12 + 1).alias("circular_mean_month"),
        F.when(has, r).alias("circular_concentration"),
    )


def timing_metrics(profile: DataFrame, cell: str, basis: str = "mean") -> DataFrame:
    """Full timing table of the month profile."""
    t = timing_from_profile(profile, cell, "month", "monthly_share")
    return t.select(
        cell,
        F.lit(basis).alias("profile_basis"),
        "peak_month",
        month_name(F.col("peak_month")).alias("peak_month_name"),
        F.col("peak_share").alias("peak_month_share"),
        F.col("hhi").alias("monthly_hhi"),
        "effective_months",
        "circular_mean_month",
        month_name(F.col("circular_mean_month")).alias("circular_mean_month_name"),
        "circular_concentration",
        circular_month_distance(F.col("peak_month"), F.col("circular_mean_month")).alias("peak_vs_circular_month_diff"),
        F.col("peak_month").isNotNull().cast("int").alias("peak_month_reliable"),
        F.col("peak_month").alias("peak_month_masked"),
    )


def cell_month_table(totals: DataFrame, wide: DataFrame, metrics: DataFrame, cell: str) -> DataFrame:
    """Totals, wide profile and timing metrics side by side."""
    return totals.join(wide, cell, "left").join(metrics, cell, "left")


def temporal_from_periods(df: DataFrame, cell: str, day: str, value: str, prefix: str = "pred") -> DataFrame:
    """Peak month, its share and effective months from period values."""
    monthly = (
        df.where(F.col(day).isNotNull() & finite(value))
        .groupBy(cell, F.month(day).alias("month"))
        .agg(F.avg(value).alias("v"))
    )
    return temporal_from_months(monthly, cell, "v", prefix)


def temporal_from_months(monthly: DataFrame, cell: str, value: str, prefix: str) -> DataFrame:
    t = timing_from_profile(monthly.where(F.col("month").between(1, 12)), cell, "month", value)
    return t.select(
        cell,
        F.col("peak_month").alias(f"{prefix}_peak_month"),
        F.col("peak_share").alias(f"{prefix}_peak_share"),
        F.col("effective_months").alias(f"{prefix}_effective_months"),
    )


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """n, mean, sd, five percentiles, minimum and maximum of several columns.

    Columns are summarised side by side in one row, which is then turned.
    """
    probs = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    values = {m: F.col(m).cast("double") for m in metrics}
    quantile = column_quantiles(df, metrics, probs)
    plain = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(v).alias(f"{m}_{k}") for m, v in values.items() for k, f in plain.items()])
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            *[F.col(f"{m}_{k}").alias(k) for k in plain],
            *[F.lit(quantile[m][p]).cast("double").alias(p) for p in probs],
        )
        for m in metrics
    ]
    return wide.select(F.explode(F.array(*rows)).alias("_m")).select("_m.*").where(F.col("n") > 0)


def category_frequency(df: DataFrame, column: str, domain: Sequence[int] = MONTHS) -> DataFrame:
    """Count and share over a fixed domain, absent categories as 0."""
    counts = df.where(F.col(column).isin(*domain)).groupBy().agg(
        *[F.count_if(F.col(column) == d).alias(f"c{d}") for d in domain]
    )
    total: Column = sum((F.col(f"c{d}") for d in domain), F.lit(0))
    rows = F.array(
        *[F.struct(F.lit(d).alias(column), F.col(f"c{d}").alias("n"), total.alias("_t")) for d in domain]
    )
    return counts.select(F.explode(rows).alias("r")).select(
        f"r.{column}",
        F.col("r.n").alias("n_hex"),
        month_name(F.col(f"r.{column}")).alias("month_name"),
        F.try_divide(F.col("r.n").cast("double"), F.col("r._t").cast("double")).alias("share_hex"),
    )
