"""Cell-period scores rolled up to hexagon indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexgale.functions.scalar import is_winter
from hexgale.operators.ordered import MAX_GROUP, finite, quantiles, scalar_quantile, settle

ACTIVE_QUANTILE = 0.95
MIN_VALID_PERIODS = 10


def weighted_cell_period_mean(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, *, name: str = "mean_pred", as_float: bool = True
) -> DataFrame:
    """Weighted mean per hexagon and period, kept as 32-bit float (D5, T9); a missing value has no weight."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    mean = F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(known))
    return df.groupBy(*keys).agg(
        (mean.cast("float") if as_float else mean).alias(name), F.sum(weight).alias("total_weight")
    )


def active_flags(
    df: DataFrame, value: str, q: float = ACTIVE_QUANTILE, *, max_group: int = MAX_GROUP
) -> DataFrame:
    """Global quantile threshold over all rows and the 0/1 flag of rows at or above it."""
    threshold = scalar_quantile(df, value, q, max_group=max_group)
    return df.withColumn("active_threshold", threshold).withColumn(
        "active_period", (F.col(value).cast("double") >= F.col("active_threshold")).cast("int")
    )


def cell_distribution(
    df: DataFrame,
    cell: str,
    value: str,
    active: str,
    area: str,
    severity: str | None = None,
    *,
    min_periods: int = MIN_VALID_PERIODS,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Mean, p95, active share, severity while active, counts and masks per hexagon."""
    df = settle(df)
    sev = F.avg(F.when(F.col(active) == 1, F.col(severity))) if severity else F.lit(None).cast("double")
    base = df.groupBy(cell).agg(
        F.max(area).cast("double").alias("forest_area_km2"),
        F.avg(F.col(value).cast("double")).alias("mean_pred_disturbance"),
        F.avg(F.col(active).cast("double")).alias("active_share_q"),
        sev.alias("severity_cond"),
        F.count(value).alias("valid_periods"),
        F.sum(F.col(active).cast("long")).alias("active_periods"),
    )
    p95 = quantiles(df, [cell], value, {"pred_p95": 0.95}, max_group=max_group)
    full = base.join(p95, cell, "left").withColumns(
        {"mask_forest": F.col("forest_area_km2") > 0, "mask_valid_periods": F.col("valid_periods") >= min_periods}
    )
    for c in ["mean_pred_disturbance", "pred_p95", "active_share_q", "severity_cond"]:
        full = full.withColumn(c, F.when(F.col("mask_valid_periods"), F.col(c)))
    return full.withColumn("mask_sev_zero", F.col("mask_forest") & F.col("severity_cond").isNull())


def indicator_suite(
    df: DataFrame,
    cell: str,
    day: str,
    value: str,
    q: float = ACTIVE_QUANTILE,
    *,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """How high, how often and when the prediction of each hexagon is high.

    Hexagons that are never active get 0 for the conditional measures (T10).
    """
    valid = settle(df.select(cell, day, F.col(value).cast("double").alias("_p")).where(finite("_p")))
    flagged = valid.withColumn("_thr", scalar_quantile(valid, "_p", q, max_group=max_group)).withColumn(
        "_on", F.col("_p") >= F.col("_thr")
    )
    on = F.col("_on")
    # Two levels: cell-years first, so that distinct years are plain counts and nothing is expanded.
    yearly = flagged.groupBy(cell, F.year(day).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_p").alias("_s"),
        F.max("_p").alias("_m"),
        F.count_if(on).alias("_on_n"),
        F.sum(F.when(on, F.col("_p"))).alias("_on_s"),
        F.count_if(on & is_winter(F.col(day))).alias("_on_w"),
        F.max("_thr").alias("_thr"),
    )
    active_n = F.sum("_on_n")
    base = yearly.groupBy(cell).agg(
        F.sum("_n").alias("n_periods"),
        (F.sum("_s") / F.sum("_n")).alias("mean_pred_prob"),
        F.max("_m").alias("max_pred_prob"),
        active_n.alias("active_n"),
        F.coalesce(F.try_divide(F.sum("_on_s"), active_n), F.lit(0.0)).alias("conditional_intensity"),
        F.max("_thr").alias("active_threshold_used"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("_y").isNotNull() & (F.col("_on_n") > 0)), F.count("_y")), F.lit(0.0)
        ).alias("active_year_prop_q95"),
        F.coalesce(F.try_divide(F.sum("_on_w"), active_n), F.lit(0.0)).alias("winter_share_q95"),
    )
    tails = quantiles(flagged, [cell], "_p", {"p95_pred_prob": 0.95, "p99_pred_prob": 0.99}, max_group=max_group)
    active_tail = quantiles(flagged.where(on), [cell], "_p", {"conditional_p95": 0.95}, max_group=max_group)
    return (
        base.join(tails, cell)
        .join(active_tail, cell, "left")
        .withColumn("conditional_p95", F.coalesce(F.col("conditional_p95"), F.lit(0.0)))
        .withColumn("recurrence_index", F.col("active_n") / F.greatest(F.col("n_periods"), F.lit(1)))
    )


def prediction_rollup(
    df: DataFrame, cell: str, day: str, value: str, first_year: int, last_year: int, *, max_group: int = MAX_GROUP
) -> DataFrame:
    """Long-term mean, p95, maximum and count per hexagon in a year range."""
    work = settle(df.where(F.col(day).isNotNull() & F.year(day).between(first_year, last_year)))
    base = work.groupBy(cell).agg(
        F.avg(value).alias("pred_mean_long"), F.max(value).alias("pred_max_long"), F.count(value).alias("n_periods")
    )
    return base.join(quantiles(work, [cell], value, {"pred_p95_long": 0.95}, max_group=max_group), cell, "left")


def forest_flag(df: DataFrame, area: str | None, fraction: str | None, min_fraction: float = 0.0) -> DataFrame:
    """Forest-presence mask from area and/or fraction."""
    ok = F.lit(True)
    if area:
        ok = ok & (F.coalesce(F.col(area), F.lit(0.0)) > 0)
    if fraction:
        ok = ok & (F.coalesce(F.col(fraction), F.lit(0.0)) >= min_fraction)
    return df.withColumn("mask_forest", ok)


def attach_geometry(df: DataFrame, cell: str, sources: Sequence[DataFrame | None]) -> DataFrame:
    """Left join onto the first available geometry table; hexagons without values are not forest."""
    geometry = next((g for g in sources if g is not None), None)
    if geometry is None:
        raise ValueError("no geometry source")
    out = geometry.dropDuplicates([cell]).join(df, cell, "left")
    return out.withColumn("mask_forest", F.coalesce(F.col("mask_forest"), F.lit(False)))
