"""Validation pixels by hexagon and year, and validation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.functions.aggregates import weighted_mean
from hexgale.functions.scalar import safe_ratio
from hexgale.operators.ordered import MAX_GROUP, finite, quantiles

# Agent codes of the disturbance map and the column each is counted in.
AGENTS = {1: "wind_bark", 2: "fire", 3: "harvest", 4: "mixed"}
PIXEL_KM2 = 0.0009
MIN_PIXELS = 10


def _agent_counts(disturbed: Column, agent: Column) -> list[Column]:
    return [F.count_if(disturbed & (agent == code)).alias(f"disturbed_px_agent_{name}") for code, name in AGENTS.items()]


def annual_stack_counts(pixels: DataFrame, keys: Sequence[str] = ("hex_id", "year")) -> DataFrame:
    """Yearly 0/1 layers: only 0 and 1 are valid forest pixels, agents counted by code."""
    v, agent = F.col("disturbed"), F.col("agent")
    valid = v.isin(0, 1)
    return pixels.where(valid).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_px"), F.count_if(v == 1).alias("disturbed_px_all"), *_agent_counts(v == 1, agent)
    )


def annual_binary_counts(pixels: DataFrame, keys: Sequence[str] = ("hex_id", "year")) -> DataFrame:
    """One layer per year: every pixel with a value is valid, positive ones are disturbed, no agents."""
    v = F.col("disturbed")
    zero = [F.lit(0).cast("long").alias(f"disturbed_px_agent_{n}") for n in AGENTS.values()]
    return (
        pixels.where(v.isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("valid_px"), F.count_if(v > 0).alias("disturbed_px_all"))
        .select("*", *zero)
    )


def year_coded_counts(pixels: DataFrame, years: Sequence[int], *, value: str = "year_value") -> DataFrame:
    """One layer with the disturbance year: valid pixels repeat for every year.

    Pixels are counted per hexagon and code first, so repeating concerns hexagons and not pixels.
    """
    v = F.col(value)
    coded = pixels.where(v.isNotNull()).groupBy("hex_id", v.cast("int").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    valid = coded.groupBy("hex_id").agg(F.sum("_n").alias("valid_px"))
    grid = valid.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    hits = coded.select("hex_id", F.col("_y").alias("year"), F.col("_n").alias("disturbed_px_all"))
    zero = [F.lit(0).cast("long").alias(f"disturbed_px_agent_{n}") for n in AGENTS.values()]
    return (
        grid.join(hits, ["hex_id", "year"], "left")
        .withColumn("disturbed_px_all", F.coalesce("disturbed_px_all", F.lit(0)))
        .select("hex_id", "year", "valid_px", "disturbed_px_all", *zero)
    )


def sum_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Add the counts of several layouts or files (G1)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    measures = [c for c in out.columns if c not in ("hex_id", "year")]
    return out.groupBy("hex_id", "year").agg(*[F.sum(c).alias(c) for c in measures])


def zonal_rates(counts: DataFrame, pixel_km2: float = PIXEL_KM2, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Counts to km2 and rates; hexagon-years below the minimum of valid pixels dropped."""
    out = counts.where(F.col("valid_px") >= min_pixels).withColumn("forest_area_km2", F.col("valid_px") * pixel_km2)
    for suffix in ["all", *[f"agent_{n}" for n in AGENTS.values()]]:
        px = F.col(f"disturbed_px_{suffix}")
        out = out.withColumns(
            {f"disturbed_area_km2_{suffix}": px * pixel_km2, f"disturbance_rate_{suffix}": px / F.col("valid_px")}
        )
    return out


def validation_hex_year(
    df: DataFrame, *, area: str | None = None, pixels: str | None = None, rate: str | None = None,
    forest: str | None = None, valid_pixels: str | None = None, first_year: int, last_year: int, pixel_km2: float = PIXEL_KM2,
) -> DataFrame:
    """Forest area, disturbed area and rate of each hexagon-year from whichever columns exist."""
    if forest:
        forest_area = F.col(forest).cast("double")
    elif valid_pixels:
        forest_area = F.col(valid_pixels).cast("double") * pixel_km2
    else:
        raise ValueError("forest area or valid pixels required")
    work = df.where(F.col("year").between(first_year, last_year)).withColumn("_fa", forest_area)
    if area:
        hit = F.col(area).cast("double")
    elif pixels:
        hit = F.col(pixels).cast("double") * pixel_km2
    elif rate:
        hit = F.col(rate).cast("double") * F.col("_fa")
    else:
        raise ValueError("disturbed area, pixels or rate required")
    annual = F.col(rate).cast("double") if rate else F.when(F.col("_fa") > 0, F.try_divide(hit, F.col("_fa")))
    return work.select(
        F.col("hex_id"), F.col("year"), F.col("_fa").alias("forest_area_km2"), hit.alias("area_km2"), annual.alias("rate_annual")
    )


def validation_rollup(df: DataFrame, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Hexagon totals over the years: median forest area, sums, mean rate, distinct years, overall rate."""
    yearly = df.groupBy("hex_id", "year").agg(
        F.sum("forest_area_km2").alias("_f"), F.sum("area_km2").alias("_a"),
        F.sum("rate_annual").alias("_r"), F.count("rate_annual").alias("_rn"),
    )
    base = yearly.groupBy("hex_id").agg(
        F.sum("_f").alias("forest_area_km2_years"),
        F.sum("_a").alias("efda_wind_bark_area_km2_total"),
        F.try_divide(F.sum("_r"), F.sum("_rn")).alias("efda_wind_bark_rate_annual_mean"),
        F.count(F.lit(1)).alias("n_years"),
    )
    out = base.join(quantiles(df, ["hex_id"], "forest_area_km2", {"forest_area_km2": 0.5}, max_group=max_group), "hex_id", "left")
    total = F.col("forest_area_km2_years")
    rate = F.when(total > 0, F.try_divide(F.col("efda_wind_bark_area_km2_total"), total))
    return out.withColumn("efda_wind_bark_mean_annual_rate", rate)


def value_deciles(df: DataFrame, value: str, n: int = 10, name: str = "decile", *, max_group: int = MAX_GROUP) -> DataFrame:
    """Right-closed bins between value quantiles; equal edges merge, so ties may give fewer bins."""
    known = df.where(finite(value))
    probs = {f"e{i}": i / n for i in range(n + 1)}
    edges = quantiles(known, [], value, probs, max_group=max_group).select(F.array_distinct(F.array(*probs)).alias("e")).scalar()
    v = F.col(value).cast("double")
    # Inner edges below the value; after merging there may be fewer than n - 1 of them.
    below = [F.when((F.lit(i) <= F.size(edges) - 2) & (F.get(edges, F.lit(i)) < v), 1).otherwise(0) for i in range(1, n)]
    number = sum(below, F.lit(1))
    return df.withColumn(name, F.when(finite(value), number))


def decile_validation(df: DataFrame, metric: str, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Count, forest area, mean prediction and disturbance rate per prediction decile."""
    binned = value_deciles(df, metric, name="decile", max_group=max_group).where(F.col("decile").isNotNull())
    forest, hit = F.sum("forest_area_km2"), F.sum("efda_wind_bark_area_km2_total")
    out = binned.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n_hex"),
        forest.alias("forest_area_km2"),
        weighted_mean(F.col(metric).cast("double"), F.col("forest_area_km2").cast("double")).alias("mean_prediction"),
        hit.alias("efda_wind_bark_area_km2_total"),
        safe_ratio(hit, forest).alias("efda_wind_bark_mean_annual_rate"),
    )
    return out.withColumns(
        {
            "prediction_metric": F.lit(metric),
            "efda_wind_bark_mean_annual_rate_percent": F.col("efda_wind_bark_mean_annual_rate") * 100,
        }
    )


def decile_contrast(summary: DataFrame) -> DataFrame:
    """Rates of the lowest and highest decile and their ratio."""
    rate = F.col("efda_wind_bark_mean_annual_rate")
    out = summary.groupBy("prediction_metric").agg(
        F.min_by(rate, "decile").alias("lowest_decile_rate"),
        F.max_by(rate, "decile").alias("highest_decile_rate"),
        F.sum("n_hex").alias("n_hex"),
    )
    return out.withColumn("highest_vs_lowest_decile_ratio", safe_ratio(F.col("highest_decile_rate"), F.col("lowest_decile_rate")))
