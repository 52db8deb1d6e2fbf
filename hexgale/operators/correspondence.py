"""Timing correspondence and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.functions.aggregates import sum_if, weighted_mean, weighted_pearson
from hexgale.functions.scalar import circular_month_distance, month_angle, signed_month_shift
from hexgale.operators.ordered import MAX_GROUP, average_rank, finite, quantiles, weighted_quantiles
from hexgale.session import cut_lineage

# Fixed value: area of every analysed hexagon in the timing tables, km2.
HEX_AREA_KM2 = 2165.0

# Measures of the summary table.
SUMMARY_MEASURES = {
    "Peak-month difference": "circular_peak_month_difference",
    "Signed peak-month shift": "signed_peak_month_shift",
    "Prediction peak-month share": "pred_peak_share",
    "Wind-anomaly peak-month share": "wind_peak_share",
    "Peak-month share difference": "peak_month_share_difference",
    "Absolute peak-month share difference": "abs_peak_month_share_difference",
}

# Agreement classes (name, lowest and highest month distance, definition); they overlap.
AGREEMENT = [
    ("Same peak month", 0, 0, "Delta month = 0"),
    ("One-month offset", 1, 1, "Delta month = 1"),
    ("Two-month offset", 2, 2, "Delta month = 2"),
    ("Mismatched", 3, 6, "Delta month >= 3"),
    ("Exact alignment", 0, 0, "Delta month = 0"),
    ("Near alignment", 0, 1, "Delta month <= 1"),
    ("Broad alignment", 0, 2, "Delta month <= 2"),
    ("Timing mismatch", 3, 6, "Delta month >= 3"),
]


def derive_timing(df: DataFrame) -> DataFrame:
    """Distances and share differences of both peaks; invalid rows dropped (H6m, B6)."""
    share = F.col("pred_peak_share") - F.col("wind_peak_share")
    return df.withColumns(
        {
            "circular_peak_month_difference": circular_month_distance(F.col("pred_peak_month"), F.col("wind_peak_month")),
            "signed_peak_month_shift": signed_month_shift(F.col("pred_peak_month"), F.col("wind_peak_month")),
            "peak_month_share_difference": share,
            "abs_peak_month_share_difference": F.abs(share),
        }
    ).where(
        F.col("pred_peak_month").between(1, 12)
        & F.col("wind_peak_month").between(1, 12)
        & finite("pred_peak_share")
        & finite("wind_peak_share")
        & finite("area_weight_km2")
        & (F.col("area_weight_km2") > 0)
    )


def merged_timing(pred: DataFrame, wind: DataFrame, cell: str, area_km2: float = HEX_AREA_KM2) -> DataFrame:
    """Prediction and wind timing of the common hexagons with equal area weights."""
    both = pred.select(cell, "pred_peak_month", "pred_peak_share").join(
        wind.select(cell, "wind_peak_month", "wind_peak_share"), cell, "inner"
    )
    return derive_timing(both.withColumn("area_weight_km2", F.lit(float(area_km2))))


def correspondence_summary(df: DataFrame, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Weighted mean, median, p25 and p75 of six measures."""
    options = [
        F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("v")) for k, c in SUMMARY_MEASURES.items()
    ]
    long = df.select("area_weight_km2", F.explode(F.array(*options)).alias("_m")).select(
        "area_weight_km2", "_m.metric", "_m.v"
    )
    mean = long.groupBy("metric").agg(weighted_mean(F.col("v"), F.col("area_weight_km2")).alias("weighted_mean"))
    probs = {"weighted_median": 0.5, "weighted_p25": 0.25, "weighted_p75": 0.75}
    return mean.join(
        weighted_quantiles(long, ["metric"], "v", "area_weight_km2", probs, method="step", max_group=max_group), "metric"
    )


def agreement_classes(df: DataFrame) -> DataFrame:
    """Area and share of the overlapping agreement classes (D35): one aggregate, then stacked."""
    area, d = F.col("area_weight_km2"), F.col("circular_peak_month_difference")
    sums = df.agg(
        F.sum(area).alias("_total"),
        *[sum_if(area, d.between(lo, hi)).alias(f"_a{i}") for i, (_, lo, hi, _) in enumerate(AGREEMENT)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("agreement_class"),
                F.lit(definition).alias("definition"),
                F.col(f"_a{i}").alias("forest_area_km2"),
                (F.try_divide(F.col(f"_a{i}"), F.col("_total")) * 100).alias("forest_area_share_percent"),
            )
            for i, (name, _, _, definition) in enumerate(AGREEMENT)
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


# Gamma(z + 1/2) / Gamma(z) = sqrt(z) * (1 + c1 / z + c2 / z**2 + ...), good to 14 digits from z = 32 on.
GAMMA_RATIO = [-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304]


def _half_gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the series 32 places up, brought down by the recurrence of Gamma."""
    z = a + 32
    series = F.lit(GAMMA_RATIO[-1])
    for c in reversed([1.0, *GAMMA_RATIO[:-1]]):
        series = series / z + c
    places = F.sequence(F.lit(0), F.lit(31))
    return F.sqrt(z) * series * F.aggregate(places, F.lit(1.0), lambda p, k: p * (a + k) / (a + k + 0.5))


def correlation_p_value(rho: str, n: str) -> Column:
    """Two-sided p-value of a correlation over n rows, from Student's t with n - 2 degrees of freedom (L1, L2, L4).

    With x = 1 - rho**2 it is the regularised incomplete beta function I_x((n - 2) / 2, 1/2), evaluated by its continued
    fraction (modified Lentz steps in one array function) on the side where it converges fast. NULL below three rows.
    """
    r, a = F.col(rho), (F.col(n) - 2) / F.lit(2.0)
    y = r * r
    x = 1 - y
    plain = x < (a + 1) / (a + 2.5)
    at, p, q = F.when(plain, x).otherwise(y), F.when(plain, a).otherwise(0.5), F.when(plain, 0.5).otherwise(a)

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def step(state: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (q - m) * at / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * at / ((p + 2 * m) * (p + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        d = 1 / safe(1 + term * state["d"])
        c = safe(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    start = 1 / safe(1 - (p + q) * at / (p + 1))
    # Steps grow with the square root of the larger parameter.
    last = (2 * F.least(F.ceil(30 + 3 * F.sqrt(F.greatest(p, q))), F.lit(200_000)) + 1).cast("int")
    found = F.aggregate(F.sequence(F.lit(2), last), F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h")), step)["h"]
    front = F.pow(x, a) * F.sqrt(y) * _half_gamma_ratio(a) / math.sqrt(math.pi)
    tail = F.when(plain, front * found / a).otherwise(1 - front * found / 0.5)
    value = F.when(y >= 1, F.lit(0.0)).when(y == 0, F.lit(1.0)).otherwise(F.greatest(tail, F.lit(0.0)))
    return F.when(r.isNotNull() & ~F.isnan(r) & (F.col(n) > 2), value)


def spearman_grid(
    df: DataFrame, pairs: Sequence[tuple[str, str]], *, min_rows: int = 10, p_value: bool = False,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Spearman correlation of several column pairs, each over its own complete rows (L1)."""
    options = [
        F.struct(
            F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
            F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        )
        for x, y in pairs
    ]
    long = df.select(F.explode(F.array(*options)).alias("_p")).select("_p.*").where(finite("x") & finite("y"))
    keys = ["x_name", "y_name"]
    ranked = average_rank(long, keys, "x", name="rx", max_group=max_group)
    ranked = average_rank(ranked, keys, "y", name="ry", max_group=max_group)
    out = ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("rho", F.when((F.col("n") >= min_rows) & ~F.isnan("rho"), F.col("rho")))
    return out.withColumn("p_value", correlation_p_value("rho", "n")) if p_value else out


def partial_spearman(
    df: DataFrame, tests: Sequence[tuple[str, str, str]], *, min_rows: int = 20, p_value: bool = False,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Spearman correlation of rank residuals after regression on the rank of a control (L2)."""
    options = [
        F.struct(
            F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.lit(c).alias("control"),
            F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(c).cast("double").alias("c"),
        )
        for x, y, c in tests
    ]
    long = df.select(F.explode(F.array(*options)).alias("_p")).select("_p.*")
    # Ranked five times below, so materialised once.
    long = cut_lineage(long.where(finite("x") & finite("y") & finite("c")))
    keys = ["x_name", "y_name", "control"]
    for v in ("x", "y", "c"):
        long = average_rank(long, keys, v, name=f"r{v}", max_group=max_group)
    fits = long.groupBy(*keys).agg(
        F.regr_slope("rx", "rc").alias("bx"), F.regr_intercept("rx", "rc").alias("ax"),
        F.regr_slope("ry", "rc").alias("by"), F.regr_intercept("ry", "rc").alias("ay"),
    )
    res = long.join(F.broadcast(fits), keys).select(  # one row per test
        *keys,
        (F.col("rx") - F.col("ax") - F.col("bx") * F.col("rc")).alias("ex"),
        (F.col("ry") - F.col("ay") - F.col("by") * F.col("rc")).alias("ey"),
    )
    res = average_rank(res, keys, "ex", name="rex", max_group=max_group)
    res = average_rank(res, keys, "ey", name="rey", max_group=max_group)
    out = res.groupBy(*keys).agg(F.corr("rex", "rey").alias("rho"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("rho", F.when(F.col("n") >= min_rows, F.col("rho")))
    return out.withColumn("p_value", correlation_p_value("rho", "n")) if p_value else out


def weighted_correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str]], weight: str) -> DataFrame:
    """Weighted Pearson correlation per named pair (L3), about the plain means of both columns."""
    means = df.agg(*[F.avg(F.when(finite(c), F.col(c))).alias(c) for c in {c for pair in pairs.values() for c in pair}])

    def centre(c: str) -> Column:
        return F.coalesce(means.select(c).scalar(), F.lit(0.0))

    aggs = [
        weighted_pearson(F.col(x), F.col(y), F.col(weight), (centre(x), centre(y))).alias(f"_p{i}")
        for i, (x, y) in enumerate(pairs.values())
    ]
    row = df.agg(*aggs)
    items = F.array(
        *[F.struct(F.lit(n).alias("comparison"), F.col(f"_p{i}").alias("weighted_pearson")) for i, n in enumerate(pairs)]
    )
    return row.select(F.explode(items).alias("r")).select("r.*")


def timing_correlations(df: DataFrame, *, p_value: bool = False, max_group: int = MAX_GROUP) -> DataFrame:
    """Correlation of peak shares and of the circular components of the peak months (L1, L3, L4)."""
    p, w = month_angle(F.col("pred_peak_month")), month_angle(F.col("wind_peak_month"))
    # Rounded so that equal components tie exactly.
    parts = df.withColumns(
        {"pc": F.round(F.cos(p), 12), "wc": F.round(F.cos(w), 12), "ps": F.round(F.sin(p), 12), "ws": F.round(F.sin(w), 12)}
    )
    pairs = {
        "Prediction peak-month share vs wind-anomaly peak-month share": ("pred_peak_share", "wind_peak_share"),
        "Peak-month cosine component": ("pc", "wc"),
        "Peak-month sine component": ("ps", "ws"),
    }
    pearson = weighted_correlations(parts, pairs, "area_weight_km2")
    ranks = spearman_grid(parts, list(pairs.values()), min_rows=3, p_value=p_value, max_group=max_group)
    names = F.create_map(*[F.lit(v) for n, (x, _) in pairs.items() for v in (x, n)])
    ranks = ranks.withColumn("comparison", names[F.col("x_name")]).drop("x_name", "y_name")
    return pearson.join(ranks.withColumnRenamed("rho", "spearman_rho"), "comparison", "left")


def robust_limits(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, *, max_group: int = MAX_GROUP) -> DataFrame:
    """q02 and q98, minimum and maximum where those are practically equal, 0 and 1 without values."""
    q = quantiles(df, [], value, {"lo": low, "hi": high}, max_group=max_group)
    ends = df.where(finite(value)).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    lo, hi = q.select("lo").scalar(), q.select("hi").scalar()
    out = ends.withColumns({"lo": lo, "hi": hi})
    flat = F.abs(F.col("lo") - F.col("hi")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("hi"))
    return out.select(
        F.coalesce(F.when(flat, F.col("mn")).otherwise(F.col("lo")), F.lit(0.0)).alias("vmin"),
        F.coalesce(F.when(flat, F.col("mx")).otherwise(F.col("hi")), F.lit(1.0)).alias("vmax"),
    )
