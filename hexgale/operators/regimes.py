"""Prediction flags, wind-anomaly regimes and their area tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.functions.aggregates import sum_if, weighted_mean
from hexgale.operators.ordered import MAX_GROUP, finite, ordinal_index, quantiles, weighted_quantiles
from hexgale.session import cut_lineage

# Regime names in table order, and the label of rows outside the mask.
COMPOUND = "Compound recurrent-intense"
RECURRENT = "Recurrent anomaly"
INTENSE = "Intensity-dominated anomaly"
BACKGROUND = "Background / mixed"
REGIMES = [COMPOUND, RECURRENT, INTENSE, BACKGROUND]
INVALID = "Invalid / outside analysis mask"

# Spelling variants of the regime names.
LABEL_VARIANTS = {
    "Compound": COMPOUND,
    "Compound recurrent–intense": COMPOUND,
    "Recurrent": RECURRENT,
    "Intensity-dominated": INTENSE,
    "Intensity dominated": INTENSE,
    "Background": BACKGROUND,
    "Background/mixed": BACKGROUND,
    "Background / Mixed": BACKGROUND,
}

# Names of the prediction metrics and wind contexts in the tables.
PREDICTIONS = {"Mean probability": "mean_prob", "P95 probability": "p95_prob"}
CONTEXTS = [
    "High anomaly frequency",
    "High anomaly intensity",
    "High frequency + high intensity",
    "Low frequency + high intensity",
]
AREA = "area_weight_km2"
REQUIRED = ["mean_prob", "p95_prob", "z_anomaly", "anomaly_frequency", AREA]


def analysis_valid(columns: Sequence[str] = tuple(REQUIRED), weight: str = AREA) -> Column:
    """All required values finite and the weight positive."""
    ok = F.col(weight) > 0
    for c in columns:
        ok = ok & finite(c)
    return F.coalesce(ok, F.lit(False))


def area_threshold(df: DataFrame, value: str, q: float, tie: str, *, max_group: int = MAX_GROUP) -> Column:
    """Area-weighted interpolated quantile of the valid rows as a scalar column (F2, T4, T5)."""
    return weighted_quantiles(
        df.where(analysis_valid()), [], value, AREA, {"q": q}, method="interp", tie=tie, max_group=max_group
    ).scalar()


def prediction_flags(df: DataFrame, key: str, q: float = 0.80, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Rows in the top area by mean and by p95 prediction."""
    valid = analysis_valid()
    return df.withColumns(
        {
            "analysis_valid": valid,
            "high_mean": valid & (F.col("mean_prob") >= area_threshold(df, "mean_prob", q, key, max_group=max_group)),
            "high_p95": valid & (F.col("p95_prob") >= area_threshold(df, "p95_prob", q, key, max_group=max_group)),
        }
    )


def _regime(valid: Column, frequent: Column, intense: Column) -> Column:
    return (
        F.when(~valid, F.lit(INVALID))
        .when(frequent & intense, F.lit(COMPOUND))
        .when(frequent, F.lit(RECURRENT))
        .when(intense, F.lit(INTENSE))
        .otherwise(F.lit(BACKGROUND))
    )


def wind_regimes(df: DataFrame, key: str, q: float = 0.75, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Four classes from high anomaly frequency and high anomaly intensity."""
    valid = analysis_valid()
    frequent = F.col("anomaly_frequency") >= area_threshold(df, "anomaly_frequency", q, key, max_group=max_group)
    intense = F.col("z_anomaly") >= area_threshold(df, "z_anomaly", q, key, max_group=max_group)
    flagged = df.withColumns({"high_frequency": valid & frequent, "high_intensity": valid & intense})
    return flagged.withColumn("wind_regime", _regime(valid, F.col("high_frequency"), F.col("high_intensity")))


def bivariate_class(intensity_pct: Column, frequency_pct: Column, high: float = 0.75) -> Column:
    """0 background, 1 frequency-dominated, 2 intensity-dominated, 3 compound."""
    hi, hf = intensity_pct >= high, frequency_pct >= high
    code = F.when(hi, F.lit(2)).otherwise(F.lit(0)) + F.when(hf, F.lit(1)).otherwise(F.lit(0))
    return F.when(intensity_pct.isNotNull() & frequency_pct.isNotNull(), code)


def _metric_rows(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """One row per prediction metric with its label and value."""
    options = [F.struct(F.lit(k).alias("label"), F.lit(c).alias("column"), F.col(c).alias("value")) for k, c in metrics.items()]
    return df.withColumn("_m", F.explode(F.array(*options))).select(
        "*",
        F.col("_m.label").alias("prediction_metric"),
        F.col("_m.column").alias("prediction_column"),
        F.col("_m.value").alias("prediction_value"),
    ).drop("_m")


def overlay_enrichment(
    df: DataFrame,
    key: str,
    top_quantiles: Sequence[float] = (0.70, 0.80, 0.90),
    *,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Wind contexts in the top-prediction area against the whole area, per metric and threshold.

    ``df`` carries the flags of :func:`wind_regimes`. The result has metrics x thresholds x contexts rows;
    all sums come from one aggregate.
    """
    long = _metric_rows(df.where(analysis_valid()), PREDICTIONS)
    probs = {f"t{i}": q for i, q in enumerate(top_quantiles)}
    limits = weighted_quantiles(
        long, ["prediction_column"], "prediction_value", AREA, probs, method="interp", tie=key, max_group=max_group
    ).select(
        "prediction_column",
        F.explode(
            F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"t{i}").alias("t")) for i, q in enumerate(top_quantiles)])
        ).alias("_q"),
    )
    rows = long.join(F.broadcast(limits), "prediction_column")  # metrics x thresholds rows, a fixed number
    freq, intens, area = F.col("high_frequency"), F.col("high_intensity"), F.col(AREA)
    top = F.col("prediction_value") >= F.col("_q.t")
    masks = [freq, intens, freq & intens, ~freq & intens]
    sums = rows.groupBy("prediction_metric", "prediction_column", "_q").agg(
        F.sum(area).alias("_total"),
        sum_if(area, top).alias("_top"),
        *[sum_if(area, m).alias(f"_bg{i}") for i, m in enumerate(masks)],
        *[sum_if(area, top & m).alias(f"_tc{i}") for i, m in enumerate(masks)],
    )
    contexts = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.col(f"_bg{i}").alias("bg"), F.col(f"_tc{i}").alias("top"))
            for i, n in enumerate(CONTEXTS)
        ]
    )
    flat = sums.withColumn("_c", F.explode(contexts))
    bg_share = F.try_divide(F.col("_c.bg"), F.col("_total"))
    top_share = F.try_divide(F.col("_c.top"), F.col("_top"))
    return flat.select(
        "prediction_metric",
        "prediction_column",
        F.col("_q.q").alias("top_prediction_quantile"),
        (F.lit(100.0) * (F.lit(1.0) - F.col("_q.q"))).alias("top_prediction_area_percent_nominal"),
        F.col("_q.t").alias("prediction_threshold"),
        F.col("_c.name").alias("wind_context"),
        (bg_share * 100).alias("background_area_share_percent"),
        (top_share * 100).alias("top_prediction_area_share_percent"),
        F.when(bg_share > 0, top_share / bg_share).alias("enrichment_ratio"),
        F.col("_c.top").alias("overlap_area_km2"),
    )


def _regime_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area and mass sums per regime with group totals; regimes without rows appear with zero area."""
    area = F.col(AREA)

    def mass(c: str) -> Column:
        return F.sum(F.col(c) * area)

    sums = df.groupBy(*by, "wind_regime").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(area).alias("area_km2"),
        mass("mean_prob").alias("_mean"),
        mass("p95_prob").alias("_p95"),
        mass("anomaly_frequency").alias("_freq"),
        mass("z_anomaly").alias("_int"),
        sum_if(area, F.col("_top_mean")).alias("_top_mean_area"),
        sum_if(area, F.col("_top_p95")).alias("_top_p95_area"),
    )
    keys = sums.select(*by).distinct() if by else sums.agg(F.max("n_cells").alias("_any")).select(F.lit(0).alias("_one"))
    full = keys.withColumn("wind_regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))
    if not by:
        full = full.drop("_one")
    dense = full.join(F.broadcast(sums), [*by, "wind_regime"], "left").fillna(
        0, subset=["n_cells", "area_km2", "_top_mean_area", "_top_p95_area"]
    )
    whole = Window.partitionBy(*by)  # four rows per group
    totals = ["area_km2", "_mean", "_p95", "_top_mean_area", "_top_p95_area"]
    return dense.withColumns({f"{c}_all": F.sum(c).over(whole) for c in totals})


def _with_top(df: DataFrame, key: str, q_pred: float, max_group: int) -> DataFrame:
    valid = df.where(analysis_valid())
    return valid.withColumns(
        {
            "_t_mean": area_threshold(valid, "mean_prob", q_pred, key, max_group=max_group),
            "_t_p95": area_threshold(valid, "p95_prob", q_pred, key, max_group=max_group),
        }
    ).withColumns(
        {
            "_top_mean": F.col("mean_prob") >= F.col("_t_mean"),
            "_top_p95": F.col("p95_prob") >= F.col("_t_p95"),
        }
    )


def _mass_columns() -> list[Column]:
    share = F.try_divide(F.col("area_km2"), F.col("area_km2_all"))
    out = [(share * 100).alias("area_share_percent")]
    for name in ("mean", "p95"):
        m = F.try_divide(F.col(f"_{name}"), F.col(f"_{name}_all"))
        out += [
            (m * 100).alias(f"{name}_prediction_mass_share_percent"),
            F.when(share > 0, m / share).alias(f"{name}_mass_to_area_ratio"),
        ]
    return out


def regime_mass(df: DataFrame) -> DataFrame:
    """Area share, weighted means, prediction-mass share and mass/area ratio per regime."""
    valid = df.where(analysis_valid()).withColumns({"_top_mean": F.lit(False), "_top_p95": F.lit(False)})
    s = _regime_sums(valid, [])
    mean = {
        "_mean": "mean_prob", "_p95": "p95_prob", "_freq": "anomaly_frequency", "_int": "anomaly_intensity",
    }
    return s.select(
        "wind_regime",
        "n_cells",
        "area_km2",
        *[F.try_divide(F.col(c), F.col("area_km2")).alias(f"{n}_area_weighted_mean") for c, n in mean.items()],
        *_mass_columns(),
    )


def _enrichment_columns(name: str) -> tuple[Column, Column, Column]:
    bg = F.try_divide(F.col("area_km2"), F.col("area_km2_all"))
    top = F.try_divide(F.col(f"_top_{name}_area"), F.col(f"_top_{name}_area_all"))
    return bg, top, F.when(bg > 0, top / bg)


def regime_enrichment(df: DataFrame, key: str, q_pred: float = 0.80, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Regime shares in the top-prediction area against the whole area."""
    flagged = _with_top(df, key, q_pred, max_group)
    s = _regime_sums(flagged, [])
    limits = {
        "mean": area_threshold(df, "mean_prob", q_pred, key, max_group=max_group),
        "p95": area_threshold(df, "p95_prob", q_pred, key, max_group=max_group),
    }
    options = []
    for label, name in (("Mean probability", "mean"), ("P95 probability", "p95")):
        bg, top, ratio = _enrichment_columns(name)
        options.append(
            F.struct(
                F.lit(label).alias("prediction_metric"),
                F.lit(PREDICTIONS[label]).alias("prediction_column"),
                limits[name].alias("prediction_threshold"),
                (bg * 100).alias("background_area_share_percent"),
                (top * 100).alias("top_prediction_area_share_percent"),
                ratio.alias("enrichment_ratio"),
                F.col(f"_top_{name}_area").alias("top_prediction_regime_area_km2"),
            )
        )
    return s.select("wind_regime", F.explode(F.array(*options)).alias("_e")).select(
        "wind_regime", "_e.*", F.lit(q_pred).alias("top_prediction_quantile")
    )


def threshold_sensitivity(
    df: DataFrame,
    key: str,
    wind_quantiles: Sequence[float] = (0.70, 0.75, 0.80),
    q_pred: float = 0.80,
    *,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Regime tables over a grid of wind thresholds, with the best enriched regime of each."""
    flagged = cut_lineage(_with_top(df, key, q_pred, max_group))
    probs = {f"q{i}": q for i, q in enumerate(wind_quantiles)}
    limits = {}
    for c in ("anomaly_frequency", "z_anomaly"):
        w = weighted_quantiles(flagged, [], c, AREA, probs, method="interp", tie=key, max_group=max_group)
        limits[c] = w.select(F.struct(*probs).alias("s")).scalar()
    grid = F.array(
        *[
            F.struct(
                F.lit(q).alias("wind_quantile"),
                limits["anomaly_frequency"][f"q{i}"].alias("f"),
                limits["z_anomaly"][f"q{i}"].alias("z"),
            )
            for i, q in enumerate(wind_quantiles)
        ]
    )
    rows = flagged.withColumn("_g", F.explode(grid)).select("*", "_g.wind_quantile", "_g.f", "_g.z")
    frequent, intense = F.col("anomaly_frequency") >= F.col("f"), F.col("z_anomaly") >= F.col("z")
    rows = rows.withColumn("wind_regime", _regime(F.lit(True), frequent, intense)).withColumnsRenamed(
        {"f": "frequency_threshold", "z": "intensity_threshold"}
    )
    by = ["wind_quantile", "frequency_threshold", "intensity_threshold"]
    s = _regime_sums(rows, by)
    options = []
    for label, name in (("Mean probability", "mean"), ("P95 probability", "p95")):
        options.append(F.struct(F.lit(label).alias("metric"), _enrichment_columns(name)[2].alias("ratio")))
    long = s.select(*by, "wind_regime", *_mass_columns(), F.explode(F.array(*options)).alias("_e"))
    group = Window.partitionBy("wind_quantile", "_e.metric")  # four rows
    best = F.max(F.struct(F.col("_e.ratio").alias("r"), F.col("wind_regime").alias("w"))).over(group)
    return long.withColumn("_best", best).select(
        *by,
        F.col("_e.metric").alias("prediction_metric_for_best_enrichment"),
        F.col("_best.w").alias("best_enriched_regime"),
        F.col("_best.r").alias("best_enrichment_ratio"),
        "wind_regime",
        "area_share_percent",
        "mean_mass_to_area_ratio",
        "p95_mass_to_area_ratio",
    )


def first_rank_bins(
    df: DataFrame, value: str, tie: str, n_bins: int, name: str, *, max_group: int = MAX_GROUP
) -> DataFrame:
    """Equal-count bins 1..n of the first-rank; NULL below n_bins values."""
    known = df.where(finite(value))
    n = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ordinal_index(known, [], value, tie, name="_r", max_group=max_group)
    r = F.col("_r").cast("long")
    # Integer arithmetic: ceil((r - 1) * n_bins / (n - 1)), at least 1.
    up = F.expr(f"((_r - 1) * {n_bins} + greatest(_n - 1, 1) - 1) div greatest(_n - 1, 1)")
    binned = (
        ranked.withColumn("_r", r)
        .withColumn("_n", n)
        .withColumn(name, F.when(F.col("_n") >= n_bins, F.greatest(up.cast("int"), F.lit(1))))
        .drop("_r", "_n")
    )
    missing = df.where(~finite(value)).withColumn(name, F.lit(None).cast("int"))
    return binned.unionByName(missing)


def response_surface(
    df: DataFrame,
    key: str,
    prediction: str,
    *,
    intensity: str = "z_anomaly",
    frequency: str = "anomaly_frequency",
    n_bins: int = 5,
    min_count: int = 10,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Lift of the weighted mean prediction over intensity x frequency bins."""
    binned = first_rank_bins(df, frequency, key, n_bins, "freq_bin", max_group=max_group)
    binned = first_rank_bins(binned, intensity, key, n_bins, "z_bin", max_group=max_group)
    overall = df.agg(weighted_mean(F.col(prediction), F.col(AREA)).alias("m")).scalar()
    bins = F.array(*[F.lit(i) for i in range(1, n_bins + 1)])
    cells = binned.groupBy("z_bin", "freq_bin").agg(
        F.count(F.lit(1)).alias("n"), weighted_mean(F.col(prediction), F.col(AREA)).alias("_m")
    )
    grid = (
        df.agg(F.count(F.lit(1)).alias("_n"))
        .select(F.explode(bins).alias("z_bin"))
        .withColumn("freq_bin", F.explode(bins))
    )
    return grid.join(F.broadcast(cells), ["z_bin", "freq_bin"], "left").select(
        "z_bin",
        "freq_bin",
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.when(F.col("n") >= min_count, F.try_divide(F.col("_m"), overall)).alias("prediction_lift"),
    )


def class_enrichment(
    df: DataFrame,
    region: str,
    *,
    class_column: str = "wind_regime",
    top_percents: Sequence[int] = (5, 10, 20, 30),
    overall: str = "Continental",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Class shares in the top x % of rows against all rows, for the whole table and each region.

    Thresholds are unweighted quantiles taken anew for each level (T5), so this is a union of levels
    and not a rollup.
    """
    levels = df.withColumn("_level", F.explode(F.array(F.lit(overall), F.col(region)))).drop(region)
    long = _metric_rows(levels.withColumnRenamed("_level", region), PREDICTIONS)
    by = [region, "prediction_metric", "prediction_column"]
    probs = {f"t{p}": 1 - p / 100.0 for p in top_percents}
    limits = quantiles(long, by, "prediction_value", probs, max_group=max_group).select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"t{p}").alias("t")) for p in top_percents])
        ).alias("_q"),
    )
    rows = long.join(F.broadcast(limits), by)  # limits: a fixed number per region, and regions are few
    top = F.col("prediction_value") >= F.col("_q.t")
    area = F.col(AREA)
    sums = rows.groupBy(*by, "_q", class_column).agg(F.sum(area).alias("_bg"), sum_if(area, top).alias("_tc"))
    full = sums.select(*by, "_q").distinct().withColumn(
        class_column, F.explode(F.array(*[F.lit(r) for r in REGIMES]))
    )
    dense = full.join(sums, [*by, "_q", class_column], "left").fillna(0.0, subset=["_bg", "_tc"])
    whole = Window.partitionBy(*by, "_q")  # one row per class
    bg = F.try_divide(F.col("_bg"), F.sum("_bg").over(whole))
    tc = F.try_divide(F.col("_tc"), F.sum("_tc").over(whole))
    return dense.select(
        *by,
        F.col("_q.p").alias("top_pct"),
        F.col("_q.t").alias("threshold"),
        F.col(class_column).alias("class"),
        bg.alias("background_area_share"),
        tc.alias("top_area_share"),
        F.when(bg > 0, tc / bg).alias("enrichment_ratio"),
    )


def plotted_enrichment(df: DataFrame, classes: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """Plot-ready rows of an enrichment table."""
    labels = F.when(F.col("prediction_column") == "mean_prob", "Mean prediction").when(
        F.col("prediction_column") == "p95_prob", "P95 prediction"
    )
    return df.withColumn("metric_label", labels).where(
        F.col("metric_label").isNotNull() & F.col("class").isin(*classes) & F.col("top_pct").isin(*percents)
    )
