"""Encoders, imputation and the locked modelling table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.functions.columns import first_numeric, harmonise, to_day, to_number
from hexgale.functions.scalar import cap_positive_at_zero, encoder_json
from hexgale.operators.ordered import MAX_GROUP, column_quantiles, handed_out, ordinal_index, quantiles
from hexgale.session import cut_lineage

SMOOTH_K = 50.0
MISSING = "__NA__"
EPS = 1e-6

# Columns of the locked modelling table in order.
ID_COLUMNS = {"sample_id": "bigint", "lon": "double", "lat": "double", "label": "int", "event_date": "date", "ref_storm_id": "double"}
NUMERIC_FEATURES = [
    "LAI_departure", "gust_peak_speed", "days_since_gust_peak", "gust_peak_percentile", "slope", "aspect",
    "aspect_sin", "aspect_cos", "terrain_roughness", "tree_height", "windwardness", "exposure",
    "height_exposure", "roughness_exposure", "susceptibility",
]


def target_encoding(df: DataFrame, category: str, label: str, k: float = SMOOTH_K) -> DataFrame:
    """Smoothed mean label per category."""
    c = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    mean = df.agg(F.avg(F.col(label).cast("double")).alias("m")).scalar()
    stats = df.groupBy(c.alias("category")).agg(F.sum(label).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    return stats.withColumn("enc", (F.col("n_pos") + mean * k) / (F.col("n") + k))


def encoder_artifact(table: DataFrame, overall: Column, k: float = SMOOTH_K) -> DataFrame:
    """The encoding table as one JSON row (H15j). One entry per category."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "enc"))))
    return table.agg(pairs.alias("mapping")).select(encoder_json(F.col("mapping"), overall, k).alias("json"))


def encoder_upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New entries win, old ones stay."""
    return (
        old.select(key, F.col(value).alias("_old"))
        .join(new.select(key, F.col(value).alias("_new")), key, "full")
        .select(key, F.coalesce("_new", "_old").alias(value))
    )


def oof_target_encoding(
    df: DataFrame, category: str, label: str, fold: str, k: float = SMOOTH_K, name: str = "enc"
) -> DataFrame:
    """Out-of-fold smoothed encoding: totals minus the row's own fold (K8).

    Sums per (category, fold) are small; a category a fold's training rows do not hold falls back to the
    training mean. Few categories and folds are few keys, so unless there are very many the rows are not dealt out by them.
    """
    c = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    work = df.withColumn("_cat", c)
    parts = cut_lineage(work.groupBy("_cat", fold).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n")))
    cats = parts.groupBy("_cat").agg(F.sum("_p").alias("_cp"), F.sum("_n").alias("_cn"))
    folds = parts.groupBy(fold).agg(F.sum("_p").alias("_fp"), F.sum("_n").alias("_fn"))
    total = parts.agg(F.struct(F.sum("_p").alias("p"), F.sum("_n").alias("n")).alias("t")).scalar()
    mean = F.try_divide((total["p"] - F.col("_fp")).cast("double"), (total["n"] - F.col("_fn")).cast("double"))
    table = (
        parts.join(cats, "_cat").join(folds, fold).select(
            "_cat", fold,
            F.coalesce(
                F.try_divide(F.col("_cp") - F.col("_p") + mean * k, F.when(F.col("_cn") > F.col("_n"), F.col("_cn") - F.col("_n") + k)), mean
            ).alias(name),
        )
    )
    return work.join(handed_out(cut_lineage(table)), ["_cat", fold]).drop("_cat")


def median_impute(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """Missing numbers become the column median, 0 for a column without values.

    ``reference`` supplies the medians (the training rows when a holdout is filled).
    """
    medians = column_medians(df if reference is None else reference, columns)
    return df.withColumns({c: F.coalesce(to_number(F.col(c)), F.lit(medians[c])) for c in columns})


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median per column, 0 without values. One number per column reaches the driver: they are model
    parameters that training, holdout and scoring rows are all filled with."""
    found = column_quantiles(df.select(*[to_number(F.col(c)).alias(c) for c in columns]), columns, {"m": 0.5})
    return {c: found[c]["m"] if found[c]["m"] is not None else 0.0 for c in columns}


def interactions(df: DataFrame) -> DataFrame:
    """Height x windwardness, roughness x exposure, height / |roughness|, wind x exposure."""
    h, rough, expo = F.col("tree_height"), F.col("terrain_roughness"), F.col("exposure")
    return df.withColumns(
        {
            "height_exposure": h * F.col("windwardness"),
            "roughness_exposure": rough * expo,
            "susceptibility": h / (F.abs(rough) + EPS),
            "wind_impact": F.col("gust_peak_speed") * expo,
        }
    )


#: Upper limit of susceptibility in model tables: flat terrain would make it as large as the rounding allows.
SUSCEPTIBILITY_LIMIT = 1000.0


def model_features(df: DataFrame, *, cross: bool = False) -> DataFrame:
    """Derived columns a model table lacks (B14): exposure from the first column that stands in for it, susceptibility
    (height / |roughness|, at most 1000), with ``cross`` also wind and interaction terms.

    Columns that are already there are kept, and nothing is derived from columns that are missing.
    """
    numeric = ["LAI_departure", "gust_peak_speed", "days_since_gust_peak", "gust_peak_percentile", "windwardness", "slope", "exposure",
               "exposure_intensity", "terrain_roughness", "tree_height", "ref_storm_id"]
    out = df.withColumns({c: to_number(F.col(c)) for c in numeric if c in df.columns})
    if "exposure" not in out.columns:
        source = next((c for c in ("exposure_intensity", "exposure_signed") if c in out.columns), None)
        out = out.withColumn("exposure", F.col(source) if source else F.lit(None).cast("double"))
    height, rough = F.col("tree_height"), F.col("terrain_roughness")
    ratio = height / (F.abs(rough) + EPS)
    terms = {"susceptibility": (["tree_height", "terrain_roughness"], F.when(ratio.isNotNull(), F.least(ratio, F.lit(SUSCEPTIBILITY_LIMIT))))}
    if cross:
        terms["wind_impact"] = (["gust_peak_speed", "exposure"], F.col("gust_peak_speed") * F.col("exposure"))
        terms["height_exposure"] = (["tree_height", "windwardness"], height * F.col("windwardness"))
        terms["roughness_exposure"] = (["terrain_roughness", "exposure"], rough * F.col("exposure"))
    there = set(out.columns)
    return out.withColumns({name: term for name, (needed, term) in terms.items() if name not in there and there.issuperset(needed)})


def locked_table(
    df: DataFrame, *, folds: int = 5, renames: Mapping[str, str] | None = None, order: Sequence[str] = ("lon", "lat"),
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Harmonise, derive, encode, impute and lock the modelling table.

    Required columns that no step computes are all missing and become 0 by imputation.
    """
    out = harmonise(df) if renames is None else harmonise(df, renames)
    for required in ("lon", "lat", "label", "event_date"):
        if required not in out.columns:
            raise KeyError(f"missing column {required}")
    rough = first_numeric(out, ["terrain_roughness_std5", "terrain_roughness_std3", "terrain_roughness"])
    expo = first_numeric(out, ["exposure_intensity", "exposure_signed", "exposure_raw"])
    missing = F.lit(None).cast("double")
    derived = {
        "event_date": to_day(F.col("event_date")),
        "terrain_roughness": to_number(F.col(rough)) if rough else missing,
        "exposure": to_number(F.col(expo)) if expo else missing,
        "label": F.coalesce(to_number(F.col("label")), F.lit(0.0)).cast("int"),
    }
    for c in ["LAI_departure", "gust_peak_speed", "days_since_gust_peak", "gust_peak_percentile", "windwardness", "slope",
              "aspect", "aspect_sin", "aspect_cos", "tree_height", "ref_storm_id"]:
        derived[c] = to_number(F.col(c)) if c in out.columns else missing
    derived["LAI_departure"] = cap_positive_at_zero(derived["LAI_departure"])
    cover = F.lit(MISSING)
    for c in ("landcover", "landcover_name"):
        if c in out.columns:
            cover = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            break
    derived["landcover"] = cover
    out = interactions(out.withColumns(derived))
    out = out.withColumn("sample_id", to_number(F.col("sample_id")).cast("long") if "sample_id" in out.columns else F.lit(None).cast("long"))
    out = fill_row_numbers(out, "sample_id", order, max_group=max_group)
    # Folds by hash of the id: nothing to sort, the same on every partitioning, labels balanced in number.
    out = out.withColumn("_fold", F.pmod(F.xxhash64("sample_id", F.lit(42)), F.lit(folds)).cast("int"))
    out = oof_target_encoding(out, "landcover", "label", "_fold", name="landcover_enc")
    out = median_impute(cut_lineage(out), NUMERIC_FEATURES)
    return out.select(
        *[F.col(c).cast(t).alias(c) for c, t in ID_COLUMNS.items()],
        *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES],
        "landcover",
        F.col("landcover_enc").cast("float").alias("landcover_enc"),
    )


def fill_row_numbers(df: DataFrame, key: str, order: Sequence[str], *, max_group: int = MAX_GROUP) -> DataFrame:
    """Missing ids become the row's position in a stable order (B13). Nothing is ranked if none is missing."""
    if df.where(F.col(key).isNull()).isEmpty():
        return df
    numbered = ordinal_index(
        df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns])), [], order[0], "_tie", name="_pos", max_group=max_group
    )
    return numbered.withColumn(key, F.coalesce(F.col(key), F.col("_pos"))).drop("_pos", "_tie")


def holdout_flag(bbox: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> Column:
    """True inside the holdout box; rows without coordinates stay in the training part."""
    inside = F.col(lon).between(bbox[0], bbox[2]) & F.col(lat).between(bbox[1], bbox[3])
    return F.coalesce(inside, F.lit(False))


def wind_gate(df: DataFrame, column: str, threshold: float) -> Column:
    """Rows at or above a threshold; percentile columns may be stored as 0-1 or 0-100."""
    v = to_number(F.col(column))
    if column != "gust_peak_percentile":
        return F.coalesce(v >= threshold, F.lit(False))
    top = df.agg(F.max(v).alias("m")).scalar()
    as_percent = threshold * 100.0 if threshold <= 1.0 else threshold
    as_share = threshold if threshold <= 1.0 else threshold / 100.0
    return F.coalesce(v >= F.when(top > 1.5, F.lit(as_percent)).otherwise(F.lit(as_share)), F.lit(False))


def structurally_valid() -> Column:
    """Tall trees, rough terrain and some exposure."""
    ok = (F.col("tree_height") > 2) & (F.col("terrain_roughness") > 0) & (F.abs(F.col("exposure")) > 0)
    return F.coalesce(ok, F.lit(False))


def departure_weight(df: DataFrame, column: str = "LAI_departure", *, max_group: int = MAX_GROUP) -> DataFrame:
    """|departure|, missing as median, capped at q99, plus 1e-3."""
    raw = F.abs(to_number(F.col(column)))
    median = quantiles(df.select(raw.alias("w")), [], "w", {"m": 0.5}, max_group=max_group).scalar()
    filled = df.withColumn("_w", F.coalesce(raw, median))
    cap = quantiles(filled.select("_w"), [], "_w", {"c": 0.99}, max_group=max_group).scalar()
    return filled.withColumn("weight", F.least(F.greatest(F.col("_w"), F.lit(0.0)), cap) + 1e-3).drop("_w")
