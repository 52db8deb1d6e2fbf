"""Column resolution and coercion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which a prediction column may appear, and words that rule a column out.
PREDICTION_NAMES = [
    "hex_period_mean_pred", "mean_pred_wind", "mean_pred_disturbance", "mean_pred", "pred_prob_mean",
    "pred_wind", "pred", "score",
]
PREDICTION_WORDS = ["pred", "score", "prob"]
NON_VALUE_WORDS = ["id", "year", "month", "day", "period", "season", "hex"]

# Harmonised column names of the modelling table.
RENAMES = {
    "index": "sample_id", "x": "lon", "y": "lat", "event_time": "event_date", "Label": "label",
    "mag": "LAI_departure", "max_wind_event": "gust_peak_speed", "max_wind_speed": "gust_peak_speed",
    "days_since_peak": "days_since_gust_peak", "wind_percentile": "gust_peak_percentile",
    "gust_percentile": "gust_peak_percentile", "exposure": "exposure_raw",
}


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """Exact, then case-insensitive, then substring match; candidates in order (B2)."""
    for c in candidates:
        if c in df.columns:
            return c
    lower = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    for c in df.columns:
        if any(k.lower() in c.lower() for k in candidates):
            return c
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def resolve_prediction_column(df: DataFrame) -> str:
    """Known name, then numeric column whose name hints at a prediction, then any plain numeric column (B2)."""
    for c in PREDICTION_NAMES:
        if c in df.columns:
            return c
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    for c in numeric:
        if any(k in c.lower() for k in PREDICTION_WORDS):
            return c
    for c in numeric:
        if not any(k in c.lower() for k in NON_VALUE_WORDS):
            return c
    raise KeyError("no numeric column can serve as prediction")


def harmonise(df: DataFrame, renames: Mapping[str, str] = RENAMES) -> DataFrame:
    """Many-to-one renames; the first source column wins and later ones are dropped (B1)."""
    taken: set[str] = set()
    out = []
    for c in df.columns:
        target = renames.get(c, c)
        if target not in taken:
            taken.add(target)
            out.append(F.col(c).alias(target))
    return df.select(*out)


def to_number(c: Column) -> Column:
    """Number or NULL (B3); NaN is NULL too."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_day(c: Column) -> Column:
    """Date or NULL."""
    return c.try_cast("date")


def whole_key(df: DataFrame, column: str, name: str = "hex_id") -> DataFrame:
    """Key as BIGINT, rows without a numeric key dropped."""
    number = to_number(F.col(column))
    return (
        df.withColumn("_key", F.round(number).cast("long"))
        .where(F.col("_key").isNotNull())
        .drop(column)
        .withColumnRenamed("_key", name)
    )


def first_numeric(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First existing candidate with any numeric value (B5): one aggregate over all candidates."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(to_number(F.col(c))).alias(f"n{i}") for i, c in enumerate(present)]).first()
    return next((c for i, c in enumerate(present) if counts[i] > 0), None)


def replace_labels(c: Column, variants: Mapping[str, str]) -> Column:
    """Trim and replace spelling variants."""
    trimmed = F.trim(c.cast("string"))
    table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    return F.coalesce(table[trimmed], trimmed)


def guess_crs(bounds: tuple[float, float, float, float]) -> str:
    """Geographic if all bounds fit lon/lat, else projected."""
    x0, y0, x1, y1 = bounds
    geographic = -180 <= x0 <= 180 and -180 <= x1 <= 180 and -90 <= y0 <= 90 and -90 <= y1 <= 90
    return "EPSG:4326" if geographic else "EPSG:3035"


def with_crs_guess(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: bounds of a coordinate table and the CRS they fit."""
    b = df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
    geographic = (
        F.col("xmin").between(-180, 180)
        & F.col("xmax").between(-180, 180)
        & F.col("ymin").between(-90, 90)
        & F.col("ymax").between(-90, 90)
    )
    return b.withColumn("crs", F.when(geographic, F.lit("EPSG:4326")).otherwise(F.lit("EPSG:3035")))
