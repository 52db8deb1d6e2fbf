"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.functions.scalar import chunk_key, normalize_longitude, year_from_name

# Country codes of the European footprint, and names left out where there are no codes.
EUROPE_CODES = [
    "AL", "AD", "AT", "BA", "BE", "BG", "BY", "CH", "CY", "CZ", "DE", "DK", "EE", "EL", "ES",
    "FI", "FR", "HR", "HU", "IE", "IT", "LI", "LT", "LU", "LV", "MD", "ME", "MK", "MT", "NL",
    "NO", "PL", "PT", "RO", "RS", "SE", "SI", "SK", "SM", "UA", "VA", "XK", "UK", "GB",
]
EXCLUDED_COUNTRIES = ["russia", "russian federation", "iceland"]
EXTRA_COUNTRIES = ["Turkey", "Cyprus"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Delimited scan with explicit schema and optional column subset (A1)."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_cube(
    spark: SparkSession, path: str, bbox: tuple[float, float, float, float], values: Sequence[str], *,
    start: str | None = None, end: str | None = None, lon: str = "lon", lat: str = "lat", day: str = "period_start",
    wrapped: bool = False,
) -> DataFrame:
    """Long grid table cropped to a box and time range.

    Latitude, time and (unless longitudes are stored as 0-360) longitude filters reach the parquet scan.
    """
    df = spark.read.parquet(path).select(day, lon, lat, *values)
    df = df.where(F.col(lat).between(bbox[1], bbox[3]))
    if start:
        df = df.where(F.col(day) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(day) <= F.lit(end).cast("date"))
    if wrapped:
        df = df.withColumn(lon, normalize_longitude(F.col(lon)))
    return df.where(F.col(lon).between(bbox[0], bbox[2]))


def read_tiles(spark: SparkSession, folder: str, pattern: str, key: str, schema: T.StructType | str) -> DataFrame:
    """All tiles of a folder whose names match, with the required key (A3)."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)
    if key not in df.columns:
        raise KeyError(f"tiles have no column {key}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (A3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def union_tiles(tiles: Sequence[DataFrame], order: Sequence[str] | None = None) -> DataFrame:
    """Stack tiles by column name, sorted where asked for (A3, F1, G1)."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy(*order) if order else out


def pair_chunks(left: DataFrame, right: DataFrame, name: str, prefix: str = "era5_chunk_", suffix: str = ".nc") -> DataFrame:
    """Pair two file lists by the period key in their names (A4)."""

    def keyed(df: DataFrame, alias: str) -> DataFrame:
        return df.select(chunk_key(F.col(name), prefix, suffix).alias("chunk_key"), F.col(name).alias(alias))

    return keyed(left, "left_file").join(keyed(right, "right_file"), "chunk_key")


def file_list(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path and size of the files of a folder tree; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(folder).select("path", "length")
    )
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.element_at(parts, -1).alias("name"),
        F.element_at(parts, -2).alias("parent"),
        F.when(F.size(parts) >= 3, F.element_at(parts, -3)).otherwise(F.lit("")).alias("country"),
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
    )


def layer_type(name: Column) -> Column:
    """Layer type by ordered name rules."""
    n = F.lower(name)

    def has(word: str) -> Column:
        return F.contains(n, F.lit(word))

    return (
        F.when(has("agent"), "agent")
        .when(has("severity") | has("nbr"), "severity")
        .when(has("stack") & has("disturb"), "annual_disturbance_stack")
        .when(has("year") & has("disturb"), "year_of_disturbance")
        .when(has("prob"), "probability")
        .when(has("disturb"), "disturbance_other")
        .otherwise("unknown")
    )


def layout(name: Column, bands: Column) -> Column:
    """Pixel layout of a disturbance file from its bands and name."""
    return (
        F.when(bands > 1, "annual_stack").when(year_from_name(name).isNotNull(), "annual_binary").otherwise("year_coded")
    )


def band_year(description: Column, band: Column, first_year: int = 1985) -> Column:
    """Year of a band from its description, else counted from the first year (H11s)."""
    return F.coalesce(year_from_name(description), F.lit(first_year) + band - 1)


def preferred_files(inventory: DataFrame, layer: str = "layer_guess") -> DataFrame:
    """Disturbance files of the best available kind: annual stacks, else all others."""
    rank = F.when(F.col(layer) == "annual_disturbance_stack", 1).when(
        F.col(layer).isin("year_of_disturbance", "disturbance_other"), 2
    )
    ranked = inventory.withColumn("_p", rank).where(F.col("_p").isNotNull())
    best = ranked.agg(F.min("_p").alias("m")).scalar()
    return ranked.where(F.col("_p") == best).drop("_p")


def companion_files(files: DataFrame, companions: DataFrame, path: str = "path") -> DataFrame:
    """Companion sharing most path parts, the first path on ties.

    Files of one folder share all parts but the name, so folders are compared and not files: each folder
    is represented by its first companion, and companions of the same file name compete with one part
    more. Parts all companion folders have (roots) cannot change the order and are not joined on; a file
    that shares nothing else gets the first companion.
    """

    def located(df: DataFrame) -> DataFrame:
        p = F.lower(path)
        folder = F.regexp_replace(p, "/[^/]*$", "")
        return df.select(path, folder.alias("folder"), F.substring_index(p, "/", -1).alias("name"))

    def parts(df: DataFrame, alias: str) -> DataFrame:
        return df.select(F.col("folder").alias(alias), F.explode(F.array_distinct(F.split("folder", "/"))).alias("part"))

    left, right = located(files.select(path).distinct()), located(companions.select(path).distinct())
    folders = right.groupBy("folder").agg(F.min(path).alias("first"))
    telling = parts(folders, "right_folder")
    n = folders.agg(F.count(F.lit(1)).alias("n")).scalar()
    common = telling.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < n).select("part")
    shared = (
        parts(left.select("folder").distinct(), "left_folder")
        .join(telling.join(common, "part", "left_semi"), "part")
        .groupBy("left_folder", "right_folder")
        .agg(F.count(F.lit(1)).alias("score"))
    )

    def best(df: DataFrame, key: str) -> DataFrame:
        # Highest score, then the first path.
        return df.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("c").alias("c"))).alias("b"))

    by_folder = best(
        shared.join(folders, F.col("right_folder") == F.col("folder")).select("left_folder", "score", F.col("first").alias("c")), "left_folder"
    ).select(F.col("left_folder").alias("folder"), (-F.col("b.s")).alias("score"), F.col("b.c").alias("c"))
    same_name = (
        left.join(right.select("name", F.col("folder").alias("right_folder"), F.col(path).alias("c")), "name")
        .join(shared.withColumnRenamed("left_folder", "folder"), ["folder", "right_folder"], "left")
        .select(path, (F.coalesce("score", F.lit(0)) + 1).alias("score"), "c")
    )
    first = companions.agg(F.min(path).alias("p")).scalar()
    default = left.select(path, F.lit(0).cast("long").alias("score"), first.alias("c"))
    candidates = left.join(by_folder, "folder").select(path, "score", "c").unionByName(same_name).unionByName(default)
    return best(candidates, path).select(path, F.col("b.c").alias("companion"))


def european_countries(
    countries: DataFrame, *, code: str | None = None, name: str | None = None, continent: str | None = None
) -> DataFrame:
    """Country filter by code list, or by continent and excluded names."""
    if code and code in countries.columns:
        return countries.where(F.col(code).isin(*EUROPE_CODES))
    keep = F.lit(True)
    if continent:
        keep = F.lower(F.col(continent)) == "europe"
        if name:
            keep = keep | F.col(name).isin(*EXTRA_COUNTRIES)
    if name:
        keep = keep & ~F.lower(F.col(name)).isin(*EXCLUDED_COUNTRIES)
    return countries.where(keep)


def bind_records(left: DataFrame, right: DataFrame, number: str) -> DataFrame:
    """Join two files on their record number; unmatched records on either side are an error (C20)."""
    unmatched = left.join(right, number, "left_anti").select(number).unionByName(right.join(left, number, "left_anti").select(number))
    if not unmatched.isEmpty():
        raise ValueError("record numbers differ between both files")
    return left.join(right, number)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Compressed parquet sink, partitioned for later pruning (A10).

    Rows are rebalanced by the partition columns: adaptive execution joins small slices and splits the rows
    of a large partition value over as many writers as its size asks for.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink for result tables (A10)."""
    df.write.mode(mode).option("header", True).csv(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], required: Sequence[str], derive: Callable[[DataFrame], DataFrame] | None = None,
    *, rebuild: bool = False,
) -> DataFrame:
    """Stored table if it exists with all columns and rows, else built and stored; derived columns anew."""
    stored = None if rebuild else _stored(spark, path, required)
    if stored is None:
        build().select(*required).write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return derive(stored) if derive else stored


def _stored(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    if not set(required) <= set(df.columns) or df.isEmpty():
        return None
    return df
