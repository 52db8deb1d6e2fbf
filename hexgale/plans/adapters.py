"""The given test tables in the roles the operators expect, in Spark and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgale.operators.composite import period_number, period_start
from hexgale.session import cut_lineage

ORIGIN = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell observations: cell, day, 16-day period, prediction in about 0-1, gust in m/s, weight."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"),
        day.alias("obs_date"),
        period_number(day, ORIGIN).alias("period_no"),
        (F.col("l_extendedprice") / 100900.0).alias("pred"),
        (F.col("l_extendedprice") / 2009.0).alias("gust"),
        F.col("l_quantity").alias("weight"),
        F.col("l_orderkey").alias("obs_id"),
        F.col("l_linenumber").alias("obs_no"),
        (F.col("l_discount") * 10 - 0.47).alias("u10"),
        (F.col("l_tax") * 10 - 0.39).alias("v10"),
    )


OBS = f"""
obs AS (
  SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS obs_date,
         CAST(floor(date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) / 16.0) AS INTEGER) AS period_no,
         l_extendedprice / 100900.0 AS pred, l_extendedprice / 2009.0 AS gust, l_quantity AS weight,
         l_orderkey AS obs_id, l_linenumber AS obs_no,
         l_discount * 10 - 0.47 AS u10, l_tax * 10 - 0.39 AS v10
  FROM lineitem)"""


def cell_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean prediction and strongest gust per cell and 16-day period."""
    obs = observations(spark, sf_dir)
    mean = (F.sum(F.col("weight") * F.col("pred")) / F.sum("weight")).alias("pred")
    return (
        obs.groupBy("cell_id", "period_no")
        .agg(mean, F.max("gust").alias("gust"))
        .withColumn("obs_date", period_start(F.col("period_no"), ORIGIN))
    )


PERIODS = (
    OBS
    + f""",
per AS (
  SELECT cell_id, period_no, sum(weight * pred) / sum(weight) AS pred, max(gust) AS gust,
         CAST(DATE '{ORIGIN}' + 16 * period_no AS DATE) AS obs_date
  FROM obs GROUP BY cell_id, period_no)"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the European box with a weight (some not positive) and a class."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("point_id"),
        (F.lit(-11.0) + F.pmod(k * 37, F.lit(5400)) / 100.0).alias("lon"),
        (F.lit(34.0) + F.pmod(k * 53, F.lit(3800)) / 100.0).alias("lat"),
        F.col("s_acctbal").alias("weight"),
        F.pmod(F.col("s_nationkey"), F.lit(4)).alias("class_id"),
        F.col("s_nationkey").alias("country"),
    )


POINTS = """
pts AS (
  SELECT s_suppkey AS point_id, -11.0::DOUBLE + ((s_suppkey * 37) % 5400) / 100.0::DOUBLE AS lon,
         34.0::DOUBLE + ((s_suppkey * 53) % 3800) / 100.0::DOUBLE AS lat, s_acctbal AS weight,
         s_nationkey % 4 AS class_id, s_nationkey AS country
  FROM supplier)"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event points: customers with the date of their first order."""
    k = F.col("c_custkey")
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("event_date"))
    return (
        table(spark, sf_dir, "customer")
        .join(first, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            k.alias("event_id"),
            (F.lit(-11.0) + F.pmod(k * 37, F.lit(5400)) / 100.0).alias("lon"),
            (F.lit(34.0) + F.pmod(k * 53, F.lit(3800)) / 100.0).alias("lat"),
            "event_date",
            F.col("c_nationkey").alias("country"),
            F.col("c_acctbal").alias("area"),
            F.col("c_mktsegment").alias("method"),
        )
    )


EVENTS = """
ev AS (
  SELECT c_custkey AS event_id, -11.0::DOUBLE + ((c_custkey * 37) % 5400) / 100.0::DOUBLE AS lon,
         34.0::DOUBLE + ((c_custkey * 53) % 3800) / 100.0::DOUBLE AS lat, f.event_date,
         c_nationkey AS country, c_acctbal AS area, c_mktsegment AS method
  FROM customer JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS event_date FROM orders GROUP BY 1) f
    ON c_custkey = o_custkey)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation pixels: hexagon, year, disturbed flag and agent code (5-7 are unknown codes)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("hex_id"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("disturbed"),
        F.col("l_linenumber").alias("agent"),
    )


PIXELS = """
px AS (
  SELECT l_suppkey AS hex_id, year(l_shipdate) AS year, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS disturbed,
         l_linenumber AS agent FROM lineitem)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score, a fold and a category."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("y"),
            F.col("n_chars").cast("double").alias("score"),
            F.pmod(F.col("doc_id"), F.lit(5)).cast("int").alias("fold"),
            F.col("lang").alias("category"),
        )
    )


SCORED = """
sc AS (
  SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) AS score, CAST(doc_id % 5 AS INTEGER) AS fold, lang AS category
  FROM documents JOIN labels USING (doc_id))"""


def regime_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged hexagon table: prediction mean and p95, anomaly intensity and frequency, area weight, lon/lat."""
    from hexgale.operators.ordered import quantiles

    per = cell_periods(spark, sf_dir)
    base = per.groupBy("cell_id").agg(
        F.avg("pred").alias("mean_prob"),
        F.max("gust").alias("z_anomaly"),
        F.avg(F.when(F.col("gust") >= 45.0, 1.0).otherwise(0.0)).alias("anomaly_frequency"),
    )
    p95 = quantiles(per, ["cell_id"], "pred", {"p95_prob": 0.95})
    pts = points(spark, sf_dir).withColumnRenamed("point_id", "cell_id").withColumnRenamed("weight", "area_weight_km2")
    # One row per hexagon that every threshold and rank below reads again.
    return cut_lineage(base.join(p95, "cell_id").join(pts, "cell_id"))


REGIME = (
    PERIODS
    + ","
    + POINTS
    + """,
reg AS (
  SELECT p.cell_id, avg(pred) AS mean_prob, max(gust) AS z_anomaly,
         avg(CASE WHEN gust >= 45.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS anomaly_frequency,
         quantile_cont(pred, 0.95) AS p95_prob, any_value(lon) AS lon, any_value(lat) AS lat,
         any_value(s.weight) AS area_weight_km2, any_value(class_id) AS class_id, any_value(country) AS country
  FROM per p JOIN pts s ON s.point_id = p.cell_id GROUP BY p.cell_id)"""
)
