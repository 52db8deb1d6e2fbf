"""Sources and sinks run for real: what is written to the shared folder is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexgale.functions import columns as col
from hexgale.plans.adapters import PERIODS, cell_periods, table
from hexgale.plans.registry import query
from hexgale.session import ensure_checkpoint_dir
from hexgale.sources import tables


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "o_orderkey:l o_totalprice:d o_orderdate:t o_comment:s",
       "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, 'a \"quoted\", text of ' || o_orderkey AS o_comment FROM orders")
def csv_round_trip(spark, sf):
    """All orders as CSV (A10), read with a schema and a column subset (A1)."""
    path = _folder(spark, "csv")
    text = F.concat(F.lit('a "quoted", text of '), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), text.alias("o_comment"))
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema, ["o_orderkey", "o_totalprice", "o_orderdate", "o_comment"])


@query("partitioned_sink", "flag:s n:l quantity:d first_day:t",
       """SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity, min(CAST(l_shipdate AS DATE)) AS first_day
       FROM lineitem WHERE l_returnflag <> 'N' OR l_linenumber < 7 GROUP BY 1""")
def partitioned_sink(spark, sf):
    """A partitioned table whose one partition is written anew without touching the others (A10)."""
    path = _folder(spark, "sink")
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_shipdate", "l_linenumber", F.col("l_returnflag").alias("flag"))
    tables.write_table(rows, path, partition_by=["flag"])
    tables.write_table(rows.where("flag = 'N' AND l_linenumber < 7"), path, partition_by=["flag"])
    back = spark.read.parquet(path).groupBy("flag")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.min(F.col("l_shipdate").cast("date")).alias("first_day"))


@query("stored_result", "cell_id:l total:d n:l share:d",
       f"""WITH {PERIODS}, t AS (SELECT cell_id, sum(pred) AS total, count(*) AS n FROM per GROUP BY 1)
       --final-- SELECT cell_id, total, n, total / (SELECT sum(total) FROM t) AS share FROM t""")
def stored_result(spark, sf):
    """Built and stored at the first call, read at the second, built anew where a column is missing."""
    path = _folder(spark, "stored")

    def build():
        return cell_periods(spark, sf).groupBy("cell_id").agg(F.sum("pred").alias("total"), F.count(F.lit(1)).alias("n"))

    def never():
        raise AssertionError("the stored table has all columns")

    def share(df):
        return df.withColumn("share", F.col("total") / df.agg(F.sum("total").alias("t")).scalar())

    tables.load_or_build(spark, path, lambda: build().select("cell_id", "total"), ["cell_id", "total"])
    tables.load_or_build(spark, path, build, ["cell_id", "total", "n"])
    return tables.load_or_build(spark, path, never, ["cell_id", "total", "n"], derive=share)


@query("resolved_columns", "cell:l best:d",
       "SELECT c_nationkey AS cell, max(c_acctbal) AS best FROM customer GROUP BY 1")
def resolved_columns(spark, sf):
    """Key by another spelling, value by a part of its name (B2)."""
    df = table(spark, sf, "customer").select(F.col("c_nationkey").alias("HEX_ID"), F.col("c_custkey").cast("string").alias("name"), F.col("c_acctbal").alias("Mean_pred_value"))
    key = col.resolve_column(df, ["cell_id", "hex_id"])
    return df.groupBy(F.col(key).alias("cell")).agg(F.max(col.resolve_prediction_column(df)).alias("best"))
