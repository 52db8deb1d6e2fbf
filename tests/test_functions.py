"""Scalar functions, projection and traps."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexgale.functions import columns as col
from hexgale.functions import projection as pj
from hexgale.functions import scalar as fs
from hexgale.functions.aggregates import weighted_mean, weighted_pearson


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_direction(spark):
    r = one(spark, *[fs.wind_from_direction(F.lit(u), F.lit(v)).alias(n) for n, u, v in [("n", 0.0, -1.0), ("e", -1.0, 0.0), ("s", 0.0, 1.0)]])
    assert (r["n"], r["e"], r["s"]) == pytest.approx((0, 90, 180))


def test_flat_ground_has_no_exposure(spark):
    r = one(
        spark, fs.windwardness(F.lit(0.9), F.lit(10.0), F.lit(10.0)).alias("w"), fs.exposure(F.lit(0.9), F.lit(10.0), F.lit(10.0)).alias("e"),
        fs.exposure(F.lit(30.0), F.lit(10.0), F.lit(10.0)).alias("full"), fs.exposure(F.lit(30.0), F.lit(190.0), F.lit(10.0)).alias("lee"),
        fs.exposure(F.lit(30.0), F.lit(None).cast("double"), F.lit(10.0)).alias("missing"),
    )
    assert r["w"] == 0 and r["e"] == 0 and r["full"] == pytest.approx(0.5) and r["lee"] == 0 and r["missing"] is None


def test_month_circle(spark):
    pairs = [(1, 12, 1, 1), (12, 1, 1, -1), (1, 7, 6, -6), (7, 1, 6, 6), (3, 3, 0, 0)]
    for a, b, d, s in pairs:
        r = one(spark, fs.circular_month_distance(F.lit(a), F.lit(b)).alias("d"), fs.signed_month_shift(F.lit(a), F.lit(b)).alias("s"))
        assert (r["d"], r["s"]) == (d, s)


def test_names(spark):
    r = one(
        spark, fs.month_name(F.lit(12.6)).alias("m"), fs.date_from_name(F.lit("ForestLAI_20030117.tif")).alias("d"),
        fs.year_from_name(F.lit("disturbance_1999_x")).alias("y"), fs.chunk_key(F.lit("u_era5_chunk_2001-01-01_a.nc")).alias("k"),
        fs.background_label(F.lit("same_month")).alias("b"), fs.background_label(F.lit("other_one")).alias("o"),
    )
    assert r["m"] == "Dec" and str(r["d"]) == "2003-01-17" and r["y"] == 1999
    assert r["k"] == "era5_chunk_2001-01-01_a" and r["b"] == "same-month background" and r["o"] == "other-one"


def test_projection_check_point(spark):
    # Published example of the projection: 50 N 5 E.
    x, y = pj.laea_forward(F.lit(5.0), F.lit(50.0))
    r = one(spark, x.alias("x"), y.alias("y"))
    assert r["x"] == pytest.approx(3962799.45, abs=0.01) and r["y"] == pytest.approx(2999718.85, abs=0.01)
    assert pj.point_laea(5.0, 50.0) == pytest.approx((r["x"], r["y"]))


def test_projection_round_trip(spark):
    grid = spark.range(40 * 80).select((F.col("id") % 80 - 30.0).alias("lon"), (F.floor(F.col("id") / 80) + 32.0).alias("lat"))
    x, y = pj.laea_forward(F.col("lon"), F.col("lat"))
    g = grid.withColumns({"x": x, "y": y})
    lon, lat = pj.laea_inverse(F.col("x"), F.col("y"))
    worst = g.select(F.max(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))))).first()[0]
    assert worst < 1e-9  # a tenth of a millimetre


def test_cell_area_sums_to_the_ellipsoid(spark):
    cells = spark.range(180).select((F.col("id") - 90.0).alias("s"))
    total = cells.select(F.sum(pj.cell_area_km2(F.col("s"), F.col("s") + 1, F.lit(-180.0), F.lit(180.0)))).first()[0]
    assert total == pytest.approx(510065621.7, rel=1e-6)


@settings(max_examples=20, deadline=None)
@given(st.floats(1.0, 1e5))
def test_hexagon_area(area):
    s = pj.hexagon_side(area)
    assert 3 * math.sqrt(3) / 2 * s * s / 1e6 == pytest.approx(area)


def test_resolver_order(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "HEX_ID int, my_pred double, other double")
    assert col.resolve_column(df, ["hex_id"]) == "HEX_ID"
    assert col.resolve_column(df, ["pred"]) == "my_pred"
    assert col.resolve_column(df, ["zzz"], required=False) is None
    assert col.resolve_prediction_column(df) == "my_pred"
    with pytest.raises(KeyError):
        col.resolve_column(df, ["zzz"])


def test_coercion(spark):
    df = spark.createDataFrame([("7", "x"), ("8.0", None), ("bad", "1")], "id string, c string")
    assert sorted(r["hex_id"] for r in col.whole_key(df, "id").collect()) == [7, 8]
    assert col.first_numeric(df, ["nope", "c", "id"]) == "c"
    assert col.harmonise(spark.createDataFrame([(1, 2)], "index int, sample_id int")).columns == ["sample_id"]
    assert col.guess_crs((-10, 30, 40, 70)) == "EPSG:4326" and col.guess_crs((2e6, 1e6, 5e6, 5e6)) == "EPSG:3035"


def test_weights(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, 6.0, 1.0), (5.0, 10.0, 0.0), (float("nan"), 1.0, 1.0)], "x double, y double, w double")
    assert df.agg(weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.0
    assert df.agg(weighted_pearson(F.col("x"), F.col("y"), F.col("w"))).first()[0] is None  # two valid rows
    three = df.withColumn("w", F.lit(1.0))
    assert three.agg(weighted_pearson(F.col("x"), F.col("y"), F.col("w"))).first()[0] == pytest.approx(1.0)
    flat = three.withColumn("x", F.lit(0.1))
    assert flat.agg(weighted_pearson(F.col("x"), F.col("y"), F.col("w"))).first()[0] is None
