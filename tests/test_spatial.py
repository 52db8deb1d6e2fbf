"""Neighbour search, polygons, grids and rasters against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexgale.operators import distance
from hexgale.operators import grid as gr
from hexgale.operators import neighbours
from hexgale.operators import spatial as sp
from hexgale.operators import tiles
from hexgale.operators.neighbours import nearest
from hexgale.session import cut_lineage


@pytest.mark.parametrize("leaf", [2, 9, 500])
def test_nearest_matches_brute_force(spark, leaf):
    rng = np.random.default_rng(5)
    # A dense cluster with copies holds half of the targets.
    dense = np.round(rng.normal(30, 0.5, (60, 2)) * 4) / 4
    targets = np.vstack([dense, rng.uniform(0, 300, (60, 2))])
    pts = np.vstack([rng.uniform(-50, 400, (80, 2)), dense[:20] + 0.25])
    t = spark.createDataFrame(pd.DataFrame({"tid": np.arange(120), "x": targets[:, 0], "y": targets[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"pid": np.arange(100), "x": pts[:, 0], "y": pts[:, 1]}))
    d = np.sqrt(((pts[:, None, :] - targets[None, :, :]) ** 2).sum(2))
    order = np.array([np.lexsort((np.arange(120), np.round(row, 9))) for row in d])  # ties: the lower id
    got = nearest(p, t, point="pid", target="tid", coords=["x", "y"], leaf=leaf).toPandas().set_index("pid").sort_index()
    np.testing.assert_allclose(got["distance"].to_numpy(), d.min(1))
    assert (got["target"].to_numpy() == order[:, 0]).all()
    five = nearest(p, t, point="pid", target="tid", coords=["x", "y"], k=5, leaf=leaf).toPandas().sort_values(["pid", "rank"])
    np.testing.assert_allclose(five["distance"].to_numpy().reshape(100, 5), np.sort(d, axis=1)[:, :5])
    assert (five["target"].to_numpy().reshape(100, 5) == order[:, :5]).all()
    near = nearest(p, t, point="pid", target="tid", coords=["x", "y"], within=10.0, leaf=leaf)
    assert near.count() == int((d.min(1) <= 10.0).sum())


@pytest.mark.parametrize("leaf", [1, 8])
def test_other_neighbour_counts_copies(spark, leaf):
    rows = [(1, "a", 0.0, 0.0), (2, "a", 0.0, 0.0), (3, "a", 3.0, 4.0), (4, "b", 1.0, 1.0), (5, "c", 0.0, 0.0), (6, "c", 0.0, 2.0)]
    rows += [(7, "c", None, 2.0), (8, "c", float("nan"), 2.0), (9, None, 0.0, 0.0), (10, "d", None, None)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    got = nearest(df, df, point="id", target="id", coords=["x", "y"], keys=["g"], other=True, leaf=leaf).collect()
    assert {r["id"]: (r["distance"], r["target"]) for r in got} == {
        1: (0.0, 2), 2: (0.0, 1), 3: (5.0, 1), 5: (2.0, 6), 6: (2.0, 5), **dict.fromkeys((4, 7, 8, 9, 10), (None, None))
    }
    empty = nearest(df, df.limit(0), point="id", target="id", coords=["x", "y"]).collect()
    assert len(empty) == 10 and not any(r["target"] for r in empty)


def test_nearest_keeps_leaves_small_in_a_hot_spot(spark):
    """Half of all points and targets in one spot, half of those at one place: leaves and visited pairs stay bounded."""
    rng = np.random.default_rng(8)
    spot = np.vstack([rng.normal(50, 1e-4, (1000, 2)), np.full((1000, 2), 50.0)])
    xy = np.vstack([spot, rng.uniform(0, 100, (2000, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "x": xy[:, 0], "y": xy[:, 1]})).repartition(4)
    tree = neighbours.build_tree(df, "id", ["x", "y"], keep=2)
    sizes = [r["n"] for r in tree.contents.select(F.size("_items").alias("n"), F.aggregate(F.transform("_items", lambda i: F.size(i["ids"])), F.lit(0), lambda a, b: a + b).alias("ids")).collect()]
    assert sum(sizes) == 3001 and max(sizes) <= neighbours.LEAF and len(sizes) < 3001 / 3
    got = nearest(df, df, point="id", target="id", coords=["x", "y"], other=True).toPandas().set_index("id").sort_index()
    d = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = d.min(1)
    np.testing.assert_allclose(got["distance"].to_numpy(), want, atol=1e-12)


def _inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


STAR = [(math.cos(a) * (5 if i % 2 else 2) + 10, math.sin(a) * (5 if i % 2 else 2) + 10) for i, a in enumerate(np.linspace(0, 2 * math.pi, 14, endpoint=False))]
BOX = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]


def _polygons(spark):
    rows = [(1, 0, 5, [{"x": float(x), "y": float(y)} for x, y in STAR]), (2, 0, 7, [{"x": x, "y": y} for x, y in BOX])]
    return spark.createDataFrame(rows, "poly int, part int, burn int, ring array<struct<x:double,y:double>>")


@pytest.mark.parametrize("most", [1, 4, 100])
def test_point_in_polygon(spark, most):
    rng = np.random.default_rng(1)
    pts = rng.uniform(0, 16, (300, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "x": pts[:, 0], "y": pts[:, 1]}))
    got = tiles.point_in_polygon(df, sp.edges(_polygons(spark), "poly"), point="id", polygon="poly", x="x", y="y", most=most)
    want = {(i, p) for i, (x, y) in enumerate(pts) for p, r in ((1, STAR), (2, BOX)) if _inside(r, x, y)}
    assert {(r["id"], r["poly"]) for r in got.collect()} == want


def test_rasterize(spark):
    shape = gr.Raster(0.0, 16.0, 1.0, 1.0, 16, 16)
    centre = sp.rasterize(_polygons(spark), shape, polygon="poly", order="poly", burn="burn")
    want = {}
    for p, r, b in ((1, STAR, 5), (2, BOX, 7)):
        for row in range(16):
            for c in range(16):
                if _inside(r, c + 0.5, 16 - row - 0.5):
                    want[(row, c)] = b
    assert {(r["row"], r["col"]): r["value"] for r in centre.collect()} == want
    touched = sp.rasterize(_polygons(spark), shape, polygon="poly", order="poly", burn="burn", all_touched=True)
    cells = {(r["row"], r["col"]) for r in touched.collect()}
    # Brute force: cells hit by a dense walk along the edges.
    walked = set()
    for ring in (STAR, BOX):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            for t in np.linspace(0, 1, 4001):
                x, y = x1 + (x2 - x1) * t, y1 + (y2 - y1) * t
                walked.add((math.floor(16 - y), math.floor(x)))
    inside = {k for k in walked if 0 <= k[0] < 16 and 0 <= k[1] < 16}
    assert set(want) | inside <= cells
    # Nothing beyond one cell of slack for edges that run along a cell border.
    assert all(any(abs(r - a) <= 1 and abs(c - b) <= 1 for a, b in inside | set(want)) for r, c in cells)


def test_measures_and_parts(spark):
    m = {r["poly"]: r for r in sp.polygon_measures(_polygons(spark), "poly", "part").collect()}
    assert m[2]["area"] == pytest.approx(64) and (m[2]["centroid_x"], m[2]["centroid_y"]) == pytest.approx((5, 5))
    flat = spark.createDataFrame([(3, 0, [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}])], "poly int, part int, ring array<struct<x:double,y:double>>")
    r = sp.polygon_measures(flat, "poly", "part").first()
    assert (r["centroid_x"], r["centroid_y"]) == (1.0, 0.0)
    assert sp.keep_parts(_polygons(spark), "poly", "part", 60.0).count() == 1


def test_hexagon_assignment_is_nearest_centre(spark):
    hexes = gr.HexGrid.over((5.0, 45.0, 10.0, 50.0), 5000.0)
    table = gr.hex_grid(spark, hexes).toPandas()
    assert (table.sort_values(["q", "r"])["hex_id"].to_numpy() == np.arange(len(table))).all()
    rng = np.random.default_rng(2)
    x, y = rng.uniform(hexes.xmin, hexes.xmax, 200), rng.uniform(hexes.ymin, hexes.ymax, 200)
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "x": x, "y": y}))
    got = gr.assign_hexagon(pts, gr.hex_grid(spark, hexes), hexes, "x", "y").toPandas().sort_values("id")
    d = (x[:, None] - table["cx"].to_numpy()) ** 2 + (y[:, None] - table["cy"].to_numpy()) ** 2
    assert (got["hex_id"].to_numpy() == table["hex_id"].to_numpy()[d.argmin(1)]).all()


def test_focal_std_and_missing(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(1000, 1010, (6, 7))
    a[0:4, 0:4] = 5.0
    shape = gr.Raster(0, 6, 1, 1, 6, 7)
    rows = [(i, j, float(a[i, j])) for i in range(6) for j in range(7)]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    for size in (3, 5):
        h = size // 2
        padded = np.pad(a, h, mode="edge")
        want = np.array([[padded[i : i + size, j : j + size].std() for j in range(7)] for i in range(6)])
        got = gr.focal_std(df, "value", size, shape).toPandas().pivot(index="row", columns="col", values="focal_std").to_numpy()
        np.testing.assert_allclose(got, want, atol=1e-6)
    holed = df.withColumn("value", F.when(~((F.col("row") == 4) & (F.col("col") == 5)), F.col("value")))
    got = gr.focal_std(holed, "value", 3, shape).where("focal_std IS NULL").select("row", "col").collect()
    assert {(r["row"], r["col"]) for r in got} == {(r, c) for r in (3, 4, 5) for c in (4, 5, 6)}


def test_slope_of_a_plane(spark):
    # Rises 1 per unit to the east: slope 45 degrees, facing west.
    df = spark.createDataFrame([(i, j, float(j)) for i in range(4) for j in range(4)], "row int, col int, value double")
    r = gr.slope_aspect(df, "value", gr.Raster(0, 4, 1, 1, 4, 4)).where("row = 1 AND col = 1").first()
    assert r["slope"] == pytest.approx(45) and r["aspect"] == pytest.approx(270)
    edge = gr.slope_aspect(df, "value", gr.Raster(0, 4, 1, 1, 4, 4)).where("row = 0 AND col = 1").first()
    assert edge["slope"] is None


def test_ring_of_many_edges_meets_few_of_them(spark):
    """A ring of 100,000 edges with spikes: a point is tested against the edges of one tile, and exactly."""
    n = 100_000
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 40 + 5 * np.sin(9 * angle) + rng.uniform(-0.5, 0.5, n)
    vx, vy = 50 + radius * np.cos(angle), 50 + radius * np.sin(angle)
    ring = spark.createDataFrame(pd.DataFrame({"poly": 1, "x1": vx, "y1": vy, "x2": np.roll(vx, -1), "y2": np.roll(vy, -1)}))
    near = rng.integers(0, n, 300)
    pts = np.vstack([rng.uniform(0, 100, (500, 2)), np.stack([vx[near], vy[near]], 1) + rng.normal(0, 0.2, (300, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(800), "x": pts[:, 0], "y": pts[:, 1]}))
    got = {r["id"] for r in tiles.point_in_polygon(df, ring, point="id", polygon="poly", x="x", y="y").collect()}
    x2, y2 = np.roll(vx, -1), np.roll(vy, -1)
    want = set()
    for i, (x, y) in enumerate(pts):
        span = (vy > y) != (y2 > y)
        if (span.sum() and (x < (x2[span] - vx[span]) * (y - vy[span]) / (y2[span] - vy[span]) + vx[span]).sum() % 2):
            want.add(i)
    assert got == want
    _, tiled, levels, several = tiles.tile_polygons(ring, "poly")
    assert not several and max(r["n"] for r in tiled.select(F.size("edges").alias("n")).collect()) <= tiles.MOST
    assert tiled.count() < n


def test_edges_through_one_spot(spark):
    """Very many edges meet at one place, which no tile can separate; holes and touching rings of one polygon."""
    fan = []
    for i in range(400):
        a, b = 2 * math.pi * i / 400, 2 * math.pi * (i + 0.5) / 400
        p, q, r = (5.0, 5.0), (5 + 4 * math.cos(a), 5 + 4 * math.sin(a)), (5 + 4 * math.cos(b), 5 + 4 * math.sin(b))
        fan += [(1, *p, *q), (1, *q, *r), (1, *r, *p)]
    hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)]
    rings = [(2, *a, *b) for ring in hole for a, b in zip(ring, ring[1:] + ring[:1])]
    edges = [(k, *map(float, e)) for k, *e in fan + rings]
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.uniform(-1, 11, (400, 2)), 5 + rng.normal(0, 1e-6, (100, 2)), [[2.0, 2.0], [8.0, 8.0], [5.0, 5.0], [10.0, 5.0], [0.0, 0.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id int, x double, y double")
    e = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["id"], r["poly"]) for r in tiles.point_in_polygon(df, e, point="id", polygon="poly", x="x", y="y").collect()}
    want = set()
    for i, (x, y) in enumerate(pts):
        for poly in (1, 2):
            hits = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for k, x1, y1, x2, y2 in edges if k == poly)
            if hits % 2:
                want.add((i, poly))
    assert got == want
    assert tiles.point_in_polygon(df, e.limit(0), point="id", polygon="poly", x="x", y="y").count() == 0


def test_boxes_of_all_sizes(spark):
    """Sizes over five orders of magnitude, points as boxes, reversed and missing bounds; rows per box are bounded."""
    rng = np.random.default_rng(2)
    def some(n, key):
        xy, half = rng.uniform(0, 1000, (n, 2)), 10 ** rng.uniform(-3, 2.3, (n, 2))
        half[: n // 10] = 0
        b = [(i, float(x - w), float(x + w), float(y - h), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(xy, half))]
        return [*b, (n, None, 1.0, 0.0, 1.0), (n + 1, 5.0, 1.0, 0.0, 1.0)], f"{key} int, xmin double, xmax double, ymin double, ymax double"
    (a, schema_a), (b, schema_b) = some(300, "k"), some(250, "m")
    got = tiles.boxes_overlap(spark.createDataFrame(a, schema_a), spark.createDataFrame(b, schema_b), left_key="k", right_key="m").collect()
    want = {(i, j) for i, *p in a[:300] for j, *q in b[:250] if p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("cells", [37, 10**6])
def test_distance_raster(spark, cells):
    shape = gr.Raster(0.0, 0.0, 2.0, 3.0, 23, 31)
    rng = np.random.default_rng(4)
    for n in (1, 3, 40):
        hits = [(int(r), int(c)) for r, c in zip(rng.integers(-2, 26, n), rng.integers(-2, 33, n))] + [(5, 7)] * 3
        known = np.array([(r, c) for r, c in hits if 0 <= r < 23 and 0 <= c < 31], dtype=float)
        got = {(r["row"], r["col"]): r["distance"] for r in distance.distance_raster(spark.createDataFrame(hits, "row int, col int"), shape, cells=cells).collect()}
        assert len(got) == 23 * 31
        for (r, c), d in got.items():
            assert d == pytest.approx(np.sqrt((3 * (known[:, 0] - r)) ** 2 + (2 * (known[:, 1] - c)) ** 2).min())
    none = distance.binned(distance.distance_raster(spark.createDataFrame([], "row int, col int"), shape), [1.0]).collect()
    assert len(none) == 23 * 31 and {(r["distance"], r["dist_bin"]) for r in none} == {(None, 2)}


def test_points_of_a_search_are_spread(spark, monkeypatch):
    """The walk of few bytes per point runs on all cores, however few partitions the points came in."""
    pts = spark.range(400).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y")).coalesce(1)
    kept = []
    monkeypatch.setattr(neighbours, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    found = neighbours.nearest(pts, pts, point="id", target="id", coords=["x", "y"], other=True)
    asked = [df for df in kept if df.columns == ["id", "_p_x", "_p_y"]]
    assert asked and asked[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.count() == 400
