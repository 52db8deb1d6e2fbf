"""Neighbours of events, point in polygon, rasterising and polygon measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.functions.scalar import EARTH_RADIUS_KM
from hexgale.operators import tiles
from hexgale.operators.neighbours import nearest
from hexgale.operators.ordered import MAX_GROUP, quantiles

DISTANCE_BINS_KM = [1.0, 5.0, 20.0]


def nearest_event(
    points: DataFrame, events: DataFrame, *, point: str, event: str, x: str, y: str, attributes: Sequence[str]
) -> DataFrame:
    """Nearest event of each point with its distance in km and attributes (C8); points without coordinates keep NULLs."""
    found = nearest(points, events, point=point, target=event, coords=[x, y])
    named = found.withColumnRenamed("target", event).withColumn("ref_event_dist_km", F.col("distance") / 1000.0)
    return named.drop("distance").join(events.select(event, *attributes), event, "left")


def distance_bin(
    cells: DataFrame, positives: DataFrame, *, cell: str, positive: str, x: str, y: str, bins_km: Sequence[float] = DISTANCE_BINS_KM
) -> DataFrame:
    """Distance to the nearest positive cell in right-closed km bins, the last bin open.

    Only distances up to the last finite edge matter, so the search stops there.
    """
    found = nearest(cells, positives, point=cell, target=positive, coords=[x, y], within=bins_km[-1] * 1000.0)
    km = F.col("distance") / 1000.0
    number = F.lit(len(bins_km) + 1)
    for i in range(len(bins_km) - 1, -1, -1):
        number = F.when(F.col("dist_km") <= bins_km[i], F.lit(i + 1)).otherwise(number)
    binned = cells.join(found.select(cell, km.alias("dist_km")), cell, "left")
    return binned.withColumn("dist_bin", F.when(F.col("dist_km").isNull(), F.lit(len(bins_km) + 1)).otherwise(number))


def with_sphere(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Unit-sphere coordinates: chord length orders points as great-circle distance does."""
    lo, la = F.radians(lon), F.radians(lat)
    return df.withColumns({"_sx": F.cos(la) * F.cos(lo), "_sy": F.cos(la) * F.sin(lo), "_sz": F.sin(la)})


def neighbour_km(df: DataFrame, *, key: str, group: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Great-circle distance of each point to the nearest other point of its group (C9), NULL where there is none."""
    pts = with_sphere(df, lon, lat)
    found = nearest(pts, pts, point=key, target=key, coords=["_sx", "_sy", "_sz"], keys=[group], other=True)
    chord = F.least(F.col("distance") / 2.0, F.lit(1.0))
    return found.select(key, (F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(chord)).alias("nearest_km"))


def group_dispersion(
    df: DataFrame, *, key: str, group: str, area: str, method: str, lon: str = "lon", lat: str = "lat",
    cell_degrees: float = 0.25, max_group: int = MAX_GROUP,
) -> DataFrame:
    """Count, median area, mean neighbour distance, occupied cells and commonest method per group."""
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_polygons"))
    median = quantiles(df, [group], area, {"median_polygon_area": 0.5}, max_group=max_group)
    near = df.select(key, group).join(neighbour_km(df, key=key, group=group, lon=lon, lat=lat), key)
    near = near.groupBy(group).agg(F.avg("nearest_km").alias("mean_nearest_neighbour_km"))
    cells = (
        df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .groupBy(group, F.floor(F.col(lon) / cell_degrees).alias("_x"), F.floor(F.col(lat) / cell_degrees).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("occupied_cells"))
    )
    name = F.coalesce(F.col(method).cast("string"), F.lit(""))
    methods = df.groupBy(group, name.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    common = methods.groupBy(group).agg(F.max("_n").alias("_n"))
    common = methods.join(common, [group, "_n"]).groupBy(group).agg(F.min("_m").alias("predominant_method"))
    out = base
    for part in (median, near, cells, common):
        out = out.join(part, group, "left")
    return out.withColumn("occupied_cells_per_1000", F.col("occupied_cells") / F.col("n_polygons") * 1000)


# --- polygons -------------------------------------------------------------------------------------


def edges(polygons: DataFrame, key: str, ring: str = "ring", keep: Sequence[str] = ()) -> DataFrame:
    """One row per polygon edge; rings may be open or closed."""
    n = F.size(ring)
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")),
    )
    return (
        polygons.select(key, *keep, F.explode(pairs).alias("e"))
        .select(key, *keep, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
        .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polygons.withColumns(
        {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}
    )


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, *, point: str, polygon: str, x: str, y: str, ring: str = "ring"
) -> DataFrame:
    """(point, polygon) rows for points inside by the crossing rule over all rings of a polygon id."""
    return tiles.point_in_polygon(points, edges(polygons, polygon, ring), point=point, polygon=polygon, x=x, y=y)


def inside_any(points: DataFrame, polygons: DataFrame, **kw) -> DataFrame:
    """Points inside the union of polygons (C15): no overlay geometry needed."""
    hits = point_in_polygon(points, polygons, **kw)
    return points.join(hits.select(kw["point"]).distinct(), kw["point"], "left_semi")


def touched_cells(polygons: DataFrame, polygon: str, shape, ring: str = "ring") -> DataFrame:
    """Raster cells any polygon edge passes through: each edge is cut by row band, then by column."""
    e = edges(polygons, polygon, ring)
    r1, r2 = shape.row(F.greatest("y1", "y2")), shape.row(F.least("y1", "y2"))
    rows = e.withColumn("row", F.explode(F.sequence(r1, r2)))
    top = F.lit(shape.y0) - F.col("row") * F.lit(shape.dy)
    ya, yb = F.least(F.greatest("y1", "y2"), top), F.greatest(F.least("y1", "y2"), top - F.lit(shape.dy))
    flat = F.col("y1") == F.col("y2")

    def x_at(yy: Column) -> Column:
        return F.col("x1") + (F.col("x2") - F.col("x1")) * F.coalesce(F.try_divide(yy - F.col("y1"), F.col("y2") - F.col("y1")), F.lit(0.0))

    xa = F.when(flat, F.col("x1")).otherwise(x_at(ya))
    xb = F.when(flat, F.col("x2")).otherwise(x_at(yb))
    cols = rows.withColumn("col", F.explode(F.sequence(shape.col(F.least(xa, xb)), shape.col(F.greatest(xa, xb)))))
    inside = F.col("row").between(0, shape.rows - 1) & F.col("col").between(0, shape.cols - 1)
    return cols.where(inside).select(polygon, "row", "col").distinct()


def rasterize(
    polygons: DataFrame, shape, *, polygon: str, order: str, burn: str, all_touched: bool = False, ring: str = "ring"
) -> DataFrame:
    """Cells covered by polygons with the burn value of the last polygon in ``order``.

    Centre rule by default, ``all_touched`` adds the cells edges pass through. Candidate cells come from
    each polygon's bounding box, so the work follows the covered area and not the raster.
    """
    boxes = bounds(polygons, ring)
    row0 = F.greatest(shape.row(F.col("ymax")), F.lit(0))
    row1 = F.least(shape.row(F.col("ymin")), F.lit(shape.rows - 1))
    col0 = F.greatest(shape.col(F.col("xmin")), F.lit(0))
    col1 = F.least(shape.col(F.col("xmax")), F.lit(shape.cols - 1))
    cells = (
        boxes.where((row0 <= row1) & (col0 <= col1))
        .select(F.explode(F.sequence(row0, row1)).alias("row"), col0.alias("_c0"), col1.alias("_c1"))
        .select("row", F.explode(F.sequence("_c0", "_c1")).alias("col"))
        .distinct()
        .withColumns({"_cell": F.struct("row", "col"), "_cx": shape.centre_x(F.col("col")), "_cy": shape.centre_y(F.col("row"))})
    )
    hits = point_in_polygon(cells, polygons, point="_cell", polygon=polygon, x="_cx", y="_cy", ring=ring).select(
        polygon, "_cell.row", "_cell.col"
    )
    if all_touched:
        hits = hits.unionByName(touched_cells(polygons, polygon, shape, ring))
    attributes = polygons.select(polygon, F.struct(F.col(order).alias("o"), F.col(polygon).alias("p"), F.col(burn).alias("b")).alias("_o")).distinct()
    return hits.join(attributes, polygon).groupBy("row", "col").agg(F.max("_o").alias("_o")).select("row", "col", F.col("_o.b").alias("value"))


def polygon_measures(polygons: DataFrame, polygon: str, part: str, ring: str = "ring") -> DataFrame:
    """Signed area and centroid over all rings; the vertex mean for degenerate shapes."""
    e = edges(polygons, polygon, ring, keep=[part])
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = e.groupBy(polygon, part).agg(
        (F.sum(cross) / 2).alias("_a"),
        (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("_cx"),
        (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("_cy"),
    )
    real = F.abs("_a") >= 1e-16
    sums = rings.groupBy(polygon).agg(*[F.sum(F.when(real, F.col(c))).alias(c) for c in ("_a", "_cx", "_cy")])
    vertices = polygons.select(polygon, F.explode(ring).alias("v")).groupBy(polygon).agg(
        F.avg("v.x").alias("_mx"), F.avg("v.y").alias("_my")
    )
    solid = F.abs("_a") > 1e-16
    return vertices.join(sums, polygon, "left").select(
        polygon,
        F.abs("_a").alias("area"),
        F.when(solid, F.try_divide("_cx", "_a")).otherwise(F.col("_mx")).alias("centroid_x"),
        F.when(solid, F.try_divide("_cy", "_a")).otherwise(F.col("_my")).alias("centroid_y"),
    )


def keep_parts(polygons: DataFrame, polygon: str, part: str, minimum: float, ring: str = "ring") -> DataFrame:
    """Polygon parts of at least a minimum area."""
    e = edges(polygons, polygon, ring, keep=[part])
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    areas = e.groupBy(polygon, part).agg((F.abs(F.sum(cross)) / 2).alias("part_area"))
    return polygons.join(areas.where(F.col("part_area") >= minimum), [polygon, part])


def foreign_in_rectangle(df: DataFrame, lon: str, lat: str, bbox: tuple[float, float, float, float], group: str, own: str) -> DataFrame:
    """Points inside a rectangle that belong to another group."""
    return df.where(F.col(lon).between(bbox[0], bbox[2]) & F.col(lat).between(bbox[1], bbox[3]) & (F.col(group) != own))
