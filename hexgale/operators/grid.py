"""Hexagon grid, raster lookups, regridding and stencils."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexgale.functions.projection import cell_area_km2, hexagon_side, point_laea
from hexgale.functions.scalar import hexagon_wkt
from hexgale.operators.series import nearest_layer


@dataclass(frozen=True)
class HexGrid:
    """Flat-top hexagon grid over a lon/lat box: origin, side and extent in projected metres."""

    side: float
    cx0: float
    cy0: float
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    @classmethod
    def over(cls, bbox: tuple[float, float, float, float], area_km2: float) -> HexGrid:
        """Grid parameters from (min lon, min lat, max lon, max lat); numbering depends on the box."""
        corners = [point_laea(lon, lat) for lon in (bbox[0], bbox[2]) for lat in (bbox[1], bbox[3])]
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        return cls(
            hexagon_side(area_km2), (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, min(xs), max(xs), min(ys), max(ys)
        )

    @property
    def q_max(self) -> int:
        return math.ceil((self.xmax - self.xmin) / (1.5 * self.side)) + 4

    @property
    def r_max(self) -> int:
        return math.ceil((self.ymax - self.ymin) / (math.sqrt(3) * self.side)) + 4

    def centre(self, q: Column, r: Column) -> tuple[Column, Column]:
        x = F.lit(self.cx0) + F.lit(1.5 * self.side) * q
        y = F.lit(self.cy0) + F.lit(math.sqrt(3) * self.side) * (r + q / F.lit(2.0))
        return x, y

    def axial(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Axial coordinates of the hexagon that holds a projected point (I3): cube rounding."""
        q = (x - F.lit(self.cx0)) / F.lit(1.5 * self.side)
        r = (y - F.lit(self.cy0)) / F.lit(math.sqrt(3) * self.side) - q / F.lit(2.0)
        s = -q - r
        rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        fix_q = (dq > dr) & (dq > ds)
        # Never NULL: a NOT NULL filter on the join key would otherwise be pushed below the projection
        # and repeat the whole expression. Points without coordinates get a column no grid has.
        nowhere = F.lit(-(2**31) + 1)
        return (
            F.coalesce(F.when(fix_q, -rr - rs).otherwise(rq).cast("int"), nowhere),
            F.coalesce(F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("int"), nowhere),
        )


def hex_grid(spark: SparkSession, grid: HexGrid) -> DataFrame:
    """All hexagons whose centre is within two sides of the box, numbered in (q, r) order.

    Numbers are counts per q column plus the place inside it, so no window spans the grid.
    """
    q_max, r_max = grid.q_max, grid.r_max
    cells = spark.range(-q_max, q_max + 1).select(
        F.col("id").cast("int").alias("q"), F.explode(F.sequence(F.lit(-r_max), F.lit(r_max))).alias("r")
    )
    cx, cy = grid.centre(F.col("q"), F.col("r"))
    pad = 2 * grid.side
    kept = cells.withColumns({"cx": cx, "cy": cy}).where(
        F.col("cx").between(grid.xmin - pad, grid.xmax + pad) & F.col("cy").between(grid.ymin - pad, grid.ymax + pad)
    )
    columns = kept.groupBy("q").agg(F.count(F.lit(1)).alias("_n"))
    before = columns.select(
        "q", F.coalesce(F.sum("_n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b")
    )
    place = F.row_number().over(Window.partitionBy("q").orderBy("r")) - 1
    return kept.join(before, "q").select((F.col("_b") + place).alias("hex_id"), "q", "r", "cx", "cy")


def with_wkt(hexes: DataFrame, grid: HexGrid) -> DataFrame:
    return hexes.withColumn("wkt", hexagon_wkt(F.col("cx"), F.col("cy"), grid.side))


def assign_hexagon(points: DataFrame, hexes: DataFrame, grid: HexGrid, x: str, y: str) -> DataFrame:
    """Hexagon of each projected point by arithmetic and an equi join, points off the grid dropped (C14)."""

    def key(q: Column, r: Column) -> Column:
        return q.cast("long") * F.lit(2**32) + r

    # One key column: with q and r as keys Catalyst would copy the grid's range filters onto the points
    # and evaluate the rounding once more for each of them.
    cells = hexes.select(key(F.col("q"), F.col("r")).alias("_key"), "hex_id")
    return points.withColumn("_key", key(*grid.axial(F.col(x), F.col(y)))).join(cells, "_key").drop("_key")


def area_weight(forest_area: str | None, polygon_area: str | None) -> Column:
    """Forest area, else polygon area, else 1; not positive becomes missing (I16)."""
    options = [F.col(c).cast("double") for c in (forest_area, polygon_area) if c]
    w = F.coalesce(*options, F.lit(1.0))
    return F.when(w > 0, w)


@dataclass(frozen=True)
class Raster:
    """Regular raster: north-west corner, pixel size and shape."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / F.lit(self.dy)).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def centre_x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def centre_y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + F.lit(0.5)) * F.lit(self.dy)


def value_at_points(
    points: DataFrame, raster: DataFrame, shape: Raster, x: str, y: str, value: str, *, name: str, clamp: bool = False
) -> DataFrame:
    """Raster value under each point: NULL outside, or the edge value with ``clamp``."""
    r, c = shape.row(F.col(y)), shape.col(F.col(x))
    if clamp:
        r = F.greatest(F.least(r, F.lit(shape.rows - 1)), F.lit(0))
        c = F.greatest(F.least(c, F.lit(shape.cols - 1)), F.lit(0))
    keyed = points.withColumns({"_row": r, "_col": c})
    cells = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(name))
    return keyed.join(cells, ["_row", "_col"], "left").drop("_row", "_col")


def yearly_value_at_points(
    points: DataFrame, raster: DataFrame, shape: Raster, x: str, y: str, year: str, value: str,
    *, name: str, years: tuple[int, int],
) -> DataFrame:
    """Value of the raster of the point's year, NULL outside the covered years."""
    keyed = points.withColumns(
        {
            "_row": shape.row(F.col(y)),
            "_col": shape.col(F.col(x)),
            "_yr": F.when(F.col(year).between(*years), F.col(year)),
        }
    )
    cells = raster.where(F.col("year").between(*years)).select(
        F.col("year").alias("_yr"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(name)
    )
    return keyed.join(cells, ["_yr", "_row", "_col"], "left").drop("_yr", "_row", "_col")


def nearest_node(points: DataFrame, nodes: DataFrame, shape: Raster, x: str, y: str, values: Sequence[str]) -> DataFrame:
    """Value at the nearest grid node, edge nodes for points outside (C6, nearest case of I6)."""
    r = F.greatest(F.least(shape.row(F.col(y)), F.lit(shape.rows - 1)), F.lit(0))
    c = F.greatest(F.least(shape.col(F.col(x)), F.lit(shape.cols - 1)), F.lit(0))
    keyed = points.withColumns({"_row": r, "_col": c})
    cells = nodes.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *values)
    return keyed.join(cells, ["_row", "_col"], "left").drop("_row", "_col")


def block_average(
    pixels: DataFrame, coarse: Raster, x: str, y: str, value: str, *, minimum: float = 0.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Average of the fine pixels in each coarse cell, clipped to 0-1, cells at or above a minimum (I4)."""
    cells = pixels.withColumns({"row": coarse.row(F.col(y)), "col": coarse.col(F.col(x))})
    inside = cells.where(F.col("row").between(0, coarse.rows - 1) & F.col("col").between(0, coarse.cols - 1))
    share = F.greatest(F.least(F.avg(value), F.lit(1.0)), F.lit(0.0))
    return inside.groupBy(*keys, "row", "col").agg(share.alias("fraction")).where(F.col("fraction") >= minimum)


def axis_overlaps(spark, count: int, start: float, step: float, to_count: int, to_start: float, to_step: float) -> DataFrame:
    """(at, to, length): how much of each source interval along an axis lies in each target interval.

    Source intervals run from ``start`` in steps of ``step``; a source interval meets a run of consecutive targets.
    Overlaps that are only rounding of touching edges do not count.
    """
    low = F.lit(start) + F.col("at") * F.lit(step)
    high = F.lit(start) + (F.col("at") + 1) * F.lit(step)
    first = F.greatest(F.floor((low - F.lit(to_start)) / F.lit(to_step)).cast("int"), F.lit(0))
    last = F.least(F.floor((high - F.lit(to_start)) / F.lit(to_step)).cast("int"), F.lit(to_count - 1))
    runs = spark.range(count).select(F.col("id").cast("int").alias("at")).where(first <= last)
    to_low = F.lit(to_start) + F.col("to") * F.lit(to_step)
    to_high = F.lit(to_start) + (F.col("to") + 1) * F.lit(to_step)
    length = F.least(high, to_high) - F.greatest(low, to_low)
    return runs.withColumn("to", F.explode(F.sequence(first, last))).withColumn("length", length).where(F.col("length") > F.lit(1e-9 * min(step, to_step)))


def area_average(
    pixels: DataFrame, fine: Raster, coarse: Raster, value: str, *, minimum: float | None = None, keys: Sequence[str] = (),
    row: str = "row", col: str = "col",
) -> DataFrame:
    """Average of fine pixels in each coarse cell, weighted by the area they share, clipped to 0-1 (I4).

    Grids need not nest. The weight of a pixel is the product of its overlaps along the two axes, so the regrid goes
    along one axis and then along the other: each step joins a table of one axis and adds up before the next shuffle.
    Missing pixels have no weight; ``minimum`` keeps cells at or above a share.
    """
    spark = pixels.sparkSession
    across = axis_overlaps(spark, fine.cols, fine.x0, fine.dx, coarse.cols, coarse.x0, coarse.dx)
    # Rows run downwards: measured from the top of the coarse grid.
    down = axis_overlaps(spark, fine.rows, coarse.y0 - fine.y0, fine.dy, coarse.rows, 0.0, coarse.dy)
    known = pixels.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(value).cast("double").alias("_v"))
    known = known.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    x = across.select(F.col("at").alias("_c"), F.col("to").alias("col"), F.col("length").alias("_x"))
    y = down.select(F.col("at").alias("_r"), F.col("to").alias("row"), F.col("length").alias("_y"))
    strips = known.join(x, "_c").groupBy(*keys, "_r", "col").agg(F.sum(F.col("_x") * F.col("_v")).alias("_s"), F.sum("_x").alias("_w"))
    cells = strips.join(y, "_r").groupBy(*keys, "row", "col").agg(
        (F.sum(F.col("_y") * F.col("_s")) / F.sum(F.col("_y") * F.col("_w"))).alias("_m")
    )
    out = cells.select(*keys, "row", "col", F.greatest(F.least("_m", F.lit(1.0)), F.lit(0.0)).alias("fraction"))
    return out if minimum is None else out.where(F.col("fraction") >= minimum)


def bilinear(targets: DataFrame, raster: DataFrame, shape: Raster, key: str, x: str, y: str, value: str) -> DataFrame:
    """Bilinear value at target nodes from the four surrounding pixel centres with data."""
    fx = (F.col(x) - F.lit(shape.x0)) / F.lit(shape.dx) - F.lit(0.5)
    fy = (F.lit(shape.y0) - F.col(y)) / F.lit(shape.dy) - F.lit(0.5)
    base = targets.select(key, fx.alias("fx"), fy.alias("fy")).withColumns(
        {"c0": F.floor("fx").cast("int"), "r0": F.floor("fy").cast("int")}
    )
    wx, wy = F.col("fx") - F.col("c0"), F.col("fy") - F.col("r0")
    corners = F.array(
        *[
            F.struct(
                (F.col("r0") + i).alias("row"),
                (F.col("c0") + j).alias("col"),
                ((wy if i else 1 - wy) * (wx if j else 1 - wx)).alias("w"),
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    near = base.select(key, F.explode(corners).alias("n")).select(key, "n.row", "n.col", "n.w").where(F.col("w") > 0)
    joined = near.join(raster.where(F.col(value).isNotNull()).select("row", "col", value), ["row", "col"])
    out = joined.groupBy(key).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("bilinear"))
    return targets.join(out, key, "left")


def focal_std(raster: DataFrame, value: str, size: int, shape: Raster, *, name: str = "focal_std") -> DataFrame:
    """Population std in a size x size window, edges repeated, NULL where any pixel is missing (I8).

    Separable: sums run along the row and then along the column, two shuffles of the raster instead of
    size*size copies. Values are centred on the raster mean against cancellation.
    """
    half = size // 2

    def along(df: DataFrame, line: str, place: str, n: int, columns: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(line).orderBy(place)
        near = w.rangeBetween(-half, half)
        whole = w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # How often the first and the last pixel of the line stand in for pixels outside.
        low = F.greatest(F.lit(half) - F.col(place), F.lit(0))
        high = F.greatest(F.col(place) - F.lit(n - 1 - half), F.lit(0))
        sums = [c for c in columns if c not in ("_lo", "_hi")]
        return df.withColumns(
            {c: F.sum(c).over(near) + low * F.first(c).over(whole) + high * F.last(c).over(whole) for c in sums}
            | {"_lo": F.min("_lo").over(near), "_hi": F.max("_hi").over(near)}
        )

    offset = raster.agg(F.avg(value).alias("m")).scalar()
    v = F.col(value) - offset
    base = raster.select("row", "col", F.col(value).alias(value), v.alias("_s")).withColumns(
        {
            "_q": F.col("_s") * F.col("_s"),
            "_k": F.when(F.col(value).isNotNull(), 1).otherwise(0),
            "_lo": F.col(value),
            "_hi": F.col(value),
        }
    ).fillna(0.0, subset=["_s", "_q"])
    cols = ["_s", "_q", "_k", "_lo", "_hi"]
    out = along(along(base, "row", "col", shape.cols, cols), "col", "row", shape.rows, cols)
    n = float(size * size)
    var = F.greatest(F.col("_q") / n - F.pow(F.col("_s") / n, 2), F.lit(0.0))
    std = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(F.sqrt(var))
    return out.select("row", "col", value, F.when(F.col("_k") == int(n), std).alias(name))


def slope_aspect(raster: DataFrame, value: str, shape: Raster) -> DataFrame:
    """Horn slope (degrees) and aspect (clockwise from north); NULL unless all eight neighbours exist.

    The gradient is separable too: weighted sums and differences down each column, then along each row.
    """
    down = Window.partitionBy("col").orderBy("row")
    right = Window.partitionBy("row").orderBy("col")

    def beside(c: str, w, k: int, place: str) -> Column:
        move = F.lag if k < 0 else F.lead
        adjacent = move(place, 1).over(w) == F.col(place) + k
        return F.when(adjacent, move(c, 1).over(w))

    v = F.col(value)
    a = raster.select("row", "col", v.alias(value))
    a = a.withColumns({"_n": beside(value, down, -1, "row"), "_s": beside(value, down, 1, "row")})
    a = a.withColumns({"_sum": F.col("_n") + 2 * v + F.col("_s"), "_dif": F.col("_s") - F.col("_n")})
    for c in ("_sum", "_dif"):
        a = a.withColumns({f"{c}_w": beside(c, right, -1, "col"), f"{c}_e": beside(c, right, 1, "col")})
    dzdx = (F.col("_sum_e") - F.col("_sum_w")) / (8.0 * shape.dx)
    # Rows run south, so the difference south - north is minus the northward gradient.
    dzdy = (F.col("_dif_w") + 2 * F.col("_dif") + F.col("_dif_e")) / (8.0 * shape.dy)
    slope = F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy)))
    aspect = F.pmod(F.degrees(F.atan2(-dzdx, dzdy)) + 360.0, F.lit(360.0))
    return a.select("row", "col", value, slope.alias("slope"), aspect.alias("aspect"))


def axis_edges(df: DataFrame, coordinate: str) -> DataFrame:
    """Lower and upper edge of each coordinate of an axis, halfway between neighbours.

    The window runs over the distinct coordinates of one axis, not over cells.
    """
    axis = df.select(coordinate).distinct()
    w = Window.orderBy(coordinate)
    c = F.col(coordinate)
    before, after = F.lag(coordinate).over(w), F.lead(coordinate).over(w)
    low = F.coalesce((before + c) / 2, c - (after - c) / 2)
    high = F.coalesce((c + after) / 2, c + (c - before) / 2)
    return axis.select(coordinate, low.alias(f"{coordinate}_low"), high.alias(f"{coordinate}_high"))


def cell_areas(cells: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Ellipsoidal area of each lon/lat cell from its inferred edges."""
    lons, lats = axis_edges(cells, lon), axis_edges(cells, lat)
    area = cell_area_km2(F.col(f"{lat}_low"), F.col(f"{lat}_high"), F.col(f"{lon}_low"), F.col(f"{lon}_high"))
    return cells.join(lons, lon).join(lats, lat).withColumn("cell_area_km2", area)


def union_extent(grids: Sequence[DataFrame], x: str = "x", y: str = "y") -> DataFrame:
    """Common extent of several grids, one row."""
    out = grids[0].select(x, y)
    for g in grids[1:]:
        out = out.unionByName(g.select(x, y))
    return out.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def mask_cells(cube: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the cells of a mask."""
    return cube.join(mask.select(*keys).distinct(), list(keys), "left_semi")


def sample_cube(
    periods: DataFrame, points: DataFrame, cube: DataFrame, shape: Raster, *, cell: str, day: str, layer: str, value: str,
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Cube value at the node and layer nearest to each hexagon point and period.

    Place and time become keys first (grid arithmetic, layer calendar), so the cube is met by one equi join.
    """
    keyed = periods.select(cell, day).distinct().join(points.select(cell, lon, lat), cell)
    dated = nearest_layer(keyed, day, cube, layer)
    r = F.greatest(F.least(shape.row(F.col(lat)), F.lit(shape.rows - 1)), F.lit(0))
    c = F.greatest(F.least(shape.col(F.col(lon)), F.lit(shape.cols - 1)), F.lit(0))
    nodes = cube.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(layer).alias("layer_date"), value)
    return (
        dated.withColumns({"_row": r, "_col": c})
        .join(nodes, ["_row", "_col", "layer_date"], "left")
        .select(cell, day, "layer_date", value)
    )
