"""Polygons and boxes on quad tiles of their own size.

Tiles of level L are squares of side ``extent / 2**L``. A polygon starts with the tiles of its own size around it, and a
tile that more than ``MOST`` of its edges touch is replaced by its four quarters, level by level, until every tile is
outside, inside, or on the boundary with a few edges of its own.

A boundary tile carries one bit. Crossings of the ray from a point to the right (the plain crossing rule: an edge counts
if exactly one end lies above the point and the crossing is to the right) split into those of edges with an end left of
the tile's right side, and the rest. The rest telescopes along the rings: it has the parity of the number of edges that
cross the line through the right side above the point. Among these, edges that do not touch the tile are the same for all
of its points; their parity is the carried bit. So a point meets the edges of one tile per polygon and gets exactly what
the crossing rule over all edges gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.session import cut_lineage

#: Edges of a tile up to which it is not cut, levels a polygon's tiles may be finer than the polygon, finest level of all.
MOST, DEEPER, FINEST = 16, 14, 40
#: Share of a tile by which tiles are enlarged when edges are dealt to them.
PAD = 1e-9

_EDGE = ("x1", "y1", "x2", "y2")


@dataclass
class Grid:
    """Origin and side of the level-0 tile."""

    x0: float
    y0: float
    extent: float

    def side(self, level: Column) -> Column:
        return F.lit(self.extent) / F.pow(F.lit(2.0), level)

    def at(self, c: Column, axis: str, level: Column) -> Column:
        return F.floor((c - F.lit(self.x0 if axis == "x" else self.y0)) / self.side(level)).cast("long")

    def low(self, i: Column, axis: str, level: Column) -> Column:
        return F.lit(self.x0 if axis == "x" else self.y0) + i * self.side(level)

    def own_level(self, width: Column) -> Column:
        """The finest level whose tiles are no smaller than a width."""
        fit = F.floor(F.log2(F.lit(self.extent) / F.greatest(width, F.lit(self.extent * 2.0**-FINEST))))
        return F.greatest(F.least(fit, F.lit(FINEST)), F.lit(0)).cast("int")


def grid_over(boxes: DataFrame) -> Grid:
    """Grid around boxes (xmin, xmax, ymin, ymax); four numbers reach the driver."""
    e = boxes.agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1")).first()
    if e["x0"] is None:
        return Grid(0.0, 0.0, 1.0)
    return Grid(float(e["x0"]), float(e["y0"]), max(e["x1"] - e["x0"], e["y1"] - e["y0"]) or 1.0)


def _corners(level: str, xmin: str, xmax: str, ymin: str, ymax: str, grid: Grid) -> Column:
    """Tiles of a level that a box meets; at most four if the level is the box's own or coarser."""
    lv = F.col(level)
    i = F.sequence(grid.at(F.col(xmin), "x", lv), grid.at(F.col(xmax), "x", lv))
    j = F.sequence(grid.at(F.col(ymin), "y", lv), grid.at(F.col(ymax), "y", lv))
    return F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(a.alias("i"), b.alias("j")))))


def _spans(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def _x_at(y: Column) -> Column:
    return (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")


def _right_y() -> Column:
    return F.when(F.col("x1") >= F.col("x2"), F.col("y1")).otherwise(F.col("y2"))


def _above(right: Column, y: Column) -> Column:
    """For an edge with ends on both sides of x = ``right``: whether its right end lies above y."""
    across = (F.col("x1") >= right) != (F.col("x2") >= right)
    return across & (_right_y() > y)


def _bit(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _touches(grid: Grid) -> Column:
    """Whether an edge meets the (slightly enlarged) tile (lv, i, j): boxes overlap and the line does not pass it by."""
    rounding = max(abs(grid.x0), abs(grid.y0), grid.extent) * 4e-15
    half = grid.side(F.col("lv")) / 2 * (1 + PAD) + rounding
    cx, cy = grid.low(F.col("i") + 0.5, "x", F.col("lv")), grid.low(F.col("j") + 0.5, "y", F.col("lv"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    beside = (
        (F.greatest("x1", "x2") < cx - half) | (F.least("x1", "x2") > cx + half)
        | (F.greatest("y1", "y2") < cy - half) | (F.least("y1", "y2") > cy + half)
    )
    off = F.abs(dx * (cy - F.col("y1")) - dy * (cx - F.col("x1"))) > half * (F.abs(dx) + F.abs(dy))
    return ~(beside | off)


def _classed(dealt: DataFrame, polygon: str, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(tiles with their carried bit and number of edges, edges of tiles) from edges dealt to candidate tiles.

    ``dealt`` holds each edge of the parent tile for each candidate (lv, i, j), with the parent's carried bit and right
    side (``up``, ``up_right``; NULL right side where the parent is the whole plane).
    """
    right, y0 = grid.low(F.col("i") + 1, "x", F.col("lv")), grid.low(F.col("j") + 0.5, "y", F.col("lv"))
    # Parity at the middle of the right side, from the parent's bit and edges.
    counted = F.coalesce(F.least("x1", "x2") < F.col("up_right"), F.lit(True))
    own = (_bit(_spans(y0) & (right <= _x_at(y0))) + _bit(_above(F.col("up_right"), y0))) % 2
    mine = F.col("touches").cast("int")
    # The tile's own edges are tested point by point, so their part in that parity is taken out.
    local = _bit(_spans(y0) & (right <= _x_at(y0))) + _bit(_above(right, y0))
    local = F.when(F.least("x1", "x2") < right, local % 2).otherwise(0)
    dealt = cut_lineage(dealt.withColumn("touches", _touches(grid)))
    tiles = dealt.groupBy(polygon, "lv", "i", "j").agg(
        F.sum(mine).alias("n_edges"),
        ((F.first("up") + F.sum(F.when(counted, own).otherwise(0)) + F.sum(mine * local)) % 2).cast("int").alias("bit"),
    )
    tiles = cut_lineage(tiles.where("n_edges > 0 OR bit = 1"))
    return tiles, dealt.where("touches").select(polygon, "lv", "i", "j", *_EDGE)


def tile_polygons(edges: DataFrame, polygon: str, most: int = MOST) -> tuple[Grid, DataFrame, list[int], bool]:
    """(grid, tiles, levels in use, whether some tile comes in several rows) for edges (polygon, x1, y1, x2, y2).

    ``tiles``: polygon, lv, i, j, bit, edges. Rings must be closed. Tiles inside a polygon have bit 1 and no edges. A tile
    that stays crowded at the finest level (very many edges through one spot) comes in rows of at most about ``most``
    edges, with the bit on the first.
    """
    edges = cut_lineage(edges.select(polygon, *[F.col(c).cast("double").alias(c) for c in _EDGE]))
    boxes = edges.groupBy(polygon).agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax"),
    )
    grid = grid_over(boxes)
    start = boxes.withColumn("lv", grid.own_level(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))
    start = start.select(polygon, "lv", F.explode(_corners("lv", "xmin", "xmax", "ymin", "ymax", grid)).alias("t")).select(polygon, "lv", "t.*")
    dealt = edges.join(start, polygon).withColumns({"up": F.lit(0), "up_right": F.lit(None).cast("double")})
    done, contents, most_in = [], [], {}
    for depth in range(DEEPER + 1):
        tiles, own = _classed(dealt, polygon, grid)
        crowded = (F.col("n_edges") > most) & F.lit(depth < DEEPER)
        done.append(tiles.where(~crowded))
        on = [polygon, "lv", "i", "j"]
        contents.append(own.join(tiles.where(~crowded & (F.col("n_edges") > 0)).select(*on, F.col("n_edges").alias("n")), on))
        seen = tiles.groupBy("lv", crowded.alias("crowded")).agg(F.max("n_edges").alias("n")).collect()  # a row or two per level
        for r in seen:
            if not r["crowded"]:
                most_in[r["lv"]] = max(r["n"], most_in.get(r["lv"], 0))
        if not any(r["crowded"] for r in seen):
            break
        large = tiles.where(crowded)
        quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
        dealt = own.join(large.select(*on, "bit"), on).select(
            polygon, (F.col("lv") + 1).alias("lv"), (F.col("i") * 2).alias("_i"), (F.col("j") * 2).alias("_j"), *_EDGE,
            F.col("bit").alias("up"), grid.low(F.col("i") + 1, "x", F.col("lv")).alias("up_right"), quarter.alias("q"),
        )
        dealt = dealt.select(polygon, "lv", (F.col("_i") + F.col("q.a")).alias("i"), (F.col("_j") + F.col("q.b")).alias("j"), *_EDGE, "up", "up_right")
    every, lists = done[0], contents[0]
    for more, further in zip(done[1:], contents[1:]):
        every, lists = every.unionByName(more), lists.unionByName(further)
    piece = F.pmod(F.xxhash64(*_EDGE), F.ceil(F.col("n") / most)).cast("int")
    lists = lists.groupBy(*on, F.when(F.col("n") > most, piece).otherwise(0).alias("piece")).agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
    several = max(most_in.values(), default=0) > most
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    first = every.select(*on, F.when(F.col("n_edges") > most, F.lit(-1)).otherwise(0).alias("piece"), "bit")
    joined = first.join(lists, [*on, "piece"], "full").withColumn("edges", F.coalesce("edges", none)).withColumn("bit", F.coalesce("bit", F.lit(0)))
    return grid, joined.drop("piece"), sorted(most_in), several


def point_in_polygon(points: DataFrame, edges: DataFrame, *, point: str, polygon: str, x: str, y: str, most: int = MOST) -> DataFrame:
    """(point, polygon) rows for points inside by the crossing rule over all edges of a polygon id.

    A point asks once per level of tiles in use and meets the edges of one tile per polygon. Points without coordinates
    are inside nothing.
    """
    grid, tiles, levels, several = tile_polygons(edges, polygon, most)
    px, py = F.col("_x"), F.col("_y")
    asked = points.select(F.col(point).alias("_point"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    asked = asked.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py))
    if not levels:
        return asked.limit(0).join(edges.select(polygon).limit(0)).select(F.col("_point").alias(point), polygon)
    asked = asked.withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels])))
    asked = asked.withColumns({"i": grid.at(px, "x", F.col("lv")), "j": grid.at(py, "y", F.col("lv"))})
    met = asked.join(tiles, ["lv", "i", "j"]).withColumn("_right", grid.low(F.col("i") + 1, "x", F.col("lv")))

    def crossings(e: Column) -> Column:
        spans = (e["y1"] > py) != (e["y2"] > py)
        at = (e["x2"] - e["x1"]) * F.try_divide(py - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        right_y = F.when(e["x1"] >= e["x2"], e["y1"]).otherwise(e["y2"])
        across = (e["x1"] >= F.col("_right")) != (e["x2"] >= F.col("_right"))
        n = F.coalesce(spans & (px < at), F.lit(False)).cast("int") + (across & (right_y > py)).cast("int")
        return F.when(F.least(e["x1"], e["x2"]) < F.col("_right"), n).otherwise(0)

    parity = F.aggregate("edges", F.col("bit"), lambda n, e: n + crossings(e))
    met = met.select(F.col("_point").alias(point), polygon, parity.alias("_n"))
    if several:
        met = met.groupBy(point, polygon).agg(F.sum("_n").alias("_n"))
    return met.where(F.col("_n") % 2 == 1).select(point, polygon)


def boxes_overlap(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str) -> DataFrame:
    """Pairs of boxes (xmin, xmax, ymin, ymax) that intersect (C16), whatever their sizes.

    A box is stored in the tiles of its own size, at most four, and asks at that and every coarser level in use, so a pair
    meets at the level of the larger box and small boxes never fill the tiles of large ones. A pair is reported in the tile
    of the lower corner of its intersection only. Boxes with a NULL bound or reversed bounds meet nothing.
    """
    ends = ("xmin", "xmax", "ymin", "ymax")

    def cleaned(df: DataFrame, key: str, p: str) -> DataFrame:
        b = df.select(F.col(key).alias(f"{p}key"), *[F.col(c).cast("double").alias(f"{p}{c}") for c in ends])
        return b.where((F.col(f"{p}xmin") <= F.col(f"{p}xmax")) & (F.col(f"{p}ymin") <= F.col(f"{p}ymax")))

    a, b = cleaned(left, left_key, "l_"), cleaned(right, right_key, "r_")
    whole = a.select(*[F.col(f"l_{c}").alias(c) for c in ends]).unionByName(b.select(*[F.col(f"r_{c}").alias(c) for c in ends]))
    grid = grid_over(whole)

    def level(df: DataFrame, p: str) -> DataFrame:
        wide = F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.col(f"{p}ymax") - F.col(f"{p}ymin"))
        return df.withColumn(f"{p}own", grid.own_level(wide))

    a, b = level(a, "l_"), level(b, "r_")
    used = [r[0] for r in a.select(F.col("l_own").alias("v")).unionByName(b.select(F.col("r_own").alias("v"))).distinct().collect()]

    def tiled(df: DataFrame, p: str, levels: Column) -> DataFrame:
        out = df.withColumn("lv", F.explode(levels))
        return out.withColumn("_t", F.explode(_corners("lv", f"{p}xmin", f"{p}xmax", f"{p}ymin", f"{p}ymax", grid))).select("*", "_t.i", "_t.j").drop("_t")

    def levels(p: str, own: bool) -> Column:
        if own:
            return F.array(f"{p}own")
        return F.filter(F.array(*[F.lit(v) for v in sorted(used)]).cast("array<int>"), lambda v: v <= F.col(f"{p}own"))

    overlap = (
        (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax"))
        & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    )
    once = (grid.at(F.greatest("l_xmin", "r_xmin"), "x", F.col("lv")) == F.col("i")) & (grid.at(F.greatest("l_ymin", "r_ymin"), "y", F.col("lv")) == F.col("j"))
    out = F.col("l_key").alias(left_key), F.col("r_key").alias(right_key)
    # The left box is the larger or an equal one, then the right one alone.
    stored_left = tiled(a, "l_", levels("l_", True)).join(tiled(b, "r_", levels("r_", False)), ["lv", "i", "j"])
    stored_right = tiled(b, "r_", levels("r_", True)).join(tiled(a, "l_", levels("l_", False)), ["lv", "i", "j"]).where("l_own > r_own")
    return stored_left.where(overlap & once).select(*out).unionByName(stored_right.where(overlap & once).select(*out))
