"""Projection, hexagon, raster, neighbour and polygon queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexgale.functions import projection as pj
from hexgale.functions.projection import laea_inverse, with_laea
from hexgale.functions.scalar import in_bbox, normalize_longitude
from hexgale.operators import distance
from hexgale.operators import grid as gr
from hexgale.operators import spatial as sp
from hexgale.operators import tiles
from hexgale.operators.composite import period_number, period_start
from hexgale.plans.adapters import EVENTS, ORIGIN, PERIODS, POINTS, cell_periods, event_points, points, table
from hexgale.plans.registry import query

BOX = (-11.5, 34.0, 42.5, 72.5)
HEXES = gr.HexGrid.over(BOX, 21650.0)
COARSE = gr.Raster(-12.0, 73.0, 1.0, 1.0, 39, 55)
WIDTH = 50  # columns of the raster made from the part table


def laea_sql(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"({1 - pj.E2!r} * ({s} / (1 - {pj.E2!r} * {s} * {s}) - ln((1 - {pj.E!r} * {s}) / (1 + {pj.E!r} * {s})) / {2 * pj.E!r}))"
    sb = f"({q} / {pj.QP!r})"
    cb = f"sqrt(1 - {sb} * {sb})"
    d = f"radians({lon} - 10.0)"
    b = f"({pj.RQ!r} * sqrt(2.0 / (1 + {pj.SINB0!r} * {sb} + {pj.COSB0!r} * {cb} * cos({d}))))"
    return (
        f"(4321000.0 + {b} * {pj.D!r} * {cb} * sin({d}))",
        f"(3210000.0 + {b} / {pj.D!r} * ({pj.COSB0!r} * {sb} - {pj.SINB0!r} * {cb} * cos({d})))",
    )


_X, _Y = laea_sql("lon", "lat")
PROJ = POINTS + f",\npp AS (SELECT *, {_X} AS x, {_Y} AS y FROM pts)"
EPROJ = EVENTS + f",\nep AS (SELECT *, {_X} AS x, {_Y} AS y FROM ev)"


@query("laea_forward", "point_id:l x_km:d y_km:d",
       f"WITH {PROJ} --final-- SELECT point_id, x / 1000 AS x_km, y / 1000 AS y_km FROM pp")
def laea_forward(spark, sf):
    p = with_laea(points(spark, sf))
    return p.withColumns({"x_km": F.col("x_laea") / 1000, "y_km": F.col("y_laea") / 1000})


@query("laea_inverse", "point_id:l lon:d lat:d", f"WITH {POINTS} --final-- SELECT point_id, lon, lat FROM pts")
def laea_inverse_roundtrip(spark, sf):
    p = with_laea(points(spark, sf))
    lon, lat = laea_inverse(F.col("x_laea"), F.col("y_laea"))
    return p.select("point_id", lon.alias("lon"), lat.alias("lat"))


@query("longitude_and_box", "event_id:l lon180:d inside:b",
       f"""WITH {EVENTS}, l AS (SELECT event_id, lat, (lon * 7 + 400) AS lon FROM ev)
       --final-- SELECT event_id, ((lon + 180) % 360 + 360) % 360 - 180 AS lon180,
       ((lon + 180) % 360 + 360) % 360 - 180 BETWEEN -11.5 AND 42.5 AND lat BETWEEN 34 AND 72.5 AS inside FROM l""")
def longitude_and_box(spark, sf):
    e = event_points(spark, sf).withColumn("lon180", normalize_longitude(F.col("lon") * 7 + 400))
    return e.withColumn("inside", in_bbox(F.col("lon180"), F.col("lat"), BOX))


_HEX = f"""hx AS (
  SELECT row_number() OVER (ORDER BY q, r) - 1 AS hex_id, cx, cy FROM (
    SELECT q, r, {HEXES.cx0!r} + {1.5 * HEXES.side!r} * q AS cx, {HEXES.cy0!r} + {3 ** 0.5 * HEXES.side!r} * (r + q / 2.0) AS cy
    FROM (SELECT unnest(range(-{HEXES.q_max}, {HEXES.q_max + 1})) AS q), (SELECT unnest(range(-{HEXES.r_max}, {HEXES.r_max + 1})) AS r))
  WHERE cx BETWEEN {HEXES.xmin - 2 * HEXES.side!r} AND {HEXES.xmax + 2 * HEXES.side!r}
    AND cy BETWEEN {HEXES.ymin - 2 * HEXES.side!r} AND {HEXES.ymax + 2 * HEXES.side!r})"""
_A = HEXES.side * 3 ** 0.5 / 2
_IN_HEX = f"""nh AS (SELECT event_id, country, area, arg_min(hex_id, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS hex_id,
  arg_min(cx, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS cx, arg_min(cy, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS cy
  FROM ep, hx GROUP BY 1, 2, 3),
ih AS (SELECT nh.* FROM nh JOIN ep USING (event_id) WHERE abs(y - cy) <= {_A!r}
  AND abs((x - cx) * {3 ** 0.5 / 2!r} + (y - cy) / 2) <= {_A!r} AND abs((x - cx) * {3 ** 0.5 / 2!r} - (y - cy) / 2) <= {_A!r})"""


def _in_hex(spark, sf):
    hexes = gr.hex_grid(spark, HEXES)
    return gr.assign_hexagon(with_laea(event_points(spark, sf)), hexes, HEXES, "x_laea", "y_laea")


@query("point_to_hex", "event_id:l hex_id:l", f"WITH {EPROJ}, {_HEX}, {_IN_HEX} --final-- SELECT event_id, hex_id FROM ih")
def point_to_hex(spark, sf):
    return _in_hex(spark, sf)


@query("hex_grid", "hex_id:l cx_km:d cy_km:d n_points:l area_weight_km2:d closed_ring:b",
       f"""WITH {EPROJ}, {_HEX}, {_IN_HEX} --final-- SELECT hex_id, max(cx) / 1000 AS cx_km, max(cy) / 1000 AS cy_km, count(*) AS n_points,
       CASE WHEN sum(area) > 0 THEN sum(area) END AS area_weight_km2, true AS closed_ring FROM ih GROUP BY 1""")
def hex_grid(spark, sf):
    hexes = gr.with_wkt(gr.hex_grid(spark, HEXES), HEXES)
    used = _in_hex(spark, sf).groupBy("hex_id").agg(F.count(F.lit(1)).alias("n_points"), F.sum("area").alias("a"))
    ring = F.split(F.regexp_extract("wkt", r"\(\((.*)\)\)", 1), ", ")
    return hexes.join(used, "hex_id").select(
        "hex_id", (F.col("cx") / 1000).alias("cx_km"), (F.col("cy") / 1000).alias("cy_km"), "n_points",
        gr.area_weight("a", None).alias("area_weight_km2"), (F.get(ring, 0) == F.get(ring, 6)).alias("closed_ring"),
    )


# --- rasters --------------------------------------------------------------------------------------


def raster(spark, sf):
    """The part table as a raster of retail prices, 50 columns wide, and its shape."""
    part = table(spark, sf, "part")
    rows = part.agg(F.max("p_partkey").alias("m")).first()["m"] // WIDTH + 1
    cells = part.select(
        F.floor(F.col("p_partkey") / WIDTH).cast("int").alias("row"), F.pmod("p_partkey", F.lit(WIDTH)).cast("int").alias("col"),
        F.col("p_retailprice").alias("value"), F.col("p_size").alias("cls"),
    )
    return cells, gr.Raster(-11.0, 34.0 + rows, 1.0, 1.0, rows, WIDTH)


RAST = f"""ra AS (SELECT p_partkey // {WIDTH} AS r, p_partkey % {WIDTH} AS c, p_retailprice AS v, p_size AS cls FROM part),
sh AS (SELECT max(r) + 1 AS nr, {WIDTH} AS nc, 34.0::DOUBLE + max(r) + 1 AS y0 FROM ra)"""


@query("raster_at_points", "event_id:l value:d clamped:d",
       f"""WITH {EVENTS}, {RAST}, k AS (SELECT event_id, floor(y0 - lat)::BIGINT AS r, floor(lon + 11.0)::BIGINT AS c, nr, nc FROM ev, sh)
       --final-- SELECT event_id, a.v AS value, b.v AS clamped FROM k LEFT JOIN ra a ON a.r = k.r AND a.c = k.c
       LEFT JOIN ra b ON b.r = least(greatest(k.r, 0), nr - 1) AND b.c = least(greatest(k.c, 0), nc - 1)""")
def raster_at_points(spark, sf):
    cells, shape = raster(spark, sf)
    e = gr.value_at_points(event_points(spark, sf), cells, shape, "lon", "lat", "value", name="value")
    return gr.value_at_points(e, cells, shape, "lon", "lat", "value", name="clamped", clamp=True)


@query("yearly_raster_at_points", "event_id:l cls:l",
       f"""WITH {EVENTS}, {RAST}, k AS (SELECT event_id, floor(y0 - lat)::BIGINT AS r, floor(lon + 11.0)::BIGINT AS c, year(event_date) AS y FROM ev, sh)
       --final-- SELECT event_id, cls FROM k LEFT JOIN ra ON ra.r = k.r AND ra.c = k.c AND 1990 + cls % 12 = y AND y BETWEEN 1996 AND 1999""")
def yearly_raster_at_points(spark, sf):
    cells, shape = raster(spark, sf)
    e = event_points(spark, sf).withColumn("y", F.year("event_date"))
    yearly = cells.withColumn("year", F.lit(1990) + F.col("cls") % 12)
    return gr.yearly_value_at_points(e, yearly, shape, "lon", "lat", "y", "cls", name="cls", years=(1996, 1999))


@query("nearest_node", "event_id:l node:d",
       f"""WITH {EVENTS}, {RAST} --final-- SELECT event_id, v AS node FROM ev, sh JOIN ra ON
       r = least(greatest(floor(y0 - lat)::BIGINT, 0), nr - 1) AND c = least(greatest(floor(lon + 11.0)::BIGINT, 0), nc - 1)""")
def nearest_node(spark, sf):
    cells, shape = raster(spark, sf)
    return gr.nearest_node(event_points(spark, sf), cells.withColumnRenamed("value", "node"), shape, "lon", "lat", ["node"])


@query("block_average_points", "row:l col:l fraction:d",
       f"""WITH {EVENTS} --final-- SELECT floor(73.0 - lat)::BIGINT AS row, floor(lon + 12.0)::BIGINT AS col,
       avg(CASE WHEN method = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS fraction FROM ev GROUP BY 1, 2 HAVING fraction >= 0.1""")
def block_average_points(spark, sf):
    e = event_points(spark, sf).withColumn("m", F.when(F.col("method") == "BUILDING", 1.0).otherwise(0.0))
    return gr.block_average(e, COARSE, "lon", "lat", "m", minimum=0.1)


#: Fine and coarse grid over Europe that do not nest, the coarse one shifted and of another shape.
FINE, SKEW = gr.Raster(-11.0, 72.0, 0.3, 0.4, 95, 180), gr.Raster(-11.7, 72.5, 1.1, 0.9, 43, 50)


@query("block_average", "row:l col:l fraction:d",
       f"""WITH {EVENTS}, fp AS (SELECT floor((72.0::DOUBLE - lat) / 0.4::DOUBLE) AS fr, floor((lon + 11.0::DOUBLE) / 0.3::DOUBLE) AS fc, avg(CASE WHEN method = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS v FROM ev GROUP BY 1, 2),
       g AS (SELECT r AS row, c AS col FROM (SELECT unnest(range(43)) AS r), (SELECT unnest(range(50)) AS c)),
       o AS (SELECT row, col, v,
         least(-11.0 + 0.3::DOUBLE * (fc + 1), -11.7 + 1.1::DOUBLE * (col + 1)) - greatest(-11.0 + 0.3::DOUBLE * fc, -11.7 + 1.1::DOUBLE * col) AS dx,
         least(72.0 - 0.4::DOUBLE * fr, 72.5 - 0.9::DOUBLE * row) - greatest(72.0 - 0.4::DOUBLE * (fr + 1), 72.5 - 0.9::DOUBLE * (row + 1)) AS dy FROM fp, g)
       --final-- SELECT row, col, sum(dx * dy * v) / sum(dx * dy) AS fraction FROM o WHERE dx > 1e-9 AND dy > 1e-9 GROUP BY 1, 2""")
def block_average(spark, sf):
    e = event_points(spark, sf).withColumns({"row": FINE.row(F.col("lat")), "col": FINE.col(F.col("lon"))})
    share = e.groupBy("row", "col").agg(F.avg(F.when(F.col("method") == "BUILDING", 1.0).otherwise(0.0)).alias("m"))
    return gr.area_average(share, FINE, SKEW, "m")


@query("bilinear_regrid", "event_id:l bilinear:d",
       f"""WITH {EVENTS}, {RAST}, k AS (SELECT event_id, lon + 11.0 - 0.5 AS fx, y0 - lat - 0.5 AS fy FROM ev, sh),
       n AS (SELECT event_id, fx, fy, floor(fx)::BIGINT + j AS c, floor(fy)::BIGINT + i AS r,
              (CASE i WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE j WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
             FROM k, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
       --final-- SELECT event_id, sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) AS bilinear
       FROM n LEFT JOIN ra ON ra.r = n.r AND ra.c = n.c AND w > 0 GROUP BY 1""")
def bilinear_regrid(spark, sf):
    cells, shape = raster(spark, sf)
    return gr.bilinear(event_points(spark, sf), cells, shape, "event_id", "lon", "lat", "value")


def _focal_sql(half: int) -> str:
    return f"""WITH {RAST}, o AS (SELECT i, j FROM (SELECT unnest(range(-{half}, {half + 1})) AS i), (SELECT unnest(range(-{half}, {half + 1})) AS j)),
    n AS (SELECT a.r, a.c, least(greatest(a.r + i, 0), nr - 1) AS rr, least(greatest(a.c + j, 0), nc - 1) AS cc FROM ra a, o, sh)
    --final-- SELECT n.r AS row, n.c AS col, stddev_pop(v) AS focal_std FROM n JOIN ra ON ra.r = rr AND ra.c = cc GROUP BY 1, 2"""


@query("focal_std3", "row:l col:l focal_std:d", _focal_sql(1))
def focal_std3(spark, sf):
    cells, shape = raster(spark, sf)
    return gr.focal_std(cells, "value", 3, shape)


@query("focal_std5", "row:l col:l focal_std:d", _focal_sql(2))
def focal_std5(spark, sf):
    cells, shape = raster(spark, sf)
    return gr.focal_std(cells, "value", 5, shape)


@query("slope_aspect", "row:l col:l slope:d aspect:d",
       f"""WITH {RAST}, g AS (SELECT a.r, a.c, w.n AS k,
           ((ne.v + 2 * e.v + se.v) - (nw.v + 2 * w.v + sw.v)) / 8 AS gx, ((sw.v + 2 * s.v + se.v) - (nw.v + 2 * n.v + ne.v)) / 8 AS gy
         FROM ra a LEFT JOIN (SELECT *, 1 AS n FROM ra) w ON w.r = a.r AND w.c = a.c - 1
         LEFT JOIN ra e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN ra n ON n.r = a.r - 1 AND n.c = a.c LEFT JOIN ra s ON s.r = a.r + 1 AND s.c = a.c
         LEFT JOIN ra nw ON nw.r = a.r - 1 AND nw.c = a.c - 1 LEFT JOIN ra ne ON ne.r = a.r - 1 AND ne.c = a.c + 1
         LEFT JOIN ra sw ON sw.r = a.r + 1 AND sw.c = a.c - 1 LEFT JOIN ra se ON se.r = a.r + 1 AND se.c = a.c + 1)
       --final-- SELECT r AS row, c AS col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
         (degrees(atan2(-gx, gy)) + 360) % 360 AS aspect FROM g""")
def slope_aspect(spark, sf):
    cells, shape = raster(spark, sf)
    return gr.slope_aspect(cells, "value", shape)


_CELLS = "cl AS (SELECT DISTINCT floor(lon / 0.5) * 0.5 + 0.25 AS lon, floor(lat / 0.5) * 0.5 + 0.25 AS lat FROM ev)"


def _cells(spark, sf):
    half = lambda c: (F.floor(F.col(c) / 0.5) * 0.5 + 0.25).alias(c)
    return event_points(spark, sf).select(half("lon"), half("lat")).distinct()


def _band(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({s} / (1 - {pj._WE2!r} * {s} * {s}) + ln((1 + {pj._WE!r} * {s}) / (1 - {pj._WE!r} * {s})) / {2 * pj._WE!r})"


def _edge(c: str) -> str:
    return f"""SELECT {c}, coalesce((lag({c}) OVER o + {c}) / 2, {c} - (lead({c}) OVER o - {c}) / 2) AS lo,
      coalesce((lead({c}) OVER o + {c}) / 2, {c} + ({c} - lag({c}) OVER o) / 2) AS hi FROM (SELECT DISTINCT {c} FROM cl) WINDOW o AS (ORDER BY {c})"""


@query("cell_area", "lon:d lat:d cell_area_km2:d",
       f"""WITH {EVENTS}, {_CELLS}, ex AS ({_edge('lon')}), ey AS ({_edge('lat')})
       --final-- SELECT cl.lon, cl.lat, abs({pj._WB * pj._WB / 2 / 1e6!r} * radians(ex.hi - ex.lo) * ({_band('ey.hi')} - {_band('ey.lo')})) AS cell_area_km2
       FROM cl JOIN ex ON ex.lon = cl.lon JOIN ey ON ey.lat = cl.lat""")
def cell_area(spark, sf):
    return gr.cell_areas(_cells(spark, sf))


@query("union_extent", "xmin:d xmax:d ymin:d ymax:d",
       f"""WITH {EVENTS}, {POINTS}, u AS (SELECT lon, lat FROM ev UNION ALL SELECT lon, lat FROM pts)
       --final-- SELECT min(lon) AS xmin, max(lon) AS xmax, min(lat) AS ymin, max(lat) AS ymax FROM u""")
def union_extent(spark, sf):
    return gr.union_extent([event_points(spark, sf), points(spark, sf)], "lon", "lat")


@query("cube_sampling", "cell_id:l obs_date:t layer_date:t value:d",
       f"""WITH {PERIODS}, {POINTS}, cu AS (SELECT o_custkey % 39 AS r, o_orderkey % 55 AS c,
         CAST(DATE '1995-01-01' + 32 * CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 32.0) AS INTEGER) AS DATE) AS l,
         max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3),
       la AS (SELECT DISTINCT l FROM cu), nl AS (SELECT d, arg_min(l, (abs(date_diff('day', d, l)), l)) AS l FROM (SELECT DISTINCT obs_date AS d FROM per), la GROUP BY 1)
       --final-- SELECT p.cell_id, p.obs_date, nl.l AS layer_date, cu.value FROM per p JOIN pts s ON s.point_id = p.cell_id JOIN nl ON nl.d = p.obs_date
       LEFT JOIN cu ON cu.l = nl.l AND cu.r = least(38, floor(73.0 - s.lat)) AND cu.c = floor(s.lon + 12.0)""")
def cube_sampling(spark, sf):
    o = table(spark, sf, "orders")
    start = period_start(period_number(F.col("o_orderdate").cast("date"), ORIGIN, 32), ORIGIN, 32)
    cube = o.groupBy(
        F.pmod("o_custkey", F.lit(39)).cast("int").alias("row"), F.pmod("o_orderkey", F.lit(55)).cast("int").alias("col"), start.alias("layer")
    ).agg(F.max("o_totalprice").alias("value"))
    p = points(spark, sf).withColumnRenamed("point_id", "cell_id")
    return gr.sample_cube(cell_periods(spark, sf), p, cube, COARSE, cell="cell_id", day="obs_date", layer="layer", value="value")


# --- neighbours -----------------------------------------------------------------------------------


@query("nearest_event", "event_id:l point_id:l ref_event_dist_km:d class_id:l",
       f"""WITH {EPROJ}, pp AS (SELECT * FROM (WITH {PROJ} SELECT * FROM pp)),
       d AS (SELECT event_id, point_id, class_id, (ep.x - pp.x) * (ep.x - pp.x) + (ep.y - pp.y) * (ep.y - pp.y) AS d2 FROM ep, pp WHERE event_id % 61 <> 0),
       n AS (SELECT event_id, arg_min(point_id, (d2, point_id)) AS point_id, sqrt(min(d2)) / 1000 AS ref_event_dist_km, arg_min(class_id, (d2, point_id)) AS class_id FROM d GROUP BY 1)
       --final-- SELECT ep.event_id, point_id, ref_event_dist_km, class_id FROM ep LEFT JOIN n USING (event_id)""")
def nearest_event(spark, sf):
    e, p = with_laea(event_points(spark, sf)), with_laea(points(spark, sf))
    # Some events come without coordinates.
    e = e.withColumn("x_laea", F.when(F.col("event_id") % 61 != 0, F.col("x_laea")))
    return sp.nearest_event(e, p, point="event_id", event="point_id", x="x_laea", y="y_laea", attributes=["class_id"])


@query("distance_bins", "event_id:l dist_km:d dist_bin:l",
       f"""WITH {EPROJ}, pp AS (SELECT * FROM (WITH {PROJ} SELECT * FROM pp)),
       d AS (SELECT event_id, sqrt(min((ep.x - pp.x) * (ep.x - pp.x) + (ep.y - pp.y) * (ep.y - pp.y))) / 1000 AS km FROM ep, pp GROUP BY 1)
       --final-- SELECT event_id, CASE WHEN km <= 300 THEN km END AS dist_km,
       CASE WHEN km <= 50 THEN 1 WHEN km <= 150 THEN 2 WHEN km <= 300 THEN 3 ELSE 4 END AS dist_bin FROM d""")
def distance_bins(spark, sf):
    e, p = with_laea(event_points(spark, sf)), with_laea(points(spark, sf))
    return sp.distance_bin(e, p, cell="event_id", positive="point_id", x="x_laea", y="y_laea", bins_km=[50.0, 150.0, 300.0])


#: 200 x 200 cells of 20 km in LAEA Europe.
WIDE = gr.Raster(2_500.0, 5_500.0, 20.0, 20.0, 200, 200)


@query("distance_raster", "row:l col:l distance:d dist_bin:l",
       f"""WITH pp AS (SELECT * FROM (WITH {PROJ} SELECT * FROM pp)),
       pos AS (SELECT DISTINCT floor((5500 - y / 1000) / 20) AS pr, floor((x / 1000 - 2500) / 20) AS pc FROM pp),
       g AS (SELECT r AS row, c AS col FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(200)) AS c)),
       d AS (SELECT row, col, sqrt(min(pow(20 * (row - pr), 2) + pow(20 * (col - pc), 2))) AS distance FROM g, pos
         WHERE pr BETWEEN 0 AND 199 AND pc BETWEEN 0 AND 199 GROUP BY 1, 2)
       --final-- SELECT row, col, distance, CASE WHEN distance <= 50 THEN 1 WHEN distance <= 150 THEN 2 WHEN distance <= 300 THEN 3 ELSE 4 END AS dist_bin FROM d""")
def distance_raster(spark, sf):
    p = with_laea(points(spark, sf)).select(
        WIDE.row(F.col("y_laea") / 1000).alias("row"), WIDE.col(F.col("x_laea") / 1000).alias("col")
    )
    return distance.binned(distance.distance_raster(p, WIDE), [50.0, 150.0, 300.0])


_NN = """nn AS (SELECT a.event_id, any_value(a.country) AS country, min(2 * 6371.0088 * asin(sqrt(
      pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
    FROM ev a JOIN ev b ON a.country = b.country AND a.event_id <> b.event_id GROUP BY 1)"""


@query("knn_mean_distance", "event_id:l nearest_km:d", f"WITH {EVENTS}, {_NN} --final-- SELECT event_id, km AS nearest_km FROM ev LEFT JOIN nn USING (event_id)")
def knn_mean_distance(spark, sf):
    return sp.neighbour_km(event_points(spark, sf), key="event_id", group="country")


@query("group_dispersion",
       "country:l n_polygons:l median_polygon_area:d mean_nearest_neighbour_km:d occupied_cells:l occupied_cells_per_1000:d predominant_method:s",
       f"""WITH {EVENTS}, {_NN}, m AS (SELECT country, method, count(*) AS n FROM ev GROUP BY 1, 2)
       --final-- SELECT ev.country, count(*) AS n_polygons, quantile_cont(ev.area, 0.5) AS median_polygon_area,
       (SELECT avg(km) FROM nn WHERE nn.country = ev.country) AS mean_nearest_neighbour_km,
       count(DISTINCT (floor(lon / 0.25), floor(lat / 0.25))) AS occupied_cells,
       1000 * count(DISTINCT (floor(lon / 0.25), floor(lat / 0.25))) / count(*) AS occupied_cells_per_1000,
       (SELECT arg_min(method, (-n, method)) FROM m WHERE m.country = ev.country) AS predominant_method FROM ev GROUP BY 1""")
def group_dispersion(spark, sf):
    return sp.group_dispersion(event_points(spark, sf), key="event_id", group="country", area="area", method="method")


@query("foreign_in_rectangle", "event_id:l country:l",
       f"WITH {EVENTS} --final-- SELECT event_id, country FROM ev WHERE lon BETWEEN 10.96 AND 24.17 AND lat BETWEEN 55.25 AND 69.06 AND country <> 7")
def foreign_in_rectangle(spark, sf):
    return sp.foreign_in_rectangle(event_points(spark, sf), "lon", "lat", (10.96, 55.25, 24.17, 69.06), "country", 7)


# --- polygons -------------------------------------------------------------------------------------


def polygons(spark, sf):
    """A hexagon of radius 3 degrees around the point of each nation."""
    k = F.col("n_nationkey")
    cx = F.lit(-11.0) + F.pmod(k * 37, F.lit(5400)) / 100.0
    cy = F.lit(34.0) + F.pmod(k * 53, F.lit(3800)) / 100.0
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda i: F.struct((cx + 3 * F.cos(F.radians(i * 60 + 10))).alias("x"), (cy + 3 * F.sin(F.radians(i * 60 + 10))).alias("y")),
    )
    return table(spark, sf, "nation").select(k.alias("poly"), F.lit(0).alias("part"), F.col("n_name").alias("name"), ring.alias("ring"))


EDGES = """vx AS (SELECT n_nationkey AS poly, i, -11.0 + ((n_nationkey * 37) % 5400) / 100.0 + 3 * cos(radians(i * 60 + 10)) AS x,
         34.0 + ((n_nationkey * 53) % 3800) / 100.0 + 3 * sin(radians(i * 60 + 10)) AS y FROM nation, (SELECT unnest(range(6)) AS i)),
ed AS (SELECT a.poly, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vx a JOIN vx b ON a.poly = b.poly AND b.i = (a.i + 1) % 6)"""


def _pip(src: str, key: str, x: str, y: str) -> str:
    return (f"SELECT {key}, poly FROM {src}, ed WHERE (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 "
            f"GROUP BY {key}, poly HAVING count(*) % 2 = 1")


@query("point_in_polygon", "event_id:l poly:l", f"WITH {EVENTS}, {EDGES} --final-- {_pip('ev', 'event_id', 'lon', 'lat')}")
def point_in_polygon(spark, sf):
    return sp.point_in_polygon(event_points(spark, sf), polygons(spark, sf), point="event_id", polygon="poly", x="lon", y="lat")


@query("polygon_footprint", "event_id:l",
       f"WITH {EVENTS}, {EDGES}, h AS ({_pip('ev', 'event_id', 'lon', 'lat')}) --final-- SELECT DISTINCT event_id FROM h")
def polygon_footprint(spark, sf):
    return sp.inside_any(event_points(spark, sf), polygons(spark, sf), point="event_id", polygon="poly", x="lon", y="lat")


@query("polygon_centroid", "poly:l area:d centroid_x:d centroid_y:d",
       f"""WITH {EDGES}, s AS (SELECT poly, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS cx,
         sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS cy FROM ed GROUP BY 1)
       --final-- SELECT poly, abs(a) AS area, cx / a AS centroid_x, cy / a AS centroid_y FROM s""")
def polygon_centroid(spark, sf):
    return sp.polygon_measures(polygons(spark, sf), "poly", "part")


@query("polygon_parts", "poly:l part:l part_area:d",
       f"""WITH {EDGES} --final-- SELECT poly, 0 AS part, abs(sum(x1 * y2 - x2 * y1)) / 2 AS part_area FROM ed GROUP BY 1 HAVING part_area >= 20""")
def polygon_parts(spark, sf):
    return sp.keep_parts(polygons(spark, sf), "poly", "part", 20.0)


_RC = "rc AS (SELECT r AS row, c AS col, -12.0 + (c + 0.5) AS x, 73.0 - (r + 0.5) AS y FROM (SELECT unnest(range(39)) AS r), (SELECT unnest(range(55)) AS c))"


@query("rasterize_polygons", "row:l col:l value:l",
       f"""WITH {EDGES}, {_RC}, h AS ({_pip('rc', 'row, col', 'x', 'y')}) --final-- SELECT row, col, max(poly) AS value FROM h GROUP BY 1, 2""")
def rasterize_polygons(spark, sf):
    return sp.rasterize(polygons(spark, sf), COARSE, polygon="poly", order="poly", burn="poly")


@query("mask_cells", "event_id:l",
       f"""WITH {EVENTS}, {EDGES}, {_RC}, h AS ({_pip('rc', 'row, col', 'x', 'y')})
       --final-- SELECT event_id FROM ev WHERE (floor(73.0 - lat), floor(lon + 12.0)) IN (SELECT (row, col) FROM h)""")
def mask_cells(spark, sf):
    e = event_points(spark, sf).withColumns({"row": COARSE.row(F.col("lat")), "col": COARSE.col(F.col("lon"))})
    return gr.mask_cells(e, rasterize_polygons(spark, sf), ["row", "col"])


@query("rasterize_touched", "row:l col:l value:l",
       f"""WITH {EDGES}, {_RC}, h AS ({_pip('rc', 'row, col', 'x', 'y')}),
       t AS (SELECT row, col, poly FROM rc, ed WHERE greatest(x1, x2) >= x - 0.5 AND least(x1, x2) <= x + 0.5 AND greatest(y1, y2) >= y - 0.5 AND least(y1, y2) <= y + 0.5
         AND abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= 0.5 * (abs(x2 - x1) + abs(y2 - y1)))
       --final-- SELECT row, col, max(poly) AS value FROM (SELECT * FROM h UNION ALL SELECT * FROM t) GROUP BY 1, 2""")
def rasterize_touched(spark, sf):
    return sp.rasterize(polygons(spark, sf), COARSE, polygon="poly", order="poly", burn="poly", all_touched=True)


@query("boxes_overlap", "poly:l event_id:l",
       f"""WITH {EVENTS}, {EDGES}, b AS (SELECT poly, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM ed GROUP BY 1),
       h AS (SELECT event_id, lon, lat, 5 * pow(10.0, -(event_id % 5)) AS half FROM ev)
       --final-- SELECT poly, event_id FROM b, h WHERE x0 <= lon + half AND lon - half <= x1 AND y0 <= lat + half AND lat - half <= y1""")
def boxes_overlap(spark, sf):
    left = sp.bounds(polygons(spark, sf))
    # Boxes of ten degrees down to a thousandth of one.
    e = event_points(spark, sf).withColumn("half", 5 * F.pow(F.lit(10.0), -(F.col("event_id") % 5)))
    right = e.select("event_id", (e.lon - e.half).alias("xmin"), (e.lon + e.half).alias("xmax"), (e.lat - e.half).alias("ymin"), (e.lat + e.half).alias("ymax"))
    return tiles.boxes_overlap(left, right, left_key="poly", right_key="event_id")
