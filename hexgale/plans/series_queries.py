"""Series, as-of and look-back queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexgale.operators import series
from hexgale.operators.composite import align_inner
from hexgale.operators.ordered import quantiles
from hexgale.plans.adapters import OBS, PERIODS, cell_periods, observations, table
from hexgale.plans.registry import query
from hexgale.session import cut_lineage

N_T = 157  # 16-day layers of the study period


@query("common_keys", "d:t", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders
       WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def common_keys(spark, sf):
    a, b = _dates(spark, sf)
    return series.common_keys(a, b, "d")


def _dates(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    b = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return a, b


@query("missing_keys", "d:t missing_in:s",
       """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
       --final-- SELECT d, 'right' AS missing_in FROM a WHERE d NOT IN (SELECT d FROM b)
       UNION ALL SELECT d, 'left' FROM b WHERE d NOT IN (SELECT d FROM a)""")
def missing_keys(spark, sf):
    a, b = _dates(spark, sf)
    return series.missing_keys(a, b, "d")


@query("aligned_inner", "cell_id:l obs_date:t g:d w:d",
       f"""WITH {OBS}, a AS (SELECT cell_id, obs_date, max(gust) AS g FROM obs WHERE obs_no <= 4 GROUP BY 1, 2),
       b AS (SELECT cell_id, obs_date, max(weight) AS w FROM obs WHERE obs_no > 4 GROUP BY 1, 2)
       --final-- SELECT cell_id, obs_date, g, w FROM a JOIN b USING (cell_id, obs_date)""")
def aligned_inner(spark, sf):
    obs = observations(spark, sf)
    a = obs.where("obs_no <= 4").groupBy("cell_id", "obs_date").agg(F.max("gust").alias("g"))
    b = obs.where("obs_no > 4").groupBy("cell_id", "obs_date").agg(F.max("weight").alias("w"))
    return align_inner(a, b, ["cell_id", "obs_date"])


@query("cover_fallback", "cell_id:l period_no:l v:d from_supplement:b",
       f"""WITH {OBS}, a AS (SELECT cell_id, period_no, max(gust) AS v FROM obs WHERE obs_no <= 3 GROUP BY 1, 2),
       b AS (SELECT cell_id, period_no, max(pred) AS v FROM obs GROUP BY 1, 2)
       --final-- SELECT cell_id, period_no, coalesce(a.v, b.v) AS v, a.v IS NULL AS from_supplement FROM a FULL JOIN b USING (cell_id, period_no)""")
def cover_fallback(spark, sf):
    obs = observations(spark, sf)
    a = obs.where("obs_no <= 3").groupBy("cell_id", "period_no").agg(F.max("gust").alias("v"))
    b = obs.groupBy("cell_id", "period_no").agg(F.max("pred").alias("v"))
    return series.cover(a, b, ["cell_id", "period_no"], "v")


# Series of median weights per cell and 16-day layer, on all layers.
SERIES = OBS + f""",
med AS (SELECT cell_id, period_no + 1 AS pos, quantile_cont(gust, 0.5) / 10 AS y FROM obs GROUP BY 1, 2),
ser AS (SELECT c.cell_id, p.pos, y FROM (SELECT DISTINCT cell_id FROM med) c CROSS JOIN (SELECT unnest(range(1, {N_T + 1})) AS pos) p
        LEFT JOIN med ON med.cell_id = c.cell_id AND med.pos = p.pos)"""


def layers(spark, sf):
    return series.dense_positions(cut_lineage(median_layers(spark, sf)), ["cell_id"], "pos", N_T, "y")


CLAMP = SERIES + """,
lg AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 3) OVER w AS c, lead(y) OVER w AS nx,
         row_number() OVER w AS rn FROM ser WINDOW w AS (PARTITION BY cell_id ORDER BY pos)),
bs AS (SELECT *, list_median([x for x in [a, b, c] if x IS NOT NULL]) AS base FROM lg),
cl AS (SELECT cell_id, pos, y, CASE WHEN rn > 3 AND y < base - greatest(0.2, 0.1 * greatest(base, 0)) AND nx >= base - 0.05
         THEN base - greatest(0.2, 0.1 * greatest(base, 0)) ELSE y END AS clamped FROM bs)"""


def clamped(spark, sf):
    return series.spike_clamp(layers(spark, sf), ["cell_id"], "pos", "y", length=N_T)


@query("spike_clamp", "cell_id:l pos:l clamped:d", f"WITH {CLAMP} --final-- SELECT cell_id, pos, clamped FROM cl")
def spike_clamp(spark, sf):
    return clamped(spark, sf)


FILL = CLAMP + """,
nb AS (SELECT *, last_value(CASE WHEN clamped IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
         first_value(CASE WHEN clamped IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY pos
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, count(clamped) OVER (PARTITION BY cell_id) AS nv FROM cl),
fil AS (SELECT n.cell_id, n.pos, CASE WHEN n.clamped IS NOT NULL THEN n.clamped WHEN pp IS NULL THEN b.clamped WHEN np IS NULL THEN a.clamped
          ELSE a.clamped + (b.clamped - a.clamped) * (n.pos - pp) / (np - pp) END AS filled
        FROM nb n LEFT JOIN cl a ON a.cell_id = n.cell_id AND a.pos = pp LEFT JOIN cl b ON b.cell_id = n.cell_id AND b.pos = np WHERE nv >= 30)"""


def filled(spark, sf):
    return series.gap_fill(cut_lineage(clamped(spark, sf)), ["cell_id"], "pos", "clamped", length=N_T)


@query("gap_fill", "cell_id:l pos:l filled:d", f"WITH {FILL} --final-- SELECT cell_id, pos, filled FROM fil")
def gap_fill(spark, sf):
    return filled(spark, sf)


_INV = series.harmonic_inverse(N_T)
_BASIS = ["1.0"] + [f"sin({2 * math.pi * k / 23!r} * pos)" for k in (1, 2, 3)] + [f"cos({2 * math.pi * k / 23!r} * pos)" for k in (1, 2, 3)]
RESID = FILL + f""",
mo AS (SELECT cell_id, {', '.join(f'sum({b} * filled) AS m{i}' for i, b in enumerate(_BASIS))} FROM fil GROUP BY 1),
be AS (SELECT cell_id, {', '.join('+'.join(f'({float(_INV[j, i])!r}) * m{i}' for i in range(7)) + f' AS b{j}' for j in range(7))} FROM mo),
res AS (SELECT cell_id, pos, filled - ({' + '.join(f'b{j} * {b}' for j, b in enumerate(_BASIS))}) AS residual FROM fil JOIN be USING (cell_id))"""


def median_layers(spark, sf):
    med = quantiles(observations(spark, sf), ["cell_id", "period_no"], "gust", {"m": 0.5})
    return med.select("cell_id", (F.col("period_no") + 1).alias("pos"), (F.col("m") / 10).alias("y"))


def residual_arrays(spark, sf):
    return series.series_arrays(median_layers(spark, sf), ["cell_id"], "pos", "y", N_T)


def residuals(spark, sf):
    return series.series_rows(residual_arrays(spark, sf), ["cell_id"], ["residual"])


@query("harmonic_residual", "cell_id:l pos:l residual:d", f"WITH {RESID} --final-- SELECT cell_id, pos, residual FROM res")
def harmonic_residual(spark, sf):
    return residuals(spark, sf)


_SAMPLES = "smp AS (SELECT o_orderkey AS sample_id, o_custkey % 100 AS cell_id, CAST(o_orderdate AS DATE) AS event_day FROM orders)"
_NEAR = f"""lay AS (SELECT row_number() OVER (ORDER BY obs_date) AS layer_index, obs_date AS layer_date FROM (SELECT DISTINCT obs_date FROM per)),
nr AS (SELECT sample_id, any_value(cell_id) AS cell_id, arg_min(layer_date, (abs(date_diff('day', event_day, layer_date)), layer_date)) AS layer_date,
         arg_min(layer_index, (abs(date_diff('day', event_day, layer_date)), layer_date)) AS layer_index
       FROM (SELECT DISTINCT event_day AS ed FROM smp) x JOIN smp ON event_day = ed, lay GROUP BY sample_id)"""


def samples(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.pmod(F.col("o_custkey"), F.lit(100)).alias("cell_id"),
        F.col("o_orderdate").cast("date").alias("event_day"),
    )


def _nearest(spark, sf):
    return series.nearest_layer(samples(spark, sf), "event_day", cell_periods(spark, sf), "obs_date")


@query("nearest_date_asof", "sample_id:l layer_date:t layer_index:l",
       f"WITH {PERIODS}, {_SAMPLES}, {_NEAR} --final-- SELECT sample_id, layer_date, layer_index FROM nr")
def nearest_date_asof(spark, sf):
    return _nearest(spark, sf)


@query("event_window_mean", "sample_id:l mag:d step_flag:s",
       f"""WITH {RESID}, per AS (SELECT DISTINCT CAST(DATE '1995-01-01' + 16 * period_no AS DATE) AS obs_date FROM obs), {_SAMPLES}, {_NEAR}
       --final-- SELECT sample_id, avg(residual) AS mag, CASE WHEN avg(residual) IS NULL THEN 'step3' ELSE 'step2' END AS step_flag
       FROM nr LEFT JOIN res ON res.cell_id = nr.cell_id AND pos BETWEEN layer_index - 1 AND layer_index + 1 GROUP BY 1""")
def event_window_mean(spark, sf):
    return series.array_window_mean(_nearest(spark, sf), residual_arrays(spark, sf), "cell_id", "layer_index", "residual")


_LOOK = f"""{PERIODS}, {_SAMPLES}, hit AS (
  SELECT s.sample_id, s.cell_id, s.event_day, p.gust, p.obs_date, CAST(p.period_no * 713 % 36000 AS DOUBLE) / 100 AS dir,
         row_number() OVER (PARTITION BY s.sample_id ORDER BY p.gust DESC, p.obs_date) AS rn
  FROM smp s JOIN per p ON p.cell_id = s.cell_id AND p.obs_date BETWEEN s.event_day - 32 AND s.event_day),
pk AS (SELECT * FROM hit WHERE rn = 1)"""


@query("lookback_peak", "sample_id:l max_wind_event:d days_since_peak:d struct_wind_dir_from_deg:d",
       f"""WITH {_LOOK} --final-- SELECT s.sample_id, gust AS max_wind_event, date_diff('day', obs_date, pk.event_day) AS days_since_peak,
       round(dir, 1) AS struct_wind_dir_from_deg FROM smp s LEFT JOIN pk USING (sample_id)""")
def lookback_peak(spark, sf):
    return _lookback(spark, sf, False)


def _lookback(spark, sf, percentile):
    per = cell_periods(spark, sf).withColumn("dir", F.pmod(F.col("period_no") * 713, F.lit(36000)).cast("double") / 100)
    return series.lookback_peak(
        samples(spark, sf), per, sample="sample_id", cell="cell_id", event_day="event_day", obs_day="obs_date",
        value="gust", direction="dir", percentile=percentile, digits=None,
    )


@query("peak_percentile_history", "sample_id:l wind_percentile:d",
       f"""WITH {_LOOK}, h AS (SELECT pk.sample_id, 100.0 * avg(CASE WHEN p.gust <= pk.gust THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct
         FROM pk JOIN per p ON p.cell_id = pk.cell_id AND NOT p.obs_date BETWEEN pk.event_day - 32 AND pk.event_day GROUP BY 1)
       --final-- SELECT sample_id, pct AS wind_percentile FROM smp LEFT JOIN h USING (sample_id)""")
def peak_percentile_history(spark, sf):
    return _lookback(spark, sf, True)
