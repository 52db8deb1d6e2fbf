"""Composites, indicators, month profiles, ranks and quantiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexgale.operators import climatology as clim
from hexgale.operators import composite as comp
from hexgale.operators import indicators as ind
from hexgale.operators import ordered
from hexgale.operators import profile as prof
from hexgale.plans.adapters import OBS, ORIGIN, PERIODS, POINTS, cell_periods, observations, points, table
from hexgale.plans.registry import query

KEYS = ["cell_id", "period_no"]

# --- composites -----------------------------------------------------------------------------------


@query("composite_16d_max", "cell_id:l period_no:l max_value:d n_values:l",
       f"WITH {OBS} --final-- SELECT cell_id, period_no, max(gust) AS max_value, count(gust) AS n_values FROM obs GROUP BY 1, 2")
def composite_16d_max(spark, sf):
    return comp.period_max(observations(spark, sf), KEYS, "gust")


@query("composite_16d_median", "cell_id:l period_no:l median_value:d",
       f"WITH {OBS} --final-- SELECT cell_id, period_no, quantile_cont(gust, 0.5) AS median_value FROM obs GROUP BY 1, 2")
def composite_16d_median(spark, sf):
    return comp.period_median(observations(spark, sf), KEYS, "gust")


@query("value_at_peak", "cell_id:l period_no:l peak_value:d peak_time:t u10:d v10:d",
       f"""WITH {OBS}, r AS (
         SELECT *, row_number() OVER (PARTITION BY cell_id, period_no
                                      ORDER BY gust DESC, obs_date, obs_id, obs_no) AS rn FROM obs)
       --final-- SELECT cell_id, period_no, gust AS peak_value, obs_date AS peak_time, u10, v10 FROM r WHERE rn = 1""")
def value_at_peak(spark, sf):
    return comp.value_at_peak(observations(spark, sf), KEYS, "gust", "obs_date", ["u10", "v10"], ["obs_id", "obs_no"])


@query("rolling_mean_3", "event_id:l value_smooth:d",
       """SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value_smooth FROM events""")
def rolling_mean_3(spark, sf):
    ev = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return comp.rolling_mean(ev, ["user_id"], "t", ["value"], ties=["event_id"])


@query("wind_composite", "user_id:l period_no:l max_wind_speed:d wind_direction:d",
       """WITH e AS (
         SELECT user_id, event_id, ts, value AS fg10, cos(event_id) AS u10, sin(event_id * 0.7) AS v10,
                CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 16.0) AS INTEGER) AS period_no FROM events),
       s AS (
         SELECT *, avg(u10) OVER w AS us, avg(v10) OVER w AS vs FROM e
         WINDOW w AS (PARTITION BY user_id, period_no ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
       p AS (SELECT *, row_number() OVER (PARTITION BY user_id, period_no ORDER BY fg10 DESC, ts) AS rn FROM s)
       --final-- SELECT user_id, period_no, CAST(fg10 AS FLOAT) AS max_wind_speed,
         CAST((degrees(atan2(-us, -vs)) + 360) % 360 AS FLOAT) AS wind_direction FROM p WHERE rn = 1""")
def wind_composite(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", "ts", F.col("value").alias("fg10"), F.cos("event_id").alias("u10"),
        F.sin(F.col("event_id") * 0.7).alias("v10"),
        comp.period_number(F.col("ts").cast("date"), "2024-01-01").alias("period_no"),
    )
    return comp.wind_composite(ev, ["user_id", "period_no"])


@query("chunk_calendar", "period_no:l chunk_start:t chunk_end:t",
       """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders),
       d AS (SELECT unnest(range(0, 1 + date_diff('day', s, e) // 16)) AS period_no, s, e FROM b)
       --final-- SELECT period_no, CAST(s + 16 * period_no::INTEGER AS DATE) AS chunk_start,
         least(CAST(s + 16 * period_no::INTEGER + 15 AS DATE), e) AS chunk_end FROM d""")
def chunk_calendar(spark, sf):
    return comp.chunk_calendar_of(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")), "d")


# --- indicators -----------------------------------------------------------------------------------


@query("weighted_cell_period_mean", "cell_id:l period_no:l mean_pred:d total_weight:d",
       f"""WITH {OBS} --final-- SELECT cell_id, period_no, CAST(sum(weight * pred) / sum(weight) AS FLOAT) AS mean_pred,
       sum(weight) AS total_weight FROM obs GROUP BY 1, 2""")
def weighted_cell_period_mean(spark, sf):
    return ind.weighted_cell_period_mean(observations(spark, sf), KEYS, "pred", "weight")


FLAGS = PERIODS + """,
fl AS (SELECT *, quantile_cont(pred, 0.95) OVER () AS thr FROM per),
act AS (SELECT *, CASE WHEN pred >= thr THEN 1 ELSE 0 END AS active FROM fl)"""


@query("active_flags", "cell_id:l period_no:l pred:d active_threshold:d active_period:l",
       f"WITH {FLAGS} --final-- SELECT cell_id, period_no, pred, thr AS active_threshold, active AS active_period FROM act")
def active_flags(spark, sf):
    return ind.active_flags(cell_periods(spark, sf), "pred")


@query("cell_distribution",
       "cell_id:l forest_area_km2:d mean_pred_disturbance:d pred_p95:d active_share_q:d severity_cond:d "
       "valid_periods:l active_periods:l mask_forest:b mask_valid_periods:b mask_sev_zero:b",
       f"""WITH {FLAGS}, {POINTS}, g AS (
         SELECT cell_id, max(s.weight) AS forest_area_km2, avg(pred) AS m, quantile_cont(pred, 0.95) AS p,
                avg(active) AS a, avg(CASE WHEN active = 1 THEN gust END) AS sv, count(*) AS valid_periods,
                sum(active) AS active_periods
         FROM act JOIN pts s ON s.point_id = cell_id GROUP BY cell_id)
       --final-- SELECT cell_id, forest_area_km2, valid_periods, active_periods, forest_area_km2 > 0 AS mask_forest,
         valid_periods >= 130 AS mask_valid_periods,
         CASE WHEN valid_periods >= 130 THEN m END AS mean_pred_disturbance,
         CASE WHEN valid_periods >= 130 THEN p END AS pred_p95,
         CASE WHEN valid_periods >= 130 THEN a END AS active_share_q,
         CASE WHEN valid_periods >= 130 THEN sv END AS severity_cond,
         forest_area_km2 > 0 AND (valid_periods < 130 OR sv IS NULL) AS mask_sev_zero FROM g""")
def cell_distribution(spark, sf):
    flags = ind.active_flags(cell_periods(spark, sf), "pred")
    area = points(spark, sf).select(F.col("point_id").alias("cell_id"), F.col("weight").alias("area"))
    return ind.cell_distribution(
        flags.join(area, "cell_id"), "cell_id", "pred", "active_period", "area", "gust", min_periods=130
    )


@query("indicator_suite",
       "cell_id:l n_periods:l mean_pred_prob:d p95_pred_prob:d p99_pred_prob:d max_pred_prob:d active_n:l "
       "recurrence_index:d conditional_intensity:d conditional_p95:d active_threshold_used:d active_year_prop_q95:d "
       "winter_share_q95:d",
       f"""WITH {FLAGS}
       --final-- SELECT cell_id, count(*) AS n_periods, avg(pred) AS mean_pred_prob,
         quantile_cont(pred, 0.95) AS p95_pred_prob, quantile_cont(pred, 0.99) AS p99_pred_prob, max(pred) AS max_pred_prob,
         sum(active) AS active_n, sum(active) / count(*) AS recurrence_index,
         coalesce(avg(pred) FILTER (active = 1), 0) AS conditional_intensity,
         coalesce(quantile_cont(pred, 0.95) FILTER (active = 1), 0) AS conditional_p95,
         max(thr) AS active_threshold_used,
         count(DISTINCT year(obs_date)) FILTER (active = 1) / count(DISTINCT year(obs_date)) AS active_year_prop_q95,
         coalesce(avg(CASE WHEN month(obs_date) IN (12, 1, 2) THEN 1 ELSE 0 END) FILTER (active = 1), 0) AS winter_share_q95
       FROM act GROUP BY cell_id""")
def indicator_suite(spark, sf):
    return ind.indicator_suite(cell_periods(spark, sf), "cell_id", "obs_date", "pred")


@query("prediction_rollup", "cell_id:l pred_mean_long:d pred_p95_long:d pred_max_long:d n_periods:l",
       f"""WITH {PERIODS} --final-- SELECT cell_id, avg(pred) AS pred_mean_long, quantile_cont(pred, 0.95) AS pred_p95_long,
       max(pred) AS pred_max_long, count(pred) AS n_periods FROM per WHERE year(obs_date) BETWEEN 1996 AND 2000 GROUP BY 1""")
def prediction_rollup(spark, sf):
    return ind.prediction_rollup(cell_periods(spark, sf), "cell_id", "obs_date", "pred", 1996, 2000)


# --- month profiles -------------------------------------------------------------------------------

PREP = PERIODS + """,
prep AS (SELECT *, least(greatest(pred, 0), 1) AS p, year(obs_date) AS y, month(obs_date) AS m FROM per)"""


def prepared(spark, sf):
    return prof.prepared_predictions(cell_periods(spark, sf), "obs_date", "pred")


@query("clip_counts", "n_below:l n_above:l n_values:l",
       f"""WITH {OBS} --final-- SELECT count(*) FILTER (pred < 0) AS n_below, count(*) FILTER (pred > 1) AS n_above,
       count(pred) AS n_values FROM obs""")
def clip_counts(spark, sf):
    return prof.clip_counts(observations(spark, sf), "pred")


@query("cell_totals",
       "cell_id:l total_pred_mass:d mean_pred_longterm:d median_pred_longterm:d max_pred:d n_periods:l "
       "n_active_periods:l active_fraction:d",
       f"""WITH {FLAGS} --final-- SELECT cell_id, sum(pred) AS total_pred_mass, avg(pred) AS mean_pred_longterm,
       quantile_cont(pred, 0.5) AS median_pred_longterm, max(pred) AS max_pred, count(*) AS n_periods,
       sum(active) AS n_active_periods, avg(active) AS active_fraction FROM act GROUP BY 1""")
def cell_totals(spark, sf):
    return prof.cell_totals(ind.active_flags(cell_periods(spark, sf), "pred"), "cell_id", "pred", "active_period")


DENSE = PREP + """,
mon AS (SELECT cell_id, m, sum(p) AS s, avg(p) AS a, count(*) AS n FROM prep GROUP BY 1, 2),
grid AS (SELECT cell_id, m FROM (SELECT DISTINCT cell_id FROM prep), (SELECT unnest(range(1, 13)) AS m)),
den AS (SELECT g.cell_id, g.m, coalesce(s, 0) AS s, coalesce(a, 0) AS a, coalesce(n, 0) AS n
        FROM grid g LEFT JOIN mon ON mon.cell_id = g.cell_id AND mon.m = g.m),
sh AS (SELECT *, s / nullif(sum(s) OVER (PARTITION BY cell_id), 0) AS ms,
              a / nullif(sum(a) OVER (PARTITION BY cell_id), 0) AS mi FROM den)"""


def month_profile(spark, sf):
    return prof.month_profile(prepared(spark, sf), "cell_id", "pred")


@query("dense_month_grid", "cell_id:l month:l monthly_pred_sum:d monthly_pred_mean:d n_periods_month:l",
       f"""WITH {DENSE} --final-- SELECT cell_id, m AS month, s AS monthly_pred_sum, a AS monthly_pred_mean,
       n AS n_periods_month FROM den""")
def dense_month_grid(spark, sf):
    return month_profile(spark, sf)


@query("month_profile_long", "cell_id:l month:l monthly_mass_share:d monthly_intensity_share:d monthly_share:d",
       f"""WITH {DENSE} --final-- SELECT cell_id, m AS month, ms AS monthly_mass_share, mi AS monthly_intensity_share,
       mi AS monthly_share FROM sh""")
def month_profile_long(spark, sf):
    return month_profile(spark, sf)


_WIDE = ", ".join(
    f"max(CASE WHEN m = {m} THEN mi END) AS m{m:02d}_share, max(CASE WHEN m = {m} THEN a END) AS m{m:02d}_mean_pred, "
    f"max(CASE WHEN m = {m} THEN s END) AS m{m:02d}_sum_pred"
    for m in range(1, 13)
)


@query("month_profile_wide",
       "cell_id:l " + " ".join(f"m{m:02d}_{k}:d" for m in range(1, 13) for k in ("share", "mean_pred", "sum_pred")),
       f"WITH {DENSE} --final-- SELECT cell_id, {_WIDE} FROM sh GROUP BY cell_id")
def month_profile_wide(spark, sf):
    return prof.month_profile_wide(month_profile(spark, sf), "cell_id")


TIMING = DENSE + f""",
tsum AS (SELECT cell_id, sum(mi) AS t, sum(mi * mi) AS q, sum(mi * cos({2 * math.pi / 12!r} * (m - 1))) AS c,
                sum(mi * sin({2 * math.pi / 12!r} * (m - 1))) AS s, max(mi) AS pk FROM sh GROUP BY cell_id),
tpk AS (SELECT sh.cell_id, min(m) AS pm FROM sh JOIN tsum USING (cell_id) WHERE mi = pk GROUP BY 1),
tim AS (SELECT cell_id, pm AS peak_month, pk / t AS peak_share, q / (t * t) AS hhi, t * t / q AS eff,
               CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + {2 * math.pi!r} ELSE atan2(s, c) END
                 / {2 * math.pi!r} * 12 + 1 AS cmm,
               sqrt(c * c + s * s) / t AS conc
        FROM tsum JOIN tpk USING (cell_id))"""
_LABELS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


@query("timing_metrics",
       "cell_id:l profile_basis:s peak_month:l peak_month_name:s peak_month_share:d monthly_hhi:d effective_months:d "
       "peak_vs_circular_month_diff:l peak_month_reliable:l",
       f"""WITH {TIMING} --final-- SELECT cell_id, 'mean' AS profile_basis, peak_month, {_LABELS}[peak_month] AS peak_month_name,
       peak_share AS peak_month_share, hhi AS monthly_hhi, eff AS effective_months,
       least(abs(peak_month - round_even(cmm, 0)), 12 - abs(peak_month - round_even(cmm, 0))) AS peak_vs_circular_month_diff,
       1 AS peak_month_reliable FROM tim""")
def timing_metrics(spark, sf):
    return prof.timing_metrics(month_profile(spark, sf), "cell_id")


@query("circular_mean_month", "cell_id:l circular_mean_month:d circular_mean_month_name:s circular_concentration:d",
       f"""WITH {TIMING} --final-- SELECT cell_id, cmm AS circular_mean_month,
       {_LABELS}[least(12, greatest(1, round_even(cmm, 0)))::INTEGER] AS circular_mean_month_name,
       conc AS circular_concentration FROM tim""")
def circular_mean_month(spark, sf):
    return prof.timing_metrics(month_profile(spark, sf), "cell_id")


@query("metric_summary", "metric:s n:l mean:d sd:d p05:d p25:d median:d p75:d p95:d min:d max:d",
       f"""WITH {TIMING}, lg AS (
         SELECT 'peak_month' AS metric, CAST(peak_month AS DOUBLE) AS v FROM tim
         UNION ALL SELECT 'peak_month_share', peak_share FROM tim UNION ALL SELECT 'effective_months', eff FROM tim
         UNION ALL SELECT 'circular_mean_month', cmm FROM tim UNION ALL SELECT 'circular_concentration', conc FROM tim)
       --final-- SELECT metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.05) AS p05,
         quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75,
         quantile_cont(v, 0.95) AS p95, min(v) AS min, max(v) AS max FROM lg GROUP BY metric""")
def metric_summary(spark, sf):
    t = prof.timing_metrics(month_profile(spark, sf), "cell_id")
    return prof.metric_summary(
        t, ["peak_month", "peak_month_share", "effective_months", "circular_mean_month", "circular_concentration"]
    )


@query("peak_month_frequency", "peak_month:l n_hex:l month_name:s share_hex:d",
       f"""WITH {TIMING}, c AS (SELECT m, count(cell_id) AS n FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN tim ON peak_month = m GROUP BY m)
       --final-- SELECT m AS peak_month, n AS n_hex, {_LABELS}[m] AS month_name, n / sum(n) OVER () AS share_hex FROM c""")
def peak_month_frequency(spark, sf):
    return prof.category_frequency(prof.timing_metrics(month_profile(spark, sf), "cell_id"), "peak_month")


@query("share_of_total", "cell_id:l period_no:l share:d",
       f"WITH {PERIODS} --final-- SELECT cell_id, period_no, pred / sum(pred) OVER (PARTITION BY cell_id) AS share FROM per")
def share_of_total(spark, sf):
    return prof.share_of_total(cell_periods(spark, sf), ["cell_id"], "pred")


@query("cell_month_table", "cell_id:l total_pred_mass:d m01_share:d m07_sum_pred:d effective_months:d",
       f"""WITH {TIMING} --final-- SELECT t.cell_id, (SELECT sum(p) FROM prep WHERE prep.cell_id = t.cell_id) AS total_pred_mass,
       (SELECT max(mi) FROM sh WHERE sh.cell_id = t.cell_id AND m = 1) AS m01_share,
       (SELECT max(s) FROM sh WHERE sh.cell_id = t.cell_id AND m = 7) AS m07_sum_pred, eff AS effective_months FROM tim t""")
def cell_month_table(spark, sf):
    profile = month_profile(spark, sf)
    return prof.cell_month_table(
        prof.cell_totals(prepared(spark, sf), "cell_id", "pred"),
        prof.month_profile_wide(profile, "cell_id"),
        prof.timing_metrics(profile, "cell_id"),
        "cell_id",
    )


@query("temporal_from_periods", "cell_id:l pred_peak_month:l pred_peak_share:d pred_effective_months:d",
       f"""WITH {PREP}, mm AS (SELECT cell_id, m, avg(pred) AS v FROM prep GROUP BY 1, 2),
       a AS (SELECT cell_id, sum(v) AS t, sum(v * v) AS q, max(v) AS pk FROM mm GROUP BY 1)
       --final-- SELECT cell_id, (SELECT min(m) FROM mm WHERE mm.cell_id = a.cell_id AND v = pk) AS pred_peak_month,
       pk / t AS pred_peak_share, t * t / q AS pred_effective_months FROM a""")
def temporal_from_periods(spark, sf):
    return prof.temporal_from_periods(cell_periods(spark, sf), "cell_id", "obs_date", "pred")


# --- ranks and quantiles --------------------------------------------------------------------------


@query("avg_rank_pct", "cell_id:l period_no:l pct:d",
       f"""WITH {PERIODS}, r AS (SELECT *, CAST(gust AS INTEGER) AS g FROM per)
       --final-- SELECT cell_id, period_no, (rank() OVER (PARTITION BY cell_id ORDER BY g)
         + (count(*) OVER (PARTITION BY cell_id, g) - 1) / 2.0) / count(*) OVER (PARTITION BY cell_id) * 100.0 AS pct FROM r""")
def avg_rank_pct(spark, sf):
    # Rounded gusts, so that ties occur.
    per = cell_periods(spark, sf).withColumn("g", F.rint("gust").cast("int"))
    ranked = ordered.average_rank(per, ["cell_id"], "g")
    return ranked.withColumn("pct", F.col("avg_rank") / F.col("avg_rank_n") * 100.0)


@query("global_rank_pct", "event_id:l pct:d",
       """SELECT event_id, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)
       / count(*) OVER () AS pct FROM events""")
def global_rank_pct(spark, sf):
    ranked = ordered.average_rank(table(spark, sf, "events").select("event_id", "value"), [], "value")
    return ranked.withColumn("pct", F.col("avg_rank") / F.col("avg_rank_n"))


@query("ordinal_rank_pct", "event_id:l pct:d",
       "SELECT event_id, (row_number() OVER (ORDER BY value, event_id) - 1) / (count(*) OVER () - 1) AS pct FROM events")
def ordinal_rank_pct(spark, sf):
    return clim.ordinal_percentile(table(spark, sf, "events").select("event_id", "value"), "value", "event_id")


@query("quantile_global", "q02:d q50:d q98:d",
       "SELECT quantile_cont(value, 0.02) AS q02, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.98) AS q98 FROM events")
def quantile_global(spark, sf):
    return ordered.quantiles(table(spark, sf, "events"), [], "value", {"q02": 0.02, "q50": 0.5, "q98": 0.98})


_WQ = POINTS + """,
ok AS (SELECT *, sum(w) OVER (ORDER BY v, id) AS cum, sum(w) OVER () AS tot FROM
       (SELECT o_orderkey AS id, o_totalprice AS v, CAST(o_custkey % 7 AS DOUBLE) - 1 AS w FROM orders) WHERE w > 0)"""


def _weighted_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"),
        (F.pmod(F.col("o_custkey"), F.lit(7)).cast("double") - 1).alias("w"),
    )


@query("weighted_quantile_interp", "q25:d q50:d q80:d",
       f"""WITH {_WQ}, br AS (SELECT *, cum / tot AS cdf, lag(cum / tot) OVER (ORDER BY v, id) AS pcdf,
              lag(v) OVER (ORDER BY v, id) AS pv FROM ok),
       r AS (SELECT q, v, cdf, pv, pcdf, row_number() OVER (PARTITION BY q ORDER BY v, id) AS rn
             FROM br JOIN (SELECT unnest([0.25, 0.5, 0.8]::DOUBLE[]) AS q) ON cdf >= q),
       o AS (SELECT q, CASE WHEN pv IS NULL THEN v ELSE pv + (q - pcdf) / (cdf - pcdf) * (v - pv) END AS x FROM r WHERE rn = 1)
       --final-- SELECT max(CASE WHEN q = 0.25 THEN x END) AS q25, max(CASE WHEN q = 0.5 THEN x END) AS q50,
       max(CASE WHEN q = 0.8 THEN x END) AS q80 FROM o""")
def weighted_quantile_interp(spark, sf):
    return ordered.weighted_quantiles(
        _weighted_orders(spark, sf), [], "v", "w", {"q25": 0.25, "q50": 0.5, "q80": 0.8}, method="interp", tie="id"
    )


@query("weighted_quantile_step", "q25:d q50:d q80:d",
       f"""WITH {_WQ} --final-- SELECT min(v) FILTER (cum >= 0.25 * tot) AS q25, min(v) FILTER (cum >= 0.5 * tot) AS q50,
       min(v) FILTER (cum >= 0.8 * tot) AS q80 FROM ok""")
def weighted_quantile_step(spark, sf):
    return ordered.weighted_quantiles(
        _weighted_orders(spark, sf), [], "v", "w", {"q25": 0.25, "q50": 0.5, "q80": 0.8}, method="step"
    )
