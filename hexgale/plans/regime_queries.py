"""Climatology, anomaly events, wind regimes, correspondence and rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexgale.functions.scalar import background_label, quadrant
from hexgale.operators import climatology as clim
from hexgale.operators import correspondence as cor
from hexgale.operators import profile as prof
from hexgale.operators import regimes as reg
from hexgale.plans.adapters import OBS, PERIODS, REGIME, cell_periods, observations, regime_cells
from hexgale.plans.registry import query
from hexgale.session import cut_lineage

MON = OBS + ",\nom AS (SELECT *, month(obs_date) AS m FROM obs)"


@query("climatology", "cell_id:l max_value:d q95:d mean_value:d std_value:d std_safe:d n_values:l",
       f"""WITH {OBS} --final-- SELECT cell_id, max(gust) AS max_value, quantile_cont(gust, 0.95) AS q95, avg(gust) AS mean_value,
       stddev_pop(gust) AS std_value, greatest(stddev_pop(gust), 1.0) AS std_safe, count(gust) AS n_values FROM obs GROUP BY 1""")
def climatology(spark, sf):
    return clim.climatology(observations(spark, sf), ["cell_id"], "gust")


@query("climatology_month", "cell_id:l month:l mean_value:d std_safe:d n_values:l",
       f"""WITH {MON} --final-- SELECT cell_id, m AS month, avg(gust) AS mean_value,
       greatest(stddev_pop(gust), 1.0) AS std_safe, count(gust) AS n_values FROM om GROUP BY 1, 2""")
def climatology_month(spark, sf):
    return clim.moments(observations(spark, sf).withColumn("month", F.month("obs_date")), ["cell_id", "month"], "gust")


def _z_sql(same_month: bool) -> str:
    part = "cell_id, m" if same_month else "cell_id"
    return MON + f""",
z AS (SELECT *, (gust - avg(gust) OVER (PARTITION BY {part})) / greatest(stddev_pop(gust) OVER (PARTITION BY {part}), 1.0) AS z FROM om)"""


_YEARS = "(SELECT date_diff('day', min(obs_date), max(obs_date)) / 365.25::DOUBLE FROM obs)"


def _events_sql(same_month: bool) -> str:
    return f"""WITH {_z_sql(same_month)} --final-- SELECT cell_id, max(z) AS max_z, count(*) FILTER (z > 1.5) AS n_events,
    count(*) FILTER (z > 1.5) / {_YEARS} AS events_per_year FROM z GROUP BY 1"""


@query("zscore_events", "cell_id:l max_z:d n_events:l events_per_year:d", _events_sql(False))
def zscore_events(spark, sf):
    return clim.anomaly_events(observations(spark, sf), ["cell_id"], "obs_date", "gust", threshold=1.5)


@query("zscore_events_month", "cell_id:l max_z:d n_events:l events_per_year:d", _events_sql(True))
def zscore_events_month(spark, sf):
    return clim.anomaly_events(observations(spark, sf), ["cell_id"], "obs_date", "gust", same_month=True, threshold=1.5)


@query("background_overlay", "cell_id:l background:s label:s z_value:d freq_value:d",
       f"""WITH {MON}, zl AS (SELECT *, (gust - avg(gust) OVER w1) / greatest(stddev_pop(gust) OVER w1, 1.0) AS zl,
         (gust - avg(gust) OVER w2) / greatest(stddev_pop(gust) OVER w2, 1.0) AS zm FROM om
         WINDOW w1 AS (PARTITION BY cell_id), w2 AS (PARTITION BY cell_id, m))
       --final-- SELECT cell_id, 'long_term' AS background, 'long-term background' AS label, CAST(max(zl) AS FLOAT) AS z_value,
         CAST(count(*) FILTER (zl > 1.5) / {_YEARS} AS FLOAT) AS freq_value FROM zl GROUP BY 1
       UNION ALL SELECT cell_id, 'same_month', 'same-month background', CAST(max(zm) AS FLOAT),
         CAST(count(*) FILTER (zm > 1.5) / {_YEARS} AS FLOAT) FROM zl GROUP BY 1""")
def background_overlay(spark, sf):
    out = clim.background_overlay(zscore_events(spark, sf), zscore_events_month(spark, sf), ["cell_id"])
    return out.withColumn("label", background_label(F.col("background")))


@query("event_timing", "cell_id:l n_events:l peak_month:l peak_share:d effective_months:d",
       f"""WITH {_z_sql(False)}, n AS (SELECT cell_id, m, count(*) FILTER (z > 1.5) AS n FROM z GROUP BY 1, 2),
       t AS (SELECT cell_id, sum(n) AS t, max(n) AS mx, sum(n * n) AS q FROM n GROUP BY 1)
       --final-- SELECT cell_id, t AS n_events, CASE WHEN t >= 3 THEN (SELECT min(m) FROM n WHERE n.cell_id = t.cell_id AND n.n = mx) END AS peak_month,
         CASE WHEN t >= 3 THEN mx / t END AS peak_share, CASE WHEN t >= 3 THEN t * t / q END AS effective_months FROM t""")
def event_timing(spark, sf):
    return clim.event_timing(observations(spark, sf), "cell_id", "obs_date", "gust", threshold=1.5)


HEXZ = PERIODS + """,
hz AS (SELECT *, month(obs_date) AS m,
         (gust - avg(gust) OVER (PARTITION BY cell_id)) / nullif(stddev_samp(gust) OVER (PARTITION BY cell_id), 0) AS z FROM per),
amp AS (SELECT cell_id, m, avg(CASE WHEN z >= 1.0 THEN 1.0 ELSE 0.0 END) AS f, avg(greatest(z, 0)) AS i, count(z) AS n
        FROM hz GROUP BY 1, 2)"""


def _hex_z(spark, sf):
    return clim.hex_z(cell_periods(spark, sf), ["cell_id"], "gust")


@query("hex_zscore", "cell_id:l period_no:l z:d", f"WITH {HEXZ} --final-- SELECT cell_id, period_no, z FROM hz")
def hex_zscore(spark, sf):
    return _hex_z(spark, sf)


def _month_anomalies(spark, sf):
    return clim.month_anomaly_profile(_hex_z(spark, sf), "cell_id", "obs_date", "z", threshold=1.0, sampled=True)


@query("anomaly_month_profile", "cell_id:l month:l anomaly_frequency:d anomaly_intensity:d n_anomaly_periods:l",
       f"""WITH {HEXZ} --final-- SELECT cell_id, m AS month, f AS anomaly_frequency, i AS anomaly_intensity,
       n AS n_anomaly_periods FROM amp""")
def anomaly_month_profile(spark, sf):
    return _month_anomalies(spark, sf)


@query("contrast_score", "cell_id:l pct_intensity:d pct_frequency:d score:d bivariate_class:l",
       f"""WITH {REGIME}, r AS (SELECT cell_id, (row_number() OVER (ORDER BY z_anomaly, cell_id) - 1) / (count(*) OVER () - 1) AS i,
         (row_number() OVER (ORDER BY anomaly_frequency, cell_id) - 1) / (count(*) OVER () - 1) AS f FROM reg)
       --final-- SELECT cell_id, i AS pct_intensity, f AS pct_frequency, i - f AS score,
         CASE WHEN i >= 0.75 THEN 2 ELSE 0 END + CASE WHEN f >= 0.75 THEN 1 ELSE 0 END AS bivariate_class FROM r""")
def contrast_score(spark, sf):
    s = clim.contrast_score(regime_cells(spark, sf), "cell_id", "z_anomaly", "anomaly_frequency")
    return s.withColumn("bivariate_class", reg.bivariate_class(F.col("pct_intensity"), F.col("pct_frequency")))


# --- regimes --------------------------------------------------------------------------------------

VALID = REGIME + ",\nval AS (SELECT * FROM reg WHERE area_weight_km2 > 0)"


def _wq(v: str, q: float) -> str:
    """Area-weighted interpolated quantile of the valid rows as a scalar subquery."""
    return f"""(SELECT CASE WHEN pv IS NULL THEN v ELSE pv + ({q} - pc) / (c - pc) * (v - pv) END FROM (
      SELECT v, id, c, lag(c) OVER (ORDER BY v, id) AS pc, lag(v) OVER (ORDER BY v, id) AS pv FROM (
        SELECT {v} AS v, cell_id AS id, sum(area_weight_km2) OVER (ORDER BY {v}, cell_id) / sum(area_weight_km2) OVER () AS c FROM val))
      WHERE c >= {q} ORDER BY v, id LIMIT 1)"""


def _class(freq: str, intens: str) -> str:
    return (f"CASE WHEN {freq} AND {intens} THEN '{reg.COMPOUND}' WHEN {freq} THEN '{reg.RECURRENT}' "
            f"WHEN {intens} THEN '{reg.INTENSE}' ELSE '{reg.BACKGROUND}' END")


FLAGGED = VALID + f""",
thr AS (SELECT {_wq('mean_prob', 0.8)} AS tm, {_wq('p95_prob', 0.8)} AS tp, {_wq('anomaly_frequency', 0.75)} AS tf,
               {_wq('z_anomaly', 0.75)} AS ti),
flg AS (SELECT v.*, mean_prob >= tm AS hm, p95_prob >= tp AS hp, anomaly_frequency >= tf AS hf, z_anomaly >= ti AS hi,
               {_class('anomaly_frequency >= tf', 'z_anomaly >= ti')} AS rg, tm, tp FROM val v, thr)"""


def flagged(spark, sf):
    flags = cut_lineage(reg.prediction_flags(regime_cells(spark, sf), "cell_id"))
    return cut_lineage(reg.wind_regimes(flags, "cell_id"))


@query("regime_classes", "cell_id:l analysis_valid:b high_mean:b high_p95:b high_frequency:b high_intensity:b wind_regime:s",
       f"""WITH {FLAGGED} --final-- SELECT r.cell_id, f.cell_id IS NOT NULL AS analysis_valid, coalesce(hm, false) AS high_mean,
       coalesce(hp, false) AS high_p95, coalesce(hf, false) AS high_frequency, coalesce(hi, false) AS high_intensity,
       coalesce(rg, '{reg.INVALID}') AS wind_regime FROM reg r LEFT JOIN flg f USING (cell_id)""")
def regime_classes(spark, sf):
    return flagged(spark, sf)


@query("regime_mass",
       "wind_regime:s n_cells:l area_km2:d area_share_percent:d mean_prob_area_weighted_mean:d p95_prob_area_weighted_mean:d "
       "anomaly_frequency_area_weighted_mean:d anomaly_intensity_area_weighted_mean:d mean_prediction_mass_share_percent:d "
       "mean_mass_to_area_ratio:d p95_prediction_mass_share_percent:d p95_mass_to_area_ratio:d",
       f"""WITH {FLAGGED}, t AS (SELECT sum(area_weight_km2) AS a, sum(mean_prob * area_weight_km2) AS m,
         sum(p95_prob * area_weight_km2) AS p FROM flg),
       g AS (SELECT x.rg, count(cell_id) AS n, coalesce(sum(area_weight_km2), 0) AS a, sum(mean_prob * area_weight_km2) AS m,
         sum(p95_prob * area_weight_km2) AS p, sum(anomaly_frequency * area_weight_km2) AS f, sum(z_anomaly * area_weight_km2) AS z
         FROM (SELECT unnest({reg.REGIMES!r}) AS rg) x LEFT JOIN flg ON flg.rg = x.rg GROUP BY x.rg)
       --final-- SELECT rg AS wind_regime, n AS n_cells, g.a AS area_km2, 100 * g.a / t.a AS area_share_percent,
         g.m / nullif(g.a, 0) AS mean_prob_area_weighted_mean, g.p / nullif(g.a, 0) AS p95_prob_area_weighted_mean,
         g.f / nullif(g.a, 0) AS anomaly_frequency_area_weighted_mean, g.z / nullif(g.a, 0) AS anomaly_intensity_area_weighted_mean,
         100 * g.m / t.m AS mean_prediction_mass_share_percent, (g.m / t.m) / nullif(g.a / t.a, 0) AS mean_mass_to_area_ratio,
         100 * g.p / t.p AS p95_prediction_mass_share_percent, (g.p / t.p) / nullif(g.a / t.a, 0) AS p95_mass_to_area_ratio
       FROM g, t""")
def regime_mass(spark, sf):
    return reg.regime_mass(flagged(spark, sf))


@query("regime_enrichment",
       "wind_regime:s prediction_metric:s prediction_column:s top_prediction_quantile:d prediction_threshold:d "
       "background_area_share_percent:d top_prediction_area_share_percent:d enrichment_ratio:d top_prediction_regime_area_km2:d",
       f"""WITH {FLAGGED}, l AS (
         SELECT *, 'Mean probability' AS pm, 'mean_prob' AS pc, hm AS top, tm AS t FROM flg
         UNION ALL SELECT *, 'P95 probability', 'p95_prob', hp, tp FROM flg),
       x AS (SELECT r, pm, pc, t FROM (SELECT unnest({reg.REGIMES!r}) AS r), (SELECT DISTINCT pm, pc, t FROM l)),
       g AS (SELECT x.r, x.pm, x.pc, x.t, coalesce(sum(area_weight_km2), 0) AS bg, coalesce(sum(area_weight_km2) FILTER (top), 0) AS tp
         FROM x LEFT JOIN l ON l.rg = x.r AND l.pm = x.pm GROUP BY 1, 2, 3, 4),
       s AS (SELECT *, bg / sum(bg) OVER (PARTITION BY pm) AS bs, tp / sum(tp) OVER (PARTITION BY pm) AS ts FROM g)
       --final-- SELECT r AS wind_regime, pm AS prediction_metric, pc AS prediction_column, 0.8 AS top_prediction_quantile,
         t AS prediction_threshold, 100 * bs AS background_area_share_percent, 100 * ts AS top_prediction_area_share_percent,
         ts / nullif(bs, 0) AS enrichment_ratio, tp AS top_prediction_regime_area_km2 FROM s""")
def regime_enrichment(spark, sf):
    return reg.regime_enrichment(flagged(spark, sf), "cell_id")


_OV = " UNION ALL ".join(
    f"SELECT '{label}' AS pm, '{c}' AS pc, {q} AS q, {_wq(c, q)} AS t"
    for label, c in reg.PREDICTIONS.items() for q in (0.7, 0.8, 0.9)
)


@query("overlay_enrichment",
       "prediction_metric:s prediction_column:s top_prediction_quantile:d prediction_threshold:d wind_context:s "
       "background_area_share_percent:d top_prediction_area_share_percent:d enrichment_ratio:d overlap_area_km2:d",
       f"""WITH {FLAGGED}, lim AS ({_OV}),
       l AS (SELECT pm, pc, q, t, area_weight_km2 AS a, hf, hi, CASE WHEN pc = 'mean_prob' THEN mean_prob ELSE p95_prob END >= t AS top
             FROM flg, lim),
       c AS (SELECT pm, pc, q, t, sum(a) AS tot, sum(a) FILTER (top) AS top, coalesce(sum(a) FILTER (hf), 0) AS b0, coalesce(sum(a) FILTER (hi), 0) AS b1,
              coalesce(sum(a) FILTER (hf AND hi), 0) AS b2, coalesce(sum(a) FILTER (NOT hf AND hi), 0) AS b3,
              coalesce(sum(a) FILTER (hf AND top), 0) AS t0, coalesce(sum(a) FILTER (hi AND top), 0) AS t1,
              coalesce(sum(a) FILTER (hf AND hi AND top), 0) AS t2, coalesce(sum(a) FILTER (NOT hf AND hi AND top), 0) AS t3 FROM l GROUP BY 1, 2, 3, 4),
       f AS (SELECT pm, pc, q, t, tot, top, unnest({reg.CONTEXTS!r}) AS cx, unnest([b0, b1, b2, b3]) AS bg, unnest([t0, t1, t2, t3]) AS tc FROM c)
       --final-- SELECT pm AS prediction_metric, pc AS prediction_column, q AS top_prediction_quantile, t AS prediction_threshold,
         cx AS wind_context, 100 * bg / tot AS background_area_share_percent, 100 * tc / top AS top_prediction_area_share_percent,
         (tc / top) / nullif(bg / tot, 0) AS enrichment_ratio, tc AS overlap_area_km2 FROM f""")
def overlay_enrichment(spark, sf):
    return reg.overlay_enrichment(flagged(spark, sf), "cell_id")


_GRID = " UNION ALL ".join(
    f"SELECT {q} AS wq, {_wq('anomaly_frequency', q)} AS tf, {_wq('z_anomaly', q)} AS ti" for q in (0.7, 0.75, 0.8)
)


@query("threshold_sensitivity",
       "wind_quantile:d frequency_threshold:d intensity_threshold:d prediction_metric_for_best_enrichment:s "
       "best_enriched_regime:s best_enrichment_ratio:d wind_regime:s area_share_percent:d mean_mass_to_area_ratio:d "
       "p95_mass_to_area_ratio:d",
       f"""WITH {FLAGGED}, gr AS ({_GRID}),
       l AS (SELECT wq, gr.tf, gr.ti, area_weight_km2 AS a, mean_prob AS m, p95_prob AS p, hm, hp,
              {_class('anomaly_frequency >= gr.tf', 'z_anomaly >= gr.ti')} AS r FROM flg, gr),
       x AS (SELECT wq, tf, ti, r FROM gr, (SELECT unnest({reg.REGIMES!r}) AS r)),
       s AS (SELECT x.wq, x.tf, x.ti, x.r, coalesce(sum(a), 0) AS a, sum(a * m) AS m, sum(a * p) AS p,
              coalesce(sum(a) FILTER (hm), 0) AS am, coalesce(sum(a) FILTER (hp), 0) AS ap
             FROM x LEFT JOIN l ON l.wq = x.wq AND l.r = x.r GROUP BY 1, 2, 3, 4),
       h AS (SELECT *, a / sum(a) OVER w AS sa, m / sum(m) OVER w AS sm, p / sum(p) OVER w AS sp,
              am / sum(am) OVER w AS sam, ap / sum(ap) OVER w AS sap FROM s WINDOW w AS (PARTITION BY wq)),
       e AS (SELECT *, 'Mean probability' AS pm, sam / nullif(sa, 0) AS ratio FROM h
             UNION ALL SELECT *, 'P95 probability', sap / nullif(sa, 0) FROM h)
       --final-- SELECT wq AS wind_quantile, tf AS frequency_threshold, ti AS intensity_threshold,
         pm AS prediction_metric_for_best_enrichment,
         first_value(r) OVER w AS best_enriched_regime, first_value(ratio) OVER w AS best_enrichment_ratio, r AS wind_regime,
         100 * sa AS area_share_percent, sm / nullif(sa, 0) AS mean_mass_to_area_ratio, sp / nullif(sa, 0) AS p95_mass_to_area_ratio
       FROM e WINDOW w AS (PARTITION BY wq, pm ORDER BY ratio DESC NULLS LAST, r DESC)""")
def threshold_sensitivity(spark, sf):
    return reg.threshold_sensitivity(flagged(spark, sf), "cell_id")


_BIN = "greatest(1, ceil((row_number() OVER (ORDER BY {c}, {k}) - 1) * {n} / (count(*) OVER () - 1)))::BIGINT"


@query("first_rank_bins", "event_id:l bin:l",
       f"SELECT event_id, {_BIN.format(c='value', k='event_id', n=5)} AS bin FROM events")
def first_rank_bins(spark, sf):
    from hexgale.plans.adapters import table

    return reg.first_rank_bins(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 5, "bin")


@query("response_surface", "z_bin:l freq_bin:l n:l prediction_lift:d",
       f"""WITH {VALID}, b AS (SELECT *, {_BIN.format(c='z_anomaly', k='cell_id', n=5)} AS zb,
         {_BIN.format(c='anomaly_frequency', k='cell_id', n=5)} AS fb FROM val),
       g AS (SELECT z_bin, freq_bin FROM (SELECT unnest([1, 2, 3, 4, 5]) AS z_bin), (SELECT unnest([1, 2, 3, 4, 5]) AS freq_bin))
       --final-- SELECT z_bin, freq_bin, count(cell_id) AS n, CASE WHEN count(cell_id) >= 10 THEN
         sum(mean_prob * area_weight_km2) / sum(area_weight_km2)
         / (SELECT sum(mean_prob * area_weight_km2) / sum(area_weight_km2) FROM val) END AS prediction_lift
       FROM g LEFT JOIN b ON zb = z_bin AND fb = freq_bin GROUP BY 1, 2""")
def response_surface(spark, sf):
    valid = regime_cells(spark, sf).where(reg.analysis_valid())
    return reg.response_surface(valid, "cell_id", "mean_prob")


_QUAD = """CASE WHEN lon < 14.4378 AND lat >= 50.0755 THEN 'Northwest' WHEN lat >= 50.0755 THEN 'Northeast'
             WHEN lon < 14.4378 THEN 'Southwest' ELSE 'Southeast' END"""


@query("class_enrichment",
       "region:s prediction_column:s metric_label:s top_pct:l threshold:d class:s background_area_share:d top_area_share:d "
       "enrichment_ratio:d",
       f"""WITH {FLAGGED}, lv AS (
         SELECT *, 'Continental' AS region FROM flg UNION ALL SELECT *, {_QUAD} AS region FROM flg),
       l AS (SELECT region, 'mean_prob' AS pc, mean_prob AS v, area_weight_km2 AS a, rg FROM lv
             UNION ALL SELECT region, 'p95_prob', p95_prob, area_weight_km2, rg FROM lv),
       p AS (SELECT unnest([5, 10, 20, 30]) AS pct),
       t AS (SELECT region, pc, unnest([5, 10, 20, 30]) AS pct,
              unnest(quantile_cont(v, [0.95, 0.9, 0.8, 0.7])) AS t FROM l GROUP BY 1, 2),
       x AS (SELECT t.*, r FROM t, (SELECT unnest({reg.REGIMES!r}) AS r)),
       g AS (SELECT x.region, x.pc, x.pct, x.t, x.r, coalesce(sum(a), 0) AS bg, coalesce(sum(a) FILTER (v >= x.t), 0) AS tc
             FROM x LEFT JOIN l ON l.region = x.region AND l.pc = x.pc AND l.rg = x.r GROUP BY 1, 2, 3, 4, 5),
       s AS (SELECT *, bg / sum(bg) OVER w AS bs, tc / nullif(sum(tc) OVER w, 0) AS ts FROM g WINDOW w AS (PARTITION BY region, pc, pct))
       --final-- SELECT region, pc AS prediction_column, CASE pc WHEN 'mean_prob' THEN 'Mean prediction' ELSE 'P95 prediction' END AS metric_label,
         pct AS top_pct, t AS threshold, r AS class, bs AS background_area_share, ts AS top_area_share, ts / nullif(bs, 0) AS enrichment_ratio
       FROM s WHERE r <> '{reg.BACKGROUND}'""")
def class_enrichment(spark, sf):
    df = flagged(spark, sf).where("analysis_valid").withColumn(
        "region", quadrant(F.col("lon"), F.col("lat"), 14.4378, 50.0755)
    )
    table = reg.class_enrichment(df, "region")
    return reg.plotted_enrichment(table, reg.REGIMES[:3], [5, 10, 20, 30])


# --- timing correspondence --------------------------------------------------------------------------

MERGED = HEXZ + """,
pm AS (SELECT cell_id, m, avg(pred) AS v FROM hz GROUP BY 1, 2),
pp AS (SELECT cell_id, arg_min(m, (-v, m)) AS pm, max(v) / sum(v) AS ps FROM pm GROUP BY 1),
wp AS (SELECT cell_id, arg_min(m, (-f, m)) AS wm, max(f) / sum(f) AS ws FROM amp GROUP BY 1 HAVING sum(f) > 0),
mg AS (SELECT cell_id, pm, ps, wm, ws, least(abs(pm - wm), 12 - abs(pm - wm)) AS cd,
         CASE WHEN pm - wm > 6 THEN pm - wm - 12 WHEN pm - wm < -6 THEN pm - wm + 12 ELSE pm - wm END AS sd,
         ps - ws AS d, abs(ps - ws) AS ad, 2165.0::DOUBLE AS a FROM pp JOIN wp USING (cell_id))"""


def merged(spark, sf):
    pred = prof.temporal_from_periods(cell_periods(spark, sf), "cell_id", "obs_date", "pred")
    wind = prof.temporal_from_months(_month_anomalies(spark, sf), "cell_id", "anomaly_frequency", "wind")
    return cut_lineage(cor.merged_timing(pred, wind, "cell_id"))


@query("merged_timing",
       "cell_id:l pred_peak_month:l pred_peak_share:d wind_peak_month:l wind_peak_share:d area_weight_km2:d "
       "circular_peak_month_difference:l signed_peak_month_shift:l peak_month_share_difference:d abs_peak_month_share_difference:d",
       f"""WITH {MERGED} --final-- SELECT cell_id, pm AS pred_peak_month, ps AS pred_peak_share, wm AS wind_peak_month,
       ws AS wind_peak_share, a AS area_weight_km2, cd AS circular_peak_month_difference, sd AS signed_peak_month_shift,
       d AS peak_month_share_difference, ad AS abs_peak_month_share_difference FROM mg""")
def merged_timing(spark, sf):
    return merged(spark, sf)


_ML = " UNION ALL ".join(
    f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS v, a, cell_id FROM mg"
    for k, v in zip(cor.SUMMARY_MEASURES, ["cd", "sd", "ps", "ws", "d", "ad"])
)


@query("correspondence_summary", "metric:s weighted_mean:d weighted_median:d weighted_p25:d weighted_p75:d",
       f"""WITH {MERGED}, l AS ({_ML}),
       c AS (SELECT metric, v, a, sum(a) OVER (PARTITION BY metric ORDER BY v, cell_id) AS cum, sum(a) OVER (PARTITION BY metric) AS tot FROM l)
       --final-- SELECT metric, sum(a * v) / sum(a) AS weighted_mean, min(v) FILTER (cum >= 0.5 * tot) AS weighted_median,
       min(v) FILTER (cum >= 0.25 * tot) AS weighted_p25, min(v) FILTER (cum >= 0.75 * tot) AS weighted_p75 FROM c GROUP BY 1""")
def correspondence_summary(spark, sf):
    return cor.correspondence_summary(merged(spark, sf))


_AG = " UNION ALL ".join(
    f"SELECT '{n}' AS agreement_class, '{t}' AS definition, coalesce(sum(a) FILTER (cd BETWEEN {lo} AND {hi}), 0) AS forest_area_km2, "
    f"100 * coalesce(sum(a) FILTER (cd BETWEEN {lo} AND {hi}), 0) / sum(a) AS forest_area_share_percent FROM mg"
    for n, lo, hi, t in cor.AGREEMENT
)


@query("agreement_classes", "agreement_class:s definition:s forest_area_km2:d forest_area_share_percent:d",
       f"WITH {MERGED} --final-- {_AG}")
def agreement_classes(spark, sf):
    return cor.agreement_classes(merged(spark, sf))


def _rank(c: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {c}" if part else f"PARTITION BY {c}"
    return f"(rank() OVER ({p}ORDER BY {c}) + (count(*) OVER ({q}) - 1) / 2.0)"


PAIRS = [(x, y) for x in ("mean_prob", "p95_prob") for y in ("z_anomaly", "anomaly_frequency", "area_weight_km2")]
_SP = " UNION ALL ".join(
    f"SELECT '{x}' AS x_name, '{y}' AS y_name, corr(a, b) AS rho, count(*) AS n FROM (SELECT {_rank(x)} AS a, {_rank(y)} AS b FROM reg)"
    for x, y in PAIRS
)


#: Two-sided tail of Student's t for whole degrees of freedom: a finite sum in sine and cosine of atan(t / sqrt(dof)).
_P = """greatest(0, 1 - CASE WHEN n % 2 = 0
  THEN abs(rho) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - rho * rho, k) for k in range(0, (n - 2) // 2)])
  ELSE 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k) - lgamma(k + 0.5)) * pow(1 - rho * rho, k - 0.5) for k in range(1, (n - 1) // 2)]), 0)) END)"""


@query("spearman_grid", "x_name:s y_name:s rho:d n:l p_value:d", f"WITH {REGIME}, s AS ({_SP}) --final-- SELECT *, {_P} AS p_value FROM s")
def spearman_grid(spark, sf):
    return cor.spearman_grid(regime_cells(spark, sf), PAIRS, p_value=True)


TESTS = [("mean_prob", "z_anomaly", "anomaly_frequency"), ("mean_prob", "anomaly_frequency", "z_anomaly"),
         ("p95_prob", "z_anomaly", "anomaly_frequency"), ("p95_prob", "anomaly_frequency", "z_anomaly")]
_PS = " UNION ALL ".join(
    f"""SELECT '{x}' AS x_name, '{y}' AS y_name, '{c}' AS control, corr(a, b) AS rho, count(*) AS n FROM (
      SELECT {_rank('ex')} AS a, {_rank('ey')} AS b FROM (
        SELECT rx - regr_intercept(rx, rc) OVER () - regr_slope(rx, rc) OVER () * rc AS ex,
               ry - regr_intercept(ry, rc) OVER () - regr_slope(ry, rc) OVER () * rc AS ey FROM (
          SELECT {_rank(x)} AS rx, {_rank(y)} AS ry, {_rank(c)} AS rc FROM reg)))"""
    for x, y, c in TESTS
)


@query("partial_spearman", "x_name:s y_name:s control:s rho:d n:l p_value:d", f"WITH {REGIME}, s AS ({_PS}) --final-- SELECT *, {_P} AS p_value FROM s")
def partial_spearman(spark, sf):
    return cor.partial_spearman(regime_cells(spark, sf), TESTS, p_value=True)


def _wp(x: str, y: str, w: str = "w") -> str:
    return (f"(sum({w}*{x}*{y})/sum({w}) - sum({w}*{x})/sum({w})*sum({w}*{y})/sum({w})) / sqrt("
            f"(sum({w}*{x}*{x})/sum({w}) - pow(sum({w}*{x})/sum({w}), 2)) * (sum({w}*{y}*{y})/sum({w}) - pow(sum({w}*{y})/sum({w}), 2)))")


@query("weighted_pearson", "comparison:s weighted_pearson:d",
       f"""WITH {VALID}, v AS (SELECT *, area_weight_km2 AS w FROM val)
       --final-- SELECT 'mean-z' AS comparison, {_wp('mean_prob', 'z_anomaly')} AS weighted_pearson FROM v
       UNION ALL SELECT 'p95-frequency', {_wp('p95_prob', 'anomaly_frequency')} FROM v""")
def weighted_pearson(spark, sf):
    pairs = {"mean-z": ("mean_prob", "z_anomaly"), "p95-frequency": ("p95_prob", "anomaly_frequency")}
    return cor.weighted_correlations(regime_cells(spark, sf), pairs, "area_weight_km2")


_K = repr(2 * math.pi / 12)


@query("circular_components", "comparison:s weighted_pearson:d spearman_rho:d",
       f"""WITH {MERGED}, c AS (SELECT ps, ws, round(cos({_K} * (pm - 1)), 12) AS pc, round(cos({_K} * (wm - 1)), 12) AS wc,
         round(sin({_K} * (pm - 1)), 12) AS pn, round(sin({_K} * (wm - 1)), 12) AS wn, a AS w FROM mg)
       --final-- SELECT 'Prediction peak-month share vs wind-anomaly peak-month share' AS comparison, {_wp('ps', 'ws')} AS weighted_pearson,
         (SELECT corr(a, b) FROM (SELECT {_rank('ps')} AS a, {_rank('ws')} AS b FROM c)) AS spearman_rho FROM c
       UNION ALL SELECT 'Peak-month cosine component', {_wp('pc', 'wc')},
         (SELECT corr(a, b) FROM (SELECT {_rank('pc')} AS a, {_rank('wc')} AS b FROM c)) FROM c
       UNION ALL SELECT 'Peak-month sine component', {_wp('pn', 'wn')},
         (SELECT corr(a, b) FROM (SELECT {_rank('pn')} AS a, {_rank('wn')} AS b FROM c)) FROM c""")
def circular_components(spark, sf):
    return cor.timing_correlations(merged(spark, sf))


@query("robust_limits", "vmin:d vmax:d",
       f"WITH {REGIME} --final-- SELECT quantile_cont(z_anomaly, 0.02) AS vmin, quantile_cont(z_anomaly, 0.98) AS vmax FROM reg")
def robust_limits(spark, sf):
    return cor.robust_limits(regime_cells(spark, sf), "z_anomaly")
