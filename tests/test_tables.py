"""Composites, indicators, profiles, regimes, validation: small frames with hand-computed results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexgale.operators import climatology as clim
from hexgale.operators import composite as comp
from hexgale.operators import correspondence as cor
from hexgale.operators import indicators as ind
from hexgale.operators import profile as prof
from hexgale.operators import regimes as reg
from hexgale.operators import series, zonal

D = dt.date


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 3.0), (2, None), (2, 5.0), (3, None)], "c int, v double")
    got = {r["c"]: (r["max_value"], r["n_values"]) for r in comp.period_max(df, ["c"], "v").collect()}
    assert got == {1: (3.0, 2), 2: (5.0, 1)}


def test_value_at_first_peak(spark):
    rows = [(1, D(2020, 1, 3), 9.0, 1.0), (1, D(2020, 1, 1), 9.0, 2.0), (1, D(2020, 1, 2), 4.0, 3.0), (1, D(2020, 1, 4), float("nan"), 9.0)]
    df = spark.createDataFrame(rows, "c int, d date, v double, u double")
    r = comp.value_at_peak(df, ["c"], "v", "d", ["u"]).first()
    assert (r["peak_value"], r["peak_time"], r["u"]) == (9.0, D(2020, 1, 1), 2.0)


def test_calendar_clips_the_last_chunk(spark):
    rows = comp.chunk_calendar(spark, "2001-01-01", "2001-02-10").collect()
    assert [(r["chunk_start"], r["chunk_end"]) for r in rows] == [
        (D(2001, 1, 1), D(2001, 1, 16)), (D(2001, 1, 17), D(2001, 2, 1)), (D(2001, 2, 2), D(2001, 2, 10)),
    ]


def test_two_z_definitions(spark):
    df = spark.createDataFrame([(1, D(2020, m, 1), 5.0) for m in range(1, 7)], "c int, d date, v double")
    assert {r["z"] for r in clim.grid_z(df, ["c"], "v").collect()} == {0.0}
    assert {r["z"] for r in clim.hex_z(df, ["c"], "v").collect()} == {None}
    # Undefined z: no event in the frequency, skipped in the intensity.
    r = clim.month_anomaly_profile(clim.hex_z(df, ["c"], "v"), "c", "d", "z", sampled=True).first()
    assert r["anomaly_frequency"] == 0.0 and r["anomaly_intensity"] is None and r["n_anomaly_periods"] == 0


def test_record_span_is_in_years_of_365_25_days(spark):
    df = spark.createDataFrame([(D(2001, 1, 1),), (D(2003, 1, 1),)], "d date")
    assert df.limit(1).select(clim.span_years(df, "d")).first()[0] == pytest.approx(730 / 365.25)


def test_inactive_hexagons(spark):
    rows = [(1, D(2020, 1, d), float(d)) for d in range(1, 21)] + [(2, D(2020, 6, d), 0.1) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "h int, d date, p double")
    got = {r["h"]: r for r in ind.indicator_suite(df, "h", "d", "p", 0.9).collect()}
    assert got[2]["active_n"] == 0 and got[2]["conditional_intensity"] == 0 and got[2]["conditional_p95"] == 0
    assert got[1]["winter_share_q95"] == 1.0 and got[1]["active_n"] == 4
    flags = ind.active_flags(df, "p", 0.9).withColumns({"a": F.lit(1.0), "s": F.lit(2.0)})
    dist = {r["h"]: r for r in ind.cell_distribution(flags, "h", "p", "active_period", "a", "s", min_periods=10).collect()}
    assert dist[2]["severity_cond"] is None and dist[2]["mask_sev_zero"] and dist[1]["severity_cond"] == 2.0


def test_profile_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [(h, D(2020, int(m), 1), float(rng.random())) for h in range(20) for m in rng.choice(np.arange(1, 13), 5, replace=False)]
    df = spark.createDataFrame(rows, "h int, d date, p double")
    p = prof.month_profile(prof.prepared_predictions(df, "d", "p"), "h", "p")
    assert p.count() == 240
    sums = p.groupBy("h").agg(F.sum("monthly_share").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
    assert sums < 1e-12
    t = prof.timing_metrics(p, "h")
    assert t.where("effective_months < 1 OR effective_months > 12 OR circular_concentration > 1.0000001").isEmpty()
    zero = spark.createDataFrame([(1, 3, 0.0)], "h int, month int, v double")
    r = prof.timing_from_profile(zero, "h", "month", "v").first()
    assert r["peak_month"] is None and r["effective_months"] is None
    tie = spark.createDataFrame([(1, 3, 2.0), (1, 2, 2.0), (1, 9, -4.0)], "h int, month int, v double")
    r = prof.timing_from_profile(tie, "h", "month", "v").first()
    assert r["peak_month"] == 2 and r["peak_share"] == 0.5


def test_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "k int, v double")
    got = [r["b"] for r in reg.first_rank_bins(df, "v", "k", 5, "b").orderBy("k").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 5]
    few = reg.first_rank_bins(df.where("k < 3"), "v", "k", 5, "b")
    assert {r["b"] for r in few.collect()} == {None}


@pytest.mark.parametrize("n", [5, 8, 13, 21, 50, 101])
def test_bins_match_pandas(spark, n):
    df = spark.createDataFrame([(i, 1.0) for i in range(n)], "k int, v double")
    got = [r["b"] for r in reg.first_rank_bins(df, "v", "k", 5, "b").orderBy("k").collect()]
    want = pd.qcut(pd.Series(np.ones(n)).rank(method="first"), 5, labels=range(1, 6)).astype(int).tolist()
    assert got == want


def test_deciles_merge_equal_edges(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.exponential(2, 200))
    df = spark.createDataFrame(pd.DataFrame({"k": range(200), "v": v}))
    got = [r["decile"] for r in zonal.value_deciles(df, "v").orderBy("k").collect()]
    want = (pd.qcut(pd.Series(v), 10, labels=False, duplicates="drop") + 1).tolist()
    assert got == want


def test_layouts(spark):
    stack = spark.createDataFrame(
        [(1, 2000, 0, None), (1, 2000, 1, 1), (1, 2000, 255, 1), (1, 2001, 1, 6), (1, 2001, 1, 2)], "hex_id int, year int, disturbed int, agent int"
    )
    got = {r["year"]: r for r in zonal.annual_stack_counts(stack).collect()}
    assert (got[2000]["valid_px"], got[2000]["disturbed_px_all"], got[2000]["disturbed_px_agent_wind_bark"]) == (2, 1, 1)
    assert (got[2001]["disturbed_px_all"], got[2001]["disturbed_px_agent_fire"]) == (2, 1)
    binary = {r["year"]: r["valid_px"] for r in zonal.annual_binary_counts(stack).collect()}
    assert binary == {2000: 3, 2001: 2}
    coded = spark.createDataFrame([(1, 2000), (1, 1970), (1, None), (2, 2001)], "hex_id int, year_value int")
    got = {(r["hex_id"], r["year"]): (r["valid_px"], r["disturbed_px_all"]) for r in zonal.year_coded_counts(coded, [2000, 2001]).collect()}
    assert got == {(1, 2000): (2, 1), (1, 2001): (2, 0), (2, 2000): (1, 0), (2, 2001): (1, 1)}


def test_p_values(spark):
    # Checked against Student's t: two-sided p of r = 0.5 with n = 20 and of r = 0.1 with n = 12.
    df = spark.createDataFrame([(0.5, 20), (0.1, 12), (1.0, 10), (None, 9)], "rho double, n int")
    got = [r[0] for r in df.select(cor.correlation_p_value("rho", "n")).collect()]
    assert got[0] == pytest.approx(0.0248, abs=2e-4) and got[1] == pytest.approx(0.757, abs=2e-3) and got[2] == 0.0 and got[3] is None


def test_p_values_against_the_finite_sum(spark):
    """For an even number of degrees of freedom Student's tail is a finite sum."""
    cases = [(r, n) for n in (4, 12, 100, 5000) for r in (0.0, 1e-6, 0.01, 0.03, -0.2, 0.5, -0.9, 0.9999)] + [(0.004, 1_000_000), (-0.001, 1_000_000), (float("nan"), 8), (0.3, 2)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(cases)], "i int, rho double, n int")
    got = {r["i"]: r["p"] for r in df.select("i", cor.correlation_p_value("rho", "n").alias("p")).collect()}
    for i, (r, n) in enumerate(cases[:-2]):
        ratio, total = 1.0, 0.0
        for k in range((n - 2) // 2):
            total += ratio * (1 - r * r) ** k
            ratio *= (2 * k + 1) / (2 * k + 2)
        assert got[i] == pytest.approx(1 - abs(r) * total, abs=1e-9)
    assert got[len(cases) - 2] is None and got[len(cases) - 1] is None


def test_nearest_layer_prefers_the_earlier(spark):
    layers = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 5),), (D(2020, 1, 17),)], "l date")
    ev = spark.createDataFrame([(1, D(2020, 1, 3)), (2, D(2020, 1, 4)), (3, D(2019, 1, 1)), (4, D(2021, 1, 1)), (5, None)], "k int, d date")
    got = {r["k"]: (r["layer_date"], r["layer_index"]) for r in series.nearest_layer(ev, "d", layers, "l").collect()}
    assert got == {1: (D(2020, 1, 1), 1), 2: (D(2020, 1, 5), 2), 3: (D(2020, 1, 1), 1), 4: (D(2020, 1, 17), 3), 5: (None, None)}


def test_lookback_against_a_loop(spark):
    rng = np.random.default_rng(8)
    start = D(2020, 1, 1)
    obs = [(int(c), start + dt.timedelta(days=int(16 * i)), float(np.round(rng.uniform(5, 30))), float(i)) for c in range(3) for i in range(40)]
    smp = [(i, int(rng.integers(0, 3)), start + dt.timedelta(days=int(rng.integers(-50, 700)))) for i in range(60)]
    o = spark.createDataFrame(obs, "c int, d date, v double, dir double")
    s = spark.createDataFrame(smp, "s int, c int, e date")
    for limit in (10**6, 7):
        got = {
            r["s"]: r
            for r in series.lookback_peak(s, o, sample="s", cell="c", event_day="e", obs_day="d", value="v", direction="dir", max_group=limit).collect()
        }
        assert len(got) == 60
        for k, c, e in smp:
            inside = [r for r in obs if r[0] == c and e - dt.timedelta(days=32) <= r[1] <= e]
            if not inside:
                assert got[k]["max_wind_event"] is None
                continue
            peak = max(inside, key=lambda r: (r[2], -r[1].toordinal()))
            hist = [r[2] for r in obs if r[0] == c and r not in inside]
            assert (got[k]["max_wind_event"], got[k]["days_since_peak"], got[k]["struct_wind_dir_from_deg"]) == (peak[2], (e - peak[1]).days, peak[3])
            assert got[k]["wind_percentile"] == pytest.approx(100 * np.mean(np.array(hist) <= peak[2]), abs=0.00501)


def test_regime_labels(spark):
    from hexgale.functions.columns import replace_labels

    df = spark.createDataFrame([(" Compound ",), ("Background/mixed",), ("Recurrent anomaly",)], "s string")
    got = [r[0] for r in df.select(replace_labels(F.col("s"), reg.LABEL_VARIANTS)).collect()]
    assert got == [reg.COMPOUND, reg.BACKGROUND, reg.RECURRENT]
