"""Sampling, encoding, metrics, models, sources and streaming."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexgale.operators import encode, model, ordered, rank_metrics, sampling
from hexgale.operators.ordered import row_index
from hexgale.plans.catalog import REGISTRY
from hexgale.sources import tables
from hexgale.streaming import composites as st

D = dt.date


def _sizes(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes, start=1)), "dist_bin int, n_cells long")


def test_quota_moves_the_overflow_to_bin_two(spark):
    got = {r["dist_bin"]: r["n_target"] for r in sampling.negative_quota(_sizes(spark, [10, 100, 100, 100]), 100).collect()}
    assert got == {1: 15, 2: 50, 3: 25, 4: 10}


@pytest.mark.parametrize("n", [1, 7, 103, 999])
def test_quota_sums_to_the_target(spark, n):
    got = [r["n_target"] for r in sampling.negative_quota(_sizes(spark, [1000, 3, 2, 50]), n).collect()]
    assert sum(got) == n


def test_rejection_rule(spark):
    rows = [(0.5, D(2020, 1, 10), D(2020, 2, 11), False), (0.5, D(2020, 1, 10), D(2020, 2, 12), True), (3.0, D(2020, 1, 10), D(2020, 1, 10), False),
            (3.0, D(2020, 1, 10), D(2020, 1, 11), True), (None, D(2020, 1, 10), D(2020, 1, 10), False), (0.2, None, D(2020, 1, 1), True)]
    df = spark.createDataFrame(rows, "k double, e date, d date, want boolean")
    assert df.where(sampling.accepted(F.col("k"), F.col("e"), F.col("d")) != F.col("want")).isEmpty()


def test_negatives_fill_their_quota(spark):
    forest = spark.range(400).select(
        F.col("id").alias("cell"), (F.when(F.col("id") < 30, 1).when(F.col("id") < 100, 2).when(F.col("id") < 250, 3).otherwise(4)).alias("dist_bin"),
        F.when(F.col("id") < 30, 0.5).when(F.col("id") < 250, 10.0).alias("km"), F.when(F.col("id") < 30, F.lit(D(2020, 6, 1))).alias("own"),
    )
    days = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=16 * i),) for i in range(23)], "d date")
    pos = spark.createDataFrame([(D(2019, 6, 3),), (D(2019, 6, 9),), (D(2019, 1, 1),)], "e date")
    dates = sampling.month_weighted_dates(pos, "e", days, "d")
    quota = sampling.negative_quota(forest.groupBy("dist_bin").agg(F.count(F.lit(1)).alias("n_cells")), 200)
    kw = {"cell": "cell", "dist_km": "km", "own_date": "own"}
    a = sampling.stratified_negatives(forest, quota, dates, **kw)
    b = sampling.stratified_negatives(forest.repartition(7), quota, dates, max_group=20, **kw)
    assert a.count() == 200 and a.where(~sampling.accepted(F.col("km"), F.col("own"), F.col("event_date"))).isEmpty()
    assert {r[0] for r in a.select(F.month("event_date")).distinct().collect()} == {1, 6}
    # The same draw whatever the partitioning and whichever way positions are counted.
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _auc_ap(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap += (recall - last) * precision
        last = recall
    return auc, ap


@pytest.mark.parametrize("limit", [10**6, 5])
def test_metrics_match_a_loop(spark, limit):
    rng = np.random.default_rng(11)
    y, s = rng.integers(0, 2, 150), np.round(rng.random(150), 1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "y": y, "s": s}))
    r = rank_metrics.rank_metrics(df, [], "y", "s", "id", max_group=limit).first()
    auc, ap = _auc_ap(y, s)
    assert r["roc_auc"] == pytest.approx(auc) and r["prauc"] == pytest.approx(ap)
    order = np.lexsort((np.arange(150), -s))
    assert r["p_at_10"] == pytest.approx(y[order][:10].mean()) and r["p_at_200"] == pytest.approx(y.mean())
    single = rank_metrics.rank_metrics(df.where("y = 1"), [], "y", "s", "id").first()
    assert single["roc_auc"] is None and single["p_at_10"] is None


def test_topk_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 2).alias("y"), F.rand(1).alias("s"))
    plan = rank_metrics.precision_at(df, ["g"], "y", "s", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_encoding(spark):
    rows = [("a", 1, 0), ("a", 0, 0), ("a", 1, 1), ("b", 0, 1), (None, 1, 0)]
    df = spark.createDataFrame(rows, "c string, y int, f int")
    got = {r["category"]: r["enc"] for r in encode.target_encoding(df, "c", "y", k=2.0).collect()}
    assert got == {"a": pytest.approx((2 + 0.6 * 2) / 5), "b": pytest.approx(1.2 / 3), "__NA__": pytest.approx(2.2 / 3)}
    oof = {(r["c"], r["f"]): r["enc"] for r in encode.oof_target_encoding(df, "c", "y", "f", k=2.0).collect()}
    assert oof[("a", 0)] == pytest.approx((1 + 0.5 * 2) / 3)  # training rows: a 1, b 0
    assert oof[(None, 0)] == pytest.approx(0.5)  # unseen category: training mean


def test_imputation_and_lock(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (float("nan"), None)], "a double, b double")
    got = encode.median_impute(df, ["a", "b"]).collect()
    assert [r["a"] for r in got] == [1.0, 3.0, 2.0, 2.0] and {r["b"] for r in got} == {0.0}
    rows = [(None if i % 5 == 0 else i, 1.0 * i, 2.0, i % 2, D(2020, 1, 1), 0.5 if i % 2 else -0.5, "9.5", "x") for i in range(40)]
    t = spark.createDataFrame(rows, "index int, x double, y double, label int, event_time date, mag double, exposure_intensity string, landcover string")
    out = encode.locked_table(t).toPandas()
    assert list(out.columns) == [*encode.ID_COLUMNS, *encode.NUMERIC_FEATURES, "landcover", "landcover_enc"]
    assert out["sample_id"].notna().all() and set(out["LAI_departure"]) == {0.0, -0.5} and set(out["exposure"]) == {9.5}
    assert set(out["aspect_sin"]) == {0.0}


def test_gate_scale_and_holdout(spark):
    pct = spark.createDataFrame([(95.0,), (10.0,), (None,)], "gust_peak_percentile double")
    share = pct.withColumn("gust_peak_percentile", F.col("gust_peak_percentile") / 100)
    for df, thr in ((pct, 0.9), (pct, 90.0), (share, 0.9), (share, 90.0)):
        assert [r[0] for r in df.select(encode.wind_gate(df, "gust_peak_percentile", thr)).collect()] == [True, False, False]
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (9.0, 9.0), (None, 1.0)], "lon double, lat double")
    assert [r[0] for r in pts.select(encode.holdout_flag((0, 0, 2, 2))).collect()] == [True, True, False, False]


def _samples(spark, n=600):
    rng = np.random.default_rng(21)
    gust, height = rng.uniform(5, 40, n), rng.uniform(0, 30, n)
    p = 1 / (1 + np.exp(-(gust - 25) / 4))
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "sample_id": range(n), "lon": rng.integers(0, 12, n) * 1.0, "lat": rng.integers(0, 12, n) * 1.0, "label": (rng.random(n) < p).astype(int),
                "ref_storm_id": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 20, n)), "LAI_departure": -rng.random(n),
                "gust_peak_speed": gust, "gust_peak_percentile": gust / 0.4, "slope": rng.uniform(0, 30, n), "terrain_roughness": rng.uniform(0, 9, n),
                "tree_height": height, "landcover_enc": rng.random(n), "susceptibility": height, "exposure": rng.random(n),
                "height_exposure": rng.random(n), "roughness_exposure": rng.random(n),
            }
        )
    ).withColumn("ref_storm_id", F.nanvl("ref_storm_id", F.lit(None).cast("double")))


def test_folds_never_split_a_group(spark):
    df = _samples(spark)
    folded = model.group_folds(df, model.location_group(), "label", 5)
    assert folded.count() == 600 and model.leaking_groups(folded, model.location_group(), "fold").isEmpty()
    assert folded.select("fold").distinct().count() == 5
    storms = model.group_folds(df, model.storm_group("ref_storm_id", "sample_id"), "label", 3, max_group=10)
    assert storms.count() == 600 and model.leaking_groups(storms, model.storm_group("ref_storm_id", "sample_id"), "fold").isEmpty()


def test_folds_by_place_leave_the_rows_where_they_are(spark):
    """Groups are worked out once per place, rows with and without coordinates find the same folds, none is shuffled (F1)."""
    df = _samples(spark).withColumn("lon", F.when(F.col("sample_id") % 50 != 0, F.col("lon")))
    plain = model.group_folds(df, model.location_group(), "label", 5)
    placed = model.group_folds(df, model.location_group(), "label", 5, by=["lon", "lat"])
    assert placed.exceptAll(plain.select(*placed.columns)).isEmpty() and placed.count() == plain.count() == 600
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "concat_ws" not in plan and "hashpartitioning" not in plan


def test_shift_weights_of_a_regression(spark):
    """Weights from the coefficients are those of the fitted pipeline, missing features filled."""
    df = _samples(spark).withColumn("a", F.when(F.col("sample_id") % 9 != 0, F.col("gust_peak_speed")))
    parts = df.where("sample_id % 3 <> 0"), df.where("sample_id % 3 = 0")
    got = model.shift_weights(*parts, ["a"], "sample_id", boosted=False)
    both = encode.median_impute(df.withColumn("_dom", (F.col("sample_id") % 3 == 0).cast("int")), ["a"])
    fitted = model._pipeline(["a"], model.LogisticRegression(maxIter=2000, tol=1e-9, featuresCol="_features", labelCol="_dom", probabilityCol="_prob")).fit(both)
    p = F.col("_p")
    want = model.score(fitted, both.where("_dom = 0"), "_p").select("sample_id", (p / (1 - p)).alias("w")).toPandas().set_index("sample_id")["w"]
    want = want.clip(upper=want.quantile(0.99))
    pd.testing.assert_series_equal(got.toPandas().set_index("sample_id")["shift_weight"].sort_index(), want.sort_index(), check_names=False, rtol=1e-6)


def test_few_categories_do_not_deal_out_the_rows(spark, monkeypatch):
    """Ten keys of category and fold would be ten tasks for all rows, so the encodings go to the rows (F2)."""
    rows = spark.range(2000).select(
        F.col("id"), (F.col("id") % 2).cast("string").alias("c"), (F.col("id") % 5).alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = encode.oof_target_encoding(rows, "c", "y", "fold")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(ordered, "SMALL_TABLE", 3)
        dealt = encode.oof_target_encoding(rows, "c", "y", "fold")
        assert "SortMergeJoin" in dealt._jdf.queryExecution().executedPlan().toString()
        assert out.exceptAll(dealt).isEmpty() and out.count() == dealt.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_full_run(spark, tmp_path):
    run = model.run_families(
        _samples(spark), ["wind", "struct"], (8.0, 8.0, 12.0, 12.0), k=2, trees=3, depth=3, grid=(1.0,), shift_rounds=2, residual=True
    )
    m = {r["split"]: r for r in run.metrics.collect()}
    assert {"IN_OOF", "IN_OOF_RESIDUAL", "HOLDOUT", "HOLDOUT_RESIDUAL", "HOLDOUT_RESIDUAL_FLIP", "HOLDOUT_RESIDUAL_FULL"} == set(m)
    assert m["IN_OOF"]["roc_auc"] > 0.7 and m["HOLDOUT"]["roc_auc"] > 0.6
    assert m["HOLDOUT_RESIDUAL"]["roc_auc"] + m["HOLDOUT_RESIDUAL_FLIP"]["roc_auc"] == pytest.approx(1.0)
    table = model.prediction_table(run)
    assert table.count() == 600 and table.where("pred_meta < 0 OR pred_meta > 1 OR pred_meta IS NULL").isEmpty()
    assert run.strata.select("model").distinct().count() == 3
    assert rank_metrics.comparison_table({"a": run.metrics, "b": run.metrics}).count() == 2
    model.save_artifact(str(tmp_path / "m"), run, spark)
    models, settings = model.load_artifact(str(tmp_path / "m"), spark)
    assert settings["families"] == ["wind", "struct"] and set(models) == {"wind", "struct", "meta"}
    # A loaded run scores new rows as the fresh one did, gaps and ineligible rows included.
    rows = _samples(spark).withColumn("tree_height", F.when(F.col("sample_id") % 7 != 0, F.col("tree_height")))
    fresh, loaded = (model.score_run(rows, m, s).select("sample_id", "pred_wind", "pred_residual", "pred_residual_full", "pred_meta").orderBy("sample_id").collect()
                     for m, s in ((run.models, run.settings), (models, settings)))
    assert fresh == loaded and all((r["pred_residual"] is None) == (r["sample_id"] % 7 == 0 or r["pred_residual_full"] is None) for r in fresh)
    again = model.score_run(_samples(spark).where("lon BETWEEN 8 AND 12 AND lat BETWEEN 8 AND 12"), models, settings)
    assert [tuple(r) for r in again.select("sample_id", "pred_meta").orderBy("sample_id").collect()] == [tuple(r) for r in run.holdout.select("sample_id", "pred_meta").orderBy("sample_id").collect()]


def test_family_comparison_runs_the_whole_job(spark, monkeypatch):
    """Five folds, all C, 600 deep trees and boosted shift weights in each of the four runs."""
    seen, signature = [], inspect.signature(model.run_families)

    def run(*args, **settings):
        bound = signature.bind(*args, **settings)
        bound.apply_defaults()
        seen.append(bound.arguments)
        row = spark.range(1).select(F.lit("HOLDOUT").alias("split"), F.lit(4).alias("n_rows"), F.lit(2).alias("n_pos"), F.lit(0.5).alias("roc_auc"), F.lit(0.5).alias("prauc"))
        return model.FamilyRun(None, row)

    monkeypatch.setattr(model, "run_families", run)
    got = {r["model"]: r["measured"] for r in REGISTRY["family_comparison"].spark(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"wind": True, "wind_struct": True, "wind_cross": True, "all": True}
    assert sorted(len(x["families"]) for x in seen) == [1, 2, 2, 3]
    for x in seen:
        assert (x["k"], x["trees"], x["depth"], x["grid"], x["shift"], x["shift_rounds"]) == (5, 600, 30, model.C_GRID, True, 400)


def test_models_of_one_class(spark):
    ones = _samples(spark).withColumn("label", F.lit(1))
    with pytest.raises(ValueError):
        model.run_families(ones, ["wind"], None, k=2, trees=2, depth=2)
    rows = ones.withColumns({"fold": F.col("sample_id") % 2, "pred_wind": F.lit(0.4), "weight": F.lit(1.0)})
    out = model.residual_out_of_fold(rows, ["exposure"], "label", "pred_wind", "fold", 2, "weight", F.lit(True))
    assert out.count() == 600 and out.where("residual IS NOT NULL").isEmpty()
    # The residual model is left out where its eligible rows have one class; its feature is neutral then.
    mixed = _samples(spark).withColumn("exposure", F.when(F.col("label") == 1, F.col("exposure")))
    run = model.run_families(mixed, ["wind", "cross"], (8.0, 8.0, 12.0, 12.0), k=2, trees=2, depth=2, grid=(1.0,), shift=False, residual=True, gate=("gust_peak_percentile", 0.1))
    assert run.settings["residual"] is None and run.settings["gate"] == ("gust_peak_percentile", 10.0)
    assert run.holdout.where("residual_logit <> 0 OR pred_residual IS NOT NULL OR pred_meta IS NULL").isEmpty()


def test_sources(spark, tmp_path):
    t = tmp_path / "tiles"
    for i in range(2):
        df = spark.createDataFrame([(i, 1.0), (7, 2.0)], "index int, v double")
        df.coalesce(1).write.option("header", True).csv(str(t / f"part{i}"))
    all_tiles = tables.read_tiles(spark, str(t / "*"), "*.csv", "index", "index int, v double")
    assert all_tiles.count() == 4 and tables.duplicate_keys(all_tiles, ["index"]).first()["n"] == 2
    with pytest.raises(KeyError):
        tables.read_tiles(spark, str(t / "*"), "*.csv", "other", "index int, v double")
    files = tables.file_list(spark, str(t), "*.csv")
    assert files.count() == 2 and files.where("size_mb > 0").count() == 2
    cube = str(tmp_path / "cube")
    rows = [(D(2020, m, 1), lon, lat, 1.0) for m in (1, 2) for lon in (10.0, 350.0) for lat in (40.0, 50.0)]
    tables.write_table(spark.createDataFrame(rows, "period_start date, lon double, lat double, v double").withColumn("year", F.year("period_start")), cube, partition_by=["year"])
    out = tables.read_cube(spark, cube, (-20, 45, 5, 55), ["v"], start="2020-02-01", wrapped=True)
    assert [(r["lon"], r["lat"]) for r in out.collect()] == [(-10.0, 50.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat)" in plan or "GreaterThanOrEqual(lat,45.0)" in plan
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2)], "a int, b int")

    path = str(tmp_path / "cached")
    for _ in range(2):
        assert tables.load_or_build(spark, path, build, ["a", "b"], lambda d: d.withColumn("c", F.col("a") + F.col("b"))).first()["c"] == 3
    assert len(calls) == 1
    with pytest.raises(ValueError):
        a = spark.createDataFrame([(1,), (2,)], "n int")
        tables.bind_records(a, a.where("n = 1"), "n")
    kinds = spark.createDataFrame([("Agent_x",), ("nbr_1",), ("disturb_stack",), ("disturbance_year",), ("probs",), ("disturbed",), ("z",)], "n string")
    assert [r[0] for r in kinds.select(tables.layer_type(F.col("n"))).collect()] == [
        "agent", "severity", "annual_disturbance_stack", "year_of_disturbance", "probability", "disturbance_other", "unknown",
    ]


def test_companions_match_a_loop(spark):
    files = ["/r/a/x/d1.tif", "/r/a/d2.tif", "/r/b/d3.tif", "/q/zz/d4.tif", "/r/c/same.tif"]
    comps = ["/r/a/g1.tif", "/r/a/x/g2.tif", "/r/b/g0.tif", "/r/b/g3.tif", "/r/d/same.tif"]

    def score(f, c):
        return len(set(f.lower().split("/")) & set(c.lower().split("/")))

    want = {f: min(comps, key=lambda c: (-score(f, c), c)) for f in files}
    f = spark.createDataFrame([(x,) for x in files], "path string")
    c = spark.createDataFrame([(x,) for x in comps], "path string")
    assert {r["path"]: r["companion"] for r in tables.companion_files(f, c).collect()} == want


def test_streaming_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(c, dt.datetime(2001, 1, 1) + dt.timedelta(days=d), float((d * 7 + c) % 13)) for c in range(3) for d in range(60)]
    df = spark.createDataFrame(rows, "c int, ts timestamp, v double")
    df.repartition(3).write.parquet(src)
    batch = st.tumbling_composite(df, ["c"], "ts", "v")
    assert {r["period_start"] for r in batch.collect()} == {D(2001, 1, 1) + dt.timedelta(days=16 * i) for i in range(4)}
    stream = st.tumbling_composite(st.file_stream(spark, src, df.schema), ["c"], "ts", "v", lateness="1 day")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    st.run_available(stream, out, ckpt)
    # Windows that the watermark has passed are final and equal the batch result.
    got = spark.read.parquet(out)
    final = batch.where(F.col("period_start") < F.lit(D(2001, 2, 10)))
    assert got.exceptAll(batch).isEmpty() and final.exceptAll(got).isEmpty()


def test_resuming_adds_nothing_twice(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "ck"))
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, v double")
    df.coalesce(1).write.parquet(src)

    def run():
        stream = st.file_stream(spark, src, df.schema, files_per_batch=1)
        st.process_incrementally(stream, lambda b: b.withColumn("w", F.col("v") * 2), out, ckpt)

    run()
    run()
    assert spark.read.parquet(out).count() == 10
    df.withColumn("k", F.col("k") + 100).coalesce(1).write.mode("append").parquet(src)
    run()
    done = spark.read.parquet(out)
    assert done.count() == 20
    assert st.pending_rows(df.unionByName(df.withColumn("k", F.lit(999))), done, ["k"]).select("k").distinct().collect()[0]["k"] == 999


@pytest.mark.parametrize("where", ["part", "mark", "merge", "after"])
def test_composite_is_taken_up_where_it_stopped(spark, tmp_path, where, monkeypatch):
    """A run that breaks off while it writes, before or after its marker, or while it merges, ends like one that did not."""
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "ck"))
    rows = [(c, dt.datetime(2001, 1, 1) + dt.timedelta(days=d), float((d * 7 + c) % 13)) for c in range(3) for d in range(80)]
    df = spark.createDataFrame(rows, "c int, ts timestamp, v double")
    late = F.pmod(F.xxhash64("c", "ts"), F.lit(4)) == 0
    df.where(~late).repartitionByRange(4, "ts").write.parquet(src)
    broken, write, mark = [], st.BatchSink.write, st.BatchSink.mark

    def lose(now: bool):
        if now and not broken:
            broken.append(1)
            raise RuntimeError("lost")

    def write_or_lose(self, part, number):
        if where == "part" and number == 1 and not broken:
            part.limit(1).write.mode("overwrite").parquet(f"{self.path}/part-1")
            lose(True)
        write(self, part, number)

    def mark_or_lose(self, kind, number):
        lose((where, kind, number) in (("mark", "part", 1), ("merge", "merged", 1)))
        mark(self, kind, number)

    monkeypatch.setattr(st.BatchSink, "write", write_or_lose)
    monkeypatch.setattr(st.BatchSink, "mark", mark_or_lose)

    def run():
        stream = st.file_stream(spark, src, df.schema, files_per_batch=1)
        return st.resumable_composite(stream, ["c"], "ts", "v", out, ckpt, every=2, after_write=lambda number: lose(where == "after" and number == 2))

    with pytest.raises(Exception, match="lost"):
        run()
    assert broken
    want = st.tumbling_composite(df.where(~late), ["c"], "ts", "v")
    got = run()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # Late days correct periods that were complete before.
    df.where(late).coalesce(2).write.mode("append").parquet(src)
    got, want = run(), st.tumbling_composite(df, ["c"], "ts", "v")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_positions_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(997)).cast("double"))
    a = row_index(df, [], "h", ["id"], max_group=40)
    b = row_index(df.repartition(9), [], "h", ["id"])
    assert a.exceptAll(b).isEmpty()


def test_model_features(spark):
    df = spark.createDataFrame([("30", 0.0, 0.5), ("x", 2.0, 0.5), (None, None, None), ("4", -2.0, float("nan"))], "tree_height string, terrain_roughness double, exposure_intensity double")
    got = [tuple(r) for r in encode.model_features(df, cross=True).select("susceptibility", "exposure", "roughness_exposure").collect()]
    assert got == [(1000.0, 0.5, 0.0), (None, 0.5, 1.0), (None, None, None), (pytest.approx(2.0, rel=1e-6), None, None)]
    kept = encode.model_features(df.withColumn("susceptibility", F.lit(5.0)).withColumn("exposure", F.lit("7")).drop("terrain_roughness"), cross=True)
    assert {(r["susceptibility"], r["exposure"]) for r in kept.collect()} == {(5.0, 7.0)} and "roughness_exposure" not in kept.columns
