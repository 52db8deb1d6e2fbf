"""Group-aware folds and the model workflow on MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.functions.scalar import clip_probability, logistic, logit
from hexgale.operators.encode import column_medians, departure_weight, holdout_flag, median_impute, structurally_valid, to_number
from hexgale.operators.ordered import MAX_GROUP, average_rank, handed_out, null_safe_join, quantiles, row_index
from hexgale.operators.rank_metrics import rank_metrics, stratified_rank_metrics
from hexgale.session import cut_lineage, store

SEED = 20251017
MAX_DEPTH = 30  # the deepest tree MLlib grows

# Feature families.
FAMILIES = {
    "wind": ["gust_peak_speed", "gust_peak_percentile"],
    "struct": ["slope", "terrain_roughness", "tree_height", "landcover_enc", "susceptibility"],
    "cross": ["exposure", "height_exposure", "roughness_exposure"],
}
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
MIN_RESIDUAL_ROWS = 50


# --- folds ----------------------------------------------------------------------------------------


def location_group(lon: str = "lon", lat: str = "lat") -> Column:
    """Rows at the same place belong together."""
    return F.concat_ws("_", F.round(lon, 6).cast("string"), F.round(lat, 6).cast("string"))


def storm_group(storm: str, row_id: str) -> Column:
    """Storm id, or an id of its own for a row without one (K1)."""
    return F.coalesce(F.col(storm).cast("string"), F.concat(F.lit("NA_"), F.col(row_id).cast("string")))


def group_folds(
    df: DataFrame, group: Column, label: str, k: int, *, by: Sequence[str] = (), name: str = "fold", seed: int = SEED,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Fold per group, dealt out in hash order within label strata (K1).

    Only the group table is ordered. A group is whole in one fold by construction, so a group with a third
    of the rows makes its fold large but never leaks. ``by`` names the columns that the group is worked out from, where
    it is the same for many rows: it is then worked out once for each of their values instead of in every row, and
    rows find their fold by these columns.
    """
    work = df if by else df.withColumn("_group", group)
    labels = work.groupBy(*(by or ["_group"])).agg(F.max((F.col(label) == 1).cast("int")).alias("_s"))
    labels = cut_lineage(labels.withColumn("_group", group) if by else labels)
    groups = labels.groupBy("_group").agg(
        F.max("_s").alias("_s"), F.pmod(F.xxhash64("_group", F.lit(seed)), F.lit(2**52)).cast("double").alias("_h")
    )
    placed = row_index(groups, ["_s"], "_h", ["_group"], name="_i", max_group=max_group)
    folds = placed.select("_group", F.pmod(F.col("_i") - 1, F.lit(k)).cast("int").alias(name))
    if not by:
        return work.join(handed_out(cut_lineage(folds)), "_group").drop("_group")
    folds = cut_lineage(labels.join(folds, "_group").select(*by, name))
    return null_safe_join(work, handed_out(folds), by)


def leaking_groups(df: DataFrame, group: Column, fold: str) -> DataFrame:
    """Groups found in more than one fold; must be empty (C17)."""
    return (
        df.groupBy(group.alias("group")).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi")).select("group")
    )


# --- single models --------------------------------------------------------------------------------


def _pipeline(features: Sequence[str], stage) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error"), stage])


def fit_forest(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, *, trees: int = 600,
    depth: int = MAX_DEPTH, seed: int = SEED,
) -> PipelineModel:
    """Weighted random forest (K3); leaves are limited by depth only.

    Regression trees on the 0/1 label: the splits are those of Gini impurity and the mean of a leaf is its probability.
    MLlib's classification trees merge leaves of the same majority class, which loses the probabilities within it.
    A lone tree takes all rows and features.
    """
    rf = RandomForestRegressor(
        featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=1, seed=seed,
        featureSubsetStrategy="sqrt" if trees > 1 else "all", bootstrap=trees > 1, predictionCol="_pred",
    )
    return _pipeline(features, rf.setWeightCol(weight) if weight else rf).fit(df)


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Probability of class 1 as a plain column (K9)."""
    out = model.transform(df)
    out = out.withColumn(name, vector_to_array("_prob")[1] if "_prob" in out.columns else F.col("_pred"))
    return out.drop("_features", "_pred", "_prob", "_raw")


def out_of_fold(
    df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], PipelineModel], name: str
) -> DataFrame:
    """Each fold scored by a model of the other folds (K2). Folds are fitted at the same time, small ones leave cores idle."""
    with ThreadPoolExecutor(k) as pool:
        models = list(pool.map(lambda f: fit(df.where(F.col(fold) != f)), range(k)))
    out = None
    for f in range(k):
        part = score(models[f], df.where(F.col(fold) == f), name)
        out = part if out is None else out.unionByName(part)
    return out


def shift_weights(
    unlabelled: DataFrame, holdout: DataFrame, features: Sequence[str], key: str, *, boosted: bool = True, rounds: int = 400,
    cap_q: float = 0.99, seed: int = SEED, max_group: int = MAX_GROUP,
) -> DataFrame:
    """Density-ratio weights p / (1 - p) of a training-versus-holdout classifier, capped at a quantile (K4)."""
    both = unlabelled.select(key, *features, F.lit(0).alias("_dom")).unionByName(
        holdout.select(key, *features, F.lit(1).alias("_dom"))
    )
    # Written once and narrow, then filled: the medians take several passes over it, the fit and the scores three more.
    both = median_impute(store(both), features)
    common = {"featuresCol": "_features", "labelCol": "_dom", "predictionCol": "_pred"}
    if boosted:
        stage = GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=5, subsamplingRate=0.8, seed=seed, **common)
    else:
        stage = LogisticRegression(maxIter=2000, tol=1e-9, **common)
    stage = stage.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    fitted = _pipeline(features, stage).fit(both)
    if boosted:
        scored, p = score(fitted, both.where("_dom = 0"), "_p"), clip_probability(F.col("_p"))
    else:
        # The probability of a regression is a column expression: no vectors, and no feature is missing here.
        linear = sum((F.lit(float(b)) * F.col(c) for c, b in zip(features, fitted.stages[-1].coefficients)), F.lit(float(fitted.stages[-1].intercept)))
        scored, p = both.where("_dom = 0"), clip_probability(logistic(linear))
    weights = store(scored.select(key, (p / (F.lit(1.0) - p)).alias("_w")))
    cap = quantiles(weights, [], "_w", {"c": cap_q}, max_group=max_group).scalar()
    return weights.select(key, F.least(F.col("_w"), cap).alias("shift_weight"))


def fit_meta(df: DataFrame, features: Sequence[str], label: str, c: float, n: int) -> PipelineModel:
    """L2 logistic regression with inverse strength C: MLlib's penalty is per row, hence 1 / (C n) (K5)."""
    lr = LogisticRegression(
        featuresCol="_features", labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
        maxIter=1000, tol=1e-8, predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw",
    )
    return _pipeline(features, lr).fit(df)


def meta_out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, c: float, name: str = "pred_meta") -> DataFrame:
    return out_of_fold(df, fold, k, lambda train: fit_meta(train, features, label, c, train.count()), name)


def meta_grid(
    df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, key: str, *, grid: Sequence[float] = C_GRID,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Out-of-fold metrics per C (K5): all settings scored into one table and measured in one pass."""
    out = None
    for c in grid:
        part = meta_out_of_fold(df, features, label, fold, k, c).select(key, label, "pred_meta", F.lit(float(c)).alias("c"))
        out = part if out is None else out.unionByName(part)
    return rank_metrics(cut_lineage(out), ["c"], label, "pred_meta", key, max_group=max_group)


def best_c(grid: DataFrame, metric: str = "prauc") -> float:
    """Best C, the first of equal ones (one row per C reaches the driver)."""
    best = grid.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col("c").asc()).first()
    return float(best["c"]) if best else float(C_GRID[0])


def two_classes(df: DataFrame, label: str, least: int = 1) -> bool:
    """Whether a table has at least ``least`` rows and both classes; without them no model is fitted (K6, K7)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return r["n"] >= least and r["lo"] != r["hi"]


@dataclass(frozen=True)
class OffsetModel:
    """Binomial GLM with offset as column expressions."""

    intercept: float
    coefficients: Mapping[str, float]

    def _linear(self) -> Column:
        lp = F.lit(float(self.intercept))
        for c, b in self.coefficients.items():
            lp = lp + F.lit(float(b)) * F.col(c)
        return lp

    def component(self) -> Column:
        """Prediction without the offset (K6)."""
        return clip_probability(logistic(self._linear()))

    def full(self, offset: Column) -> Column:
        return clip_probability(logistic(self._linear() + offset))


def fit_offset_glm(df: DataFrame, features: Sequence[str], label: str, offset: str, weight: str | None = None) -> OffsetModel:
    """Binomial GLM with a logit link and an offset (K6)."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_features", labelCol=label, offsetCol=offset, maxIter=200, tol=1e-9, predictionCol="_pred"
    )
    fitted = (glm.setWeightCol(weight) if weight else glm).fit(vec)
    return OffsetModel(float(fitted.intercept), {c: float(b) for c, b in zip(features, fitted.coefficients)})


def residual_out_of_fold(
    df: DataFrame, features: Sequence[str], label: str, wind: str, fold: str, k: int, weight: str, eligible: Column,
    *, min_rows: int = MIN_RESIDUAL_ROWS, name: str = "residual",
) -> DataFrame:
    """Vulnerability component out of fold; NULL for rows that are not eligible or have no model."""
    work = df.withColumn("_off", logit(F.col(wind))).withColumn("_ok", eligible)
    out = None
    for f in range(k):
        train = work.where((F.col(fold) != f) & F.col("_ok"))
        held = work.where(F.col(fold) == f)
        value = F.lit(None).cast("double")
        if two_classes(train, label, min_rows):
            value = F.when(F.col("_ok"), fit_offset_glm(train, features, label, "_off", weight).component())
        part = held.withColumn(name, value)
        out = part if out is None else out.unionByName(part)
    return out.drop("_off", "_ok")


# --- full runs ------------------------------------------------------------------------------------


@dataclass
class FamilyRun:
    """Result tables of one run and the models behind them."""

    oof: DataFrame
    metrics: DataFrame
    holdout: DataFrame | None = None
    strata: DataFrame | None = None
    models: dict[str, PipelineModel] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


def _tagged_metrics(df: DataFrame, split: str, label: str, column: str, key: str, max_group: int) -> DataFrame:
    return rank_metrics(df, [], label, column, key, max_group=max_group).select(F.lit(split).alias("split"), "*")


def _eligible(gate: tuple[str, float] | None) -> Column:
    """Rows of the residual model: structurally valid and, with a gate, at or above its threshold."""
    ok = structurally_valid()
    return ok if gate is None else ok & F.coalesce(to_number(F.col(gate[0])) >= gate[1], F.lit(False))


def resolve_gate(df: DataFrame, column: str, threshold: float) -> tuple[str, float]:
    """The gate in the scale of the column: percentiles may be stored as 0-1 or 0-100."""
    if column != "gust_peak_percentile":
        return column, float(threshold)
    top = df.agg(F.max(to_number(F.col(column)))).first()[0] or 0.0
    percent = threshold * 100.0 if threshold <= 1.0 else threshold
    return column, float(percent if top > 1.5 else percent / 100.0)


def score_run(df: DataFrame, models: Mapping[str, PipelineModel], settings: Mapping) -> DataFrame:
    """Rows scored by the models of a run, fresh or loaded: families, residual model and, if there is one, the meta model (K7).

    Missing features are filled with the medians of the training rows; whether a row is eligible for the residual model is
    judged before that. Without a residual model its logit is neutral (0).
    """
    columns, medians = settings["columns"], settings["medians"]
    out = df.withColumn("_elig", _eligible(tuple(settings["gate"]) if settings["gate"] else None))
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in medians})
    for f in columns:
        out = score(models[f], out, f"pred_{f}")
    if settings["use_residual"]:
        part, full = F.lit(None).cast("double"), F.lit(None).cast("double")
        if settings["residual"]:
            glm = OffsetModel(**settings["residual"])
            part = F.when(F.col("_elig"), glm.component())
            full = F.when(F.col("_elig"), glm.full(logit(F.col("pred_wind"))))
        out = out.withColumns({"pred_residual": part, "pred_residual_full": full})
        out = out.withColumn("residual_logit", logit(F.coalesce("pred_residual", F.lit(0.5))))
    out = out.drop("_elig")
    return score(models["meta"], out, "pred_meta") if "meta" in models else out


def run_families(
    df: DataFrame,
    families: Sequence[str],
    holdout_bbox: tuple[float, float, float, float] | None,
    *,
    key: str = "sample_id",
    label: str = "label",
    k: int = 5,
    trees: int = 600,
    depth: int = MAX_DEPTH,
    grid: Sequence[float] = C_GRID,
    shift: bool = True,
    shift_rounds: int = 400,
    residual: bool = False,
    gate: tuple[str, float] | None = None,
    select_metric: str = "prauc",
    max_group: int = MAX_GROUP,
) -> FamilyRun:
    """Out-of-fold base models, stacked meta model, refit on all training rows and holdout scores (K2-K7).

    The final meta model is fitted on the scores of the refitted models, the same that rows to be scored get. ``gate`` is
    (column, threshold) for the residual model. Training rows of one class are an error.
    """
    known = [f for f in FAMILIES if f in families]
    if not known or len(known) != len(set(families)):
        raise ValueError(f"families must be among {list(FAMILIES)}")
    columns = {f: [c for c in FAMILIES[f] if c in df.columns] for f in known}
    every = sorted({c for cs in columns.values() for c in cs})
    held = holdout_flag(holdout_bbox) if holdout_bbox else F.lit(False)
    flagged = df.withColumn("_hold", held).withColumn(label, F.col(label).cast("int"))
    inside, holdout = flagged.where(~F.col("_hold")).drop("_hold"), flagged.where("_hold").drop("_hold")
    if not two_classes(inside, label):
        raise ValueError("training rows need both classes")
    has_holdout = holdout_bbox is not None and not holdout.isEmpty()

    residual_cols = sorted({c for f in known if f != "wind" for c in columns[f]})
    use_residual = residual and "wind" in known and bool(residual_cols)
    settings = {
        "families": known, "columns": columns, "medians": column_medians(inside, every), "folds": k, "seed": SEED,
        "gate": resolve_gate(inside, *gate) if gate else None, "use_residual": use_residual, "residual": None,
    }

    def filled(part: DataFrame) -> DataFrame:
        return part.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in settings["medians"].items()})

    # Whether a row is eligible is judged before its gaps are filled.
    inside = cut_lineage(departure_weight(inside, max_group=max_group))
    train = filled(inside.withColumn("_elig", _eligible(settings["gate"])))
    if shift and has_holdout:
        w = shift_weights(
            train.where(F.col(label) == 0), filled(holdout).where(F.col(label) == 0), every, key, rounds=shift_rounds, max_group=max_group
        )
        train = train.join(w, key, "left").withColumn("weight", F.col("weight") * F.coalesce("shift_weight", F.lit(1.0))).drop("shift_weight")
    train = cut_lineage(group_folds(train, location_group(), label, k, by=["lon", "lat"], max_group=max_group))

    def fitter(f: str) -> Callable[[DataFrame], PipelineModel]:
        return lambda part: fit_forest(part, columns[f], label, "weight", trees=trees, depth=depth)

    oof = train
    for f in known:
        oof = cut_lineage(out_of_fold(oof, "fold", k, fitter(f), f"pred_{f}"))
    meta = [f"pred_{f}" for f in known]
    if use_residual:
        oof = group_folds(oof, storm_group("ref_storm_id", key), label, k, name="storm_fold", max_group=max_group)
        oof = residual_out_of_fold(cut_lineage(oof), residual_cols, label, "pred_wind", "storm_fold", k, "weight", F.col("_elig"))
        oof = cut_lineage(oof.withColumn("residual_logit", logit(F.coalesce("residual", F.lit(0.5)))))
        meta = [*meta, "residual_logit"]
    c = best_c(meta_grid(oof, meta, label, "fold", k, key, grid=grid, max_group=max_group), select_metric)
    oof = cut_lineage(meta_out_of_fold(oof, meta, label, "fold", k, c))
    metrics = _tagged_metrics(oof, "IN_OOF", label, "pred_meta", key, max_group)

    models = {f: fitter(f)(train) for f in known}
    if use_residual:
        ok = oof.where("_elig").withColumn("_off", logit(F.col("pred_wind")))
        if two_classes(ok, label, MIN_RESIDUAL_ROWS):
            glm = fit_offset_glm(ok, residual_cols, label, "_off", "weight")
            settings["residual"] = {"intercept": glm.intercept, "coefficients": dict(glm.coefficients)}
        metrics = metrics.unionByName(
            _tagged_metrics(oof.where("residual IS NOT NULL"), "IN_OOF_RESIDUAL", label, "residual", key, max_group)
        )
    refitted = cut_lineage(score_run(inside, models, settings))
    models["meta"] = fit_meta(refitted, meta, label, c, refitted.count())
    settings["best_c"] = c
    run = FamilyRun(oof, metrics, models=models, settings=settings)
    if not has_holdout:
        return run

    scored = cut_lineage(score_run(holdout, models, settings))
    run.holdout = scored
    parts = [_tagged_metrics(scored, "HOLDOUT", label, "pred_meta", key, max_group)]
    if use_residual:
        known_rows = scored.where("pred_residual IS NOT NULL").withColumn("_flip", F.lit(1.0) - F.col("pred_residual"))
        for split, column in (("HOLDOUT_RESIDUAL", "pred_residual"), ("HOLDOUT_RESIDUAL_FLIP", "_flip"), ("HOLDOUT_RESIDUAL_FULL", "pred_residual_full")):
            parts.append(_tagged_metrics(known_rows, split, label, column, key, max_group))
    for p in parts:
        run.metrics = run.metrics.unionByName(p)
    for name in [*known, "meta"]:
        s = stratified_rank_metrics(scored, label, f"pred_{name}", key, "gust_peak_speed", max_group=max_group)
        s = s.withColumns({"split": F.lit("HOLDOUT"), "model": F.lit(name)})
        run.strata = s if run.strata is None else run.strata.unionByName(s)
    return run


def prediction_table(run: FamilyRun, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Out-of-fold and holdout scores side by side."""
    names = [c for c in run.oof.columns if c.startswith("pred_")]
    out = run.oof.select(F.lit("IN_OOF").alias("split"), key, "lon", "lat", label, *names)
    if run.holdout is not None:
        out = out.unionByName(run.holdout.select(F.lit("HOLDOUT").alias("split"), key, "lon", "lat", label, *names))
    return out


def score_cells(
    model: PipelineModel, df: DataFrame, cell: str, value: str, *, name: str = "pred_wind", max_group: int = MAX_GROUP
) -> DataFrame:
    """Score every cell-period from its value and the value's percentile in the cell."""
    ranked = average_rank(df, [cell], value, max_group=max_group).withColumns(
        {"gust_peak_speed": F.col(value).cast("double"), "gust_peak_percentile": F.col("avg_rank") / F.col("avg_rank_n") * 100.0}
    )
    features = FAMILIES["wind"]
    medians = column_medians(ranked, features)
    ready = ranked.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in features})
    return score(model, ready, name).drop("avg_rank", "avg_rank_n")


def save_artifact(path: str, run: FamilyRun, spark) -> None:
    """Models as MLlib pipelines and one JSON row of settings: medians, gate and residual model, all that ``score_run`` needs."""
    for name, model in run.models.items():
        model.write().overwrite().save(f"{path}/{name}")
    row = [(json.dumps(run.settings, sort_keys=True),)]
    spark.createDataFrame(row, "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_artifact(path: str, spark) -> tuple[dict[str, PipelineModel], Mapping]:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return {n: PipelineModel.load(f"{path}/{n}") for n in [*settings["families"], "meta"]}, settings
