"""Tree models, ensembles, scoring and model metadata.

Forests and both families of boosted trees come from ``operators.trees``, which grows all models of a query together; the logistic
meta-learner is MLlib's. Training sets are materialised once (reliable ``checkpoint`` into the
cluster's shared checkpoint directory) so every fit, fold and scoring pass
reads the same rows without recomputing the feature plan, and a lost
executor recomputes from the checkpoint rather than from the raw tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pct_change, risk_bin
from ..operators import evaluation as E
from ..operators import trees as T
from ..operators.sampling import class_weights, row_hash
from ..session import checkpoint_dir

# The reference's settings. Every registered query fits with them; the first library grows by level, the second leaf by leaf.
FULL_PARAMS = {
    "random_forest": {"kind": "forest", "trees": 200, "depth": 15, "min_leaf": 5, "min_split": 10, "min_weight": 0.0, "l2": 0.0},
    "gbt_a": {"kind": "level", "trees": 200, "depth": 8, "rate": 0.05, "rows": 0.8, "columns": 0.8},
    "gbt_b": {"kind": "leaf", "trees": 200, "depth": 8, "leaves": 31, "rate": 0.05, "rows": 0.8, "columns": 0.8, "min_leaf": 20,
              "min_weight": 0.001, "l2": 0.0},
}
# The settings of the sampling studies. The first study fits forests, the second boosted trees.
STUDY_PARAMS = {
    "forest": {"kind": "forest", "trees": 100, "depth": 10, "min_weight": 0.0, "l2": 0.0},
    "boosted": {"kind": "level", "trees": 200, "depth": 8, "rate": 0.05, "rows": 0.8, "columns": 0.8},
}
KINDS = ("random_forest", "gbt_a", "gbt_b")
Model = T.TreeModel | PipelineModel


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint directory."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spec(kind: str, params: Mapping | None = None, seed: int = 42) -> T.Spec:
    return T.Spec(seed=seed, **{**FULL_PARAMS[kind], **(params or {})})


def fit(df: DataFrame, features: Sequence[str], kind: str, params: Mapping | None = None, label: str = "target",
        weight_col: str | None = None, seed: int = 42, name: str | None = None) -> Model:
    """Fit one model; the feature list (in order) travels with it. ``params`` overrides single settings of ``FULL_PARAMS``."""
    if kind in FULL_PARAMS:
        weights = {"m": F.col(weight_col)} if weight_col else None
        return T.fit_many(df, features, {"m": spec(kind, params, seed)}, label, weights)["m"]
    if kind != "logistic":
        raise ValueError(f"unknown model kind {kind!r}")
    name = name or kind
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    clf = LogisticRegression(featuresCol="features", labelCol=label, predictionCol=f"pred_{name}", probabilityCol=f"prob_{name}",
                             rawPredictionCol=f"raw_{name}", **(params or {}))
    if weight_col:
        clf.setWeightCol(weight_col)
    return Pipeline(stages=[assembler, clf]).fit(df.withColumn(label, F.col(label).cast("double")))


def probability(model: Model, df: DataFrame, name: str) -> DataFrame:
    """Add ``p_<name>`` = P(class 1) from a fitted model."""
    if isinstance(model, T.TreeModel):
        return T.scored(df, {name: model})
    out = model.transform(df)
    return (out.withColumn(f"p_{name}", vector_to_array(F.col(f"prob_{name}"))[1])
            .drop("features", f"prob_{name}", f"raw_{name}", f"pred_{name}"))


# -- M7 -----------------------------------------------------------------------------------
def score(model: Model, df: DataFrame, name: str, model_used: str, version: str,
          keys: Sequence[str], threshold: float = 0.5, with_risk: bool = False) -> DataFrame:
    """Batch-score every row: class, P(1), model name and version (+ P25 risk bin)."""
    x = probability(model, df, name)
    p = F.col(f"p_{name}")
    out = x.select(*keys, (p >= threshold).cast("int").alias("predicted_outage"),
                   p.alias("outage_probability"), F.lit(model_used).alias("model_used"),
                   F.lit(version).alias("model_version"))
    if with_risk:
        out = out.withColumn("risk_level", risk_bin("outage_probability"))
    return out


# -- M6 -----------------------------------------------------------------------------------
def importances(model: Model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) sorted descending; zeros when the model has none."""
    spark = SparkSession.getActiveSession()
    vals = model.importances() if isinstance(model, T.TreeModel) else [0.0] * len(features)
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature"))


# -- M9 / M5 --------------------------------------------------------------------------------
def evaluate(scored: DataFrame, prob_col: str, label: str = "target", threshold: float = 0.5) -> DataFrame:
    x = scored.select(F.col(label).alias("target"), F.col(prob_col).alias("p"),
                      (F.col(prob_col) >= threshold).cast("int").alias("pred"))
    return E.metrics(x, "target", "pred", "p")


def fit_all(train: DataFrame, features: Sequence[str], kinds: Sequence[str] = KINDS, params: Mapping[str, Mapping] | None = None,
            label: str = "target", seed: int = 42, weight_col: str | None = None) -> dict[str, T.TreeModel]:
    """One model of each kind, grown together."""
    specs = {k: spec(k, (params or {}).get(k), seed) for k in kinds}
    return T.fit_many(train, features, specs, label, {k: F.col(weight_col) for k in kinds} if weight_col else None)


def score_all(models: Mapping[str, T.TreeModel], df: DataFrame) -> DataFrame:
    """``p_<kind>`` of every model, scored in one pass and checkpointed."""
    return materialize(T.scored(df, models))


def metrics_table(scored: DataFrame, kinds: Sequence[str], label: str = "target") -> DataFrame:
    table = None
    for k in kinds:
        row = evaluate(scored, f"p_{k}", label).select(F.lit(k).alias("model"), "*")
        table = row if table is None else table.unionByName(row)
    return table


def train_compare(train: DataFrame, test: DataFrame, features: Sequence[str], kinds: Sequence[str] = KINDS,
                  params: Mapping[str, Mapping] | None = None, label: str = "target", seed: int = 42,
                  weight_col: str | None = None):
    """Fit each kind (in one pass), score the test rows once, return (models, metrics DataFrame)."""
    models = fit_all(train, features, kinds, params, label, seed, weight_col)
    return models, metrics_table(score_all(models, test), kinds, label)


def pick_best(metrics_table: DataFrame, by: str = "f1") -> str:
    """Name of the model with the best ``by`` (ties: first name alphabetically)."""
    return metrics_table.orderBy(F.col(by).desc(), "model").select("model").first()[0]


def gains(metrics_table: DataFrame, baseline: str, by: Sequence[str] = ("precision", "recall", "f1", "roc_auc")) -> DataFrame:
    """Per model, % change of each metric against ``baseline`` (P30; NULL when the base is 0)."""
    base = metrics_table.filter(F.col("model") == baseline)
    return metrics_table.select("model", *[
        pct_change(base.agg(F.first(c)).scalar(), F.col(c)).alias(f"{c}_gain_pct") for c in by])


# -- M4 ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference's: soft-voting weight schemes (rf, gbt_a, gbt_b).
VOTING_SCHEMES = {
    "Equal Weights": (1, 1, 1),
    "XGB Focused": (1, 2, 1),
    "Best Two": (1, 2, 0),
    "XGB Heavy": (1, 3, 1),
}


def vote(scored: DataFrame, prob_cols: Sequence[str], weights: Sequence[float], out: str = "p_vote") -> DataFrame:
    """Weighted mean of probability columns (soft voting)."""
    total = float(sum(weights))
    expr = sum((F.col(c) * float(w) for c, w in zip(prob_cols, weights) if w), F.lit(0.0)) / total
    return scored.withColumn(out, expr)


# -- M3 ---------------------------------------------------------------------------------------
def stack(train: DataFrame, features: Sequence[str], key: Sequence[str], kinds: Sequence[str] = KINDS,
          params: Mapping[str, Mapping] | None = None, folds: int = 5, label: str = "target", seed: int = 42):
    """Stacking: out-of-fold base probabilities (hash folds) -> balanced logistic meta-learner.

    Returns ``(base_models, meta_model)``; bases are refit on all training rows. The folds x kinds fits and the final ones
    share one binned matrix: a fold is a weight of 0 on its rows.
    """
    t = materialize(train.withColumn("_fold", F.pmod(row_hash(list(key), seed, "fold"), F.lit(folds))))
    specs: dict[str, T.Spec] = {}
    weights: dict[str, Column] = {}
    for k in kinds:
        for f in [*range(folds), None]:
            name = k if f is None else f"{k}/{f}"
            specs[name] = spec(k, (params or {}).get(k), seed)
            weights[name] = F.lit(1.0) if f is None else (F.col("_fold") != f).cast("double")
    models = T.fit_many(t, features, specs, label, weights)
    oof = None
    for f in range(folds):
        hold = T.scored(t.filter(F.col("_fold") == f), {k: models[f"{k}/{f}"] for k in kinds})
        oof = hold if oof is None else oof.unionByName(hold)
    oof = materialize(class_weights(oof, label, "_w"))
    meta = fit(oof, [f"p_{k}" for k in kinds], "logistic", {"maxIter": 1000}, label, "_w", seed, name="meta")
    return {k: models[k] for k in kinds}, meta


def stack_score(bases: Mapping[str, T.TreeModel], meta: PipelineModel, df: DataFrame) -> DataFrame:
    return probability(meta, T.scored(df, bases), "meta").withColumnRenamed("p_meta", "p_stack")


# -- M8 ---------------------------------------------------------------------------------------
def compare(strategies: Mapping[str, DataFrame], test: DataFrame, features: Sequence[str], studies: Mapping[str, str],
            label: str = "target", seed: int = 42, weight_cols: Mapping[str, str] | None = None) -> DataFrame:
    """One model per resampled training set, all grown in one pass and evaluated on the same test rows.

    ``studies`` names the settings (of ``STUDY_PARAMS``) of each strategy. A strategy's rows have its weight, the others' rows weight 0.
    """
    weight_cols, rows = weight_cols or {}, None
    for name, train in strategies.items():
        w = F.col(weight_cols[name]).cast("double") if name in weight_cols else F.lit(1.0)
        part = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias(label),
                            F.lit(name).alias("_strategy"), w.alias("_weight"))
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows)
    counts = {r["_strategy"]: r["count"] for r in rows.groupBy("_strategy").count().collect()}
    models = T.fit_many(rows, features, {n: T.Spec(seed=seed, **STUDY_PARAMS[studies[n]]) for n in strategies}, label,
                        {n: F.when(F.col("_strategy") == n, F.col("_weight")).otherwise(0.0) for n in strategies})
    scores = materialize(T.scored(test, models))
    table = None
    for name in strategies:
        row = evaluate(scores, f"p_{name}", label).select(F.lit(name).alias("strategy"), "*", F.lit(counts.get(name, 0)).alias("train_rows"))
        table = row if table is None else table.unionByName(row)
    return table


# -- M10 --------------------------------------------------------------------------------------
def metadata_row(metrics_table: DataFrame, imp: DataFrame, version: str, best: str,
                 features: Sequence[str]) -> DataFrame:
    """One row: version, best model, feature list, metrics map of maps, importances map."""
    mcols = [c for c in metrics_table.columns if c != "model"]
    per_model = metrics_table.select("model", F.create_map(*[x for c in mcols for x in (F.lit(c), F.col(c))]).alias("m"))
    metrics_map = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("metrics"))
    imp_map = imp.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importances"))
    return metrics_map.select(
        F.lit(version).alias("model_version"), F.lit(best).alias("best_model"),
        F.array(*[F.lit(f) for f in features]).alias("feature_columns"), "metrics",
        imp_map.scalar().alias("feature_importances"))


def importances_from_metadata(metadata: DataFrame, version: str) -> DataFrame:
    """The stored ``feature_importances`` map of one version as rows, largest first."""
    row = metadata.filter(F.col("model_version") == version)
    return (row.select(F.explode("feature_importances").alias("feature", "importance"))
            .orderBy(F.col("importance").desc(), F.col("feature")))


def save_metadata(metadata: DataFrame, path: str) -> None:
    """M10 + S11: replace only this version's metadata row(s)."""
    from ..sources.sinks import replace_keyed

    replace_keyed(metadata, path, "model_version")


def to_vectors(df: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "target",
               seed: int = 42) -> DataFrame:
    """(id, features array<double>, target) for the kNN-based resamplers; id is a hash of the key."""
    return df.select(row_hash(list(key), seed, "vec").alias("id"),
                     F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
                     F.col(label).cast("int").alias("target"))


def from_vectors(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """Inverse of ``to_vectors``: one column per feature (synthetic rows included)."""
    return df.select(*[F.col("features")[i].alias(c) for i, c in enumerate(features)],
                     F.col(label).alias(label), "is_synthetic")


def save_model(model: Model, path: str) -> None:
    """Persist a fitted model with its feature order."""
    if isinstance(model, T.TreeModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> T.TreeModel:
    return T.TreeModel.load(path)
