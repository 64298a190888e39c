"""Training, selection, persistence and scoring of classifiers with MLlib."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ordered import row_positions
from flowloom.operators import evaluate, scale, score

FEATURES = "features"
WEIGHT = "_weight"
VALIDATION = "_validation"


@dataclass(frozen=True)
class ModelSpec:
    """A named classifier: ``forest``, ``boosted`` or ``network`` with MLlib parameters."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)
    balanced: bool = False


# The experiment grid. MLlib bounds tree depth at 30 and grows boosted trees by level.
EXPERIMENTS = (
    ModelSpec("RF_baseline", "forest", {"numTrees": 100, "maxDepth": 30}, True),
    ModelSpec("RF_deep", "forest", {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2}, True),
    ModelSpec("RF_wide", "forest", {"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 2}, True),
    ModelSpec("GBT_baseline", "boosted", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}, True),
    ModelSpec("GBT_deep", "boosted", {"maxIter": 200, "maxDepth": 10, "stepSize": 0.05, "subsamplingRate": 0.8}, True),
    ModelSpec("GBT_regularized", "boosted", {"maxIter": 150, "maxDepth": 8, "stepSize": 0.1, "minInfoGain": 0.001}, True),
    ModelSpec("NN_small", "network", {"hidden": [64, 32], "maxIter": 50}),
    ModelSpec("NN_medium", "network", {"hidden": [128, 64, 32], "maxIter": 100}),
    ModelSpec("NN_large", "network", {"hidden": [256, 128, 64, 32], "maxIter": 100}),
)


def assemble(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Vector of the contract columns."""
    return VectorAssembler(inputCols=list(contract), outputCol=FEATURES, handleInvalid="keep").transform(df)


def estimator(spec: ModelSpec, label: str, n_features: int, n_classes: int, seed: int = 42):
    """MLlib estimator of a spec; boosted trees become one-vs-rest for more than two classes."""
    common = {"featuresCol": FEATURES, "labelCol": label, "seed": seed}
    params = dict(spec.params)
    weight = {"weightCol": WEIGHT} if spec.balanced else {}
    if spec.kind == "forest":
        return RandomForestClassifier(**common, **weight, **params)
    if spec.kind == "boosted":
        if n_classes > 2:
            return OneVsRest(classifier=GBTClassifier(featuresCol=FEATURES, seed=seed, **params), featuresCol=FEATURES, labelCol=label, **weight)
        return GBTClassifier(**common, **weight, **params)
    if spec.kind == "network":
        hidden = params.pop("hidden", [64, 32])
        return MultilayerPerceptronClassifier(**common, layers=[n_features, *hidden, n_classes], **params)
    raise ValueError(f"unknown model kind: {spec.kind}")


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight column rows / (classes x rows of the class); one small count per class."""
    rows = evaluate.class_weights(df, label).collect()
    weight = None
    for r in rows:
        hit = F.col(label) == r[label]
        weight = F.when(hit, F.lit(r["weight"])) if weight is None else weight.when(hit, F.lit(r["weight"]))
    return df.withColumn(WEIGHT, weight)


def fit(
    spec: ModelSpec,
    train: DataFrame,
    contract: Sequence[str],
    label: str,
    seed: int = 42,
    classes: int | None = None,
    scaler: scale.Params | None = None,
    validation: DataFrame | None = None,
) -> PipelineModel:
    """Train one model on the contract columns (or on a ready ``features`` vector).

    With ``scaler`` parameters, fitted on the training rows, scaling is the first pipeline stage,
    so batch and live scoring cannot miss it. Boosted trees of two classes stop early on ``validation`` rows.
    """
    classes = classes or int(train.agg(F.max(label)).first()[0]) + 1
    data = with_class_weights(train, label) if spec.balanced else train
    watched = validation is not None and spec.kind == "boosted" and classes == 2
    if watched:
        seen = validation.withColumn(WEIGHT, F.lit(1.0)) if spec.balanced else validation
        data = data.withColumn(VALIDATION, F.lit(False)).unionByName(seen.withColumn(VALIDATION, F.lit(True)), allowMissingColumns=True)
    stages: list = []
    if FEATURES not in data.columns:
        names = [scale.scaled_name(c) for c in contract] if scaler else list(contract)
        stages = [scale.scaler_stage({c: scaler[c] for c in contract})] if scaler else []
        stages.append(VectorAssembler(inputCols=names, outputCol=FEATURES))
    last = estimator(spec, label, len(contract), classes, seed)
    if watched:
        last = last.setValidationIndicatorCol(VALIDATION)
    return Pipeline(stages=[*stages, last]).fit(data)


def class_count(model: PipelineModel) -> int:
    """Number of classes the model was trained for."""
    last = model.stages[-1]
    return len(last.models) if isinstance(last, OneVsRestModel) else last.numClasses


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the class probabilities as an array column.

    A one-vs-rest model of boosted trees has a margin per class; their logistic values are scaled to add up to one.
    """
    out = model.transform(df)
    if not isinstance(model.stages[-1], OneVsRestModel):
        return out.withColumn("probabilities", vector_to_array("probability"))
    each = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
    out = out.withColumn("probabilities", each)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("probabilities", F.transform("probabilities", lambda x: x / total))


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score rows once and decide: at the threshold for two classes, for the most likely one (smallest of equals) beyond.

    With more than two classes ``probability`` is that of any class but the first, and ``prediction`` the class number.
    """
    scored = probabilities(model, df.drop("prediction"))
    many = class_count(model) > 2
    attack = F.lit(1.0) - F.element_at("probabilities", 1) if many else F.element_at("probabilities", -1)
    scored = scored.withColumn("probability", attack).drop("rawPrediction", "prediction", FEATURES)
    twins = [c for c in scored.columns if c.endswith(scale.scaled_name(""))]
    out = score.decide(scored.drop(*twins), threshold)
    if not many:
        return out
    best = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")
    return out.withColumn("prediction", best).withColumns({
        "is_attack": F.col("prediction") != 0, "confidence": F.array_max("probabilities"),
        "class_name": F.when(F.col("prediction") != 0, "ATTACK").otherwise("BENIGN")})


def evaluate_split(scored: DataFrame, label: str, prefix: str) -> dict[str, float]:
    """F1, ROC area and average precision of a scored split."""
    f1 = evaluate.binary_metrics(scored, label).first()["f1"]
    area = evaluate.ranking_metrics(scored, label).first()
    return {f"{prefix}_f1": f1, f"{prefix}_roc_auc": area["roc_auc"], f"{prefix}_pr_auc": area["pr_auc"]}


def sweep(
    specs: Sequence[ModelSpec], splits: dict[str, DataFrame], contract: Sequence[str], label: str, seed: int = 42
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Train every spec, evaluate validation and test splits, best validation F1 first."""
    spark = splits["train"].sparkSession
    rows, fitted = [], {}
    for spec in specs:
        start = time.time()
        model = fit(spec, splits["train"], contract, label, seed, validation=splits["val"])
        row = {"name": spec.name, "training_time": time.time() - start}
        for part in ("val", "test"):
            row |= evaluate_split(cut(predict(model, splits[part]).select(label, "probability", "prediction")), label, part)
        rows.append(row)
        fitted[spec.name] = model
    return spark.createDataFrame(rows).orderBy(F.desc("val_f1"), "name"), fitted


def best_model(results: DataFrame, fitted: dict[str, PipelineModel], metric: str = "val_f1") -> tuple[str, PipelineModel]:
    """The model with the largest metric (ties by name)."""
    name = results.orderBy(F.desc(metric), "name").first()["name"]
    return name, fitted[name]


def ensemble(
    models: Sequence[PipelineModel], df: DataFrame, weights: Sequence[float] | None = None, voting: str = "soft", threshold: float = 0.5
) -> DataFrame:
    """Add ``prediction`` by weighted mean probability or by majority over the models' decisions."""
    columns = []
    out = df
    for i, m in enumerate(models):
        keep = out.columns
        out = probabilities(m, out.drop("prediction", "rawPrediction", "probability", "probabilities"))
        keep = [c for c in keep if c in out.columns and c != FEATURES]
        ready = [FEATURES] if FEATURES in df.columns else []
        out = out.select(*keep, *ready, F.col("probabilities").alias(f"_m{i}"))
        columns.append(f"_m{i}")
    if voting == "soft":
        width = len(out.first()[columns[0]]) if out.first() else 2
        mean, best = score.soft_vote([[F.col(c)[k] for k in range(width)] for c in columns], weights)
        return out.withColumns({"probability": mean[-1], "prediction": best}).drop(*columns, FEATURES)
    votes = F.array(*[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1 for c in columns])
    return out.withColumn("prediction", score.majority(votes)).drop(*columns, FEATURES)


def importances(model: PipelineModel, contract: Sequence[str]) -> DataFrame:
    """Features by importance; a tree model holds one number per feature, one-vs-rest the mean of its members' numbers.

    Networks hold none: see ``permutation_importances``, which serves any model.
    """
    last = model.stages[-1]
    members = last.models if isinstance(last, OneVsRestModel) else [last]
    if not all(hasattr(m, "featureImportances") for m in members):
        raise ValueError(f"{type(last).__name__} holds no importances; use permutation_importances")
    values = sum(m.featureImportances.toArray() for m in members)
    values = values / (values.sum() or 1.0)
    spark = SparkSession.getActiveSession()
    rows = [(c, float(v)) for c, v in zip(contract, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importances(
    model: PipelineModel, df: DataFrame, contract: Sequence[str], label: str, keys: Sequence[str], seed: int = 42, threshold: float = 0.5
) -> DataFrame:
    """How much accuracy is lost when the values of one feature are dealt to other rows, per feature; serves any model.

    Rows are put in the order of a seeded hash of ``keys`` and every row takes the values of the row before it, the first
    those of the last: one permutation serves all features, since each is exchanged alone. A row is scored once as it
    is and once a feature. Rows without a truth are left out; without rows every importance is null. ``keys`` should tell rows
    apart: rows with equal keys stand in any order among themselves.
    """
    ready = FEATURES in df.columns
    cells = vector_to_array(FEATURES) if ready else F.array(*[F.col(f"`{c}`").cast("double") for c in contract])
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_truth"), cells.alias("_own"), F.xxhash64(F.lit(seed), *keys).alias("_h"))
    placed = cut(row_positions(rows, ["_h"], "_at").drop("_h"))
    total = placed.count()
    givers = placed.select(F.pmod(F.col("_at") + 1, F.lit(max(total, 1))).alias("_at"), F.col("_own").alias("_other"))
    mixed = placed.join(givers, "_at").select("_truth", "_own", "_other", F.explode(F.sequence(F.lit(0), F.lit(len(contract)))).alias("_k"))
    cells = F.transform("_own", lambda v, i: F.when(i + 1 == F.col("_k"), F.get("_other", i)).otherwise(v))
    mixed = mixed.select("_truth", "_k", cells.alias("_cells"))
    if ready:
        mixed = mixed.select("_truth", "_k", array_to_vector("_cells").alias(FEATURES))
    else:
        mixed = mixed.select("_truth", "_k", *[F.col("_cells")[i].alias(c) for i, c in enumerate(contract)])
    hits = predict(model, mixed, threshold).groupBy("_k").agg(F.count_if(F.col("prediction") == F.col("_truth")).alias("hits")).collect()
    right = {r["_k"]: r["hits"] for r in hits}  # one number per feature
    spark = df.sparkSession
    found = [(c, (right[0] - right[i + 1]) / total if total else None) for i, c in enumerate(contract)]
    return spark.createDataFrame(found, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def describe(model: PipelineModel, contract: Sequence[str], threshold: float = 0.5) -> dict:
    """Model type, feature count, threshold and the size parameters it has."""
    last = model.stages[-1]
    info = {"loaded": True, "model_type": type(last).__name__, "n_features": len(contract), "threshold": threshold}
    for name, label in (("numTrees", "n_estimators"), ("maxIter", "n_estimators"), ("maxDepth", "max_depth")):
        if last.hasParam(name) and last.isDefined(name):
            info.setdefault(label, last.getOrDefault(name))
    return info


def save(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)


def save_ensemble(models: Sequence[PipelineModel], weights: Sequence[float], path: str) -> str:
    """Persist each member and the weights in member order."""
    spark = SparkSession.getActiveSession()
    for i, m in enumerate(models):
        save(m, f"{path}/model_{i}")
    total = sum(weights)
    rows = [(i, float(w / total)) for i, w in enumerate(weights)]
    spark.createDataFrame(rows, "member int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    return path


def load_ensemble(path: str) -> tuple[list[PipelineModel], list[float]]:
    """Load members and weights."""
    spark = SparkSession.getActiveSession()
    rows = spark.read.parquet(f"{path}/weights").orderBy("member").collect()
    return [load(f"{path}/model_{r['member']}") for r in rows], [r["weight"] for r in rows]
