"""Training and scoring queries. Only models of one split have an SQL equivalent; of the others rows are checked."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import evaluate, models, scale, split
from flowloom.plans.registry import register, rounded
from flowloom.plans.score_plans import _CELLS, metrics_sql
from flowloom.plans.views import cte, table, view


def _vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Labelled vectors with one binary label: the first class against the rest."""
    df = table(spark, sf_dir, "embeddings")
    n = len(df.select("embedding").first()[0])
    contract = [f"f{i}" for i in range(n)]
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias(models.FEATURES)
    return df.select("vec_id", vector, (F.col("label") % 2).cast("int").alias("y_true")), contract


def _parts(spark, sf_dir):
    df, contract = _vectors(spark, sf_dir)
    marked = split.stratified_split(df, ["vec_id"], "y_true")
    return {s: marked.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}, contract


SMALL = {
    "m1_random_forest": models.ModelSpec("RF", "forest", {"numTrees": 20, "maxDepth": 5}, True),
    "m2_boosted_trees": models.ModelSpec("GBT", "boosted", {"maxIter": 10, "maxDepth": 4}, True),
    "m3_network": models.ModelSpec("NN", "network", {"hidden": [16], "maxIter": 30}),
}


def _register(name: str, spec: models.ModelSpec) -> None:
    @register(name)
    def run(spark, sf_dir):
        parts, contract = _parts(spark, sf_dir)
        model = models.fit(spec, parts["train"], contract, "y_true", classes=2)
        return models.predict(model, parts["test"]).select("vec_id", "y_true", "probability", "prediction", "confidence")


for _name, _spec in SMALL.items():
    _register(_name, _spec)


@register("m4_m5_model_sweep")
def m5(spark, sf_dir):
    parts, contract = _parts(spark, sf_dir)
    results, _ = models.sweep([SMALL["m1_random_forest"], SMALL["m2_boosted_trees"]], parts, contract, "y_true")
    return results.drop("training_time")


@register("m9_feature_importance")
def m9(spark, sf_dir):
    parts, contract = _parts(spark, sf_dir)
    return models.importances(models.fit(SMALL["m1_random_forest"], parts["train"], contract, "y_true", classes=2), contract)


@register("m9_permutation_importance")
def m9_permuted(spark, sf_dir):
    """A network, which holds no importances of its own, judged on every row that it was not fitted on."""
    parts, contract = _parts(spark, sf_dir)
    model = models.fit(SMALL["m3_network"], parts["train"], contract, "y_true", classes=2)
    return models.permutation_importances(model, parts["val"].unionByName(parts["test"]), contract, "y_true", ["vec_id"])


@register("m10_score_and_evaluate")
def m10(spark, sf_dir):
    parts, contract = _parts(spark, sf_dir)
    model = models.fit(SMALL["m1_random_forest"], parts["train"], contract, "y_true", classes=2)
    return evaluate.binary_metrics(models.predict(model, parts["val"].unionByName(parts["test"])))


TRAFFIC = ["fwd_len", "bytes_s", "iat_mean"]


#: Bound of the rows that the traffic model is fitted on.
FIT_ROWS = 20_000


def traffic_rows(spark, sf_dir, fit_rows=FIT_ROWS):
    """Fitting rows (a hash sample of at most ``fit_rows``) and all other rows."""
    rows = view(spark, sf_dir, "labelled")
    train = split.sample_rows(rows, fit_rows, ["flow_key"])
    return train, rows.join(train.select("flow_key"), "flow_key", "left_anti")


def traffic_model(spark, sf_dir, fit_rows=FIT_ROWS):
    """Boosted trees on the labelled traffic, with the scaler inside the pipeline."""
    train, _ = traffic_rows(spark, sf_dir, fit_rows)
    spec = models.ModelSpec("GBT", "boosted", {"maxIter": 20, "maxDepth": 4}, True)
    return models.fit(spec, train, TRAFFIC, "label_binary", classes=2, scaler=scale.fit_scaler(train, TRAFFIC))


@register("m10_score_all_traffic")
def m10_traffic(spark, sf_dir):
    """Every row that the model was not fitted on."""
    scored = models.predict(traffic_model(spark, sf_dir), traffic_rows(spark, sf_dir)[1])
    return evaluate.binary_metrics(scored, "label_binary")


# ---- models of one split, which SQL can fit as well -------------------------------------------

STUMP = ["fwd_len", "iat_mean"]
_TRUTH = "case when label_multiclass = 0 then label_binary when fwd_len > 20 then 1 else 0 end"
#: Both columns have few values, so every border between two of them is tried: the split with the least Gini impurity.
_SPLIT_SQL = cte("labelled") + f""", d as (select *, {_TRUTH} as y_true from labelled),
  long as (select y_true, unnest(['fwd_len', 'iat_mean']) as f, unnest([fwd_len, iat_mean]) as x from d),
  v as (select f, x, count(*)::double as n, sum(y_true)::double as a from long group by all),
  c as (select f, x, sum(n) over below as ln, sum(a) over below as la, sum(n) over (partition by f) as tn, sum(a) over (partition by f) as ta from v
        window below as (partition by f order by x)),
  g as (select f, x, la / ln as lp, (ta - la) / (tn - ln) as rp, ln, tn - ln as rn from c where ln < tn),
  best as (select f, x, lp, rp from g order by ln * lp * (1 - lp) + rn * rp * (1 - rp), f, x limit 1),
  leaf as (select flow_key, y_true, case when (case when f = 'fwd_len' then fwd_len else iat_mean end) <= x then lp else rp end as p from d, best)"""
_ONE_SPLIT = {
    "forest": models.ModelSpec("stump", "forest", {"numTrees": 1, "maxDepth": 1, "maxBins": 64, "featureSubsetStrategy": "all", "bootstrap": False}),
    "boosted": models.ModelSpec("boosted stump", "boosted", {"maxIter": 1, "maxDepth": 1, "maxBins": 64}),
}


def one_split(spark, sf_dir, kind):
    """Labelled traffic with a truth that mostly follows one column, and a model of one split fitted on all of it."""
    df = view(spark, sf_dir, "labelled").withColumn("y_true", F.expr(_TRUTH)).select("flow_key", "y_true", *STUMP)
    return df, models.fit(_ONE_SPLIT[kind], df, STUMP, "y_true", classes=2)


def _stump_rows(spark, sf_dir, kind):
    df, model = one_split(spark, sf_dir, kind)
    return rounded(models.predict(model, df).select("flow_key", "y_true", "probability", "prediction"))


@register("m1_forest_of_one_split", _SPLIT_SQL + "select flow_key, y_true, round(p, 6) as probability, (p >= 0.5)::int as prediction from leaf")
def m1one_split(spark, sf_dir):
    return _stump_rows(spark, sf_dir, "forest")


@register("m2_boosted_one_split", _SPLIT_SQL + """select flow_key, y_true, round(1 / (1 + exp(-2 * (2 * p - 1))), 6) as probability, (p >= 0.5)::int as prediction from leaf""")
def m2one_split(spark, sf_dir):
    """The first boosted tree predicts the mean of -1 and 1; its logistic value is the probability."""
    return _stump_rows(spark, sf_dir, "boosted")


@register("m9_importance_of_one_split", _SPLIT_SQL + "select x.f as feature, (x.f = best.f)::int::double as importance from (select distinct f from g) x, best")
def m9one_split(spark, sf_dir):
    return models.importances(one_split(spark, sf_dir, "forest")[1], STUMP)


@register("m10_evaluate_one_split", _SPLIT_SQL + f", p as (select y_true, (p >= 0.5)::int as prediction from leaf), t as (select {_CELLS} from p) {metrics_sql('t')}")
def m10one_split(spark, sf_dir):
    df, model = one_split(spark, sf_dir, "forest")
    return rounded(evaluate.binary_metrics(models.predict(model, df)))
