"""Exact evaluation of predictions.

Everything starts from counts per (truth, prediction) or per distinct score; both are combined
before the shuffle. Curves are running totals over distinct scores, cut into score ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ordered import quantiles, running_totals


def safe_div(a: Column, b: Column) -> Column:
    """Quotient, 0 unless the divisor is positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion_counts(truth: Column, prediction: Column) -> dict[str, Column]:
    """The four cells of the binary confusion table as aggregates."""
    t, p = truth == 1, prediction == 1
    return {
        "true_positives": F.count_if(t & p),
        "false_positives": F.count_if(~t & p),
        "true_negatives": F.count_if(~t & ~p),
        "false_negatives": F.count_if(t & ~p),
    }


def binary_scores() -> dict[str, Column]:
    """Precision, recall, F1, accuracy and specificity from the four cell columns."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": safe_div(F.lit(2.0) * precision * recall, precision + recall),
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn),
        "specificity": safe_div(tn, tn + fp),
    }


def confusion(df: DataFrame, truth: str = "y_true", prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    """Binary confusion table."""
    cells = confusion_counts(F.col(truth), F.col(prediction))
    return df.groupBy(*groups).agg(*[c.alias(k) for k, c in cells.items()])


def binary_metrics(df: DataFrame, truth: str = "y_true", prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    """Confusion table with the scores derived from it."""
    return confusion(df, truth, prediction, groups).withColumns(binary_scores())


def class_table(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows per (truth, prediction)."""
    return df.groupBy(F.col(truth).alias("y_true"), F.col(prediction).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def normalised_confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Confusion cells as a share of their true class."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("y_true"))
    return class_table(df, truth, prediction).withColumn("share", share)


def class_scores(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction."""
    cells = class_table(df, truth, prediction)
    both = cells.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"),
                 F.lit(0).cast("long").alias("hit")),
    )).alias("c")).select("c.*")
    per = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    precision, recall = safe_div(F.col("hit"), F.col("claimed")), safe_div(F.col("hit"), F.col("support"))
    return per.select("class", precision.alias("precision"), recall.alias("recall"),
                      safe_div(F.lit(2.0) * precision * recall, precision + recall).alias("f1"), "support", "hit")


def _weighted(c: str) -> Column:
    return F.sum(F.col(c) * F.col("support")) / F.sum("support")


def multiclass_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Accuracy plus macro and weighted precision, recall and F1."""
    names = ("precision", "recall", "f1")
    return class_scores(df, truth, prediction).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in names],
        *[_weighted(c).alias(f"{c}_weighted") for c in names],
    )


def classification_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    per = class_scores(df, truth, prediction)
    rows = per.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double")
    hit = (F.sum("hit") / F.sum("support")).alias("x")
    summary = per.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), hit.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), _weighted("precision").alias("precision"), _weighted("recall").alias("recall"), _weighted("f1").alias("f1"), total.alias("support")),
    ).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.unionByName(summary)


def score_steps(df: DataFrame, truth: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (high to low): rows at the score and running positives / negatives."""
    per = df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    return running_totals(cut(per), ["score"], {"tp": F.col("pos"), "fp": F.col("neg")}, groups, descending=True)


def _curve_areas(steps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Area under ROC (ties count half) and average precision; 0 when a class is absent."""
    # A negative at this score ranks below all positives above it and ties with those beside it.
    wins = F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0))
    gain = F.col("pos").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = steps.groupBy(*groups).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("_w"), F.sum(gain).alias("_g"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *groups, "positives", "negatives",
        F.when(both, F.col("_w") / (F.col("positives").cast("double") * F.col("negatives"))).otherwise(F.lit(0.0)).alias("roc_auc"),
        F.when(both, F.col("_g") / F.col("positives")).otherwise(F.lit(0.0)).alias("pr_auc"))


def ranking_metrics(df: DataFrame, truth: str = "y_true", score: str = "probability", groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC area and average precision."""
    return _curve_areas(score_steps(df, truth, score, groups), groups)


def roc_auc_ovr(df: DataFrame, truth: str, scores: dict[int, str]) -> DataFrame:
    """One-vs-rest ROC area averaged with class support as weight."""
    cells = [F.struct(F.lit(k).alias("class"), (F.col(truth) == k).cast("int").alias("hit"), F.col(c).alias("score")) for k, c in scores.items()]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    per = ranking_metrics(rows, "hit", "score", ["class"])
    return per.agg((F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc_ovr"))


def curve_points(df: DataFrame, truth: str = "y_true", score: str = "probability", groups: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points at every distinct score, with the share of positives.

    The row with an infinite threshold is the end of both curves: nothing found, precision 1.
    """
    steps = score_steps(df, truth, score, groups)
    names = [f"_g{i}" for i in range(len(groups))]
    totals = df.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)]).agg(
        F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) != 1).alias("_n"))
    if groups:
        on = F.lit(True)
        for g, n in zip(groups, names):
            on = on & F.col(g).eqNullSafe(F.col(n))
        joined = steps.join(totals, on)
    else:
        row = totals.first()
        joined = steps.withColumns({"_p": F.lit(row["_p"]), "_n": F.lit(row["_n"])})
    baseline = F.col("_p") / (F.col("_p") + F.col("_n"))
    points = joined.select(
        *groups, F.col("score").cast("double").alias("threshold"), safe_div(F.col("fp"), F.col("_n")).alias("fpr"),
        safe_div(F.col("tp"), F.col("_p")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), baseline.alias("baseline"))
    ends = totals.where("_p + _n > 0").select(
        *[F.col(n).alias(g) for g, n in zip(groups, names)], F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"), F.lit(1.0).alias("precision"), baseline.alias("baseline"))
    return points.unionByName(ends)


def latency_summary(df: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Exact interpolated p50 / p95 / p99 with mean and maximum; zeros for no rows."""
    found = quantiles(df, {"x": F.col(latency)}, [0.5, 0.95, 0.99])["x"]
    return df.agg(
        *[F.lit(0.0 if q is None else q).alias(f"{n}_ms") for n, q in zip(("p50", "p95", "p99"), found)],
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.max(latency), F.lit(0.0)).alias("max_ms"))


def final_report(df: DataFrame, time_us: str = "ts_us", latency: str = "latency_ms") -> DataFrame:
    """Totals, throughput, scores (4 decimals) and latencies (2 decimals) of a scored run."""
    found = quantiles(df, {"x": F.col(latency)}, [0.5, 0.95, 0.99])["x"]
    cells = confusion_counts(F.col("y_true"), F.col("prediction"))
    base = df.agg(
        F.count(F.lit(1)).alias("total_flows"), F.count_if(F.col("prediction") == 1).alias("total_alerts"),
        ((F.max(time_us) - F.min(time_us)) / F.lit(1e6)).alias("_s"),
        *[c.alias(k) for k, c in cells.items()], F.avg(latency).alias("_mean"), F.max(latency).alias("_max"))
    scores = binary_scores()
    return base.select(
        "total_flows", "total_alerts", F.bround("_s", 2).alias("elapsed_seconds"),
        F.bround(safe_div(F.col("total_flows"), F.col("_s")), 1).alias("throughput_flows_per_sec"), *cells,
        *[F.bround(scores[k], 4).alias(k) for k in ("precision", "recall", "f1", "accuracy")],
        *[F.bround(F.lit(0.0 if q is None else q), 2).alias(f"{n}_ms") for n, q in zip(("p50", "p95", "p99"), found)],
        F.bround(F.coalesce("_mean", F.lit(0.0)), 2).alias("mean_ms"), F.bround(F.coalesce("_max", F.lit(0.0)), 2).alias("max_ms"))


def report_text(report: DataFrame) -> DataFrame:
    """The one-row report as readable text lines."""
    lines = [
        F.lit("RUN REPORT"),
        F.format_string("Total Flows Processed: %,d", "total_flows"),
        F.format_string("Total Alerts Generated: %,d", "total_alerts"),
        F.format_string("Elapsed Time: %.2f seconds", "elapsed_seconds"),
        F.format_string("Throughput: %.0f flows/sec", "throughput_flows_per_sec"),
        *[F.format_string(f"{n}: %.4f", n.lower()) for n in ("Precision", "Recall", "F1", "Accuracy")],
        F.format_string("Actual Benign: %,d benign, %,d attack", "true_negatives", "false_positives"),
        F.format_string("Actual Attack: %,d benign, %,d attack", "false_negatives", "true_positives"),
        *[F.format_string(f"{n} latency: %.2f ms", f"{n}_ms") for n in ("p50", "p95", "p99", "mean", "max")],
    ]
    return report.select(F.posexplode(F.array(*lines)).alias("line", "text"))


def scoring_summary(df: DataFrame) -> DataFrame:
    """Totals, attack share and mean confidence, both in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("total_flows"), F.count_if(F.col("prediction") == 0).alias("benign_count"),
        F.count_if(F.col("prediction") == 1).alias("attack_count"),
        (F.avg((F.col("prediction") == 1).cast("double")) * 100.0).alias("attack_rate"),
        (F.avg("confidence") * 100.0).alias("avg_confidence"))


def probability_histogram(df: DataFrame, probability: str = "probability", bins: int = 10) -> DataFrame:
    """Counts over equal bins of [0, 1]; the last bin is closed and empty bins appear."""
    p = F.col(probability)
    bin_no = F.least(F.floor(p * F.lit(bins)), F.lit(bins - 1)).cast("long")
    counts = df.where((p >= 0) & (p <= 1)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return edges.join(counts, "bin", "left").select(
        "bin", F.round(F.col("bin") / F.lit(float(bins)), 1).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("count"))


def analyzer_counters(df: DataFrame) -> DataFrame:
    """Live counters and rates."""
    total = F.count(F.lit(1))
    attack = F.count_if(F.col("prediction") == 1)
    base = F.greatest(total, F.lit(1))
    return df.agg(
        total.alias("total_predictions"), (total - attack).alias("benign_count"), attack.alias("attack_count"),
        ((total - attack) / base).alias("benign_rate"), (attack / base).alias("attack_rate"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everyone = Window.partitionBy()
    return per.select(label, "n", (F.sum("n").over(everyone) / (F.count(F.lit(1)).over(everyone) * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg(safe_div(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("scale_pos_weight"))
