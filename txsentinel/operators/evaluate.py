"""Distributed evaluation of score tables.

A score table is long: (tx_id, model, label, score, prediction), one row per
transaction and model.  All metrics are grouped by ``model``; curve metrics
start from ``cumulative_counts`` (W7), which pre-aggregates to one row per
(model, distinct score) and ranks those rows over range partitions, so no
model's scores are gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.operators import ordered
from txsentinel.session import materialize
from txsentinel.schema import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE

EPS_F1 = 1e-10  # fixed value: denominator guard of the optimal-threshold F1


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def flag_scores(scores: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """prediction = score > t (strict) or score >= t."""
    cond = F.col("score") > threshold if strict else F.col("score") >= threshold
    return scores.withColumn("prediction", F.when(cond, 1).otherwise(0))


def confusion_counts(scores: DataFrame) -> DataFrame:
    """TN, FP, FN, TP per model (always four counts, also for one class)."""
    lab, pred = F.col("label"), F.col("prediction")
    return scores.groupBy("model").agg(
        F.count_if((lab == 0) & (pred == 0)).alias("true_negatives"),
        F.count_if((lab == 0) & (pred == 1)).alias("false_positives"),
        F.count_if((lab == 1) & (pred == 0)).alias("false_negatives"),
        F.count_if((lab == 1) & (pred == 1)).alias("true_positives"),
    )


def classification_metrics(scores: DataFrame,
                           cost_fn: float = COST_FALSE_NEGATIVE,
                           cost_fp: float = COST_FALSE_POSITIVE) -> DataFrame:
    """V1 + V2: accuracy, precision, recall, F1 (0 when undefined), total cost."""
    return metrics_of(confusion_counts(scores), cost_fn, cost_fp)


def counted_confusion(counts: DataFrame) -> DataFrame:
    """A7 from rows that carry their number ``n``."""
    def cell(label, prediction):
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    return counts.groupBy("model").agg(
        cell(0, 0).alias("true_negatives"), cell(0, 1).alias("false_positives"),
        cell(1, 0).alias("false_negatives"), cell(1, 1).alias("true_positives"))


def metrics_of(confusion: DataFrame, cost_fn: float = COST_FALSE_NEGATIVE,
               cost_fp: float = COST_FALSE_POSITIVE) -> DataFrame:
    """V1 + V2 from the four counts per model."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    return confusion.select(
        "model",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "true_positives", "false_positives", "true_negatives", "false_negatives",
        (fn.cast("double") * F.lit(float(cost_fn)) + fp.cast("double") * F.lit(float(cost_fp))
         ).alias("total_cost"),
    )


def financial_cost(scores: DataFrame, cost_fn: float = COST_FALSE_NEGATIVE,
                   cost_fp: float = COST_FALSE_POSITIVE) -> DataFrame:
    """V2: FN * cost_fn + FP * cost_fp per model."""
    return classification_metrics(scores, cost_fn, cost_fp).select(
        "model", "false_negatives", "false_positives", "total_cost")


def cumulative_counts(scores: DataFrame, num_partitions: int | None = None,
                      method: str = "ranged") -> DataFrame:
    """Per model and distinct score (descending), counts of rows with
    score >= that score: tp, fp; plus pos/neg at the score and class totals.

    Rows are first pre-aggregated to one per (model, distinct score).
    method='ranged' ranks them with ``ordered.running_totals`` (range
    partitions, no model gathered into one task); method='window' uses a
    window per model, for scores with few distinct values.
    """
    per_score = (scores.where(F.col("score").isNotNull())
                 .groupBy("model", "score")
                 .agg(F.sum(F.col("label").cast("long")).alias("pos"),
                      F.sum((1 - F.col("label")).cast("long")).alias("neg")))
    return ranked_counts(per_score, num_partitions, method)


def ranked_counts(per_score: DataFrame, num_partitions: int | None = None,
                  method: str = "ranged") -> DataFrame:
    """W7 from one row per model and distinct score (see ``cumulative_counts``)."""
    if method == "window":
        w = Window.partitionBy("model").orderBy(F.col("score").desc())
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy("model")
        return per_score.select(
            "model", "score", "pos", "neg",
            F.sum("pos").over(run).alias("tp"), F.sum("neg").over(run).alias("fp"),
            F.sum("pos").over(every).alias("n_pos"), F.sum("neg").over(every).alias("n_neg"))
    ranked = ordered.running_totals(per_score, [F.col("score").desc()],
                                    {"tp": "pos", "fp": "neg"}, ["model"],
                                    group_totals=True, num_partitions=num_partitions)
    return (ranked.withColumnRenamed("tp_total", "n_pos")
            .withColumnRenamed("fp_total", "n_neg"))


def auc_scores(curve: DataFrame) -> DataFrame:
    """V3 + V4 from W7: AUC-ROC (trapezoids, ties as one step) and average
    precision sum((R_i - R_{i-1}) * P_i).  NULL when a class is absent."""
    tp, fp = F.col("tp"), F.col("fp")
    pos, neg = F.col("pos"), F.col("neg")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    auc_term = neg.cast("double") * (2 * tp - pos).cast("double")
    ap_term = pos.cast("double") * tp.cast("double") / (tp + fp).cast("double")
    g = curve.groupBy("model").agg(
        F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"),
        F.max(n_pos).alias("_p"), F.max(n_neg).alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return g.select(
        "model",
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_auc") / (2.0 * p * n)).alias("auc_roc"),
        F.when(F.col("_p") > 0, F.col("_ap") / p).alias("auc_pr"),
    )


def pr_curve(curve: DataFrame) -> DataFrame:
    """V7: (model, threshold, precision, recall) per distinct score, plus the
    closing point (precision 1, recall 0, threshold NULL)."""
    tp, fp, n_pos = F.col("tp"), F.col("fp"), F.col("n_pos")
    pts = curve.select(
        "model", F.col("score").alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"),
        F.when(n_pos == 0, F.lit(1.0)).otherwise(_ratio(tp, n_pos)).alias("recall"))
    end = curve.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def roc_curve(curve: DataFrame) -> DataFrame:
    """V8: (model, threshold, fpr, tpr) per distinct score plus the (0, 0) start."""
    pts = curve.select(
        "model", F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    start = curve.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """V5 + W8: threshold maximising F1 = 2PR/(P+R+1e-10) over every distinct
    score (flag = score >= threshold); ties go to the lowest threshold."""
    tp, fp, n_pos = F.col("tp"), F.col("fp"), F.col("n_pos")
    prec = _ratio(tp, tp + fp)
    rec = F.when(n_pos == 0, F.lit(1.0)).otherwise(_ratio(tp, n_pos))
    pts = curve.select("model", "score", prec.alias("p"), rec.alias("r"))
    pts = pts.withColumn("f1", F.lit(2.0) * (F.col("p") * F.col("r"))
                         / (F.col("p") + F.col("r") + F.lit(EPS_F1)))
    best = pts.groupBy("model").agg(F.max_by(
        F.struct("score", "f1", "p", "r"), F.struct(F.col("f1"), -F.col("score"))).alias("b"))
    return best.select(
        "model", F.col("b.score").alias("optimal_threshold"),
        F.col("b.f1").alias("f1_at_optimal"),
        F.col("b.p").alias("precision_at_optimal"),
        F.col("b.r").alias("recall_at_optimal"))


def score_quantile(scores: DataFrame, q: float = 0.95, name: str = "threshold",
                   num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentile of the scores per model."""
    return ordered.exact_quantiles(scores, "score", {name: q}, ["model"],
                                   num_partitions=num_partitions)


def _grid_point(j: Column, lo: Column, hi: Column, width: Column, n: int) -> Column:
    """Grid threshold j: lo + j*width, with the last point exactly hi."""
    return F.when(j >= n, hi).otherwise(lo + j * width)


def _grid_index(value: Column, lo: Column, hi: Column, width: Column, n: int) -> Column:
    """Largest j in [0, n] with grid point j <= value.

    The floor is corrected by one step either way so that the index agrees
    with direct comparisons against the grid points.
    """
    raw = F.floor((value - lo) / width)
    b = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    b = F.when(value >= _grid_point(b + 1, lo, hi, width, n), b + 1).otherwise(b)
    b = F.when((b > 0) & (value < _grid_point(b, lo, hi, width, n)), b - 1).otherwise(b)
    return F.when(width == 0, F.lit(n)).otherwise(b).cast("int")


def threshold_sweep(scores: DataFrame, steps: int = 200) -> DataFrame:
    """V6: thresholds min + j*(max-min)/steps, j = 0..steps (the last one is
    exactly max, like a slider's end); precision, recall and F1 of
    score >= threshold at each.

    Scores are bucketed onto the grid (one pass, partial aggregation); the
    per-model grid has steps+1 rows and the suffix sums run on that grid.
    """
    rng = scores.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"),
                                      F.sum(F.col("label").cast("long")).alias("n_pos"))
    rng = rng.withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(float(steps)))
    joined = scores.where(F.col("score").isNotNull()).join(rng, "model")
    hist = (joined.withColumn("j", _grid_index(F.col("score"), F.col("lo"), F.col("hi"), F.col("width"), steps))
            .groupBy("model", "j")
            .agg(F.sum(F.col("label").cast("long")).alias("pos"),
                 F.sum((1 - F.col("label")).cast("long")).alias("neg")))
    grid = rng.select("model", "lo", "hi", "width", "n_pos",
                      F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("j"))
    g = grid.join(hist, ["model", "j"], "left").fillna(0, ["pos", "neg"])
    suffix = Window.partitionBy("model").orderBy(F.col("j").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    g = g.select("model", "j", _grid_point(F.col("j"), F.col("lo"), F.col("hi"), F.col("width"),
                                           steps).alias("threshold"),
                 "n_pos", F.sum("pos").over(suffix).alias("tp"),
                 F.sum("neg").over(suffix).alias("fp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp")
    return g.select("model", "j", "threshold",
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_histogram(scores: DataFrame, bins: int = 80, value: str = "score",
                    group: str = "model", cls: str = "label") -> DataFrame:
    """Equal-width histogram of ``value`` per group and class over
    the group's [min, max] range; the max lands in the last bin."""
    rng = scores.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (scores.where(F.col(value).isNotNull()).join(rng, group)
            .withColumn("bin", b)
            .groupBy(group, cls, "bin")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.first("lo").alias("lo"), F.first("hi").alias("hi"))
            .select(group, cls, "bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
                     ).alias("bin_start"), "n"))


def confusion_long(scores: DataFrame) -> DataFrame:
    """V9: the 2x2 confusion matrix as (model, actual, predicted, n)."""
    return (scores.groupBy("model", F.col("label").alias("actual"),
                           F.col("prediction").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n"))
            .unionByName(_zero_cells(scores))
            .groupBy("model", "actual", "predicted").agg(F.sum("n").alias("n")))


def _zero_cells(scores: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"))
                                for a in (0, 1) for p in (0, 1)]))
    return (scores.select("model").distinct().select("model", cells.alias("c"))
            .select("model", "c.actual", "c.predicted", F.lit(0).cast("long").alias("n")))


def tournament(scores: DataFrame, cost_fn: float = COST_FALSE_NEGATIVE,
               cost_fp: float = COST_FALSE_POSITIVE,
               num_partitions: int | None = None) -> DataFrame:
    """One row per model with all metrics; ``rank`` 1 = best F1 (O3).

    The scores are read once: their counts by (model, score, label, prediction) are written, and
    both the confusion matrix and the curves come from them.

    The rank window runs over one row per model (bounded by the model count).
    """
    counts = materialize(
        scores.groupBy("model", "score", "label", "prediction").agg(F.count(F.lit(1)).alias("n")),
        "score-counts")
    m = metrics_of(counted_confusion(counts), cost_fn, cost_fp)
    per_score = (counts.where(F.col("score").isNotNull()).groupBy("model", "score")
                 .agg(F.sum(F.col("label").cast("long") * F.col("n")).alias("pos"),
                      F.sum((1 - F.col("label")).cast("long") * F.col("n")).alias("neg")))
    auc = auc_scores(ranked_counts(per_score, num_partitions))
    t = m.join(auc, "model", "left")
    rank = F.row_number().over(Window.orderBy(F.col("f1_score").desc(), F.col("model")))
    return t.select("model", "accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr",
                    "total_cost", rank.alias("rank"))


def winner(tournament_df: DataFrame) -> DataFrame:
    """O3: the first row of the tournament."""
    return tournament_df.where(F.col("rank") == 1)


def compare_thresholds(optimal: DataFrame) -> DataFrame:
    """Optimal thresholds of all models, ranked by F1 at the optimum."""
    rank = F.row_number().over(Window.orderBy(F.col("f1_at_optimal").desc(), F.col("model")))
    return optimal.withColumn("rank", rank)


QUALITY_METRICS = ["accuracy", "precision", "recall", "f1_score", "auc_roc"]


def metrics_long(tournament_df: DataFrame,
                 metrics: list[str] | None = None) -> DataFrame:
    """Melt to (model, metric, value)."""
    metrics = metrics or ["accuracy", "precision", "recall", "f1_score"]
    return tournament_df.select("model", *[F.col(m).cast("double") for m in metrics]).unpivot(
        "model", metrics, "metric", "value")


def best_per_metric(tournament_df: DataFrame) -> DataFrame:
    """Per metric and model, whether the value is the best one (max for
    quality metrics, min for total_cost)."""
    long = metrics_long(tournament_df, QUALITY_METRICS + ["total_cost"])
    w = Window.partitionBy("metric")
    best = F.when(F.col("metric") == "total_cost", F.min("value").over(w)).otherwise(
        F.max("value").over(w))
    return long.withColumn("is_best", (F.col("value") == best).cast("int"))
