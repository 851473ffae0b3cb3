"""Classifier evaluation on a scored table.

Input: a DataFrame with a label, a predicted class and (for AUC / curves) a
score.  Everything reduces to the (label, prediction) count table or to the
distinct-score table, both aggregated before any global ordering.  Curves
use the two-level running sum from ``plans.ordering``; neighbouring curve
points are compared through an equi-join on the point index, never through
an unpartitioned ``lag`` window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.ordering import running_totals


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- #94
def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) for every occurring pair."""
    return (scored.groupBy(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Wide confusion matrix: one row per true class, one column per predicted class, zero-filled."""
    cc = confusion_counts(scored, label, prediction)
    return cc.groupBy("label").pivot("prediction").agg(F.sum("count")).na.fill(0).orderBy("label")


# ---------------------------------------------------------------- #95
def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support, plus ``macro avg`` and ``weighted avg`` rows.

    Undefined ratios (no predictions of a class) are 0, as in the usual report.
    """
    cc = confusion_counts(scored, label, prediction)
    tp = cc.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    sup = cc.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    pred = cc.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    per = (sup.join(pred, "cls", "full").join(tp, "cls", "left")
           .na.fill(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select(F.col("cls").cast("string").alias("class"), prec.alias("precision"), rec.alias("recall"),
                     F.col("support").cast("long").alias("support"))
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    per = per.withColumn("f1", f1)
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), tot.alias("support"), F.avg("f1").alias("f1"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"), tot.alias("support"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------- #93
def _score_counts(scored: DataFrame, label: str, score: str | Column, positive: float) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    s = _c(score).cast("double")
    y = (F.col(label).cast("double") == F.lit(float(positive))).cast("long")
    return scored.where(s.isNotNull()).groupBy(s.alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(scored: DataFrame, label: str = "label", score: str | Column = "score", positive: float = 1.0) -> DataFrame:
    """Exact ROC AUC by the rank-sum (Mann–Whitney) identity with mid-ranks for tied scores."""
    sc = _score_counts(scored, label, score, positive).withColumn("w", F.col("pos") + F.col("neg"))
    rt = running_totals(sc, "score", ["w"])
    mid = F.col("w_cum") - (F.col("w") - 1) / 2.0
    agg = rt.agg(F.sum(F.col("pos") * mid).alias("rank_sum"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    npos, nneg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = (F.col("rank_sum") - npos * (npos + 1) / 2) / (npos * nneg)
    return agg.select(F.when((npos > 0) & (nneg > 0), auc).alias("roc_auc"))


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | Column | None = None, positive: float = 1.0) -> DataFrame:
    """Accuracy, weighted precision / recall / F1 and (if a score is given) ROC AUC, as one row."""
    rep = classification_report(scored, label, prediction)
    w = rep.where(F.col("class") == "weighted avg").select(
        F.col("precision").alias("precision"), F.col("recall").alias("recall"), F.col("f1").alias("f1_score"))
    acc = scored.agg((F.sum((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("long"))
                      / F.count(F.lit(1))).alias("accuracy"))
    parts = [acc, w]
    if score is not None:
        parts.append(roc_auc(scored, label, score, positive))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = ["accuracy", "precision", "recall", "f1_score"] + (["roc_auc"] if score is not None else [])
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


# ---------------------------------------------------------------- #96, #97
def _cumulative(scored: DataFrame, label: str, score: str | Column, positive: float) -> DataFrame:
    """Per distinct score in descending order: cumulative tps/fps, index, and totals."""
    sc = _score_counts(scored, label, score, positive).withColumn("one", F.lit(1))
    rt = running_totals(sc, "score", ["pos", "neg", "one"], descending=True)
    return rt.select("score", F.col("pos_cum").alias("tps"), F.col("neg_cum").alias("fps"),
                     (F.col("one_cum") - 1).alias("idx"), F.col("pos_total").alias("P"), F.col("neg_total").alias("N"))


def roc_curve(scored: DataFrame, label: str = "label", score: str | Column = "score", positive: float = 1.0,
              drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) with a leading (0, 0, +inf) point; collinear interior points dropped."""
    cum = _cumulative(scored, label, score, positive)
    if drop_intermediate:
        prev = cum.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp_prev"), F.col("fps").alias("fp_prev"))
        nxt = cum.select((F.col("idx") - 1).alias("idx"), F.col("tps").alias("tp_next"), F.col("fps").alias("fp_next"))
        j = cum.join(prev, "idx", "left").join(nxt, "idx", "left")
        keep = (F.col("tp_prev").isNull() | F.col("tp_next").isNull()
                | ((F.col("fp_next") - 2 * F.col("fps") + F.col("fp_prev")) != 0)
                | ((F.col("tp_next") - 2 * F.col("tps") + F.col("tp_prev")) != 0))
        cum = j.where(keep).select(*cum.columns)
    pts = cum.select((F.col("fps") / F.col("N")).alias("fpr"), (F.col("tps") / F.col("P")).alias("tpr"),
                     F.col("score").alias("threshold"), (F.col("idx") + 1).alias("point"))
    origin = cum.where(F.col("idx") == 0).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                                 F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("point"))
    return origin.unionByName(pts)


def precision_recall_curve(scored: DataFrame, label: str = "label", score: str | Column = "score",
                           positive: float = 1.0) -> DataFrame:
    """(precision, recall, threshold) from the highest threshold down to the first reaching full recall,
    plus the final (precision 1, recall 0, NULL threshold) point."""
    cum = _cumulative(scored, label, score, positive)
    # keep every point before full recall and the first point that reaches it (equi-join on the index)
    prev = cum.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp_prev"))
    kept = cum.join(prev, "idx", "left").where(
        (F.col("tps") < F.col("P")) | F.col("tp_prev").isNull() | (F.col("tp_prev") < F.col("P")))
    pts = kept.select((F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
                      (F.col("tps") / F.col("P")).alias("recall"), F.col("score").alias("threshold"))
    final = cum.where(F.col("idx") == 0).select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                                                F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(final)


# ---------------------------------------------------------------- #100–#102
def best_model(metrics: DataFrame, metric: str = "accuracy", model: str = "model", order: str = "model_order") -> DataFrame:
    """The model with the highest ``metric``; ties go to the earlier model (strict >)."""
    return metrics.orderBy(F.col(metric).desc(), F.col(order).asc()).limit(1).select(model, metric)


def model_comparison(metrics_long: DataFrame) -> DataFrame:
    """Per metric: best model (earliest on ties), best, mean and population sd of the scores."""
    key = F.struct(F.col("score"), -F.col("model_order"))
    return metrics_long.groupBy("metric").agg(
        F.max_by("model", key).alias("best_model"), F.max("score").alias("best_score"),
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def recommendations(metrics: DataFrame, model: str = "model", order: str = "model_order") -> DataFrame:
    """Best model for accuracy, F1, AUC and balanced = (accuracy + F1) / 2."""
    crit = {"best_accuracy": F.col("accuracy"), "best_f1": F.col("f1_score"),
            "best_auc": F.col("roc_auc"), "best_balanced": (F.col("accuracy") + F.col("f1_score")) / 2}
    recs = F.array(*[F.struct(F.lit(k).alias("criterion"), v.cast("double").alias("score")) for k, v in crit.items()])
    long = metrics.select(model, order, F.explode(recs).alias("r")).select(model, order, "r.criterion", "r.score")
    long = long.where(F.col("score").isNotNull())
    key = F.struct(F.col("score"), -F.col(order))
    return long.groupBy("criterion").agg(F.max_by(model, key).alias("model"), F.max("score").alias("score"))


def metrics_long(metrics: DataFrame, model: str = "model", order: str = "model_order",
                 cols: Sequence[str] = ("accuracy", "precision", "recall", "f1_score", "roc_auc")) -> DataFrame:
    present = [c for c in cols if c in metrics.columns]
    return (metrics.select(model, order, *[F.col(c).cast("double").alias(c) for c in present])
            .unpivot([model, order], present, "metric", "score").where(F.col("score").isNotNull())
            .withColumnRenamed(model, "model").withColumnRenamed(order, "model_order"))

