"""Bindings for classifier evaluation (#93–#102, #119) on a scored table derived from the driver tables.

Scored table: ``labels`` joined to ``documents``; label = quality, score =
n_chars, prediction = n_chars above a threshold.  Several thresholds act as
competing "models" for the model-comparison operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import evaluate as V
from tabulon.operators import report as R
from tabulon.plans.registry import Query, register, table, union_all

THRESHOLDS = {"len_gt_1000": 1000, "len_gt_3000": 3000, "len_gt_10000": 10000}


def scored(s, d, threshold: int = 3000):
    j = table(s, d, "labels").join(table(s, d, "documents"), "doc_id")
    return j.select(F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("score"),
                    (F.col("n_chars") > threshold).cast("double").alias("prediction"))


def scored_sql(threshold: int = 3000) -> str:
    return f"""(SELECT CAST(quality AS DOUBLE) label, CAST(n_chars AS DOUBLE) score,
                       CAST(n_chars > {threshold} AS DOUBLE) prediction FROM labels JOIN documents USING (doc_id))"""


def report_sql(src: str) -> str:
    return f"""
WITH sc AS (SELECT * FROM {src}),
cc AS (SELECT label, prediction, count(*) c FROM sc GROUP BY ALL),
cls AS (SELECT label AS cls FROM cc UNION SELECT prediction FROM cc),
per AS (SELECT cls, coalesce((SELECT sum(c) FROM cc WHERE label = cls), 0) support,
               coalesce((SELECT sum(c) FROM cc WHERE prediction = cls), 0) predicted,
               coalesce((SELECT sum(c) FROM cc WHERE label = cls AND prediction = cls), 0) tp FROM cls),
pr AS (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END p,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END f1 FROM pr)"""


def metrics_sql(threshold: int) -> str:
    src = scored_sql(threshold)
    return report_sql(src) + f""",
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 r FROM sc
       WHERE score IS NOT NULL),
auc AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - np * (np + 1) / 2) / (np * nn) v
        FROM rk, (SELECT count(*) FILTER (WHERE label = 1) np, count(*) FILTER (WHERE label <> 1) nn FROM sc) GROUP BY np, nn)
SELECT (SELECT avg(CAST(label = prediction AS DOUBLE)) FROM sc) AS accuracy,
       sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
       sum(f1 * support) / sum(support) AS f1_score, (SELECT v FROM auc) AS roc_auc FROM f"""


MET_DBL = ("accuracy", "precision", "recall", "f1_score", "roc_auc")

register(Query("classification_metrics_labels",
               lambda s, d: V.classification_metrics(scored(s, d), score="score"),
               metrics_sql(3000), dbl=MET_DBL, operators=(93,)))

register(Query("confusion_counts_labels",
               lambda s, d: V.confusion_counts(scored(s, d)),
               f"SELECT label, prediction, count(*) AS count FROM {scored_sql()} GROUP BY ALL",
               dbl=("label", "prediction"), ints=("count",), operators=(94,)))

register(Query("confusion_matrix_labels",
               lambda s, d: V.confusion_matrix(scored(s, d)),
               f"""SELECT label, count(*) FILTER (WHERE prediction = 0.0) AS "0.0", count(*) FILTER (WHERE prediction = 1.0)
                   AS "1.0" FROM {scored_sql()} GROUP BY label""",
               dbl=("label",), ints=("0.0", "1.0"), operators=(94,)))

register(Query("classification_report_labels",
               lambda s, d: V.classification_report(scored(s, d)),
               report_sql(scored_sql()) + """
SELECT CAST(cls AS VARCHAR) AS class, p AS precision, r AS recall, support, f1 FROM f
UNION ALL SELECT 'macro avg', avg(p), avg(r), sum(support), avg(f1) FROM f
UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(support),
                 sum(f1 * support) / sum(support) FROM f""",
               dbl=("precision", "recall", "f1"), ints=("support",), operators=(95,)))


def _cum_sql() -> str:
    return f"""
WITH sc AS (SELECT * FROM {scored_sql()} WHERE score IS NOT NULL),
s AS (SELECT score, sum(CAST(label = 1 AS BIGINT)) pos, sum(CAST(label <> 1 AS BIGINT)) neg FROM sc GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tps,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) fps,
             row_number() OVER (ORDER BY score DESC) - 1 idx, sum(pos) OVER () P, sum(neg) OVER () N FROM s),
k AS (SELECT *, lag(tps) OVER (ORDER BY idx) tp_prev, lead(tps) OVER (ORDER BY idx) tp_next,
             lag(fps) OVER (ORDER BY idx) fp_prev, lead(fps) OVER (ORDER BY idx) fp_next FROM c)"""


register(Query("roc_curve_labels",
               lambda s, d: V.roc_curve(scored(s, d)),
               _cum_sql() + """
SELECT fps * 1.0 / N AS fpr, tps * 1.0 / P AS tpr, score AS threshold, idx + 1 AS point FROM k
WHERE tp_prev IS NULL OR tp_next IS NULL OR fp_next - 2 * fps + fp_prev <> 0 OR tp_next - 2 * tps + tp_prev <> 0
UNION ALL SELECT 0.0, 0.0, 'inf'::DOUBLE, 0""",
               dbl=("fpr", "tpr", "threshold"), ints=("point",), operators=(96,)))

register(Query("precision_recall_curve_labels",
               lambda s, d: V.precision_recall_curve(scored(s, d)),
               _cum_sql() + """
SELECT tps * 1.0 / (tps + fps) AS precision, tps * 1.0 / P AS recall, score AS threshold FROM k
WHERE tps < P OR tp_prev IS NULL OR tp_prev < P
UNION ALL SELECT 1.0, 0.0, NULL""",
               dbl=("precision", "recall", "threshold"), operators=(97,)))


def model_metrics(s, d):
    parts = []
    for i, (name, t) in enumerate(THRESHOLDS.items()):
        m = V.classification_metrics(scored(s, d, t), score="score")
        parts.append(m.select(F.lit(name).alias("model"), F.lit(i).alias("model_order"), *m.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MODEL_METRICS_SQL = "(" + union_all(
    f"SELECT '{name}' AS model, {i} AS model_order, * FROM ({metrics_sql(t)})"
    for i, (name, t) in enumerate(THRESHOLDS.items())) + ")"

register(Query("model_metrics_labels", model_metrics, f"SELECT * FROM {MODEL_METRICS_SQL}",
               dbl=MET_DBL, ints=("model_order",), operators=(6, 93)))

register(Query("best_model_accuracy_labels",
               lambda s, d: V.best_model(model_metrics(s, d), "accuracy"),
               f"SELECT model, accuracy FROM {MODEL_METRICS_SQL} ORDER BY accuracy DESC, model_order LIMIT 1",
               dbl=("accuracy",), operators=(100,)))

register(Query("model_comparison_labels",
               lambda s, d: V.model_comparison(V.metrics_long(model_metrics(s, d))),
               f"""WITH l AS (UNPIVOT {MODEL_METRICS_SQL} ON accuracy, precision, recall, f1_score, roc_auc
                              INTO NAME metric VALUE score)
                   SELECT metric, arg_max(model, score * 1000 - model_order) AS best_model, max(score) AS best_score,
                          avg(score) AS mean_score, stddev_pop(score) AS std_score FROM l GROUP BY metric""",
               dbl=("best_score", "mean_score", "std_score"), operators=(101,)))

register(Query("recommendations_labels",
               lambda s, d: V.recommendations(model_metrics(s, d)),
               f"""WITH m AS (SELECT * FROM {MODEL_METRICS_SQL}),
                   l AS (SELECT model, model_order, 'best_accuracy' criterion, accuracy score FROM m
                         UNION ALL SELECT model, model_order, 'best_f1', f1_score FROM m
                         UNION ALL SELECT model, model_order, 'best_auc', roc_auc FROM m
                         UNION ALL SELECT model, model_order, 'best_balanced', (accuracy + f1_score) / 2 FROM m)
                   SELECT criterion, arg_max(model, score * 1000 - model_order) AS model, max(score) AS score FROM l
                   WHERE score IS NOT NULL GROUP BY criterion""",
               dbl=("score",), operators=(102,)))

register(Query("metric_comparison_labels",
               lambda s, d: R.metric_comparison(model_metrics(s, d).drop("model_order")),
               f"""UNPIVOT (SELECT model, accuracy, precision, recall, f1_score, roc_auc FROM {MODEL_METRICS_SQL})
                   ON accuracy, precision, recall, f1_score, roc_auc INTO NAME metric VALUE score""",
               dbl=("score",), operators=(119,)))
