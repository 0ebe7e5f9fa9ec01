"""The whole evaluation of a case: its tables for all scopes, and the payload of overall figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import similarity
from ..tables import to_table

# Columns whose mixing among neighbours is looked at.
BATCHES = ("batch", "batch_id", "case_id", "slide_id", "patient_id", "stain", "scanner", "platform")
#: Neighbours of the metrics by label and by batch.
KS, K_BATCH = (1, 5), 5


def evaluate(rows: DataFrame, predictions: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    """The six tables of an evaluation, ordered by scope.

    ``rows`` has id, split, the vectors vec, a (image) and b (genes), and whatever label and batch
    columns there are; labels that don't tell rows apart get no metrics.  Neighbours are found
    once and serve all metrics.
    """
    labels = M.label_columns(rows)
    batches = [c for c in BATCHES if c in rows.columns]
    scoped = M.scopes(rows)
    knn = to_table(similarity.knn(scoped, max(*KS, K_BATCH)), "evaluation-knn") if labels or batches else None
    of = lambda df, name, column: df.withColumn(name, F.lit(column))

    def union(parts: list[DataFrame], empty: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], empty)

    return {
        "prediction_summary": M.prediction_summary(predictions).orderBy("split"),
        "retrieval_metrics": M.scope_order(M.retrieval(scoped, KS), "k"),
        "embedding_qc": M.scope_order(union([of(M.silhouette(scoped, c), "label_column", c) for c in labels], "scope string, n_regions long, n_labels long, silhouette double, label_column string"), "label_column"),
        "label_retrieval_metrics": M.scope_order(union([of(M.same_label_hit(scoped, c, KS, knn), "label_column", c) for c in labels], "scope string, k long, effective_k long, n_regions long, same_label_recall double, label_column string"), "label_column", "k"),
        "batch_mixing_metrics": M.scope_order(union([of(M.batch_mixing(scoped, c, K_BATCH, knn), "batch_column", c) for c in batches], "scope string, k long, effective_k long, n_regions long, batch_mixing_entropy double, batch_column string"), "batch_column"),
        "failure_analysis": M.scope_order(failures, "category", "metric", scope="split"),
    }


def payload(tables: dict[str, DataFrame], about: dict | None = None) -> dict:
    """Rows of each table, and all its rows of ``overall`` but for failures; ``about`` is carried along."""
    out = dict(about or {})
    for name, df in tables.items():
        out[f"n_{name}_rows"] = df.count()
        if name != "failure_analysis":
            scope = "scope" if "scope" in df.columns else "split"
            rows = [r.asDict() for r in df.where(F.col(scope) == "overall").collect()]  # a few for each label and k
            out[f"overall_{name}"] = (rows[0] if rows else {}) if name == "prediction_summary" else rows
    return out
