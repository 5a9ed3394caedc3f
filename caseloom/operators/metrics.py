"""Exact classification metrics over a table with a 0/1 label and a score."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import safe_ratio
from caseloom.operators.ranking import running_totals

# Thresholds tried for the best F1; 80 doubles from 0.10 to 0.89.
THRESHOLDS = [float(t) for t in np.arange(0.1, 0.9, 0.01)]
CLASS_NAMES = ["Non-Serious", "Serious"]


def score_table(df: DataFrame, label: str = "serious", score: str = "score", by: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; rows without a label or score do not count."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    # -0.0 and 0.0 are one score.
    keys = [*([F.col(by)] if by else []), (F.lit(0.0) - F.col(score)).alias("descending")]
    positive = F.col(label).cast("bigint")
    return known.groupBy(*keys).agg(F.sum(positive).alias("positives"), F.sum(F.lit(1) - positive).alias("negatives"))


def score_curve(df: DataFrame, label: str = "serious", score: str = "score", by: str | None = None) -> DataFrame:
    """``score_table`` with the positives and negatives that score strictly higher."""
    return running_totals(score_table(df, label, score, by), "descending", ["positives", "negatives"], by)


def _area_under_roc() -> Column:
    positives, negatives = F.col("positives").cast("double"), F.col("negatives").cast("double")
    won = F.sum(negatives * (F.col("positives_before") + positives / 2))
    return F.try_divide(won, F.sum(positives) * F.sum(negatives))


def _average_precision() -> Column:
    found = (F.col("positives_before") + F.col("positives")).cast("double")
    seen = found + F.col("negatives_before") + F.col("negatives")
    return F.try_divide(F.sum(F.col("positives") * found / seen), F.sum(F.col("positives").cast("double")))


def ranking_metrics(df: DataFrame, label: str = "serious", score: str = "score", by: str | None = None) -> DataFrame:
    """Area under ROC (ties count half) and average precision; null when a class is missing.

    ``by`` is a column with few values, such as a fold number.
    """
    return (score_curve(df, label, score, by).groupBy(*([by] if by else []))
            .agg(_area_under_roc().alias("auc_roc"), _average_precision().alias("auc_pr")))


def _counts(threshold: float, score: Column) -> list[Column]:
    hit = score >= F.lit(float(threshold))
    return [F.coalesce(F.sum(F.when(hit, F.col("positives"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(hit, F.col("negatives"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(~hit, F.col("negatives"))), F.lit(0)).alias("tn"),
            F.coalesce(F.sum(F.when(~hit, F.col("positives"))), F.lit(0)).alias("fn")]


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "specificity": safe_ratio(tn, tn + fp),
    }


def confusion_metrics(df: DataFrame, label: str = "serious", score: str = "score",
                      threshold: float = 0.5) -> DataFrame:
    """Confusion counts and their rates at a threshold, in one pass."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    known = known.select(F.col(score).alias("score"), F.col(label).cast("bigint").alias("positives"),
                         (F.lit(1) - F.col(label).cast("bigint")).alias("negatives"))
    return known.agg(*_counts(threshold, F.col("score"))).withColumns(_rates())


def compute_metrics(df: DataFrame, label: str = "serious", score: str = "score",
                    threshold: float = 0.5, by: str | None = None) -> DataFrame:
    """All metrics in one row (one per ``by``), from one ordered table of scores."""
    group = [by] if by else []
    return (score_curve(df, label, score, by).groupBy(*group)
            .agg(_area_under_roc().alias("auc_roc"), _average_precision().alias("auc_pr"),
                 *_counts(threshold, F.lit(0.0) - F.col("descending")))
            .withColumns(_rates()).withColumn("threshold", F.lit(float(threshold)))
            .select(*group, "auc_roc", "auc_pr", "f1", "precision", "recall", "specificity", "threshold"))


def threshold_sweep(df: DataFrame, label: str = "serious", score: str = "score") -> DataFrame:
    """F1 at each of the tried thresholds.

    Rows fold to one count per number of thresholds reached; the running sums
    then run over at most 81 rows.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    last = len(THRESHOLDS) - 1
    # Nearest threshold, then an exact comparison with it.
    near = F.greatest(F.lit(0), F.least(F.lit(last), F.round((F.col(score) - 0.1) / 0.01).cast("int")))
    reached = near + (F.col(score) >= F.element_at(grid, near + 1)).cast("int")
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    positive = F.col(label).cast("bigint")
    folded = (known.select(reached.alias("reached"), positive.alias("p"))
              .groupBy("reached").agg(F.sum("p").alias("p"), F.sum(F.lit(1) - F.col("p")).alias("n")))
    # One row per threshold, also where no score falls between two of them.
    steps = df.sparkSession.range(len(THRESHOLDS) + 1).select(F.col("id").cast("int").alias("reached"))
    filled = steps.join(folded, "reached", "left").na.fill(0, ["p", "n"])
    upward = Window.partitionBy(F.lit(0)).orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(0))
    return (filled.select("reached", F.sum("p").over(upward).alias("tp"), F.sum("n").over(upward).alias("fp"),
                          F.sum("p").over(total).alias("_all"))
            .where("reached > 0")
            .select(F.element_at(grid, F.col("reached")).alias("threshold"), "tp", "fp",
                    (F.col("_all") - F.col("tp")).alias("fn"))
            .withColumn("f1", safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def best_threshold(df: DataFrame, label: str = "serious", score: str = "score") -> DataFrame:
    """The threshold with the highest F1, the lowest one among equals."""
    return threshold_sweep(df, label, score).select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


def class_report(df: DataFrame, label: str = "serious", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and the two averages."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        support.cast("bigint").alias("support"))

    p0, r0, f0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp), safe_ratio(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), safe_ratio(2 * tp, 2 * tp + fp + fn)
    n0, n1 = tn + fp, tp + fn

    def weighted(a: Column, b: Column) -> Column:
        return safe_ratio(a * n0 + b * n1, n0 + n1)

    lines = F.array(
        line(CLASS_NAMES[0], p0, r0, f0, n0),
        line(CLASS_NAMES[1], p1, r1, f1, n1),
        line("accuracy", F.lit(None), F.lit(None), safe_ratio(tp + tn, n0 + n1), n0 + n1),
        line("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n0 + n1),
    )
    return confusion_metrics(df, label, score, threshold).select(F.inline(lines))


def fold_summary(fold_scores: DataFrame, value: str = "auc_roc") -> DataFrame:
    """Mean, population standard deviation and the list of per-fold values."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda x: x[value])
    return fold_scores.agg(F.avg(value).alias("mean_auc"), F.stddev_pop(value).alias("std_auc"),
                           ordered.alias("fold_aucs"))


def log_loss(df: DataFrame, label: str = "serious", score: str = "score") -> DataFrame:
    """Mean cross-entropy; scores are kept 1e-15 away from 0 and 1."""
    p_true = F.when(F.col(label) == 1, F.col(score)).otherwise(1 - F.col(score))
    kept = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p_true))
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.agg(F.avg(-F.ln(kept)).alias("log_loss"))
