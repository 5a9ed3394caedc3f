"""Trees as Spark ML grows them, in one task and over many, and the queries that fit them full-size."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from caseloom.config import TreeSettings
from caseloom.operators import boosting
from caseloom.plans import catalog
from caseloom.session import materialize

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Features of few values, a label that follows them; two rows have none."""
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).cast("double") for i, n in enumerate((7, 20, 30))]
    table = spark.range(3_000).select(F.col("id").alias("primaryid"), *[c.alias(n) for c, n in zip(x, NAMES)])
    risk = F.col("a") * 3 + F.when(F.col("b") > 10, F.col("c")).otherwise(30 - F.col("c")) + F.pmod(F.xxhash64("primaryid"), F.lit(16))
    return materialize(table.withColumn("serious", F.when(F.col("primaryid") >= 2, (risk > 33).cast("int"))), "rows")


def scores(model: PipelineModel, table) -> np.ndarray:
    return np.array([r[0] for r in boosting.predict_proba(model, table).orderBy("primaryid").select("tree_proba").collect()])


@pytest.mark.parametrize("trees", [1, 12])
def test_grown_as_spark_ml_grows_them(rows, trees):
    """Without draws of rows and features the models agree."""
    settings = TreeSettings(trees=trees, depth=4, rate=0.1, row_share=1.0, feature_share=1.0)
    plain = GBTClassifier(labelCol="serious", featuresCol="tree_features", predictionCol="tree_class",
                          maxIter=trees, maxDepth=4, stepSize=0.1)
    plain = plain.setProbabilityCol("tree_probability").setRawPredictionCol("tree_raw")
    assembler = VectorAssembler(inputCols=NAMES, outputCol="tree_features")
    expected = PipelineModel([assembler, plain.fit(assembler.transform(rows.where("serious is not null")))])
    grown = boosting.fit_trees(rows, settings, NAMES)
    assert np.allclose(scores(grown, rows), scores(expected, rows), atol=1e-6)
    theirs, ours = (boosting.ensemble(m).featureImportances.toArray() for m in (expected, grown))
    assert np.allclose(theirs, ours, atol=1e-6)
    assert boosting.ensemble(grown).getNumTrees == trees and boosting.ensemble(grown).getMaxIter() == trees


def test_one_task_or_many(rows, monkeypatch, tmp_path):
    """Rows in one task or in parts, in any order and with checkpoints between, give the same models, held-out folds too."""
    settings = TreeSettings(trees=6, depth=4)
    folded = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("primaryid", F.lit(9)), F.lit(3)).cast("int")), "folded")
    once = scores(boosting.fit_trees(rows, settings, NAMES), rows)
    held = boosting.out_of_fold(folded, settings, 3, NAMES).orderBy("primaryid").collect()
    monkeypatch.setattr(boosting, "ROWS_IN_A_TASK", 100)
    monkeypatch.setattr(boosting, "ROWS_IN_A_PART", 200)
    monkeypatch.setattr("caseloom.operators.treegrowth.KEPT", 2)
    assert (scores(boosting.fit_trees(rows.repartition(5), settings, NAMES), rows) == once).all()
    assert boosting.out_of_fold(folded, settings, 3, NAMES).orderBy("primaryid").collect() == held


def test_many_values(spark):
    """Bins hold about as many rows each, and thresholds lie between values that are there."""
    table = spark.range(5_000).select((F.col("id") * F.col("id")).cast("double").alias("_0"), (F.col("id") % 5).cast("double").alias("_1"))
    many, few = boosting._cuts(table, 2)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(many) == 31
    bins = np.bincount(np.searchsorted(many, np.arange(5_000.0) ** 2), minlength=32)
    assert bins.min() >= 155 and bins.max() <= 158
    assert not set(many) & set(np.arange(5_000.0) ** 2)


def test_missing_and_no_rows(rows):
    with pytest.raises(ValueError):
        boosting.fit_trees(rows.where("serious is null"), TreeSettings(trees=1), NAMES)
    with pytest.raises(ValueError):
        boosting.fit_trees(rows.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), TreeSettings(trees=1), NAMES)


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["tree_fit_report", "tree_importance", "tree_scores", "fusion_scores", "ablation_fit", "fusion_fit"])
def test_full_size_trees(spark, rows, monkeypatch, name):
    """F11 to F16: these queries grew 10 trees of 500."""
    def fit(cases, settings, *rest):
        assert settings == TreeSettings() and settings.trees == 500
        raise Fitted

    monkeypatch.setattr(catalog, "_training_table", lambda *a: rows.withColumn("is_train", F.lit(1)))
    monkeypatch.setattr(catalog, "_labelled", lambda *a, **k: rows)
    monkeypatch.setattr(catalog.boosting, "fit_trees", fit)
    monkeypatch.setattr(catalog, "train", fit)
    monkeypatch.setattr(catalog.training, "fusion_inputs", fit)
    with pytest.raises(Fitted):
        catalog.queries()[name](spark, "")
