"""Boosted trees on the tabular features, as models of Spark ML."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.commits import current_version, save_version
from caseloom.config import FEATURES, TreeSettings
from caseloom.functions.numbers import at_least
from caseloom.operators.cases import union_quarters
from caseloom.operators.metrics import fold_summary, ranking_metrics
from caseloom.operators.ranking import running_totals
from caseloom.operators.treegrowth import BINS, Part, Tree, grow_here, grow_over, nodes_of
from caseloom.session import materialize, new_path, remove_path, remove_table

# Functions used inside tasks travel with them, so the cluster need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# A model of no more rows is grown in one task, so are the models of all folds side by side;
# about as many rows are a part of a larger fit.
ROWS_IN_A_TASK, ROWS_IN_A_PART = 1 << 18, 1 << 19
# Held-out fold of a model that sees all rows; folds count from 0.
NONE, NO_FOLD = -2, -1


def fit_trees(train: DataFrame, settings: TreeSettings = TreeSettings(), features: Sequence[str] = FEATURES,
              label: str = "serious") -> PipelineModel:
    """Fit on the ``features`` columns; ``train`` is best a written table."""
    return _fit_models(train.withColumn("fold", F.lit(NO_FOLD)), [NONE], settings, features, label)[0]


def _fit_models(df: DataFrame, held: Sequence[int], settings: TreeSettings, features: Sequence[str], label: str) -> list[PipelineModel]:
    """One model for each fold held out, as Spark ML's ``GBTClassifier`` fits them (``treegrowth``), all on the same bins.

    Rows are drawn by the hash of ``primaryid``, if there is one, else of their values.
    """
    spark = df.sparkSession
    own = "primaryid" if "primaryid" in df.columns else None
    values = [F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
    known = df.where(F.col(label).isNotNull()).select(
        *values, F.col(label).cast("int").alias("label"), F.coalesce("fold", F.lit(NO_FOLD)).alias("fold"),
        F.xxhash64(*([own] if own else [*features, label])).alias("draw"))
    cuts = _cuts(known, len(features))
    binned = materialize(known.mapInArrow(_binning(cuts), "bins binary, label int, fold int, draw bigint"), "bins")
    rows = binned.count()
    if rows <= ROWS_IN_A_TASK:
        # The rows of each model are a partition of their own.
        each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(fold).alias("held")) for m, fold in enumerate(held)]))
        dealt = binned.select("*", each).where("fold <> held").repartitionById(len(held), F.col("model"))
        nodes = dealt.mapInArrow(_growth(cuts, settings), _NODES).toArrow()
    else:
        parts = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_IN_A_PART))
        packed = binned.repartition(parts).mapInArrow(_packing, "bins binary, label binary, fold binary, draw binary").rdd
        kinds, width, models = (("label", np.int32), ("fold", np.int32), ("draw", np.int64)), len(features), len(held)
        state = packed.map(lambda r: _part(r["bins"], *[np.frombuffer(r[c], kind) for c, kind in kinds], width, models).arrays())
        grown = grow_over(state, held, len(features), settings, lambda path: remove_path(spark, path))
        nodes = pa.Table.from_batches([_node_batch(m, trees, cuts) for m, trees in enumerate(grown)])
    remove_table(binned)
    if len(pc.unique(nodes["model"])) < len(held):
        raise ValueError("no labelled rows to fit trees on")
    assembler = VectorAssembler(inputCols=list(features), outputCol="tree_features")
    saved = _template(spark, settings, len(features), label)

    # Jobs of the threads keep the caller's job group and properties.
    @inheritable_thread_target(spark)
    def loaded(model: int) -> PipelineModel:
        return PipelineModel([assembler, _loaded(spark, saved, nodes.filter(pc.equal(nodes["model"], model)), settings, len(features))])

    with ThreadPool(min(5, len(held))) as pool:
        fitted = pool.map(loaded, range(len(held)))
    remove_path(spark, saved)
    return fitted


def _cuts(known: DataFrame, features: int) -> list[np.ndarray]:
    """Thresholds of each feature, between neighbouring distinct values: all of a feature with few, else those nearest to even bins.

    Counts of distinct values are a written table, so no order of all rows is needed.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"_{i}").alias("value")) for i in range(features)])
    counted = materialize(known.select(F.inline(cells)).groupBy("feature", "value").agg(F.count("*").alias("_n")), "values")
    sizes = {r["feature"]: r for r in counted.groupBy("feature").agg(
        F.count("*").alias("distinct"), F.sum("_n").alias("n"),
        F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).alias("missing")).collect()}
    if not sizes:
        raise ValueError("no labelled rows to fit trees on")
    if any(r["missing"] for r in sizes.values()):
        raise ValueError("a feature holds null or NaN")
    bins = min(BINS, sizes[0]["n"])
    many = [i for i, r in sizes.items() if r["distinct"] > bins]
    last = {}
    if many:
        # The last value of each bin: the running count passes a multiple of the bin's size.
        upto = F.col("_n_before") + F.col("_n")
        ends = running_totals(counted.where(F.col("feature").isin(many)), "value", ["_n"], by="feature").where(
            (F.floor(upto * bins / F.col("_n_all")) > F.floor(F.col("_n_before") * bins / F.col("_n_all"))) & (upto < F.col("_n_all")))
        for r in ends.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values")).collect():
            last[r["feature"]] = r["values"]
    # First and last value of each bin; features of few values have a bin for each.
    bin_of = F.coalesce(*[F.when(F.col("feature") == i, F.size(F.filter(F.lit(ends), lambda c: c < F.col("value"))).cast("double"))
                          for i, ends in last.items()], F.col("value"))
    found = counted.groupBy("feature", bin_of.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high")).toArrow().to_pandas()
    remove_table(counted)
    cuts = []
    for i in range(features):
        own = found[found["feature"] == i].sort_values("low")
        cuts.append((own["high"].to_numpy()[:-1] + own["low"].to_numpy()[1:]) / 2)
    return cuts


def _binning(cuts: Sequence[np.ndarray]) -> Callable:
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = np.empty((n, len(cuts)), np.uint8)
            for i, own in enumerate(cuts):
                codes[:, i] = np.searchsorted(own, batch.column(i).to_numpy(zero_copy_only=False), side="left")
            ends = pa.array(np.arange(0, (n + 1) * len(cuts), len(cuts), dtype=np.int32))
            cells = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([cells, *[batch.column(c) for c in ("label", "fold", "draw")]], ["bins", "label", "fold", "draw"])

    return binned


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[bytes, list[np.ndarray], pa.Table]:
    """Bins, row by row, and the numbers of all rows, with the rows themselves."""
    table = pa.Table.from_batches(batches)
    return b"".join(table["bins"].to_pylist()), [table[c].to_numpy() for c in ("label", "fold", "draw")], table


def _part(codes: bytes, label: np.ndarray, fold: np.ndarray, draw: np.ndarray, features: int, models: int) -> Part:
    bins = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(-1, features).T)
    return Part(bins, np.where(label > 0, 1.0, -1.0), draw.astype(np.int64).view(np.uint64), fold.astype(np.int32), np.zeros((models, len(label))))


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one row."""
    kept = [b for b in batches if b.num_rows]
    if kept:
        codes, (label, fold, draw), _ = _columns(kept)
        cells = [codes, label.astype(np.int32).tobytes(), fold.astype(np.int32).tobytes(), draw.astype(np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["bins", "label", "fold", "draw"])


_NODES = ("model int, tree int, id int, prediction double, impurity double, n double, total double, squares double, gain double, "
          "left int, right int, feature int, threshold double")


def _node_batch(model: int, trees: Sequence[Tree], cuts: Sequence[np.ndarray]) -> pa.RecordBatch:
    tables = [{"model": np.full(len(t["id"]), model), "tree": np.full(len(t["id"]), i), **t}
              for i, t in enumerate(nodes_of(tree, cuts) for tree in trees)]
    kinds = [part.strip().split(" ") for part in _NODES.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([t[c] for t in tables]), pa.int32() if kind == "int" else pa.float64(), safe=False)
                                       for c, kind in kinds], [c for c, _ in kinds])


def _growth(cuts: Sequence[np.ndarray], settings: TreeSettings) -> Callable:
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            codes, columns, table = _columns(kept)
            trees = grow_here(_part(codes, *columns, len(cuts), 1), NONE, settings)
            yield _node_batch(table["model"][0].as_py(), trees, cuts)

    return grown


def _template(spark: SparkSession, settings: TreeSettings, features: int, label: str) -> str:
    """Folder of a saved model of one tree with all settings, by Spark ML's own fit of two rows."""
    trees = GBTClassifier(
        labelCol=label, featuresCol="tree_features", predictionCol="tree_class",
        maxIter=1, maxDepth=settings.depth, stepSize=settings.rate,
        subsamplingRate=settings.row_share, featureSubsetStrategy=str(settings.feature_share), seed=settings.seed)
    trees = trees.setProbabilityCol("tree_probability").setRawPredictionCol("tree_raw").setSubsamplingRate(1.0)
    rows = spark.createDataFrame([(y, Vectors.dense([float(y)] * features)) for y in (0, 1)], T.StructType(
        [T.StructField(label, T.IntegerType()), T.StructField("tree_features", VectorUDT())]))
    path = new_path(spark, "template")
    trees.fit(rows).write().save(path)
    return path


def _loaded(spark: SparkSession, saved: str, nodes: pa.Table, settings: TreeSettings, features: int) -> GBTClassificationModel:
    """A model of ``nodes``, written in the form Spark ML saves models in, with the settings of the ``saved`` one."""
    path = new_path(spark, "grown")
    says = json.loads(spark.read.text(f"{saved}/metadata").first()[0])
    says["paramMap"] |= {"maxIter": settings.trees, "subsamplingRate": settings.row_share}
    says |= {"numFeatures": features, "numTrees": settings.trees, "uid": f"{says['uid']}{uuid.uuid4().hex[:8]}"}
    spark.createDataFrame([(json.dumps(says),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = spark.read.parquet(f"{saved}/treesMetadata")
    about = weights.first()
    spark.createDataFrame([(i, about[1], settings.rate if i else 1.0) for i in range(settings.trees)], weights.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    cells = nodes.to_pydict()
    struct = [{"id": i, "prediction": p, "impurity": im, "impurityStats": [n, s, q], "rawCount": int(n), "gain": g, "leftChild": lc, "rightChild": rc,
               "split": {"featureIndex": f, "leftCategoriesOrThreshold": [t] if f >= 0 else [], "numCategories": -1}}
              for i, p, im, n, s, q, g, lc, rc, f, t in zip(*[cells[c] for c in ("id", "prediction", "impurity", "n", "total", "squares", "gain", "left", "right", "feature", "threshold")])]
    shape = spark.read.parquet(f"{saved}/data").schema
    table = pa.table({"treeID": pa.array(cells["tree"], pa.int32()), "nodeData": pa.array(struct, to_arrow_type(shape["nodeData"].dataType))})
    spark.createDataFrame(table, shape).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    remove_path(spark, path)
    return model


def ensemble(model: PipelineModel) -> GBTClassificationModel:
    return next(stage for stage in model.stages if isinstance(stage, GBTClassificationModel))


def predict_proba(model: PipelineModel, df: DataFrame, name: str = "tree_proba") -> DataFrame:
    """Add the probability of the serious class."""
    return (model.transform(df).withColumn(name, vector_to_array("tree_probability")[1])
            .drop("tree_features", "tree_raw", "tree_probability", "tree_class"))


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the probability and the 0/1 class at ``threshold``."""
    return predict_proba(model, df).withColumn("predicted", at_least(F.col("tree_proba"), threshold))


def fit_report(model: PipelineModel, train: DataFrame, validation: DataFrame | None = None,
               label: str = "serious") -> DataFrame:
    """AUC on the training rows and, if given, on the validation rows."""
    parts = [("train", train)] + ([("validation", validation)] if validation is not None else [])
    scored = [predict_proba(model, rows).select(label, "tree_proba", F.lit(name).alias("part")) for name, rows in parts]
    return ranking_metrics(union_quarters(scored), label, "tree_proba", by="part").select("part", "auc_roc")


def out_of_fold(df: DataFrame, settings: TreeSettings = TreeSettings(), folds: int = 5,
                features: Sequence[str] = FEATURES, label: str = "serious") -> DataFrame:
    """Score every row by a model that did not see its fold.

    ``df`` is a written table with ``fold``. The models are fitted side by side.
    """
    models = _fit_models(df, range(folds), settings, features, label)
    return union_quarters([predict_proba(model, df.where(F.col("fold") == fold))
                           for fold, model in enumerate(models)])


def cross_validate(scored: DataFrame, label: str = "serious") -> tuple[DataFrame, DataFrame]:
    """AUC per fold of out-of-fold scores, and their summary."""
    per_fold = ranking_metrics(scored, label, "tree_proba", by="fold").select("fold", "auc_roc")
    return per_fold, fold_summary(per_fold)


def feature_importance(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Normalized gain per feature, highest first."""
    gains = ensemble(model).featureImportances.toArray()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    rows = [(name, float(gain)) for name, gain in zip(features, gains)]
    return SparkSession.active().createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def save_trees(model: PipelineModel, folder: str, keep: int = 3) -> int:
    """Save as a new version below ``folder``; its number. A save that breaks leaves the last one."""
    return save_version(SparkSession.active(), folder, lambda path: model.write().save(path), keep)


def load_trees(spark: SparkSession, folder: str) -> PipelineModel:
    """The newest version ``save_trees`` wrote."""
    return PipelineModel.load(current_version(spark, folder))
