"""Trees, attributions, embedding, fusion, scoring in batch and as a stream."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from caseloom.config import FEATURES, FusionSettings, TreeSettings
from caseloom.operators import attribution, boosting, fusion, tokeninfluence
from caseloom.operators.features import fit_features, with_narrative
from caseloom.operators.splits import stratified_folds
from caseloom.plans.training import combined, frequencies, load_models, train
from caseloom.session import materialize
from caseloom.sources.requests import REQUEST_SCHEMA, read_request_stream
from caseloom.sources.synthetic import demo_cases
from caseloom.streaming.scoring import score_requests, start_scoring

TREES = TreeSettings(trees=5, depth=3)
FUSION = FusionSettings(iterations=(5, 15))


@pytest.fixture(scope="module")
def cases(spark):
    return materialize(demo_cases(spark, 1_500), "demo")


@pytest.fixture(scope="module")
def table(cases):
    return materialize(fit_features(cases).transform(cases), "features")


@pytest.fixture(scope="module")
def trees(table):
    return boosting.fit_trees(table, TREES)


@pytest.fixture(scope="module")
def models(cases):
    return train(cases, TREES, FUSION, folds=3)


def test_two_rows_are_enough(two_reports):
    features = fit_features(two_reports).transform(two_reports)
    scored = boosting.predict(boosting.fit_trees(features, TREES), features).collect()
    assert len(scored) == 2
    assert all(0 <= r["tree_proba"] <= 1 and r["predicted"] in (0, 1) for r in scored)


def test_trees_learn_the_rule(trees, table):
    report = {r["part"]: r["auc_roc"] for r in boosting.fit_report(trees, table, table.where("primaryid < 500")).collect()}
    assert report["train"] > 0.7 and set(report) == {"train", "validation"}


def test_importance_is_sorted_and_sums_to_one(trees):
    gains = [r["importance"] for r in boosting.feature_importance(trees).collect()]
    assert len(gains) == len(FEATURES) and gains == sorted(gains, reverse=True) and sum(gains) == pytest.approx(1)


def test_save_load(trees, table, tmp_path):
    trees.write().overwrite().save(str(tmp_path / "trees"))
    loaded = PipelineModel.load(str(tmp_path / "trees"))
    before, after = (boosting.predict_proba(m, table).orderBy("primaryid").collect() for m in (trees, loaded))
    assert before == after


def test_every_row_gets_one_out_of_fold_score(table):
    scored = boosting.out_of_fold(materialize(stratified_folds(table), "folds"), TREES)
    assert scored.count() == scored.select("primaryid").distinct().count() == 1_500
    per_fold, summary = boosting.cross_validate(scored)
    aucs = [r["auc_roc"] for r in per_fold.orderBy("fold").collect()]
    row = summary.first()
    assert row["fold_aucs"] == aucs and row["mean_auc"] == pytest.approx(np.mean(aucs)) and row["mean_auc"] > 0.6


def test_shapley_values_add_up_to_the_margin(spark, trees, table):
    explained = attribution.TreeExplainer(trees, spark).explain(boosting.predict_proba(trees, table), ("primaryid", "tree_proba"))
    margin = F.col("base") + sum((F.col(f) for f in FEATURES), F.lit(0.0))
    error = explained.select(F.max(F.abs(1 / (1 + F.exp(-2 * margin)) - F.col("tree_proba")))).first()[0]
    assert error < 1e-12


def test_shapley_values_by_brute_force(spark, trees, table):
    leaves = attribution.leaves_of(trees, spark)
    rows = table.orderBy("primaryid").limit(2)
    found = {r["primaryid"]: r for r in attribution.TreeExplainer(trees, spark).explain(rows).collect()}
    for row in rows.collect():
        x = [row[f] for f in FEATURES]

        def value(known):
            total = 0.0
            for leaf in leaves:
                part = leaf.value
                for f, share, low, high in zip(leaf.features, leaf.shares, leaf.lows, leaf.highs):
                    part *= float(low < x[f] <= high) if f in known else share
                total += part
            return total

        used = sorted({f for leaf in leaves for f in leaf.features})
        m = len(used)
        for f in used:
            others = [g for g in used if g != f]
            exact = sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                        * (value({*s, f}) - value(set(s)))
                        for n in range(m) for s in itertools.combinations(others, n))
            assert found[row["primaryid"]][FEATURES[f]] == pytest.approx(exact, abs=1e-10)


def test_shapley_forms(spark, trees, table):
    wide = materialize(attribution.TreeExplainer(trees, spark).explain(table), "shap")
    long = attribution.shap_long(wide)
    assert long.count() == 1_500 * len(FEATURES)
    first = wide.orderBy("primaryid").first()
    assert attribution.shap_map(wide).orderBy("primaryid").first()["shap"] == {f: first[f] for f in FEATURES}
    factors = attribution.top_factors(wide, n=4).orderBy("primaryid").first()["factors"]
    strongest = sorted(FEATURES, key=lambda f: -abs(first[f]))[:4]
    assert [f["feature"] for f in factors] == strongest
    for f in factors:
        assert f["shap_value"] == pytest.approx(first[f["feature"]], abs=5.1e-5)
        assert f["direction"] == ("increases risk" if first[f["feature"]] > 0 else "decreases risk")
    summary = attribution.shap_summary(long, 3).collect()
    assert len(summary) == 3 and summary[0]["mean_abs_shap"] >= summary[1]["mean_abs_shap"]


def test_embedding(cases):
    rows = fusion.with_tokens(with_narrative(cases))
    vectors = [r["embedding"].toArray() for r in fusion.embed(fusion.fit_embedding(rows, FUSION), rows).limit(20).collect()]
    assert {len(v) for v in vectors} == {128}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in vectors)


def test_embedding_of_tables(spark, cases):
    """By words and broadcast buckets what the row by row way gives, without Python, for texts without words too."""
    rows = fusion.with_tokens(with_narrative(cases)).select("primaryid", "serious", "tokens")
    model = fusion.fit_embedding(rows.where("primaryid % 2 = 0"), FUSION)
    rows = rows.unionByName(spark.createDataFrame([(-1, 1, []), (-2, 0, None), (None, None, ["zzzunseen"]), (-3, 1, ["bleeding"] * 3)], "primaryid long, serious int, tokens array<string>"))
    table = fusion.embed_table(model, rows)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r.primaryid: r for r in table.collect()}
    for r in fusion.embed(model, rows).collect():
        assert tuple(got[r.primaryid])[:3] == tuple(r)[:3]
        assert np.allclose(got[r.primaryid].embedding.toArray(), r.embedding.toArray(), atol=1e-12)


def test_fusion_output(models, cases):
    scored = models[0].score(cases).collect()
    assert len(scored) == 1_500
    assert all(0 <= r["fused_proba"] <= 1 for r in scored)
    assert all((r["risk"] == "HIGH RISK") == (r["fused_proba"] >= 0.5) for r in scored)
    assert all(len(r["factors"]) == 5 and r["report"].count("•") == 5 for r in scored)


def test_best_candidate_is_kept(models):
    candidates = models[1].collect()
    assert sorted(r["iterations"] for r in candidates) == [5, 15]
    assert candidates[0]["auc_roc"] == max(r["auc_roc"] for r in candidates) > 0.6


def test_saved_models_score_alike(spark, models, cases, tmp_path):
    models[0].save(str(tmp_path / "models"))
    loaded = load_models(spark, str(tmp_path / "models"))
    assert loaded.settings == FUSION
    before, after = (m.score(cases).orderBy("primaryid").collect() for m in (models[0], loaded))
    assert before == after


def test_stream_scores_as_batch_does(spark, models, cases, tmp_path):
    requests = cases.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA]).limit(300)
    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_request_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    assert stream.isStreaming
    start_scoring(models[0], stream, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("primaryid").collect()
    batch = score_requests(models[0], spark.read.parquet(str(tmp_path / "in"))).orderBy("primaryid").collect()
    assert len(streamed) == 300 and streamed == batch


def test_ablation_names_the_models(cases):
    from caseloom.plans.training import fusion_inputs
    *_, rows = fusion_inputs(cases, TREES, FUSION, folds=2)
    training, held_out = rows.where("is_train = 1"), rows.where("is_train = 0")
    fused = fusion.fuse(fusion.fit_fusion(training, FUSION), held_out)
    table = {r["model"]: r for r in fusion.ablation(fusion.score_text_only(fusion.fit_text_only(training), fused)).collect()}
    assert set(table) == {"trees", "text", "fusion"}
    assert all(0 <= r["auc_roc"] <= 1 and 0 <= r["f1"] <= 1 for r in table.values())


def test_tokens_that_raise_the_risk(cases):
    rows = materialize(fusion.with_tokens(with_narrative(cases)).select("primaryid", "serious", "tokens"), "tokens")
    embedding = fusion.fit_embedding(rows)
    embedded = materialize(fusion.embed(embedding, rows), "embedded")
    text = fusion.fit_text_only(embedded)
    ranked = tokeninfluence.token_influence(embedded, embedding, text).collect()
    mean = {t: np.mean([r["importance"] for r in ranked if r["token"] == t]) for t in ("bleeding", "anaphylaxis")}
    assert mean["bleeding"] > 0 and mean["anaphylaxis"] > 0
    weights = text.stages[-1].coefficients.toArray()
    for row in embedded.orderBy("primaryid").limit(20).collect():
        mine = sorted((r for r in ranked if r["primaryid"] == row["primaryid"]), key=lambda r: r["place"])
        assert {r["token"] for r in mine} == set(row["tokens"])
        assert [r["importance"] for r in mine] == sorted((r["importance"] for r in mine), reverse=True)
        assert sum(r["importance"] for r in mine) == pytest.approx(float(row["embedding"].toArray() @ weights), abs=1e-3)


def test_words_without_a_weight(spark, cases):
    """Unseen words are null and last, and every word of a long text takes part."""
    rows = fusion.with_tokens(with_narrative(cases)).select("primaryid", "serious", "tokens")
    embedding = fusion.fit_embedding(rows)
    text = fusion.fit_text_only(materialize(fusion.embed(embedding, rows), "embedded"))
    long = spark.createDataFrame([(1, ["bleeding"] + ["oral"] * 500 + ["zzzunseen", "rash"])], "primaryid long, tokens array<string>")
    got = {r["token"]: r for r in tokeninfluence.token_influence(long, embedding, text).collect()}
    assert got["zzzunseen"]["importance"] is None and got["zzzunseen"]["place"] == 4 and got["rash"]["importance"] is not None


def test_word2vec_option(cases):
    settings = FusionSettings(embedding="word2vec")
    rows = fusion.with_tokens(with_narrative(cases)).limit(200)
    assert len(fusion.embed(fusion.fit_embedding(rows, settings), rows).first()["embedding"]) == 128


def test_rare_words_do_not_share_weights(spark):
    """With many thousands of words no weight falls to zero."""
    rows = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: F.concat(F.lit("w"), F.col("id") * 97 + i)).alias("tokens"))
    rarity = fusion.fit_embedding(rows).rarity
    assert np.nanmin(rarity) > 1


def test_combined_table(cases):
    table = combined(fit_features(cases), cases)
    assert table.columns == ["primaryid", "narrative", "serious", *FEATURES] and table.count() == 1_500


def test_expanded_frequencies(spark, cases):
    worded = frequencies(cases, True)
    assert {r[0] for r in worded.select("dose_freq").distinct().collect()} == {
        "once daily", "twice daily", "three times daily", "four times daily", "as needed"}
    assert frequencies(cases, False) is cases


def test_embedding_and_influences_of_batches(spark):
    """Many texts at once give what each alone does; null words count as none."""
    import pyarrow as pa
    from caseloom.operators.tokeninfluence import influences
    texts = [["a", "b", "a"], [], None, ["c"] * 9000 + ["a"], ["zzz", None, "a"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "primaryid long, tokens array<string>").coalesce(1)
    model = fusion.fit_embedding(rows.where("primaryid < 4"), FUSION)
    one = [fusion.embed(model, rows.where(F.col("primaryid") == i)).first().embedding.toArray() for i in range(5)]
    for r in fusion.embed(model, rows).collect():
        assert np.allclose(r.embedding.toArray(), one[r.primaryid], atol=1e-12)
    weights = np.linspace(-1, 1, 128)
    found = influences(pa.array(texts, pa.list_(pa.string())), model.rarity, model.seed, weights).to_pylist()
    for own, vector in zip(found, one):
        assert sum(x["importance"] or 0.0 for x in own) == pytest.approx(float(vector @ weights), abs=1e-9)
        assert [x["place"] for x in own] == list(range(1, len(own) + 1))
    assert [x["token"] for x in found[4]][-1] == "zzz" and found[4][-1]["importance"] is None
