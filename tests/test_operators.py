import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.operators import attribution, audit, metrics, model, screen
from siftlode.sources import tables


def test_screen_filter_edges(spark):
    rows = [
        ("a", ["Li", "P", "S"], 0.0, 1.5), ("b", ["Li", "P", "S"], 0.05, 1.5), ("c", ["Li", "P", "S"], 0.051, 2.0), ("d", ["Li", "S"], 0.0, 2.0),
        ("e", ["H", "Li", "S"], 0.0, 2.0), ("f", ["Fe", "Li", "S"], 0.0, 2.0), ("g", ["Li", "P", "S"], 0.0, None), ("h", ["Cl", "Li", "O", "P", "S", "Si"], 0.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "material_id string, elements array<string>, e_above_hull double, band_gap double")
    assert [r[0] for r in screen.ScreenFilter().apply(df).orderBy("material_id").collect()] == ["a", "b"]
    funnel = screen.ScreenFilter().funnel(df).orderBy("step").collect()
    left = [r["n_candidates"] for r in funnel]
    assert left[0] == 8 and left[-1] == 2 and left == sorted(left, reverse=True)
    assert sum(r["dropped"] for r in funnel) == 6
    assert screen.ScreenFilter(cap=1).apply(df).count() == 1
    assert screen.ScreenFilter.loose().apply(df).count() == 6


def test_top_lists(spark):
    df = spark.createDataFrame([("m1", "A", 3.0), ("m2", "A", 3.0), ("m3", "B", 2.0), ("m4", "C", 1.0)], "material_id string, formula string, pred double")
    assert [r[0] for r in screen.top_list(df, 3).collect()] == ["m1", "m3"]
    assert [r[0] for r in screen.top_list(df, 3, dedupe="before").collect()] == ["m1", "m3", "m4"]
    ranked = {r["material_id"]: r["rank"] for r in screen.with_rank(df, "pred", "material_id").collect()}
    assert ranked == {"m1": 0, "m2": 1, "m3": 2, "m4": 3}


def test_metrics(spark):
    y, p = [1.0, 2.0, 4.0, 5.0], [1.5, 2.0, 3.0, 6.0]
    df = spark.createDataFrame([*zip(y, p), (None, 1.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    e = np.array(p) - np.array(y)
    assert r["mae"] == pytest.approx(abs(e).mean()) and r["rmse"] == pytest.approx(math.sqrt((e**2).mean()))
    assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((np.array(y) - 3) ** 2).sum())


def test_quantile_bins_and_percentile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(121)], "v double")
    sizes = [r["n"] for r in metrics.quantile_bins(df, "v").groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()]
    assert sizes == [25, 24, 24, 24, 24]
    tied = spark.createDataFrame([(1.0,)] * 8 + [(2.0,)] * 2, "v double")
    assert metrics.quantile_bins(tied, "v").select("bin").distinct().count() <= 2
    pool = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    leads = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", 9.0)], "label string, v double")
    assert {r["label"]: r["percentile"] for r in metrics.pool_percentile(leads, pool, "v").collect()} == {"a": 25.0, "b": 0.0, "c": 100.0}


def test_spearman_and_p(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "a double, b double")
    rho, p = metrics.spearman(df, "a", "b")
    assert rho == pytest.approx(0.8) and p == pytest.approx(0.10408803866182788, rel=1e-6)
    assert metrics.p_value(0.45581, 121) == pytest.approx(1.492e-7, rel=1e-3)


def test_folds(spark):
    df = spark.range(103)
    sizes = [r["count"] for r in metrics.even_folds(df, "id").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5
    assert df.select(metrics.hashed_fold(F.col("id")).alias("f")).distinct().count() == 5


def test_audit(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "c string")
    got = audit.coverage(df, "c").collect()
    assert sum(r["pct"] for r in got) == pytest.approx(100) and got[-1]["c"] == "x"
    leads = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    values = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "label string, sigma300_mS_cm double")
    assert {r["label"]: r["good"] for r in audit.with_metrics(leads, values).collect()} == {"a": True, "b": False, "c": False}
    assert audit.risk_map(leads, values).columns == ["label", "kind", "sigma300_mS_cm"]
    order = spark.createDataFrame([("z", 0), ("w", 1), ("x", 2)], "c string, position int")
    assert [r["c"] for r in audit.present_in_order(df, "c", order).collect()] == ["z", "x"]


def test_sources_round_trip(spark, tmp_path):
    props = {r["element"]: r for r in tables.element_props(spark).collect()}
    assert len(props) == 118 and (props["Li"]["row"], props["Li"]["group"]) == (2, 1) and (props["Cl"]["row"], props["Cl"]["group"]) == (3, 17)
    assert (props["Fe"]["row"], props["Fe"]["group"]) == (4, 8) and props["La"]["group"] == 3 and props["Hf"]["group"] == 4
    (tmp_path / "metrics_lead_a.json").write_text('{"arrhenius": {"mace": {"sigma300_mS_cm": 2.5}}}')
    assert tables.read_metrics_json(spark, f"{tmp_path}/metrics_*.json").first()[:] == ("lead_a", 2.5)
    tables.write_provenance(spark, ["a", "b"], [(1, "x")], str(tmp_path), "figures/fig1.png")
    assert tables.read_result(spark, f"{tmp_path}/fig1", "a long, b string").first()[:] == (1, "x")


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    rows = [(i, float(a), float(b) if i % 10 else None, "uv"[i % 2], float(2 * a + (b > 0) + i % 2)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind string, y double")
    features = model.Features(("a", "b"), ("kind",))
    rows = model.align_features(df, features, ("id", "y")).cache()
    return features, rows, model.boosted(features, trees=4, depth=3, rate=0.5).fit(rows)


def test_attributions_add_up(spark, trained, tmp_path):
    _, rows, fitted = trained
    fitted.stages[-1].write().overwrite().save(f"{tmp_path}/m")
    paths, weights = attribution.tree_paths(spark, f"{tmp_path}/m")
    out = fitted.transform(rows)
    x = np.array([r["features"].toArray() for r in out.orderBy("id").collect()])
    want = np.array([r["prediction"] for r in out.orderBy("id").collect()])
    assert attribution.tree_outputs(paths, x) @ weights == pytest.approx(want)
    phi, base = attribution.shapley(paths, weights, x)
    assert phi.sum(1) + base == pytest.approx(want)
    names = fitted.stages[-2].getInputCols()
    long = attribution.attribute(out, paths, weights, names)
    assert long.count() == 300 * len(names)
    assert metrics.ranked_features(long).first()["feature"] == "a_filled"
    virtual = attribution.virtual_ensemble(out, paths, weights, 3).orderBy("id").collect()
    assert [r["members"][-1] for r in virtual] == pytest.approx(want.tolist())


def test_models_beat_the_mean(spark, trained):
    features, rows, fitted = trained
    assert model.holdout_metrics(fitted, rows).first()["r2"] > 0.8
    folds = rows.withColumn("fold", metrics.hashed_fold(F.col("id"), 2))
    per_fold, summary = model.cross_validate(folds, lambda: model.forest(features, trees=8, depth=5), k=2)
    assert per_fold.count() == 2 and summary.first()["r2_mean"] > 0.3
    models = model.fit_ensemble(rows, lambda s: model.boosted(features, trees=3, depth=3, rate=0.5, seed=s, share=0.7), seeds=(0, 1))
    spread = model.score_ensemble(models, rows, ("id",))
    assert spread.where("ens_std > 0").count() > 0 and spread.count() == 300
    scored = model.score(fitted, rows.select("id", *[c for c in rows.columns if c not in ("id", "y")]))
    assert scored.where("abs(pred_sigma - pow(10D, pred)) > 1e-9").count() == 0
