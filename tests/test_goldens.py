"""Orders against brute force, fixed tables, and results with published values."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.functions import composition, parse, rules
from siftlode.operators import attribution, audit, metrics, model, order, screen
from siftlode.plans import jobs
from siftlode.sources import known, tables


def test_orders_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.choice([1, 2, 2, 3, 5, 8])) if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    by_group = {g: sorted(v for _, h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    for r in order.running_counts(df.where("v IS NOT NULL"), "v", ("g",)).collect():
        values = by_group[r["g"]]
        assert (r["n"], r["below"], r["total"]) == (values.count(r["v"]), sum(x < r["v"] for x in values), len(values))
    for r in order.quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], ("g",)).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(by_group[r["g"]], [0.0, 0.3, 0.5, 1.0]).tolist())
    placed = order.positions(df, [F.asc("v"), F.asc("id")], ("g",)).collect()
    for g in by_group:
        own = sorted((r for r in placed if r["g"] == g), key=lambda r: (r["v"] is not None, r["v"] or 0, r["id"]))
        assert [r["_position"] for r in own] == list(range(len(own))) and {r["_total"] for r in own} == {len(own)}
    assert order.quantiles(df.where("1 = 0"), "v", [0.5]).first()["quantiles"] == [None] and order.quantiles(df.where("1 = 0"), "v", [0.5], ("g",)).count() == 0 and order.positions(df.where("1 = 0"), [F.asc("v")]).count() == 0


def test_offsets_spread_evenly(spark):
    rows = [(0, "g", 0.0), (1, "g", 0.001), (2, "g", 0.002), (3, "g", 1.0), (4, "one", 5.0), (5, "one", 5.0), (6, "g", None)]
    got = {r["id"]: r["offset"] for r in metrics.density_offsets(spark.createDataFrame(rows, "id long, g string, v double"), "g", "v", "id").collect()}
    s = 0.42 * min(1, 3 / (0.03 * 4 + 1))
    assert [got[i] for i in range(4)] == pytest.approx([-s, 0, s, 0]) and got[4] == got[5] == 0 and got[6] is None


def test_null_scores_come_last(spark):
    df = spark.createDataFrame([("m1", "A", None), ("m2", "A", 1.0), ("m3", "B", float("nan")), ("m4", "B", -2.0), ("m5", "C", None)], "material_id string, formula string, pred double")
    assert {r["formula"]: r["material_id"] for r in screen.best_of_each(df, "formula", "pred", "material_id").collect()} == {"A": "m2", "B": "m4", "C": "m5"}
    assert [r["material_id"] for r in screen.top_list(df, 5, dedupe=None).collect()][:2] == ["m2", "m4"]
    assert {r["material_id"]: r["rank"] for r in screen.with_rank(df, "pred", "material_id").collect()}["m2"] == 0
    assert [r["highlight"] for r in screen.with_highlight(df, ["A"]).orderBy("material_id").collect()] == [True, True, False, False, False]


def test_ranges_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([("a", ["Li", "P", "S"], 0.0, 1.5)], "material_id string, elements array<string>, e_above_hull double, band_gap double").write.parquet(f"{tmp_path}/c")
    screen.ScreenFilter().apply(spark.read.parquet(f"{tmp_path}/c")).explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(band_gap,1.5)" in pushed and "LessThanOrEqual(e_above_hull,0.05)" in pushed


def test_known_materials_and_audit(spark):
    good, bad = composition.parse_formulas(known.known_materials(spark))
    want = ["LGPS", "LGPS", "argyrodites", "argyrodites", "argyrodites", "sulfides", "sulfides", "thio-LISICON", "unknown"]
    labelled = {r["label"]: r["Family"] for r in rules.assign_family(good).collect()}
    assert bad.isEmpty() and [labelled[k] for k in ("Li10GeP2S12", "Li10SnP2S12", "Li6PS5Cl", "Li6PS5Br", "Li6PS5I", "b-Li3PS4", "Li7P3S11", "Li4GeS4", "Li2S")] == want
    counts = audit.verdict_counts(known.audited_hits(spark), known.verdicts(spark)).collect()
    assert [r["n"] for r in counts] == [5, 2, 1, 3, 1, 3] and sum(r["n"] for r in counts if r["kept"]) == 7
    props = {r["element"]: r for r in tables.element_props(spark).collect()}
    assert (props["Li"]["mass"], props["S"]["X"], props["P"]["mendeleev"], props["Ge"]["radius"]) == (6.94, 2.58, 90, 1.25) and props["Og"]["mass"] is None
    colours = audit.with_attribute(rules.assign_family(good), {"LGPS": "x", "unknown": "other"}, "colour").where("Family <> 'LGPS'")
    assert {r["colour"] for r in colours.collect()} == {"other"}


def test_coverage_as_published(spark):
    families = {"unknown": 144, "thio-LISICON": 23, "LGPS": 9, "sulfides": 6, "argyrodites": 2}
    got = audit.coverage(spark.createDataFrame([(k,) for k, n in families.items() for _ in range(n)], "Family string"), "Family").collect()
    assert {r["Family"]: r["n"] for r in got} == families and got[-1]["pct"] == pytest.approx(78.26086956521739)


def test_leads_against_prior_rank(spark):
    leads = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.5, 0.4), ("c", 0.7, 0.2)], "label string, ens_mean double, ens_std double")
    values = spark.createDataFrame([("a", 0.2), ("b", 3.0)], "label string, sigma300_mS_cm double")
    pool = spark.createDataFrame([(x / 10,) for x in range(1, 5)], "ens_std double")
    scored = audit.retro_scored(leads, values, pool)
    assert {r["label"]: (r["good"], r["percentile"]) for r in scored.collect()} == {"a": (False, 0.0), "b": (True, 75.0), "c": (False, 25.0)}
    got = {r["label"]: (r["prior_rank"], r["measured_rank"], r["shift"]) for r in audit.against_prior_rank(scored).collect()}
    assert got == {"a": (0, 1, 1), "b": (2, 0, -2), "c": (1, 2, 1)}
    spread = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, virtual_std double")
    rho, _ = jobs.spreads_agree(lambda: spread, spread.withColumnRenamed("virtual_std", "ens_std"))
    assert rho == pytest.approx(1.0)
    with pytest.warns(UserWarning):
        assert jobs.spreads_agree(lambda: spread.select("nothing"), spread) is None


def test_shapley_values_over_all_coalitions():
    paths = [[
        attribution.Path(1.0, [0, 1], [-np.inf, -np.inf], [0.5, 0.2], [None, None], [0.6, 0.3]), attribution.Path(4.0, [0, 1, 2], [-np.inf, 0.2, -np.inf], [0.5, np.inf, 1.0], [None] * 3, [0.6, 0.7, 0.5]),
        attribution.Path(-2.0, [0, 1, 2], [-np.inf, 0.2, 1.0], [0.5, np.inf, np.inf], [None] * 3, [0.6, 0.7, 0.5]), attribution.Path(3.0, [0], [0.5], [np.inf], [None], [0.4]),
    ]]
    x = np.array([[0.1, 0.1, 2.0], [0.1, 0.9, 0.3], [0.9, 0.0, 0.0]])

    def value(row, coalition):
        out = 0.0
        for p in paths[0]:
            w = p.value
            for j, f in enumerate(p.features):
                w *= float(p.low[j] < row[f] <= p.high[j]) if f in coalition else p.share[j]
            out += w
        return out

    phi, _ = attribution.shapley(paths, [1.0], x)
    for k, row in enumerate(x):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(factorial(n) * factorial(2 - n) / factorial(3) * (value(row, {*s, f}) - value(row, set(s))) for n in range(3) for s in combinations(others, n))
            assert phi[k, f] == pytest.approx(want)


def test_sources_and_sinks(spark, tmp_path):
    head = "id,raw_value,true_composition,reduced_composition,a,b,c,alpha,beta,gamma,spacegroup_no,Z,family\n"
    (tmp_path / "train.csv").write_text(head + "1,<1E-10, ,Li2S,5.7,5.7,5.7,90,90,90,225,4,\n")
    (tmp_path / "test.csv").write_text(head + "2,3e-4,Li3PS4,Li3PS4,1,1,1,90,90,90,62,4,thio\n")
    rows = tables.read_measurements(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv")
    named = rows.withColumn("formula", parse.first_filled(F.col("true_composition"), F.col("reduced_composition")))
    assert [(r["split"], r["formula"]) for r in named.orderBy("id").collect()] == [("train", "Li2S"), ("test", "Li3PS4")]
    good, _ = composition.parse_formulas(named)
    assert [r["Family"] for r in rules.assign_family(good, "family").orderBy("id").collect()] == ["unknown", "thio"]
    assert "sigma" not in model.feature_columns(parse.parse_measurements(rows, "raw_value"))
    tables.write_metrics(spark.range(1).select(F.lit(0.5).alias("rho"), F.struct(F.lit(1).alias("x")).alias("deep")), f"{tmp_path}/m")
    assert tables.read_scalar(spark, f"{tmp_path}/m", "rho") == 0.5 and tables.read_scalar(spark, f"{tmp_path}/m", "deep.x", "int") == 1


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), "uv"[i % 2], float(i % 7 + i % 2)) for i in range(60)], "id long, a double, kind string, y double")
    features = model.Features(("a",), ("kind",))
    rows = model.align_features(df, features, ("id", "y"))
    fitted = model.boosted(features, trees=3, depth=2, rate=0.5).fit(rows)
    tables.save_model(fitted, f"{tmp_path}/model")
    again = tables.load_model(f"{tmp_path}/model")
    assert metrics.disagreement(model.score(fitted, rows).select("id", "pred").join(model.score(again, rows).select("id", F.col("pred").alias("p")), "id"), "pred", "p").first()[0] == 0
    metric = model.holdout_metrics(fitted, rows).first()
    pairs = np.array([(r["y"], r["pred"]) for r in model.score(fitted, rows.drop("y")).join(rows.select("id", "y"), "id").collect()])
    assert metric["mae"] == pytest.approx(np.abs(pairs[:, 0] - pairs[:, 1]).mean())
