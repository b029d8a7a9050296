"""Checked reads, versions, folders of candidates, sketches, grids and scored streams."""

import random

import pytest
from pyspark.sql import functions as F

from siftlode.functions.composition import parse_formulas
from siftlode.operators import metrics, model, screen, sketches
from siftlode.plans import jobs
from siftlode.sources import tables, versions
from siftlode.streaming import arrivals


def test_lines_that_do_not_fit_are_kept_with_a_reason(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,formula,v\n1,Li2S,0.5\n2,"Li,S",\n3,Li2S\n4,Li2S,1,2\n,,\n')
    (tmp_path / "in" / "b.csv").write_text('id,formula,v\nfive,Li2S,1\n6,"Li""2""S",2\n7,Li2S,much\n8,Li"2S",\n')
    good, bad = tables.read_checked(spark, f"{tmp_path}/in", "id long, formula string, v double")
    assert sorted(tuple(r) for r in good.collect() if r["id"] and r["id"] != 8) == [(1, "Li2S", 0.5), (2, "Li,S", None), (6, 'Li"2"S', 2.0)]
    assert {(r["record"], r["reason"]) for r in bad.collect()} == {("3,Li2S", "columns"), ("4,Li2S,1,2", "columns"), ("five,Li2S,1", "type"), ("7,Li2S,much", "type")}
    assert good.columns == ["id", "formula", "v"]


def test_a_table_is_made_anew_from_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError):
        versions.read_version(spark, path)
    assert versions.write_version(spark.range(5), path, "first") == 1
    assert versions.write_version(versions.read_version(spark, path).where("id > 2"), path) == 2
    assert sorted(r["id"] for r in versions.read_version(spark, path).collect()) == [3, 4]
    assert versions.read_version(spark, path, 1).count() == 5
    #: A write that fails names nothing, and the next one goes on.
    with pytest.raises(Exception):
        versions.write_version(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert versions.read_version(spark, path).count() == 2
    assert versions.write_version(spark.range(0), path) == 3 and versions.read_version(spark, path).count() == 0
    assert [(r["version"], r["rows"], r["note"]) for r in versions.history(spark, path).orderBy("version").collect()] == [(1, 5, "first"), (2, 2, ""), (3, 0, "")]
    with pytest.raises(ValueError):
        versions.read_version(spark, path, 9)


def test_screens_read_only_the_folders_that_they_need(spark, tmp_path):
    formulas = ["Li3PS4", "Li6PS5Cl", "LiPH21S3N7", "Na3PS4", "Li2S", "LiCoO2", "Li3CuS2", "Li4SnS4"]
    rows = [(f"m{k}", formulas[k % len(formulas)], 0.001 * (k % 70), 1.0 + k % 3) for k in range(400)]
    good, _ = parse_formulas(spark.createDataFrame(rows, "material_id string, formula string, e_above_hull double, band_gap double"))
    made = good.withColumns({"spacegroup_no": F.lit(1), "z_factor": F.lit(1), "lattice": F.expr("named_struct('a', 1D, 'b', 1D, 'c', 1D, 'alpha', 90D, 'beta', 90D, 'gamma', 90D)")})
    tables.write_candidates(made, f"{tmp_path}/pool")
    read = tables.read_candidates(spark, f"{tmp_path}/pool")
    assert read.count() == 400
    for condition in (screen.ScreenFilter(), screen.ScreenFilter.loose(), screen.ScreenFilter(include=("P",), exclude=(), n_elements=(None, 4))):
        want = {r["material_id"] for r in condition.apply(good).collect()}
        assert {r["material_id"] for r in condition.apply(read).collect()} == want and want
    left = screen.ScreenFilter().selected(read)
    plan = left._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert all(x in filters for x in ("has_Li", "has_S", "has_H", "n_elements"))
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    few, every = files(left), files(read)
    assert 0 < len(few) < len(every) and all("has_Li=true" in f and "has_S=true" in f and "has_H=false" in f for f in few)


def test_sketches_of_runs_answer_together(spark):
    rng = random.Random(4)
    rows = [(g, run, rng.gauss(0, 10**g)) for g in range(3) for run in range(6) for _ in range(1_000)] + [(0, 0, None), (1, 1, float("nan")), (7, 0, None)]
    df = spark.createDataFrame(rows, "g int, run int, v double")
    runs = [sketches.sketched(df.where(F.col("run") == k), "v", ("g",)) for k in range(6)]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in sketches.quantiles_of(sketches.merged(every, ("g",)), shares, ("g",)).collect()}
    assert set(got) == {0, 1, 2}
    for g, r in got.items():
        own = sorted(v for h, _, v in rows if h == g and v is not None and v == v)
        assert r["n"] == len(own) == 6_000 and (r["quantiles"][0], r["quantiles"][-1]) == (own[0], own[-1])
        for share, q in zip(shares, r["quantiles"], strict=True):
            assert abs(sum(v <= q for v in own) / len(own) - share) < 0.025
    assert sketches.quantiles_of(sketches.sketched(df.where("1 = 0"), "v"), [0.5]).count() == 0


def test_grids_are_judged_on_the_folds_given(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.random(), rng.random(), k % 3) for k in range(300)], "id long, x double, y double, fold int").withColumn("y", F.col("x") * 3 + F.col("y") / 10).cache()
    features = model.Features(("x",))
    aligned = model.align_features(df, features, ("id", "y", "fold")).cache()
    build = lambda: model.forest(features, trees=3, depth=4)
    best, table = model.grid_search(aligned, build, {"maxDepth": [1, 4]}, k=3)
    assert best.stages[-1].getOrDefault("maxDepth") == 4 and table.count() == 6
    per_fold, _ = model.cross_validate(aligned, build, 3)
    want = {r["fold"]: r["rmse"] for r in per_fold.collect()}
    got = {r["fold"]: r["rmse"] for r in table.where("setting['maxDepth'] = '4'").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert metrics.fold_summary(table.where("setting['maxDepth'] = '4'")).count() == 1


def test_a_scored_stream_equals_the_scored_table(spark, tmp_path):
    rng = random.Random(4)
    features = model.Features(("Z_mean", "Li_frac", "cell_volume"), ("Family", "crystal_system"))
    schema = "material_id string, formula string, a double, b double, c double, alpha double, beta double, gamma double, spacegroup_no int"
    rows = [(f"m{i}", rng.choice(["Li3PS4", "Li6PS5Cl", "Li4SnS4", "??", "Li2S"]), 5.0 + i % 7, 6.0, 7.0, 90.0, 90.0, 90.0, 1 + i) for i in range(40)]
    table, props = spark.createDataFrame(rows, schema), tables.element_props(spark)
    good, bad = jobs.feature_frame(table, props, "material_id")
    aligned = model.align_features(good, features, ("material_id", "formula"))
    fitted = model.boosted(features, trees=2, depth=2).fit(aligned.withColumn("y", F.col("Z_mean")))
    for k in range(2):
        table.where(F.expr(f"cast(substr(material_id, 2) AS int) % 2 = {k}")).write.mode("append").parquet(f"{tmp_path}/in")
    listener = arrivals.Arrived()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = arrivals.scored(stream, props, fitted, features, "material_id", f"{tmp_path}/out", f"{tmp_path}/c", "scores")
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    want = {r["material_id"]: r["pred"] for r in model.score(fitted, aligned).collect()}
    assert {r["material_id"]: r["pred"] for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()} == want
    assert {r["material_id"] for r in spark.read.parquet(f"{tmp_path}/out/not_parsed").collect()} == {r["material_id"] for r in bad.collect()}
    assert listener.rows["scores"] == 40
