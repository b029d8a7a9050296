import random

from pyspark.sql import functions as F

from siftlode.operators import model
from siftlode.plans import jobs
from siftlode.sources import tables

FEATURES = model.Features(("Z_mean", "Z_max", "n_elements", "Li_frac", "cell_volume"), ("Family", "crystal_system"))


def materials(n=80, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        li, s = rng.randint(1, 9), rng.randint(2, 8)
        formula = rng.choice([f"Li{li}PS{s}", f"Li{li}P2S{s}Cl", f"Li{li}Ge(PS{s})2", f"Li{li}FeP2S{s}"])
        out.append((f"m{i:03d}", formula, 5.0 + li, 6.0, 7.0, 90.0, 90.0, 90.0, rng.randint(1, 230), float(li) / s + rng.random() / 10))
    return out


def test_jobs_end_to_end(spark, tmp_path):
    raw = spark.createDataFrame(materials(), "material_id string, formula string, a double, b double, c double, alpha double, beta double, gamma double, spacegroup_no int, y double")
    props = tables.element_props(spark)
    good, bad = jobs.feature_frame(raw, props, "material_id")
    assert bad.count() == 0 and good.where("Li_frac <= 0 OR Z_mean < 3").count() == 0
    rows = model.align_features(good, FEATURES, ("material_id", "y")).withColumn("split", F.when(F.xxhash64("material_id") % 4 == 0, "test").otherwise("train")).cache()
    build = lambda: model.boosted(FEATURES, trees=4, depth=3, rate=0.5)
    fitted, report = jobs.train_job(rows, {"boosted": build}, "material_id", k=2)
    assert report.first()["cv"]["mae_mean"] > 0 and report.first()["test"]["n"] > 0

    lattice = F.struct(*[F.col(x) for x in jobs.CELL]).alias("lattice")
    from siftlode.functions.composition import parse_formulas

    parsed, _ = parse_formulas(raw)
    pool = parsed.select("material_id", "formula", "elements", "spacegroup_no", F.lit(0.01).alias("e_above_hull"), F.lit(2.0).alias("band_gap"), lattice)
    config = jobs.ScreenConfig(str(tmp_path / "screen"), top=10)
    top = jobs.screen_job(pool, props, fitted["boosted"], FEATURES, config)
    assert 0 < top.count() <= 10 and config.seen["scanned"] == 80
    assert config.seen["flagged"] == sum("Fe" in m[1] for m in materials())
    assert spark.read.parquet(f"{tmp_path}/screen/pool").where("formula LIKE '%Fe%'").count() == 0
    assert jobs.screen_job(pool.where("1 = 0"), props, fitted["boosted"], FEATURES, config) is None

    known = raw.select(F.col("material_id").alias("label"), "formula", *jobs.CELL, "spacegroup_no").limit(9)
    answers = jobs.known_answer_screen(known, props, fitted["boosted"], FEATURES).collect()
    assert len(answers) == 9 and [r["pred"] for r in answers] == sorted((r["pred"] for r in answers), reverse=True)

    models = model.fit_ensemble(rows.where("split = 'train'"), lambda s: model.boosted(FEATURES, trees=3, depth=3, rate=0.5, seed=s, share=0.7), seeds=(0, 1))
    bins, rho, p = jobs.calibration_job(models, rows.where("split = 'test'"), "material_id", 3)
    assert bins.count() >= 1 and -1 <= rho <= 1 and 0 <= p <= 1
