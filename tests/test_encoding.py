"""Target statistics, players of attributions, medians and folds against brute force."""

import hashlib
import random
from itertools import combinations
from math import factorial
from statistics import median

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlode.operators import attribution, encoding, metrics, model, order


def rows(n=120, seed=2):
    rng = random.Random(seed)
    out = [(k, rng.choice(["a", "a", "a", "b", None, f"rare{k}"]), rng.choice([None, float("nan"), 1.0, 2.5, -7.0]), float(k % 5)) for k in range(n)]
    return [*out, out[3], out[3]]


def table(spark, found):
    return spark.createDataFrame(found, "id long, c string, y double, x double").repartition(5)


@pytest.mark.parametrize("weight", [1.0, 3.0])
def test_ordered_statistics(spark, weight):
    found = rows()
    real = [y for _, _, y, _ in found if y is not None and y == y]
    base = sum(real) / len(real)
    want, sums = [], {}
    for k, c, y, _ in sorted(found, key=lambda r: (hashlib.md5(f"{r[0]}:9".encode()).hexdigest(), r[0])):
        s, n = sums.get(c, (0.0, 0))
        want.append((k, c or "", round((s + base * weight) / (n + weight), 9)))
        sums[c] = (s + y, n + 1) if y is not None and y == y else (s, n)
    got = encoding.ordered_statistics(table(spark, found), "c", "y", "id", weight, seed=9).collect()
    assert sorted((r["id"], r["c"] or "", round(r["c_mean"], 9)) for r in got) == sorted(want)
    assert encoding.ordered_statistics(table(spark, []), "c", "y", "id").count() == 0


def test_statistics_of_the_whole_table(spark):
    train = table(spark, [(1, "a", 1.0, 0.0), (2, "a", 3.0, 0.0), (3, None, 8.0, 0.0), (4, "b", None, 0.0)])
    means, base = encoding.statistics(train, "c", "y", weight=2.0)
    assert base == 4.0 and {r["c"]: r["c_mean"] for r in means.collect()} == {"a": 3.0, None: pytest.approx(16 / 3), "b": 4.0}
    new = table(spark, [(7, "a", None, 0.0), (8, "new", None, 0.0), (9, None, None, 0.0)])
    assert {r["id"]: r["c_mean"] for r in encoding.encoded(new, means, "c", base).collect()} == {7: 3.0, 8: 4.0, 9: pytest.approx(16 / 3)}


def test_an_encoded_model_tells_categories_apart(spark):
    rng = random.Random(1)
    mean = {f"k{k}": float(rng.choice([0, 5, 10, 20])) for k in range(40)}
    names = list(mean)
    found = [(k, c, mean[c] + rng.random(), rng.random()) for k in range(2_000) for c in [rng.choice(names)]]
    train, test = table(spark, found[:1_600]), table(spark, found[1_600:])
    plan = lambda: model.boosted(model.Features(("x", "c_mean")), trees=5, depth=3, rate=0.5)

    def build():
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler

        return Pipeline(stages=[VectorAssembler(inputCols=["x", "c_mean"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, stepSize=0.5)])

    fitted = encoding.fit_ordered(train, ("c",), "y", "id", build)
    assert metrics.regression_metrics(fitted.transform(test), "y", "prediction").first()["r2"] > 0.8
    assert plan().getStages()


def test_columns_of_one_player_come_and_go_together():
    rng = np.random.default_rng(3)
    inf = np.inf
    paths = [[
        attribution.Path(2.0, [0, 1, 2], [-inf, -inf, -inf], [0.5, 0.5, 0.3], [None] * 3, [0.6, 0.8, 0.5]), attribution.Path(-1.0, [0, 1, 2], [-inf, -inf, 0.3], [0.5, 0.5, inf], [None] * 3, [0.6, 0.8, 0.5]),
        attribution.Path(4.0, [0, 1], [-inf, 0.5], [0.5, inf], [None] * 2, [0.6, 0.2]), attribution.Path(3.0, [0, 3], [0.5, -inf], [inf, 0.4], [None] * 2, [0.4, 0.7]), attribution.Path(9.0, [0, 3], [0.5, 0.4], [inf, inf], [None] * 2, [0.4, 0.3]),
    ], [attribution.Path(5.0, [], [], [], [], [])]]
    x, players = rng.random((7, 4)), [0, 0, 1, 2]
    phi, base = attribution.shapley(paths, [1.0, 0.5], x, players)

    def value(row, known):
        return sum(w * sum(p.value * np.prod([float(p.low[j] < row[f] <= p.high[j]) if players[f] in known else p.share[j] for j, f in enumerate(p.features)]) for p in tree) for tree, w in zip(paths, [1.0, 0.5], strict=True))

    for row, got in zip(x, phi, strict=True):
        for p in range(3):
            others = [q for q in range(3) if q != p]
            want = sum(factorial(n) * factorial(2 - n) / 6 * (value(row, {*some, p}) - value(row, some)) for n in range(3) for some in combinations(others, n))
            assert got[p] == pytest.approx(want)
        assert got.sum() + base == pytest.approx(value(row, {0, 1, 2})) and base == pytest.approx(value(row, set()))


@pytest.mark.parametrize("one_hot", [False, True])
def test_attributions_are_of_features_and_add_up(spark, tmp_path, one_hot):
    rng = random.Random(8)
    found = [(k, rng.choice(["a", "b", "c"]), None, rng.choice([None, rng.random()])) for k in range(300)]
    df = spark.createDataFrame([(k, c, x, (x or 2.0) + ord(c)) for k, c, _, x in found], "id long, c string, x double, y double")
    features = model.Features(("x", "absent"), ("c",))
    aligned = model.align_features(df, features, ("id", "y"))
    pipeline = model.forest(features, trees=3, depth=3) if one_hot else model.boosted(features, trees=3, depth=3)
    fitted = pipeline.fit(aligned)
    fitted.stages[-1].write().overwrite().save(f"{tmp_path}/m")
    paths, weights = attribution.tree_paths(spark, f"{tmp_path}/m")
    weights = [w / len(weights) for w in weights] if one_hot else weights
    out = fitted.transform(aligned)
    names = model.players(out, features)
    assert set(names) == {"x", "absent", "c"} and len(names) == (7 if one_hot else 5) or one_hot
    phi = attribution.attribute(out, paths, weights, names)
    sums = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.count_distinct("feature").alias("n")).join(out, "id").select((F.col("prediction") - F.col("s")).alias("base"), "n").collect()
    assert {r["n"] for r in sums} == {3} and max(r["base"] for r in sums) - min(r["base"] for r in sums) < 1e-9


def test_medians_are_exact_and_saved(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = random.Random(5)
    found = [(k, rng.choice([None, float("nan"), float(rng.randint(0, 9))]), rng.random(), None) for k in range(101)]
    df = spark.createDataFrame(found, "id long, a double, b double, c double").repartition(4)
    stage = model.Medians(("a", "b", "c")).fit(df)
    PipelineModel(stages=[stage]).write().overwrite().save(f"{tmp_path}/p")
    want = [median([v for v in (r[k] for r in found) if v is not None and v == v] or [0.0]) for k in (1, 2, 3)]
    for r in PipelineModel.load(f"{tmp_path}/p").transform(df).collect():
        for c, m in zip("abc", want, strict=True):
            assert r[f"{c}_filled"] == pytest.approx(m if r[c] is None or r[c] != r[c] else r[c])


@pytest.mark.parametrize(("n", "k"), [(23, 5), (20, 5), (3, 5), (0, 4), (1, 1)])
def test_even_folds_are_tiles(spark, n, k):
    df = spark.range(n).repartition(4)
    want = df.withColumn("fold", F.ntile(k).over(Window.orderBy(F.xxhash64("id", F.lit(42)), "id")) - 1)
    assert sorted(map(tuple, metrics.even_folds(df, "id", k).collect())) == sorted(map(tuple, want.collect()))


def test_running_sums_across_ranges(spark):
    found = [(k % 3 if k % 7 else None, k, float(k)) for k in range(200)]
    df = spark.createDataFrame(found, "g long, k long, v double").repartition(6)
    got = {r["k"]: (r["s"], r["n"]) for r in order.running_sums(df, {"s": F.col("v"), "n": F.lit(1)}, [F.desc("k")], ("g",)).collect()}
    for g, k, _ in found:
        earlier = [v for h, q, v in found if h == g and q > k]
        assert got[k] == (sum(earlier), len(earlier))
