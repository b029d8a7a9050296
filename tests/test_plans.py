from pyspark.sql import functions as F

from siftlode.plans import queries

SF = "/root/testdata/sf0.001"


def test_all_rows_are_attributed_and_ranked(spark):
    rows = queries._training(spark, SF)
    ids = sorted(r["id"] for r in rows.select("id").collect())
    phi = queries.tree_attribution(spark, SF).groupBy("id").agg(F.count_distinct("feature").alias("n")).collect()
    assert sorted(r["id"] for r in phi) == ids and len({r["n"] for r in phi}) == 1
    ranked = queries.score_and_rank(spark, SF).collect()
    assert sorted(r["id"] for r in ranked) == ids and sorted(r["rank"] for r in ranked) == list(range(len(ids)))
    held_out = sorted(r["id"] for r in queries.virtual_ensemble(spark, SF).select("id").collect())
    assert held_out == sorted(r["id"] for r in rows.where("fold = 0").select("id").collect())


def test_cross_validation_takes_the_five_folds(spark, monkeypatch):
    seen = {}
    whole = queries.model.cross_validate

    def watched(rows, build, k, **options):
        out = whole(rows, build, k=k, **options)
        seen["folds"] = [(r["fold"], r["count"]) for r in rows.groupBy("fold").count().orderBy("fold").collect()]
        seen["per_fold"] = out[0].count()
        return out

    monkeypatch.setattr(queries.model, "cross_validate", watched)
    assert queries.cv_eval(spark, SF).count() == 1
    sizes = [n for _, n in seen["folds"]]
    assert [k for k, _ in seen["folds"]] == list(range(5)) and seen["per_fold"] == 5 and max(sizes) < 2 * min(sizes)
