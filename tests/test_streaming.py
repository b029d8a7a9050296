import pytest

from siftlode.operators.screen import ScreenFilter
from siftlode.streaming import arrivals


def test_screened_stream_equals_the_table(spark, tmp_path):
    rows = [("a", "Li3PS4", 0.0, 2.0), ("b", "Li2S", 0.0, 2.0), ("c", "LiFeS2", 0.0, 2.0), ("d", "??", 0.0, 2.0), ("e", "Li6PS5Cl", 0.01, 1.6), ("f", "Li3PS4", 0.2, 2.0)]
    schema = "material_id string, formula string, e_above_hull double, band_gap double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    arrivals.written(arrivals.screened(stream).select("material_id", "Family"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "sulfides"), ("e", "argyrodites")}
    with pytest.raises(ValueError):
        arrivals.screened(stream, ScreenFilter(cap=3))


def test_cleaned_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<1e-3"), (2, "x"), (3, "2")], "id int, raw_value string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, raw_value string").parquet(f"{tmp_path}/in")
    arrivals.written(arrivals.cleaned(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert {(r["id"], r["censored"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 1), (3, 0)}
