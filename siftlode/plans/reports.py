"""More registered queries with their DuckDB counterparts: files and back, looser and capped screens, reports, and what must hold of trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import composition, parse, rules
from siftlode.operators import attribution, audit, metrics, model, screen
from siftlode.operators.order import kept
from siftlode.plans.queries import _METRICS, _PAIR, _POOL, _boosted, _candidates, _explained, _folder, _made, _pairs, _rounded, _split, _training, query, r6, table
from siftlode.sources import tables

# ---- files and back

_RAW = "CASE p_partkey % 4 WHEN 0 THEN '<1E-10' WHEN 1 THEN '3 E-4' WHEN 2 THEN '' ELSE concat(p_size, 'e-3') END"
_TRUE = "CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Na3PS4' END"


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN p_partkey % 3 = 1 THEN 'Na3PS4' ELSE concat('Li', p_size, 'S') END AS composition,
    round(log10(CASE p_partkey % 4 WHEN 0 THEN 1e-10 WHEN 1 THEN 3e-4 ELSE p_size / 1000.0 END), 6) AS y, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS censored FROM part WHERE p_partkey % 4 <> 2"""
)
def measurement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements written to a train and a test file, read by their schema and put under each other."""
    folder = _folder(spark, "measured")
    cell = ["1.5D AS a", "2D AS b", "3D AS c", "90D AS alpha", "90D AS beta", "90D AS gamma", "p_size AS spacegroup_no", "CAST(p_size AS DOUBLE) AS Z"]
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_RAW} AS raw_value", f"{_TRUE} AS true_composition", "concat('Li', p_size, 'S') AS reduced_composition", *cell, "p_brand AS family")
    tables.write_result(rows.where("id % 5 <> 0"), f"{folder}/train", "csv")
    tables.write_result(rows.where("id % 5 = 0"), f"{folder}/test", "csv")
    read = parse.parse_measurements(tables.read_measurements(spark, f"{folder}/train", f"{folder}/test"), "raw_value")
    return read.select("id", "split", parse.first_filled(F.col("true_composition"), F.col("reduced_composition")).alias("composition"), r6("y").alias("y"), "censored")


@query(f"WITH p AS ({_PAIR}), m AS (SELECT sqrt(avg((pred - y) * (pred - y))) AS rmse FROM p) SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(pred - y) > rmse) AS beyond FROM p, m GROUP BY 1")
def beyond_stored_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose error is above the RMSE that a metrics document holds."""
    path = f"{_folder(spark, 'metrics')}/test"
    pairs = _pairs(spark, sf_dir)
    tables.write_metrics(metrics.regression_metrics(pairs, "y", "pred").select(F.struct("n", "mae", "rmse", "r2").alias("test")), path)
    rmse = tables.read_scalar(spark, path, "test.rmse")
    return pairs.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("pred") - F.col("y")) > rmse).alias("beyond"))


@query(f"SELECT {_METRICS} FROM ({_PAIR})")
def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics document written and read again."""
    path = f"{_folder(spark, 'metrics')}/all"
    tables.write_metrics(metrics.regression_metrics(_pairs(spark, sf_dir), "y", "pred").select(F.struct("n", "mae", "rmse", "r2").alias("test")), path)
    read = spark.read.schema("test struct<n: long, mae: double, rmse: double, r2: double>").json(path).select("test.*")
    return _rounded(read, ("mae", "rmse", "r2"))


# ---- screens

_ODD = (("Li(2S", 0), ("li2s", 0), ("", 0), ("Li2S", 1), ("[Li2](S)2", 1))
_ODD_SQL = f"CASE p_partkey % 5 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, (x, _) in enumerate(_ODD))} END"


@query(f"SELECT {_ODD_SQL} AS formula, p_partkey % 5 > 2 AS parsed, count(*) AS n FROM part GROUP BY 1, 2")
def quarantined_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by formula, and whether these were parsed or set aside."""
    good, bad = composition.parse_formulas(table(spark, sf_dir, "part").select(F.expr(_ODD_SQL).alias("formula")))
    every = good.select("formula", F.lit(True).alias("parsed")).union(bad.select("formula", F.lit(False)))
    return every.groupBy("formula", "parsed").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id AS material_id, f AS formula FROM {_POOL} WHERE k NOT IN (4, 5) AND hull <= 0.05 AND gap >= 0.5")
def loose_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen as it was before: a lower gap, and any number and kind of other elements."""
    return screen.ScreenFilter.loose().apply(_candidates(spark, sf_dir)).select("material_id", "formula")


@query(f"SELECT id AS material_id, f AS formula FROM (SELECT * FROM {_POOL} WHERE k NOT IN (4, 5, 6, 8) AND hull <= 0.05 AND gap >= 1.5 ORDER BY id LIMIT 40) WHERE k < 4")
def capped_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen of a query with a row limit: flagged elements are dropped after it, so fewer rows are left."""
    return screen.ScreenFilter(cap=40).apply(_candidates(spark, sf_dir)).select("material_id", "formula")


@query(f"SELECT p_partkey AS material_id, CASE WHEN p_partkey % 4 = 0 THEN 'garnets' ELSE {_made(1)} END AS Family FROM part")
def given_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family that a row brings along, else the one by rule."""
    rows = _candidates(spark, sf_dir).withColumn("given", F.expr("CASE WHEN material_id % 4 = 0 THEN 'garnets' END"))
    return rules.assign_family(rows, "given").select("material_id", "Family")


# ---- reports


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'orange' ELSE 'grey' END AS colour, coalesce(o_orderstatus IN ('F', 'P'), false) AS highlight FROM orders")
def family_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listed attribute of each row's group with a default, and whether the row is to be highlighted."""
    coloured = audit.with_attribute(table(spark, sf_dir, "orders"), {"1-URGENT": "red", "2-HIGH": "orange", "unknown": "grey"}, "colour", "o_orderpriority")
    return screen.with_highlight(coloured, ["F", "P"], "o_orderstatus").select("o_orderkey", "colour", "highlight")


_KNOWN_TYPES = "(VALUES ('refund', 0), ('purchase', 1), ('view', 2), ('click', 3)) AS t(event_type, position)"


@query(f"SELECT event_type, position FROM {_KNOWN_TYPES} WHERE event_type IN (SELECT event_type FROM events)")
def present_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.present_in_order(table(spark, sf_dir, "events"), "event_type", spark.sql(f"SELECT * FROM {_KNOWN_TYPES}"))


@query("SELECT l_quantity <= 25 AS known, round(median(CAST(l_extendedprice AS DOUBLE)), 6) AS median FROM lineitem GROUP BY 1")
def median_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") <= 25).alias("known"), F.col("l_extendedprice").cast("double").alias("v"))
    return metrics.group_median(lines, "known", "v").select("known", r6("median").alias("median"))


@query(
    """WITH m AS (SELECT user_id AS label, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS sigma FROM events GROUP BY 1),
    l AS (SELECT s_suppkey AS label, s_suppkey * 37 % 101 AS mean, s_acctbal AS spread, sigma FROM supplier LEFT JOIN m ON label = s_suppkey),
    r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, label) - 1 AS prior_rank, row_number() OVER (ORDER BY sigma IS NULL, sigma DESC, label) - 1 AS measured_rank FROM l)
    SELECT label, sigma AS sigma300_mS_cm, coalesce(sigma >= 1, false) AS good, round(100.0 * (SELECT count(*) FROM customer WHERE c_acctbal < spread) / (SELECT count(*) FROM customer), 6) AS percentile,
    prior_rank, measured_rank, measured_rank - prior_rank AS shift FROM r"""
)
def retro_scored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with their metric, the percentile of their spread in the pool, and their ranks by prediction and by metric."""
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("label")).agg(F.max(F.get_json_object("props", "$.k").cast("double")).alias("sigma300_mS_cm"))
    leads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), (F.col("s_suppkey") * 37 % 101).alias("ens_mean"), F.col("s_acctbal").alias("ens_std"))
    scored = audit.retro_scored(leads, found, table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("ens_std")))
    ranked = audit.against_prior_rank(scored)
    return ranked.select("label", "sigma300_mS_cm", "good", r6("percentile").alias("percentile"), "prior_rank", "measured_rank", "shift")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS acct, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS acct_missing,
    NULL::DOUBLE AS absent, 1.0::DOUBLE AS absent_missing, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_mktsegment END AS segment, 'unknown' AS none FROM customer"""
)
def aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's columns in its order, with gaps, NaN, texts that are no numbers, and columns that are not there."""
    acct = "CASE WHEN c_custkey % 5 = 0 THEN 'NaN' WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS acct"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", acct, "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment")
    return model.align_features(rows, model.Features(("acct", "absent"), ("segment", "none")), ("c_custkey",))


# ---- what must hold of trained models


@query("SELECT count(DISTINCT l_partkey) AS n, true AS gapless, true AS descending FROM lineitem JOIN part ON p_partkey = l_partkey")
def ranking_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ranks of all scored rows: none is missing or there twice, and no row stands before one with a higher score."""
    rows = _training(spark, sf_dir)
    train, _ = _split(rows)
    ranked = kept(screen.with_rank(model.score(_boosted(train).fit(train), rows).select("id", "pred"), "pred", "id"))
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("pred").alias("next"))
    both = ranked.join(after, "rank", "left")
    whole = both.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("next").alias("followed"), F.count_if(F.col("next") > F.col("pred")).alias("wrong"))
    return whole.select("n", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("followed") == F.col("n") - 1)).alias("gapless"), (F.col("wrong") == 0).alias("descending"))


@query("SELECT count(DISTINCT l_partkey) AS n, 5 AS features, true AS adds_up FROM lineitem JOIN part ON p_partkey = l_partkey")
def attribution_adds_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the attributions of all rows: each has one for every feature, and they differ from the prediction by the same base."""
    prepared, paths, weights, names = _explained(spark, sf_dir, held_out=False)
    sums = attribution.attribute(prepared, paths, weights, names).groupBy("id").agg(F.sum("phi").alias("phi"), F.countDistinct("feature").alias("k"))
    rest = prepared.select("id", "prediction").join(sums, "id").select("k", (F.col("prediction") - F.col("phi")).alias("base"))
    return rest.agg(F.count(F.lit(1)).alias("n"), F.max("k").cast("int").alias("features"), ((F.max("base") - F.min("base") < 1e-6) & (F.min("k") == F.max("k"))).alias("adds_up"))
