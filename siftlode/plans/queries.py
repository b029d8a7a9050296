"""Registered queries and their DuckDB counterparts.

The tables at hand stand in for measurements and candidates: formulas and raw
values are put together from whole numbers of their columns.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import composition, parse, rules
from siftlode.operators import attribution, audit, encoding, metrics, model, screen, sketches
from siftlode.operators.order import kept
from siftlode.sources import tables, versions
from siftlode.sources.tables import element_props

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- measurements and cells

_RAW = "concat(CASE l_linenumber % 5 WHEN 0 THEN '<' WHEN 1 THEN '~ ' WHEN 2 THEN ' >' WHEN 3 THEN '' ELSE '=' END, CASE l_partkey % 9 WHEN 0 THEN '1E-10' WHEN 1 THEN '3 E-4' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN '0' WHEN 5 THEN '-1' WHEN 6 THEN '2.5' WHEN 7 THEN '.5e2' ELSE '7' END)"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {_RAW} AS raw FROM lineitem),
    s AS (SELECT *, regexp_replace(replace(raw, ' ', ''), '^[<>~=]+', '') AS t FROM r),
    v AS (SELECT *, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) END AS sigma,
          CASE WHEN substr(trim(raw), 1, 1) IN ('<', '>') THEN 1 ELSE 0 END AS censored FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, raw, sigma, censored, round(log10(sigma), 6) AS y FROM v WHERE sigma > 0"""
)
def parse_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_RAW).alias("raw"))
    return parse.parse_measurements(raw, "raw").withColumn("y", r6("y"))


@query(
    """SELECT p_partkey, p_size * 5 AS spacegroup_no, CASE WHEN p_size * 5 <= 2 THEN 'triclinic' WHEN p_size * 5 <= 15 THEN 'monoclinic'
    WHEN p_size * 5 <= 74 THEN 'orthorhombic' WHEN p_size * 5 <= 142 THEN 'tetragonal' WHEN p_size * 5 <= 167 THEN 'trigonal'
    WHEN p_size * 5 <= 194 THEN 'hexagonal' WHEN p_size * 5 <= 230 THEN 'cubic' ELSE 'unknown' END AS crystal_system FROM part"""
)
def range_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_size") * 5
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("spacegroup_no"), parse.crystal_system(number).alias("crystal_system"))


_CELL = "SELECT p_partkey, p_size + 1.0 AS a, p_size + 2.0 AS b, p_size + 3.0 AS c, 80.0 + p_partkey % 20 AS alpha, 85.0 + p_partkey % 15 AS beta, 90.0 + p_partkey % 10 AS gamma, CAST(p_size AS INT) AS spacegroup_no FROM part"


@query(
    f"""SELECT p_partkey, round(a * b * c * sqrt(1 - pow(cos(radians(alpha)), 2) - pow(cos(radians(beta)), 2) - pow(cos(radians(gamma)), 2)
    + 2 * cos(radians(alpha)) * cos(radians(beta)) * cos(radians(gamma))), 4) AS cell_volume FROM ({_CELL})"""
)
def cell_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("a", "b", "c", "alpha", "beta", "gamma")
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size + 1.0D AS a", "p_size + 2.0D AS b", "p_size + 3.0D AS c", "80.0D + p_partkey % 20 AS alpha", "85.0D + p_partkey % 15 AS beta", "90.0D + p_partkey % 10 AS gamma", "p_size AS spacegroup_no")
    assert set(names) < set(part.columns)
    return parse.crystal_features(part).select("p_partkey", F.round("cell_volume", 4).alias("cell_volume"))


# ---- formulas

_A, _B, _C = "(1 + p_partkey % 7)", "(1 + p_size % 5)", "(1 + p_partkey % 3)"
_FORMULA = f"concat('Li', CAST({_A} AS STRING), 'Ge(PS', CAST({_B} AS STRING), ')', CAST({_C} AS STRING))"


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_FORMULA).alias("formula"))


@query(
    f"""SELECT p_partkey, u.element AS element, CAST(u.amount AS DOUBLE) AS amount FROM part,
    LATERAL (VALUES ('Li', {_A}), ('Ge', 1), ('P', {_C}), ('S', {_B} * {_C})) AS u(element, amount)"""
)
def formula_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = composition.parse_formulas(_formulas(spark, sf_dir))
    return good.select("p_partkey", F.explode("amounts").alias("element", "amount"))


_PROPS = "(VALUES ('Li', 3.0, 1.5), ('Ge', 32.0, NULL), ('P', 15.0, 1.0), ('S', 16.0, 1.1)) AS t(element, Z, radius)"


@query(
    f"""WITH e AS (SELECT p_partkey, u.element AS element, CAST(u.amount AS DOUBLE) AS n FROM part,
         LATERAL (VALUES ('Li', {_A}), ('Ge', 1), ('P', {_C}), ('S', {_B} * {_C})) AS u(element, amount)),
    w AS (SELECT *, n / sum(n) OVER (PARTITION BY p_partkey) AS w FROM e JOIN (SELECT element, CAST(Z AS DOUBLE) AS Z, CAST(radius AS DOUBLE) AS radius FROM {_PROPS}) USING (element)),
    m AS (SELECT *, sum(w * Z) OVER p AS zm, sum(w * radius) OVER p / sum(CASE WHEN radius IS NOT NULL THEN w END) OVER p AS rm FROM w WINDOW p AS (PARTITION BY p_partkey))
    SELECT p_partkey, count(*) AS n_elements, round(max(CASE WHEN element = 'Li' THEN w END), 6) AS Li_frac,
      round(max(zm), 6) AS Z_mean, round(sqrt(sum(w * (Z - zm) * (Z - zm))), 6) AS Z_std, round(min(Z), 6) AS Z_min, round(max(Z), 6) AS Z_max, round(max(Z) - min(Z), 6) AS Z_range,
      round(max(rm), 6) AS radius_mean, round(sqrt(sum(w * (radius - rm) * (radius - rm)) / sum(CASE WHEN radius IS NOT NULL THEN w END)), 6) AS radius_std,
      round(min(radius), 6) AS radius_min, round(max(radius), 6) AS radius_max, round(max(radius) - min(radius), 6) AS radius_range
    FROM m GROUP BY p_partkey"""
)
def composition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = composition.parse_formulas(_formulas(spark, sf_dir))
    props = spark.sql(f"SELECT element, CAST(Z AS DOUBLE) AS Z, CAST(radius AS DOUBLE) AS radius FROM {_PROPS}")
    out = composition.composition_features(good, props, "p_partkey", ("Z", "radius"))
    return out.select("p_partkey", "n_elements", *[r6(c).alias(c) for c in out.columns[2:]])


#: The last three are dropped for too few elements, for a redox metal and for hydrogen.
_FAMILIES = (
    ("Li6PS5Cl", "argyrodites"), ("Li10Ge(PS6)2", "LGPS"), ("Li4SnS4", "thio-LISICON"), ("Li3PS4", "sulfides"), ("Na3PS4", "unknown"), ("LiCoO2", "unknown"),
    ("Li2S", "unknown"), ("Li3CuS2", "unknown"), ("LiPH21S3N7", "unknown"),
)


def _made(n: int) -> str:
    return f"CASE p_partkey % 9 {' '.join(f'WHEN {k} THEN {chr(39)}{x[n]}{chr(39)}' for k, x in enumerate(_FAMILIES))} END"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates: a formula, and hull energy and gap from whole numbers."""
    part = table(spark, sf_dir, "part")
    raw = part.select(F.col("p_partkey").alias("material_id"), F.expr(_made(0)).alias("formula"), (F.col("p_size") / 500).alias("e_above_hull"), (F.col("p_partkey") % 40 / 10).alias("band_gap"))
    good, _ = composition.parse_formulas(raw)
    return good


@query(f"SELECT p_partkey AS material_id, {_made(0)} AS formula, {_made(1)} AS Family FROM part")
def family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assign_family(_candidates(spark, sf_dir)).select("material_id", "formula", "Family")


_POOL = f"(SELECT p_partkey AS id, {_made(0)} AS f, p_partkey % 9 AS k, p_size / 500.0 AS hull, p_partkey % 40 / 10.0 AS gap FROM part)"


@query(
    f"""SELECT u.step AS step, u.stage AS stage, u.n AS n_candidates, u.d AS dropped FROM
    (SELECT count(*) AS a, count(*) FILTER (k NOT IN (4, 5)) AS b, count(*) FILTER (k NOT IN (4, 5, 8)) AS c, count(*) FILTER (k NOT IN (4, 5, 6, 8)) AS d,
      count(*) FILTER (k NOT IN (4, 5, 6, 8) AND hull <= 0.05) AS e, count(*) FILTER (k NOT IN (4, 5, 6, 8) AND hull <= 0.05 AND gap >= 1.5) AS f,
      count(*) FILTER (k < 4 AND hull <= 0.05 AND gap >= 1.5) AS g FROM {_POOL}),
    LATERAL (VALUES (0, 'all', a, 0), (1, 'include', b, a - b), (2, 'exclude', c, b - c), (3, 'n_elements', d, c - d), (4, 'hull', e, d - e), (5, 'gap', f, e - f), (6, 'flagged', g, f - g)) AS u(step, stage, n, d)"""
)
def redox_flag_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.ScreenFilter().funnel(_candidates(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT {_made(1)} AS Family FROM {_POOL} JOIN part ON p_partkey = id WHERE k < 4 AND hull <= 0.05 AND gap >= 1.5)
    SELECT Family, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM c GROUP BY 1"""
)
def screen_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = screen.ScreenFilter().apply(_candidates(spark, sf_dir))
    return audit.coverage(rules.assign_family(left), "Family").withColumn("pct", r6("pct"))


@query(
    """WITH t AS (SELECT p_partkey, 12 * (1 + p_partkey % 4) AS a, 6 * (1 + p_size % 6) AS b, 4 * (1 + p_partkey % 9) AS c FROM part)
    SELECT p_partkey, gcd(gcd(a, b), c)::BIGINT AS factor, a / gcd(gcd(a, b), c) AS li FROM t"""
)
def formula_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "map('Li', CAST(12 * (1 + p_partkey % 4) AS DOUBLE), 'P', CAST(6 * (1 + p_size % 6) AS DOUBLE), 'S', CAST(4 * (1 + p_partkey % 9) AS DOUBLE))"
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(made).alias("amounts")).withColumn("factor", composition.common_factor(F.col("amounts")))
    li = F.filter(composition.reduced(F.col("amounts"), F.col("factor")), lambda x: x["key"] == "Li")[0]["value"]
    return part.select("p_partkey", "factor", li.alias("li"))


_TEMPLATES = (
    ("concat('[Li', {a}, '(PS4)', {b}, ']', {c}, '*', {a}, 'H2O')", "('Li', {a} * {c}), ('P', {b} * {c}), ('S', 4 * {b} * {c}), ('H', 2 * {a}), ('O', {a})", "0"),
    ("concat('{{Li', {a}, '[Ge(S', {b}, ')', {c}, ']2}}^', {b}, '-')", "('Li', {a}), ('Ge', 2), ('S', 2 * {b} * {c})", "-{b}"),
    ("concat({a}, 'Li2SO4\u00b7', {b}, 'H2O\u00b7', {c}, '.5NaCl')", "('Li', 2 * {a}), ('S', {a}), ('O', 4 * {a} + {b}), ('H', 2 * {b}), ('Na', {c} + 0.5), ('Cl', {c} + 0.5)", "0"),
    ("concat('[Fe(CN)', {a}, ']', {b}, '+')", "('Fe', 1), ('C', {a}), ('N', {a})", "{b}"),
)


def _template(n: int, wrap: str = "{}") -> str:
    names = {"a": _A, "b": _B, "c": _C}
    texts = {k: f"CAST({v} AS STRING)" for k, v in names.items()} if n == 0 else names
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {wrap.format(t[n].format(**texts))}" for k, t in enumerate(_TEMPLATES)) + " END"


@query(
    "SELECT p_partkey, u.element AS element, CAST(u.amount AS DOUBLE) AS amount, charge FROM ("
    + " UNION ALL ".join(
        f"SELECT p_partkey, element, amount, CAST({t[2].format(a=_A, b=_B, c=_C)} AS INTEGER) AS charge FROM part, LATERAL (VALUES {t[1].format(a=_A, b=_B, c=_C)}) AS v(element, amount) WHERE p_partkey % 4 = {k}"
        for k, t in enumerate(_TEMPLATES)
    )
    + ") AS u"
)
def formula_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and charges of formulas with all kinds of brackets, adducts and charges."""
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr(_template(0)).alias("formula"))
    good, _ = composition.parse_formulas(made)
    return good.select("p_partkey", F.explode("amounts").alias("element", "amount"), composition.charge(F.col("formula")).alias("charge"))


#: A formula in any order and multiple, and how it reads when reduced.
_WRITTEN = (("S{12}P{2}Ge{1}Li{10}", "Li10Ge(PS6)2"), ("Cl{1}S{5}(P{1}Li{6})", "Li6PS5Cl"), ("(PS4){4}Zn{3}[Li2]{3}", "Li6Zn3(PS4)4"), ("S{1}Li{2}", "Li2S"), ("O{2}Co{1}Li{1}", "LiCoO2"), ("O{1}", "O2"), ("Li0.5S", "Li0.5S"))


def _multiple(text: str) -> str:
    """SQL for the text with each number in curly brackets multiplied."""
    import re

    pieces = re.split(r"\{(\d+)\}", text)
    return "concat(" + ", ".join(f"'{x}'" if k % 2 == 0 else f"CAST({x} * (1 + p_size % 6) AS STRING)" for k, x in enumerate(pieces) if x) + ", '')"


@query(f"SELECT p_partkey, CASE p_partkey % {len(_WRITTEN)} {' '.join(f'WHEN {k} THEN {chr(39)}{x[1]}{chr(39)}' for k, x in enumerate(_WRITTEN))} END AS reduced FROM part")
def reduced_formula_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced formulas, as text, of formulas written in another order and multiple."""
    made = f"CASE p_partkey % {len(_WRITTEN)} {' '.join(f'WHEN {k} THEN {_multiple(x[0])}' for k, x in enumerate(_WRITTEN))} END"
    good, _ = composition.parse_formulas(table(spark, sf_dir, "part").select("p_partkey", F.expr(made).alias("formula")))
    return good.select("p_partkey", composition.reduced_formula(F.col("amounts"), composition.negativities(element_props(spark))).alias("reduced"))


# ---- screening and ranking

_SCORED = "SELECT l_partkey AS material_id, count(*) AS n, round(sum(l_quantity), 2) AS pred FROM lineitem GROUP BY 1"


@query(
    f"""SELECT material_id, p_size, pred FROM ({_SCORED}) JOIN part ON p_partkey = material_id
    WHERE p_size BETWEEN 5 AND 25 AND p_retailprice >= 500 ORDER BY pred DESC, material_id LIMIT 50"""
)
def candidate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material_id"), "p_size", "p_retailprice").where("p_size BETWEEN 5 AND 25 AND p_retailprice >= 500")
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("material_id")).agg(F.round(F.sum("l_quantity"), 2).alias("pred"))
    return screen.top_list(scored.join(part, "material_id"), 50, dedupe=None).select("material_id", "p_size", "pred")


_BEST = "SELECT p_partkey AS material_id, p_brand AS formula, p_retailprice AS pred FROM part"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material_id"), F.col("p_brand").alias("formula"), F.col("p_retailprice").alias("pred"))


_FIRST = "QUALIFY row_number() OVER (PARTITION BY formula ORDER BY pred DESC, material_id) = 1"


@query(f"SELECT * FROM ({_BEST}) {_FIRST}")
def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.best_of_each(_priced(spark, sf_dir), "formula", "pred", "material_id")


@query(f"SELECT * FROM (SELECT * FROM ({_BEST}) ORDER BY pred DESC, material_id LIMIT 20) {_FIRST}")
def limit_then_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.top_list(_priced(spark, sf_dir), 20, dedupe="after")


@query(f"SELECT * FROM (SELECT * FROM ({_BEST}) {_FIRST}) ORDER BY pred DESC, material_id LIMIT 20")
def dedupe_then_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.top_list(_priced(spark, sf_dir), 20, dedupe="before")


@query(f"SELECT material_id, pred, row_number() OVER (ORDER BY pred DESC, material_id) - 1 AS rank FROM ({_BEST})")
def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.with_rank(_priced(spark, sf_dir), "pred", "material_id").select("material_id", "pred", "rank")


# ---- evaluation

_PAIR = "SELECT l_orderkey, l_partkey, l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 AS pred FROM lineitem"
_METRICS = "count(*) AS n, round(avg(abs(pred - y)), 4) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse, round(1 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)), 6) AS r2"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"))


def _rounded(df: DataFrame, names: tuple[str, ...], digits: dict[str, int] | None = None) -> DataFrame:
    return df.withColumns({c: F.round(c, (digits or {}).get(c, 6 if c.startswith("r2") else 4)) for c in names})


@query(f"SELECT {_METRICS} FROM ({_PAIR})")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(_pairs(spark, sf_dir), "y", "pred"), ("mae", "rmse", "r2"))


@query(f"SELECT l_returnflag, {_METRICS} FROM ({_PAIR}) GROUP BY 1")
def metrics_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(_pairs(spark, sf_dir), "y", "pred", ["l_returnflag"]), ("mae", "rmse", "r2"))


@query(
    f"""WITH f AS (SELECT l_orderkey % 5 AS fold, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, 1 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)) AS r2 FROM ({_PAIR}) GROUP BY 1)
    SELECT round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std_samp, round(avg(rmse), 4) AS rmse_mean, round(stddev_samp(rmse), 4) AS rmse_std_samp,
      round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std_samp FROM f"""
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _pairs(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    out = metrics.fold_summary(metrics.regression_metrics(folds, "y", "pred", ["fold"]))
    return _rounded(out, tuple(out.columns))


@query("SELECT p_brand, round(median(p_retailprice), 6) AS median FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def group_median_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_median(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 10).withColumn("median", r6("median"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS ens_mean, round(stddev_pop(l_quantity), 6) AS ens_std FROM lineitem GROUP BY 1")
def ensemble_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.ensemble_spread(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")
    return out.select("l_partkey", r6("ens_mean").alias("ens_mean"), r6("ens_std").alias("ens_std"))


@query(
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM lineitem),
    b AS (SELECT greatest(len(list_filter(edges, lambda x: x < l_quantity)) - 1, 0)::INT AS bin, l_quantity AS sd, l_discount AS err FROM lineitem, e)
    SELECT bin, round(avg(sd), 6) AS mean_std, round(sqrt(avg(err * err)), 6) AS rmse, count(*) AS n FROM b GROUP BY 1"""
)
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return out.select("bin", r6("mean_std").alias("mean_std"), r6("rmse").alias("rmse"), "n")


@query("SELECT s_suppkey, round(100.0 * (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) / (SELECT count(*) FROM customer), 6) AS percentile FROM supplier")
def pool_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    pool = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"))
    return metrics.pool_percentile(leads, pool, "v").select("s_suppkey", r6("percentile").alias("percentile"))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    ranked = metrics.average_rank(metrics.average_rank(rows, "a", "ra"), "b", "rb")
    return ranked.agg(r6(F.corr("ra", "rb")).alias("rho"))


@query(
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT least(floor((o_totalprice - lo) / (hi - lo) * 30)::INT + 1, 30) AS bucket, count(*) AS n FROM orders, e GROUP BY 1"""
)
def histogram_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1),
    b AS (SELECT event_id, event_type, n, lo, hi, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 100), 99) ELSE 0 END AS bin FROM events JOIN e USING (event_type)),
    s AS (SELECT event_id, lo, hi, row_number() OVER (PARTITION BY event_type, bin ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type, bin) AS k,
            0.42 * least(1.0, count(*) OVER (PARTITION BY event_type, bin) / (0.03 * n + 1)) AS spread FROM b)
    SELECT event_id, round(CASE WHEN k > 1 AND hi > lo THEN -spread + i * (2 * spread / (k - 1)) ELSE 0 END, 6) + 0.0 AS "offset" FROM s"""
)
def density_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.density_offsets(table(spark, sf_dir, "events"), "event_type", "value", "event_id")
    return out.select("event_id", (r6("offset") + 0.0).alias("offset"))


@query(
    """WITH e AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1)
    SELECT event_id, round(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (value - lo) / (hi - lo))) ELSE 0.5 END, 6) AS scaled FROM events JOIN e USING (event_type)"""
)
def clip_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.clip_normalised(table(spark, sf_dir, "events"), "event_type", "value").select("event_id", r6("scaled").alias("scaled"))


@query("SELECT floor((min(o_totalprice) - 0.4) * 2) / 2 AS label_floor, min(o_totalprice) - 0.5 AS axis_low, max(o_totalprice) + 0.5 AS axis_high FROM orders")
def axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.axis_stats(table(spark, sf_dir, "orders"), "o_totalprice")


# ---- reports


@query("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(table(spark, sf_dir, "orders"), "o_orderpriority").withColumn("pct", r6("pct"))


_CATEGORIES = "(VALUES ('view', 'seen', 0), ('click', 'clicked', 1), ('purchase_kept', 'bought', 2), ('refund', 'returned', 3)) AS t(category, label, position)"


@query(
    f"""SELECT category, label, position, coalesce(n, 0) AS n, ends_with(category, '_kept') AS kept FROM {_CATEGORIES}
    LEFT JOIN (SELECT CASE WHEN event_type = 'purchase' THEN 'purchase_kept' ELSE event_type END AS category, count(*) AS n FROM events GROUP BY 1) USING (category)"""
)
def audit_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "purchase_kept").otherwise(F.col("event_type")).alias("category"))
    return audit.verdict_counts(named, spark.sql(f"SELECT * FROM {_CATEGORIES}"))


@query(
    """WITH m AS (SELECT user_id AS label, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS sigma FROM events GROUP BY 1)
    SELECT c_custkey, sigma AS sigma300_mS_cm, coalesce(sigma >= 1.0, false) AS good FROM customer LEFT JOIN m ON label = c_custkey"""
)
def lead_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(k).alias("sigma300_mS_cm"))
    leads = table(spark, sf_dir, "customer").select("c_custkey")
    return audit.with_metrics(leads, found, "c_custkey").select("c_custkey", "sigma300_mS_cm", "good")


@query("SELECT c_custkey AS id, c_acctbal AS ens_mean, 'mp' AS kind, NULL::VARCHAR AS label FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'lead', s_name FROM supplier")
def risk_map_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("ens_mean"))
    leads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("ens_mean"), F.col("s_name").alias("label"))
    return audit.risk_map(pool, leads)


_NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'X_mean' WHEN 1 THEN 'spacegroup_no' WHEN 2 THEN 'radius_range' WHEN 3 THEN 'other' WHEN 4 THEN 'mendeleev_std' WHEN 5 THEN 'n_elements' WHEN 6 THEN 'alpha' WHEN 7 THEN 'Family' ELSE 'Z' END"


@query(
    f"""SELECT p_partkey, CASE {_NAMES} WHEN 'X_mean' THEN 'Electronegativity (mean)' WHEN 'spacegroup_no' THEN 'Space-group no.' WHEN 'radius_range' THEN 'Atomic radius (range)'
    WHEN 'Z' THEN 'Formula units (Z)' WHEN 'mendeleev_std' THEN 'Mendeleev number (SD)' WHEN 'n_elements' THEN 'No. of elements' WHEN 'alpha' THEN 'Angle α' WHEN 'Family' THEN 'Structural family' ELSE 'other' END AS label FROM part"""
)
def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.feature_label(F.expr(_NAMES)).alias("label"))


@query(f"SELECT p_partkey, regexp_replace({_FORMULA}, '([0-9]+)', '$_{{\\1}}$', 'g') AS shown FROM part")
def subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("p_partkey", parse.subscripts(F.col("formula")).alias("shown"))


@query("SELECT p_partkey, printf('%.1e', p_size * 1.0) AS shown FROM part")
def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.scientific(F.col("p_size").cast("double")).alias("shown"))


@query(
    """WITH p AS (SELECT unnest(range(len(embedding))) AS k, unnest(embedding) AS phi FROM embeddings)
    SELECT concat('f', k) AS feature, round(avg(abs(phi)), 6) AS mean_abs FROM p GROUP BY 1 ORDER BY avg(abs(phi)) DESC, 1 LIMIT 15"""
)
def mean_abs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("k", "phi")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), F.col("phi").cast("double").alias("phi"))
    return metrics.top_features(phi).select("feature", r6("mean_abs").alias("mean_abs"))


@query("SELECT round(max(abs(l_extendedprice - l_quantity * 1500.0)), 4) AS max_abs_diff FROM lineitem")
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.disagreement(_pairs(spark, sf_dir), "y", "pred").select(F.round("max_abs_diff", 4).alias("max_abs_diff"))


# ---- sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the tables that ``kept`` writes."""
    import uuid

    spark.range(1).transform(kept)
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LINE = """CASE p_partkey % 6 WHEN 0 THEN concat(p_partkey, ',1e-3,Li2S') WHEN 1 THEN concat(p_partkey, ',1e-3,Li2S,,,,,,,,,,,,') WHEN 2 THEN concat('no ', p_partkey, ',<1e-10,Li2S,,1,2,3,90,90,90,2,4,x')
    WHEN 3 THEN concat(p_partkey, ',1e-3,"Li2,S",,1,2,wide,90,90,90,2,4,x') WHEN 4 THEN concat(p_partkey, ',1e-3,"Li2,S",,1,2,3,90,90,90,', p_size, ',4,x') ELSE concat(p_partkey, ',,,Li2S,,,,,,,,,') END"""


@query("SELECT CASE WHEN p_partkey % 6 < 2 THEN 'columns' WHEN p_partkey % 6 < 4 THEN 'type' ELSE 'read' END AS reason, count(*) AS n, coalesce(sum(CASE p_partkey % 6 WHEN 4 THEN p_size END), 0)::BIGINT AS groups FROM part GROUP BY 1")
def corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV files that were read, and those that were not by reason."""
    folder = _folder(spark, "lines")
    table(spark, sf_dir, "part").select(F.expr(_LINE).alias("line")).write.text(folder)
    good, bad = tables.read_checked(spark, folder, header=False)
    count = lambda df, reason, number: df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("long").alias("groups"))
    return count(good, F.lit("read"), F.col("spacegroup_no")).union(count(bad, F.col("reason"), F.lit(0)))


@query("SELECT p_partkey, p_size * 2 AS p_size, 2 AS version FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size, 1 FROM part")
def versioned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table, and the version that was made from itself; both read again."""
    path = f"{_folder(spark, 'results')}/pool"
    versions.write_version(table(spark, sf_dir, "part").select("p_partkey", "p_size"), path)
    versions.write_version(versions.read_version(spark, path).where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") * 2), path)
    return versions.read_version(spark, path).withColumn("version", F.lit(2)).union(versions.read_version(spark, path, 1).withColumn("version", F.lit(1)))


@query(
    """SELECT p_partkey AS material_id, e_above_hull FROM (SELECT p_partkey, p_size / 500.0 AS e_above_hull, p_partkey % 9 AS k, p_partkey % 40 / 10.0 AS gap FROM part)
    WHERE k < 4 AND e_above_hull <= 0.05 AND gap >= 1.5"""
)
def screen_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written in folders by their elements, and screened from these."""
    path = f"{_folder(spark, 'candidates')}/pool"
    lattice = F.expr("named_struct('a', 1D, 'b', 1D, 'c', 1D, 'alpha', 90D, 'beta', 90D, 'gamma', 90D)")
    made = _candidates(spark, sf_dir).withColumns({"material_id": F.col("material_id").cast("string"), "spacegroup_no": F.lit(1), "z_factor": F.lit(1), "lattice": lattice}).drop("amounts")
    tables.write_candidates(made, path)
    return screen.ScreenFilter().apply(tables.read_candidates(spark, path)).select(F.col("material_id").cast("long").alias("material_id"), "e_above_hull")


@query("SELECT l_returnflag, share, true AS within, n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest([0.05, 0.25, 0.5, 0.95]) AS share)")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by sketches of each month, merged by flag; whether each one's rank is within 2 in 100 of its share."""
    shares = [0.05, 0.25, 0.5, 0.95]
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.month("l_shipdate").alias("m"), F.col("l_extendedprice").cast("double").alias("v"))
    monthly = kept(sketches.sketched(lines, "v", ("l_returnflag", "m")))
    found = sketches.quantiles_of(sketches.merged(monthly, ("l_returnflag",)), shares, ("l_returnflag",))
    each = found.select("l_returnflag", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), "quantiles")).alias("x")).select("l_returnflag", "n", "x.share", F.col("x.quantiles").alias("q"))
    ranks = lines.join(F.broadcast(each), "l_returnflag").groupBy("l_returnflag", "share", "n").agg((F.count_if(F.col("v") < F.col("q")) / F.col("n")).alias("below"), (F.count_if(F.col("v") <= F.col("q")) / F.col("n")).alias("upto"))
    return ranks.select("l_returnflag", "share", ((F.col("below") <= F.col("share") + 0.02) & (F.col("upto") >= F.col("share") - 0.02)).alias("within"), "n")


# ---- categories by their target

_ORDERS = "SELECT o_orderkey, o_orderpriority AS c, CAST(o_totalprice AS DOUBLE) AS y FROM orders"


@query(
    f"""WITH o AS ({_ORDERS}), m AS (SELECT avg(y) AS prior FROM o)
    SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + prior) / (count(*) OVER w + 1), 2) AS encoded FROM o, m
    WINDOW w AS (PARTITION BY c ORDER BY md5(concat(o_orderkey, ':0')), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def ordered_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priority by what earlier orders of that priority cost, earlier in a shuffled order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("c"), F.col("o_totalprice").cast("double").alias("y"))
    return encoding.ordered_statistics(orders, "c", "y", "o_orderkey", out="encoded").select("o_orderkey", F.round("encoded", 2).alias("encoded"))


@query(
    """WITH t AS (SELECT p_brand AS c, CAST(p_retailprice AS DOUBLE) AS y FROM part WHERE p_partkey % 5 <> 0 AND p_size % 7 <> 3), m AS (SELECT avg(y) AS prior FROM t),
    s AS (SELECT c, (sum(y) + 2 * any_value(prior)) / (count(*) + 2) AS mean FROM t, m GROUP BY 1)
    SELECT p_partkey, round(coalesce(mean, prior), 2) AS encoded FROM part LEFT JOIN s ON c = p_brand, m WHERE p_partkey % 5 = 0"""
)
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out parts' brands by the mean price of the brand among the others."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("c"), F.col("p_retailprice").cast("double").alias("y"))
    means, base = encoding.statistics(part.where("p_partkey % 5 <> 0 AND p_size % 7 <> 3"), "c", "y", weight=2.0, out="encoded")
    return encoding.encoded(part.where("p_partkey % 5 = 0"), means, "c", base).select("p_partkey", F.round("encoded", 2).alias("encoded"))


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY md5(concat(o_orderkey, ':0')), o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def even_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven folds of the orders whose sizes differ by one at most."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return metrics.even_folds(orders, "o_orderkey", 7, order=encoding.shuffled("o_orderkey"))


# ---- models: rows only, as SQL cannot train

_FEATURES = model.Features(("p_size", "p_retailprice", "n", "discount"), ("p_brand",))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part: what it sold for, from its own columns and its orders."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_discount").alias("discount"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand")
    rows = part.join(lines, part["id"] == lines["l_partkey"]).withColumn("y", F.log10("y"))
    return kept(model.align_features(rows, _FEATURES, ("id", "y")).withColumn("fold", metrics.hashed_fold(F.col("id"))))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("fold <> 0"), rows.where("fold = 0")


@query()
def forest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(_training(spark, sf_dir))
    return model.holdout_metrics(model.forest(_FEATURES, trees=20, depth=5).fit(train), test)


@query()
def boosted_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(_training(spark, sf_dir))
    return model.holdout_metrics(model.boosted(_FEATURES, trees=8, depth=4, rate=0.3).fit(train), test)


@query()
def cv_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    return model.cross_validate(rows, lambda: model.forest(_FEATURES, trees=10, depth=4), k=5)[1]


def _boosted(rows: DataFrame, seed: int = 1, share: float = 1.0) -> Pipeline:
    return model.boosted(_FEATURES, trees=6, depth=4, rate=0.3, seed=seed, share=share)


@query()
def seed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(_training(spark, sf_dir))
    models = model.fit_ensemble(train, lambda s: _boosted(train, s, 0.8), seeds=(0, 1, 2))
    return model.score_ensemble(models, test, ("id", "y")).select("id", "y", "ens_mean", "ens_std")


@query()
def score_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    train, _ = _split(rows)
    scored = model.score(_boosted(train).fit(train), rows)
    return screen.with_rank(scored.select("id", "pred", "pred_sigma"), "pred", "id")


def _explained(spark: SparkSession, sf_dir: str, held_out: bool):
    """The rows that were held out, or all rows, with their feature vectors, and the paths of a model of the training rows."""
    import uuid

    rows = _training(spark, sf_dir)
    train, test = _split(rows)
    fitted = _boosted(train).fit(train)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    place = f"{base}/tree-model-{uuid.uuid4().hex}"
    fitted.stages[-1].write().overwrite().save(place)
    paths, weights = attribution.tree_paths(spark, place)
    prepared = fitted.transform(test if held_out else rows)
    return prepared, paths, weights, model.players(prepared, _FEATURES)


@query()
def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, paths, weights, names = _explained(spark, sf_dir, held_out=False)
    return attribution.attribute(prepared, paths, weights, names)


@query()
def virtual_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, paths, weights, _ = _explained(spark, sf_dir, held_out=True)
    return attribution.virtual_ensemble(prepared, paths, weights, 4)
