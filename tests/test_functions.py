import math

import pytest
from pyspark.sql import functions as F

from siftlode.functions import composition, parse, rules


def test_measured_values(spark):
    raw = ["1.2E-3", "<1E-10", "> 5e-4", "~1e-6", "=2e-5", " 3 E-4 ", "abc", "", "0", "-1", None, "1.0d", "inf"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "id int, raw string")
    every = {r["id"]: (r["s"], r["c"]) for r in df.select("id", parse.measured(F.col("raw")).alias("s"), parse.censored(F.col("raw")).alias("c")).collect()}
    assert every[1] == (1e-10, 1) and every[2] == (5e-4, 1) and every[3] == (1e-6, 0) and every[5] == (3e-4, 0)
    assert every[6] == (None, 0) and every[7] == (None, 0) and every[10] == (None, 0) and every[11][0] is None and every[12][0] is None
    kept = parse.parse_measurements(df, "raw").orderBy("id").collect()
    assert [r["id"] for r in kept] == [0, 1, 2, 3, 4, 5]
    assert kept[0]["y"] == pytest.approx(math.log10(1.2e-3))


def test_crystal_systems(spark):
    edges = {1: "triclinic", 2: "triclinic", 3: "monoclinic", 15: "monoclinic", 16: "orthorhombic", 74: "orthorhombic", 75: "tetragonal", 142: "tetragonal", 143: "trigonal", 167: "trigonal", 168: "hexagonal", 194: "hexagonal", 195: "cubic", 230: "cubic", 231: "unknown", None: "unknown"}
    df = spark.createDataFrame([(k, v) for k, v in edges.items()], "n int, want string")
    assert df.where(parse.crystal_system(F.col("n")) != F.col("want")).count() == 0


def test_cell_volume(spark):
    df = spark.createDataFrame([(9.86, 9.86, 9.86, 90.0, 90.0, 90.0, 1), (12.50, 6.03, 12.53, 102.0, 113.0, 74.0, 2)], "a double, b double, c double, alpha double, beta double, gamma double, spacegroup_no int")
    got = [r[0] for r in parse.crystal_features(df).select("cell_volume").collect()]
    assert got == pytest.approx([958.585256, 830.315049916], abs=1e-5)


def test_labels_and_subscripts(spark):
    df = spark.createDataFrame([("X_mean", "Electronegativity (mean)"), ("spacegroup_no", "Space-group no."), ("odd_name", "odd_name"), ("Z", "Formula units (Z)"), ("Z_std", "Atomic number (SD)"), ("row_min", "Periodic row (min)"), ("beta", "Angle β"), ("Z_max", "Atomic number (max)")], "n string, want string")
    assert df.where(parse.feature_label(F.col("n")) != F.col("want")).count() == 0
    one = spark.createDataFrame([("Li10Ge(PS6)2", 0.0067)], "f string, v double").select(parse.subscripts(F.col("f")), parse.scientific(F.col("v"))).first()
    assert tuple(one) == ("Li$_{10}$Ge(PS$_{6}$)$_{2}$", "6.7e-03")


def amounts(spark, formulas):
    df = spark.createDataFrame([(f,) for f in formulas], "f string").withColumn("a", composition.amounts(F.col("f")))
    return {r["f"]: r["a"] for r in df.collect()}


def test_formula_amounts(spark):
    got = amounts(spark, ["Li6PS5Cl", "Li10Ge(PS6)2", "A(B", "Li6Zn3(PS4)4", "Li0.5S", "Li3SbS4*9H2O", "", "Xx2", "K(Li(PS2)2)3", "LiSLi", ")Li(", None])
    assert got["Li6PS5Cl"] == {"Li": 6, "P": 1, "S": 5, "Cl": 1}
    assert got["Li10Ge(PS6)2"] == {"Li": 10, "Ge": 1, "P": 2, "S": 12}
    assert got["Li6Zn3(PS4)4"] == {"Li": 6, "Zn": 3, "P": 4, "S": 16}
    assert got["K(Li(PS2)2)3"] == {"K": 1, "Li": 3, "P": 6, "S": 12}
    assert got["LiSLi"] == {"Li": 2, "S": 1} and got["Li0.5S"] == {"Li": 0.5, "S": 1}
    assert all(got[x] is None for x in ("A(B", "", "Xx2", ")Li(", None))
    assert got["Li3SbS4*9H2O"] == {"Li": 3, "Sb": 1, "S": 4, "H": 18, "O": 9}


def test_brackets_adducts_and_charges(spark):
    got = amounts(spark, ["[Li2{P(S2)2}3]2", "2CaSO4\u00b7H2O", "Li2S\u22190.5H2O*2LiCl", "SO4^2-", "SO4 2-", "[Fe(CN)6]4-", "Li+", "Fe2+", "O--", "PS4^3-*2H2O", "[Li)", "(Li]", "{Li2S", "Li2S*", "*Li2S", "2Li2S", "Li2S*.H2O", "Li2S**H2O", "+", "Li ", "(2Li)"])
    assert got["[Li2{P(S2)2}3]2"] == {"Li": 4, "P": 6, "S": 24}
    assert got["2CaSO4\u00b7H2O"] == {"Ca": 2, "S": 2, "O": 9, "H": 2}
    assert got["Li2S\u22190.5H2O*2LiCl"] == {"Li": 4, "S": 1, "H": 1, "O": 0.5, "Cl": 2}
    assert got["SO4^2-"] == got["SO4 2-"] == {"S": 1, "O": 4}
    assert got["[Fe(CN)6]4-"] == {"Fe": 1, "C": 6, "N": 6} and got["Li+"] == {"Li": 1} and got["Fe2+"] == {"Fe": 2} and got["O--"] == {"O": 1}
    assert all(got[x] is None for x in ("PS4^3-*2H2O", "[Li)", "(Li]", "{Li2S", "Li2S*", "*Li2S", "2Li2S", "Li2S*.H2O", "Li2S**H2O", "+", "Li ", "(2Li)"))
    want = {"SO4^2-": -2, "SO4 2-": -2, "[Fe(CN)6]4-": -4, "[Fe(CN)6]4": 0, "Li+": 1, "Fe2+": 1, "O--": -2, "Li2S": 0, "PS4^-": -1, "": 0}
    df = spark.createDataFrame(list(want.items()), "f string, want int")
    assert df.where(~composition.charge(F.col("f")).eqNullSafe(F.col("want"))).count() == 0


def test_reduced_formula_texts(spark):
    from siftlode.sources.tables import element_props

    want = {
        "Li10Ge(PS6)2": "Li10Ge(PS6)2", "GeS12P2Li10": "Li10Ge(PS6)2", "S32P8Zn6Li12": "Li6Zn3(PS4)4", "Cl2S10P2Li12": "Li6PS5Cl", "Li6P2S8": "Li3PS4", "S2Li4": "Li2S", "Li0.5S": "Li0.5S",
        "Li2O2": "Li2O2", "O6": "O2", "Li1.5P0.5S2": "Li1.5P0.5S2", "CoLiO2": "LiCoO2", "Li4GeS4": "Li4GeS4", "Li0S": "S",
        "Pb2(SO4)2": "SO4Pb",  # lead's electronegativity is not in the built-in table, so it comes last
    }
    good, _ = composition.parse_formulas(spark.createDataFrame([(f,) for f in want], "formula string"))
    got = {r["formula"]: r["text"] for r in good.select("formula", composition.reduced_formula(F.col("amounts"), composition.negativities(element_props(spark))).alias("text")).collect()}
    assert got == want
    assert spark.sql("SELECT cast(map() AS map<string,double>) AS m").select(composition.reduced_formula(F.col("m"), composition.negativities(element_props(spark)))).first()[0] == ""


def test_formulas_are_parsed_in_a_table_of_their_own(spark):
    from siftlode.plans import queries

    plan = queries.screen_coverage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_quarantine_keeps_bad_rows(spark):
    df = spark.createDataFrame([(1, "Li2S"), (2, "??"), (3, None), (4, "Li2S")], "id int, formula string")
    good, bad = composition.parse_formulas(df)
    assert sorted(r["id"] for r in good.collect()) == [1, 4] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_composition_statistics(spark):
    df = spark.createDataFrame([(1, "Li6PS5Cl"), (2, "S")], "id int, formula string")
    good, _ = composition.parse_formulas(df)
    props = spark.createDataFrame([("Li", 3.0, None), ("P", 15.0, 2.0), ("S", 16.0, 1.0), ("Cl", 17.0, None)], "element string, Z double, radius double")
    r = {x["id"]: x for x in composition.composition_features(good, props, "id", ("Z", "radius")).collect()}
    one = r[1]
    assert (one["n_elements"], one["Z_mean"], one["Z_min"], one["Z_max"], one["Z_range"]) == (4, pytest.approx(10), 3, 17, 14)
    assert one["Z_std"] == pytest.approx(6.492599337233598) and one["Li_frac"] == pytest.approx(6 / 13)
    assert one["radius_mean"] == pytest.approx((2 + 5) / 6) and r[2]["Z_std"] == 0 and r[2]["Li_frac"] == 0


def test_factor(spark):
    df = spark.createDataFrame([({"Li": 40.0, "Ge": 4.0, "P": 8.0, "S": 48.0}, 4), ({"Li": 3.0, "P": 1.0}, 1)], "a map<string,double>, want int")
    assert df.where(composition.common_factor(F.col("a")) != F.col("want")).count() == 0


def test_factor_of_amounts_that_take_many_steps(spark):
    fibonacci = [1, 1]
    while len(fibonacci) < 78:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases = [({"Li": float(a), "S": float(b)}, 1) for a, b in zip(fibonacci, fibonacci[1:])]
    cases += [({"Li": float(a), "S": float(b), "P": float(c)}, math.gcd(a, b, c)) for a in range(0, 50, 3) for b in range(50) for c in (0, 6, 35, 48)]
    cases += [({"Li": -4.0, "S": 6.0, "P": None}, 6), ({"Li": 2.0**52, "S": 2.0**30 * 3}, 2**30), ({}, 1), (None, 1)]
    df = spark.createDataFrame([(a, max(n, 1)) for a, n in cases], "a map<string,double>, want long")
    assert df.where(~composition.common_factor(F.col("a")).eqNullSafe(F.col("want"))).count() == 0


def test_each_factor_is_computed_once(spark):
    from siftlode.plans import queries

    plan = queries.formula_factor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1  # as many steps as the amounts need; a fixed number stands there as a literal
    text = spark.createDataFrame([({"Li": 4.0},)], "a map<string,double>").select(composition.reduced_formula(F.col("a"), F.create_map(F.lit("Li"), F.lit(1.0))).alias("t"))
    assert text._jdf.queryExecution().analyzed().toString().count("sequence(") == 2  # of all amounts, and of the anion's


def test_families(spark):
    want = {"Li6PS5Cl": "argyrodites", "Li10Ge(PS6)2": "LGPS", "Li4SnS4": "thio-LISICON", "Li3PS4": "sulfides", "Na3PS4": "unknown", "LiCoO2": "unknown", "Li7PS2Cl4": "unknown", "Li2S": "unknown"}
    good, _ = composition.parse_formulas(spark.createDataFrame([(f,) for f in want], "formula string"))
    got = {r["formula"]: r["Family"] for r in rules.assign_family(good).collect()}
    assert got == want
    flagged = {r["formula"] for r in good.where(rules.flag_elements(F.col("elements"))).collect()}
    assert flagged == {"LiCoO2"}
