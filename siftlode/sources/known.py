"""Small tables of fixed values: materials whose answer is known, and hits that were audited by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Label, formula, cell lengths and angles, space group, formula units, noted conductivity.
KNOWN = (
    ("Li6PS5Cl", "Li6PS5Cl", 9.86, 9.86, 9.86, 90.0, 90.0, 90.0, 216, 4, "~1e-3"),
    ("Li6PS5Br", "Li6PS5Br", 9.98, 9.98, 9.98, 90.0, 90.0, 90.0, 216, 4, "~1e-3"),
    ("Li6PS5I", "Li6PS5I", 10.14, 10.14, 10.14, 90.0, 90.0, 90.0, 216, 4, "~1e-6"),
    ("Li10GeP2S12", "Li10GeP2S12", 8.69, 8.69, 12.63, 90.0, 90.0, 90.0, 137, 2, "~1e-2"),
    ("Li10SnP2S12", "Li10SnP2S12", 8.74, 8.74, 12.76, 90.0, 90.0, 90.0, 137, 2, "~4e-3"),
    ("b-Li3PS4", "Li3PS4", 12.82, 8.22, 6.12, 90.0, 90.0, 90.0, 62, 4, "~1e-4"),
    ("Li7P3S11", "Li7P3S11", 12.50, 6.03, 12.53, 102.0, 113.0, 74.0, 2, 2, "~1e-2"),
    ("Li4GeS4", "Li4GeS4", 14.05, 7.76, 6.13, 90.0, 90.0, 90.0, 62, 4, "~1e-7"),
    ("Li2S", "Li2S", 5.71, 5.71, 5.71, 90.0, 90.0, 90.0, 225, 4, "~1e-13"),
)
#: Identifier, formula and verdict of the hits audited by hand.
AUDITED = (
    ("mp-696128", "Li10Ge(PS6)2", "true_positive_kept"),
    ("mp-696129", "Li10Si(PS6)2", "true_positive_kept"),
    ("mp-696123", "Li10Sn(PS6)2", "true_positive_kept"),
    ("mp-696138", "Li10Ge(PS6)2 (P1)", "true_positive_kept"),
    ("mp-720509", "Li10Si(PS6)2 (P1)", "true_positive_kept"),
    ("mp-1040451", "Li20Si3P3S23Cl", "novel_lead_kept"),
    ("mp-753546", "Li8TiS6", "novel_lead_kept"),
    ("mp-756490", "Li6MnS4", "novel_redox_dropped"),
    ("mp-1153", "Li2S", "fp_binary_dropped"),
    ("mp-769032", "Li3NbS4", "fp_redox_cathode_dropped"),
    ("mp-753974", "Li8CrS6", "fp_redox_cathode_dropped"),
    ("mp-766506", "Li3CuS2", "fp_redox_cathode_dropped"),
    ("mp-777963", "Li3SbS4*9H2O", "artifact_H_dropped"),
    ("mp-740717", "Li(NH4)SO4", "artifact_H_dropped"),
    ("mp-760046", "LiPH21S3N7", "artifact_H_dropped"),
)
#: The verdicts in their order, with their labels.
VERDICTS = (
    ("true_positive_kept", "True positive (kept)"),
    ("novel_lead_kept", "Novel lead (kept)"),
    ("novel_redox_dropped", "Novel, redox risk (dropped)"),
    ("fp_redox_cathode_dropped", "False pos.: redox-TM / cathode (dropped)"),
    ("fp_binary_dropped", "False pos.: binary precursor (dropped)"),
    ("artifact_H_dropped", "Artifact: H-hydrate/oxysalt (dropped)"),
)


def known_materials(spark: SparkSession) -> DataFrame:
    """``label, formula``, the cell, ``spacegroup_no``, ``Z`` and ``note`` of nine materials, for ``known_answer_screen``."""
    return spark.createDataFrame(KNOWN, "label string, formula string, a double, b double, c double, alpha double, beta double, gamma double, spacegroup_no int, Z int, note string")


def audited_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AUDITED, "material_id string, formula string, category string")


def verdicts(spark: SparkSession) -> DataFrame:
    """``category, label, position``, for ``verdict_counts``."""
    return spark.createDataFrame([(c, label, k) for k, (c, label) in enumerate(VERDICTS)], "category string, label string, position int")
