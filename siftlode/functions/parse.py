"""Column expressions that clean raw measurements and describe unit cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: The last space group of each crystal system.
SYSTEMS = ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic"))


def measured(raw: Column) -> Column:
    """The number of a raw value such as ``<1E-10`` or ``~ 3e-4``; null if there is none."""
    text = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("")), "^[<>~=]+", "")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def censored(raw: Column) -> Column:
    """1 where the value is a bound: its first character is ``<`` or ``>``; else 0."""
    return F.coalesce(F.substring(F.trim(raw), 1, 1).isin("<", ">").cast("int"), F.lit(0))


def parse_measurements(df: DataFrame, raw_col: str) -> DataFrame:
    """``df`` with ``sigma``, ``censored`` and ``y`` = log10(sigma), rows with sigma > 0 only."""
    out = df.withColumn("sigma", measured(F.col(raw_col))).withColumn("censored", censored(F.col(raw_col)))
    return out.where("sigma > 0 AND NOT isnan(sigma)").withColumn("y", F.log10("sigma"))


def first_filled(first: Column, second: Column) -> Column:
    """The first of two texts that is not blank."""
    return F.when(F.trim(first) != "", first).otherwise(second)


def crystal_system(number: Column) -> Column:
    """Crystal system of a space-group number; ``unknown`` above 230 and for null."""
    out = F.lit("unknown")
    for last, name in reversed(SYSTEMS):
        out = F.when(number <= last, name).otherwise(out)
    return out


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Volume of a triclinic cell from three lengths and three angles in degrees."""
    x, y, z = (F.cos(F.radians(v)) for v in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - x * x - y * y - z * z + 2 * x * y * z)


def crystal_features(df: DataFrame) -> DataFrame:
    """``df`` with ``cell_volume`` and ``crystal_system`` from ``a b c alpha beta gamma spacegroup_no``."""
    volume = cell_volume(*[F.col(x) for x in ("a", "b", "c", "alpha", "beta", "gamma")])
    return df.withColumn("cell_volume", volume).withColumn("crystal_system", crystal_system(F.col("spacegroup_no")))


#: Readable names of single features, of element properties and of statistics.
SINGLE = {
    "n_elements": "No. of elements", "Li_frac": "Li fraction", "a": "Lattice a", "b": "Lattice b", "c": "Lattice c",
    "alpha": "Angle α", "beta": "Angle β", "gamma": "Angle γ", "cell_volume": "Cell volume", "spacegroup_no": "Space-group no.",
    "Z": "Formula units (Z)", "crystal_system": "Crystal system", "Family": "Structural family",
}
PROPERTIES = {"Z": "Atomic number", "mass": "Atomic mass", "X": "Electronegativity", "row": "Periodic row", "group": "Group number", "mendeleev": "Mendeleev number", "radius": "Atomic radius"}
STATISTICS = {"mean": "mean", "std": "SD", "min": "min", "max": "max", "range": "range"}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def feature_label(name: Column) -> Column:
    """A readable label: the name's own, else ``Property (statistic)`` split at the last ``_``, else the name."""
    prop, stat = (F.regexp_extract(name, "^(.*)_([^_]*)$", k) for k in (1, 2))
    pair = F.concat(F.try_element_at(_literal_map(PROPERTIES), prop), F.lit(" ("), F.try_element_at(_literal_map(STATISTICS), stat), F.lit(")"))
    return F.coalesce(F.try_element_at(_literal_map(SINGLE), name), pair, name)


def subscripts(formula: Column) -> Column:
    """Runs of digits as ``$_{12}$``."""
    return F.regexp_replace(formula, "([0-9]+)", r"\$_{$1}\$")


def scientific(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}e", value)
