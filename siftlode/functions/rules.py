"""Rule-based family labels and element flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.composition import amount

#: Metals that take part in redox.
REDOX = ("V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Mo", "W")


def has_all(elements: Column, *names: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, names)), elements)) == 0


def has_any(elements: Column, *names: str) -> Column:
    return F.arrays_overlap(elements, F.array(*map(F.lit, names)))


def flag_elements(elements: Column, names: tuple[str, ...] = REDOX) -> Column:
    """Whether any of ``names`` is there; false where the formula could not be parsed."""
    return F.coalesce(has_any(elements, *names), F.lit(False))


def family(amounts: Column) -> Column:
    """The first family whose rule fits, by elements and amounts; ``unknown`` where none does."""
    el = F.map_keys(amounts)
    halogen = amount(amounts, "Cl") + amount(amounts, "Br") + amount(amounts, "I")
    ratio = amount(amounts, "S") / F.greatest(halogen, F.lit(1e-9))
    lps = has_all(el, "Li", "P", "S")
    only = F.size(F.array_except(el, F.array(F.lit("Li"), F.lit("P"), F.lit("S")))) == 0
    return (
        F.when(amounts.isNull() | ~F.array_contains(el, "S"), "unknown")
        .when(lps & (halogen >= 0.5) & ratio.between(4, 7), "argyrodites")
        .when(lps & has_any(el, "Ge", "Sn", "Si"), "LGPS")
        .when(~F.array_contains(el, "P") & has_any(el, "Ge", "Sn", "Si", "Al", "Ga") & F.array_contains(el, "Li"), "thio-LISICON")
        .when(only & F.array_contains(el, "Li") & F.array_contains(el, "P"), "sulfides")
        .otherwise("unknown")
    )


def assign_family(df: DataFrame, given: str | None = None) -> DataFrame:
    """``df`` with ``Family``: the given one where there is one, else by rule."""
    rule = family(F.col("amounts"))
    return df.withColumn("Family", F.coalesce(F.col(given), rule) if given else rule)
