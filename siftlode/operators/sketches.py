"""Quantiles by mergeable sketches: a sketch for each group and run, merged over runs when asked.

Exact quantiles (``order.quantiles``) need the rows again for each question.
Sketches are made in the one pass that a run makes over its own rows, take a
few kilobytes each, and those of all runs answer together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; ranks are then wrong by some 1.7 in 100 at most, in 99 of 100 cases.
SIZE = 200


def sketched(df: DataFrame, value: str, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """``by, sketch, least, most, n`` of each group's values; null and NaN ones are left out."""
    number = F.col(value).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(number, F.lit(size)).alias("sketch"), F.min(number).alias("least"), F.max(number).alias("most"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of several runs, or of finer groups, as one for each group."""
    known = sketches.where("n > 0")
    return known.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))


def quantiles_of(sketches: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, n, quantiles``: a value near each share's rank; shares 0 and 1 give the least and the greatest value exactly."""
    at = lambda s: F.col("least") if s <= 0 else F.col("most") if s >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(s)))
    return sketches.where("n > 0").select(*by, "n", F.array(*[at(s) for s in shares]).alias("quantiles"))
