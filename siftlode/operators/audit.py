"""Reports on a pool: coverage, verdicts, leads and the risk map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.operators.metrics import pool_percentile
from siftlode.operators.screen import with_rank


def coverage(df: DataFrame, column: str) -> DataFrame:
    """``column, n, pct`` of each value, the rarest first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("_all")))
    return counts.crossJoin(whole).select(column, "n", (100 * F.col("n") / F.col("_all")).alias("pct")).orderBy("n", column)


def verdict_counts(df: DataFrame, categories: DataFrame, column: str = "category") -> DataFrame:
    """``categories`` (``category, label, position``) with ``n`` and ``kept``; a category without rows has 0. A name that ends in ``_kept`` is kept."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    joined = categories.join(counts, column, "left")
    return joined.select(column, "label", "position", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.endswith(F.col(column), F.lit("_kept")).alias("kept")).orderBy("position")


def present_in_order(df: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """The values of ``order`` (``column, position``) that ``df`` has."""
    return order.join(df.select(column).distinct(), column, "left_semi").orderBy("position")


def with_metrics(leads: DataFrame, metrics: DataFrame, label: str = "label", value: str = "sigma300_mS_cm", least: float = 1.0) -> DataFrame:
    """``leads`` with their metric, null where there is none, and ``good``: at least ``least``; a missing one is not good."""
    joined = leads.join(metrics.select(label, value), label, "left")
    return joined.withColumn("good", F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")) >= least, F.lit(False)))


def retro_scored(leads: DataFrame, metrics: DataFrame, pool: DataFrame, spread: str = "ens_std") -> DataFrame:
    """Leads with metric, verdict and the percentile of their spread within the pool."""
    return pool_percentile(with_metrics(leads, metrics), pool, spread)


def against_prior_rank(scored: DataFrame, predicted: str = "ens_mean", value: str = "sigma300_mS_cm", tie: str = "label") -> DataFrame:
    """``scored`` with ``prior_rank`` by prediction and ``measured_rank`` by metric, both from 0 for the highest, missing ones last, and ``shift``, how many places the metric moves the row down."""
    ranked = with_rank(scored, predicted, tie).withColumnRenamed("rank", "prior_rank")
    return with_rank(ranked, value, tie).withColumnRenamed("rank", "measured_rank").withColumn("shift", F.col("measured_rank") - F.col("prior_rank"))


def with_attribute(df: DataFrame, values: dict[str, str], name: str, column: str = "Family", default: str = "unknown") -> DataFrame:
    """``df`` with ``name``: the value listed for the row's ``column``, else the one listed for ``default``."""
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return df.withColumn(name, F.coalesce(F.try_element_at(known, F.col(column)), F.lit(values[default])))


def risk_map(pool: DataFrame, leads: DataFrame) -> DataFrame:
    """Pool and leads under each other, told apart by ``kind``; columns that one of them lacks are null."""
    return pool.withColumn("kind", F.lit("mp")).unionByName(leads.withColumn("kind", F.lit("lead")), allowMissingColumns=True)
