"""Orders of whole tables: ranks, running counts and exact quantiles, without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``: what is read twice is the same both times, also when executors are lost.

    Where that setting is absent, on one machine, a temporary folder is set first.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-siftlode-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b`` where both are equal in all of ``names``, two nulls included."""
    other = b.select(*[F.col(n).alias(f"_of_{n}") if n in names else F.col(n) for n in b.columns])
    equal = F.lit(True)
    for n in names:
        equal &= F.col(n).eqNullSafe(F.col(f"_of_{n}"))
    return a.join(other, equal).drop(*[f"_of_{n}" for n in names])


def running_counts(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, value, n, below, total``: how often each distinct value is there, how many rows of its group are below it, and the group's rows.

    Rows are counted before they are shuffled. Distinct values are dealt by
    ranges and summed up within their range; the ranges' sums, as many as
    there are partitions and groups, are added. ``df`` may have a column
    ``_weight``, the number of rows that each stands for.
    """
    weight = F.sum("_weight") if "_weight" in df.columns else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(weight.alias("n"))
    dealt = kept(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))
    within = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined(dealt, sums, [*by, "_part"]).select(*by, value, "n", (F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("below"), "total")


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, quantiles``: exact quantiles of each group, between two values in proportion; null and NaN values are left out. Without groups it is one row, of nulls for an empty table."""
    number = F.col(value).cast("double")
    counts = running_counts(df.where(number.isNotNull() & ~F.isnan(number)), value, by)
    picked = []
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("total") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value).cast("double"))).alias(f"{name}{k}"))
    ends = counts.groupBy(*by).agg(F.max("total").alias("total"), *picked)
    between = lambda k, share: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (F.lit(share) * (F.col("total") - 1) - F.floor(F.lit(share) * (F.col("total") - 1)))
    return ends.select(*by, F.array(*[between(k, share) for k, share in enumerate(shares)]).alias("quantiles"))


def _dealt(df: DataFrame, order: list[Column], by: tuple[str, ...]) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and the order, with ``_part``, its range, and ``_id``, which rises within it."""
    ordered = [*[F.col(c) for c in by], *order]
    dealt = df.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("_id", F.monotonically_increasing_id())
    return kept(dealt.withColumn("_part", F.shiftright("_id", 33)))


def running_sums(df: DataFrame, sums: dict[str, Column], order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows of its group that stand before it in the given order, 0 for the first.

    A range's rows are summed up within it, and the sums of a group's earlier
    ranges, as many as there are partitions and groups, are added.
    """
    dealt = _dealt(df.withColumns(sums), order, by)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_whole_{c}") for c in sums])
    spans = spans.select(*by, "_part", *[F.coalesce(F.sum(f"_whole_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = Window.partitionBy(*by, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined(dealt, spans, [*by, "_part"]).withColumns({c: F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return placed.drop("_id", "_part", *[f"_before_{c}" for c in sums])


def positions(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_position``, from 0 in the given order, and ``_total``, the rows of its group.

    Rows are dealt by ranges, so a group that holds a third of all rows lies in
    many tasks; each range's part of a group is counted, and the counts added.
    """
    dealt = _dealt(df, order, by)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spans = spans.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"))
    placed = joined(dealt, spans, [*by, "_part"]).withColumn("_position", F.col("_before") + F.col("_id") - F.col("_first"))
    return placed.drop("_id", "_part", "_first", "_before")
