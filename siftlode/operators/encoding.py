"""Categories as numbers: statistics of the target, ordered so that no row sees its own.

In a training table a row's category is encoded by the target's mean over the
rows of that category that stand before it in a fixed shuffled order; in any
other table by the mean over the whole training table. Both lean towards the
training table's mean by a weight, so a rare category says little.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.operators.order import running_sums


def shuffled(key: str, seed: int = 0) -> Column:
    """What orders rows as if by chance, the same on every run: a digest of the key and a seed, the key itself between equal ones."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def prior(train: DataFrame, label: str) -> float:
    """The target's mean; 0 without any target."""
    return train.agg(F.avg(label)).first()[0] or 0.0


def ordered_statistics(train: DataFrame, category: str, label: str, key: str, weight: float = 1.0, seed: int = 0, out: str | None = None) -> DataFrame:
    """``train`` with ``<category>_mean``: the mean of ``label`` over earlier rows of the category, with ``weight`` rows of the table's mean added.

    Rows are dealt by ranges of category and order, so a category that a third
    of all rows have lies in many tasks, whose sums are added. A null category
    is one of its own. A row with a null or NaN label is encoded, but adds
    nothing. ``key`` may repeat; such rows stand in any order.
    """
    value = F.when(~F.isnan(F.col(label).cast("double")), F.col(label).cast("double"))
    sums = running_sums(train, {"_sum": F.coalesce(value, F.lit(0.0)), "_n": value.isNotNull().cast("double")}, [shuffled(key, seed), F.col(key)], (category,))
    mean = (F.col("_sum") + F.lit(prior(train.select(value.alias("v")), "v") * weight)) / (F.col("_n") + F.lit(weight))
    return sums.withColumn(out or f"{category}_mean", mean).drop("_sum", "_n")


def statistics(train: DataFrame, category: str, label: str, weight: float = 1.0, out: str | None = None) -> tuple[DataFrame, float]:
    """``category, <category>_mean`` over all of ``train``, and the value for categories that it does not have."""
    value = F.when(~F.isnan(F.col(label).cast("double")), F.col(label).cast("double"))
    rows = train.select(category, value.alias("_v"))
    base = prior(rows, "_v")
    mean = (F.coalesce(F.sum("_v"), F.lit(0.0)) + F.lit(base * weight)) / (F.count("_v") + F.lit(weight))
    return rows.groupBy(category).agg(mean.alias(out or f"{category}_mean")), base


def encoded(df: DataFrame, table: DataFrame, category: str, base: float) -> DataFrame:
    """``df`` with the statistics of its categories, ``base`` where there are none."""
    name = next(c for c in table.columns if c != category)
    return _with_table(df, table, category).withColumn(name, F.coalesce(name, F.lit(base)))


def _with_table(df: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """``df`` with the other columns of ``table`` where both are equal in ``name``, two nulls included; null elsewhere."""
    other = table.withColumnRenamed(name, "_key")
    return df.join(other, F.col(name).eqNullSafe(F.col("_key")), "left").drop("_key")


@dataclass
class Encoded:
    """A fitted model that reads categories by their statistics over its training table."""

    model: PipelineModel
    tables: dict[str, tuple[DataFrame, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        for category, (table, base) in self.tables.items():
            df = encoded(df, table, category, base)
        return self.model.transform(df)


def fit_ordered(train: DataFrame, categories: tuple[str, ...], label: str, key: str, build: Callable[[], Estimator], weight: float = 1.0, seed: int = 0) -> Encoded:
    """Train on ordered statistics of ``categories`` (columns ``<category>_mean``, which ``build``'s estimator reads), and keep those of the whole table for scoring."""
    rows = train
    for c in categories:
        rows = ordered_statistics(rows, c, label, key, weight, seed)
    return Encoded(build().fit(rows), {c: statistics(train, c, label, weight) for c in categories})

