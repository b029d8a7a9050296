"""Evaluation of predictions, calibration and distributions, as aggregations."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.order import positions, quantiles, running_counts


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """``n, mae, rmse, r2`` by group: R2 is 1 - residual / total sum of squares. Rows without either value are left out."""
    e = F.col(pred) - F.col(y)
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    r2 = 1 - F.sum(e * e) / F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric over folds."""
    return per_fold.agg(*[f(m).alias(f"{m}_{s}") for m in ("mae", "rmse", "r2") for s, f in (("mean", F.avg), ("std_samp", F.stddev_samp))])


def hashed_fold(key: Column, k: int = 5, seed: int = 42) -> Column:
    """A fold by hash: about equal in size, the same on every run, without a shuffle."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def even_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``df`` with ``fold``; sizes differ by one at most, the first folds being the larger ones. Rows are dealt by ranges of ``order``, a hash of the key where none is given."""
    placed = positions(df, [F.xxhash64(key, F.lit(seed)) if order is None else order, F.col(key)])
    return placed.withColumn("fold", F.expr(f"int(if(_position < (_total % {k}) * (_total div {k} + 1), _position div (_total div {k} + 1), (_position - _total % {k}) div greatest(_total div {k}, 1)))")).drop("_position", "_total")


def ensemble_spread(df: DataFrame, key: str, pred: str) -> DataFrame:
    """``ens_mean`` and ``ens_std`` (population) of the members' predictions of each row."""
    return df.groupBy(key).agg(F.avg(pred).alias("ens_mean"), F.stddev_pop(pred).alias("ens_std"))


def group_median(df: DataFrame, by: str, value: str, top: int | None = None) -> DataFrame:
    """The exact median of each group; with ``top`` the largest so many, in ascending order."""
    out = quantiles(df, value, [0.5], (by,)).select(by, F.col("quantiles")[0].alias("median"))
    return out.orderBy(F.desc("median"), by).limit(top).orderBy("median", by) if top else out


def quantile_edges(df: DataFrame, value: str, k: int, accuracy: int | None = None) -> DataFrame:
    """One row: the distinct edges of ``k`` quantile bins; approximate if an ``accuracy`` is given."""
    shares = [i / k for i in range(k + 1)]
    if accuracy:
        return df.agg(F.array_distinct(F.percentile_approx(value, shares, accuracy)).alias("edges"))
    return quantiles(df, value, shares).select(F.array_distinct("quantiles").alias("edges"))


def quantile_bins(df: DataFrame, value: str, k: int = 5, **options) -> DataFrame:
    """``df`` with ``bin``: bins are closed on the right, the lowest on both sides; equal edges count once."""
    edges = quantile_edges(df, value, k, **options)
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(value))) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(value).isNotNull(), at)).drop("edges")


def calibration(df: DataFrame, spread: str, err: str, k: int = 5) -> DataFrame:
    """``bin, mean_std, rmse, n``: error by bins of the spread."""
    binned = quantile_bins(df, spread, k).groupBy("bin")
    return binned.agg(F.avg(spread).alias("mean_std"), F.sqrt(F.avg(F.col(err) * F.col(err))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value``: from the counts of its distinct values, whose running sum is taken."""
    counts = running_counts(df.where(F.col(value).isNotNull()).select(value), value)
    ranks = counts.select(F.col(value).alias("_v"), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, df[value] == ranks["_v"]).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> tuple[float, float]:
    """Rank correlation and its two-sided p-value; distributed, with average ranks for ties."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    n = rows.count()
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows).select("v")
    rho = float(Correlation.corr(vectors, "v", "spearman").first()[0].toArray()[0, 1])
    return rho, p_value(rho, n)


def p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation of ``n`` pairs, by Student's t."""
    if n < 3 or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    t2, nu = rho * rho * (n - 2) / (1 - rho * rho), n - 2
    return _incomplete_beta(nu / 2, 0.5, nu / (nu + t2))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def pool_percentile(leads: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """``leads`` with ``percentile``: the share of pool rows strictly below, in percent.

    The pool is first counted by distinct value and summed up; a lead then
    takes the running count of the largest value below its own. A union of both
    in one order does that for any number of leads, without pairing them with
    the pool.
    """
    one = lambda df, n: df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"), F.lit(n).cast("long").alias("_weight"))
    counts = running_counts(one(pool, 1).unionByName(one(leads, 0)), "_v")
    found = leads.join(counts.select("_v", "below", "total"), leads[column] == counts["_v"], "left").drop("_v")
    return found.withColumn("percentile", 100 * F.col("below") / F.nullif(F.col("total"), F.lit(0))).drop("below", "total")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bucket, n`` of equal-width bins over the data's range, the last one closed; empty bins are left out."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") + 1, F.lit(bins))).otherwise(1)
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentile_pair(df: DataFrame, by: str, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``by, lo, hi``: two exact percentiles of each group."""
    return quantiles(df, column, [low, high], (by,)).select(by, F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))


def clip_normalised(df: DataFrame, by: str, column: str) -> DataFrame:
    """``df`` with ``scaled``: the value between its group's 5th and 95th percentile, clipped; 0.5 where they are equal."""
    ends = percentile_pair(df, by, column)
    scaled = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0.5)
    return df.join(ends, by).withColumn("scaled", scaled).drop("lo", "hi")


def density_offsets(df: DataFrame, by: str, value: str, tie: str, width: float = 0.42, bins: int = 100) -> DataFrame:
    """``df`` with ``offset``: the rows of each of ``bins`` equal bins of a group, in the order of ``tie``, spread evenly from ``-s`` to ``s``.

    ``s`` is ``width * min(1, k / (0.03 n + 1))`` for ``k`` rows in the bin and
    ``n`` in the group. A row alone in its bin, and every row of a group with
    one value only, stays at 0; a row without a value has no offset.
    """
    ends = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    at = F.when(F.col(value).isNotNull(), at)
    placed = positions(df.join(ends, by).withColumn("_bin", at), [F.asc(tie)], (by, "_bin"))
    k = F.col("_total")
    spread = width * F.least(F.lit(1.0), k / (0.03 * F.col("_n") + 1))
    offset = F.when((k > 1) & (F.col("_hi") > F.col("_lo")), spread * (2 * F.col("_position") / F.greatest(k - 1, F.lit(1)) - 1)).otherwise(0.0)
    return placed.withColumn("offset", F.when(F.col(value).isNotNull(), offset)).drop("_lo", "_hi", "_n", "_bin", "_position", "_total")


def axis_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: a floor for labels below the data, and the data's range widened by half a unit."""
    low, high = F.min(column), F.max(column)
    return df.agg((F.floor((low - 0.4) * 2) / 2).alias("label_floor"), (low - 0.5).alias("axis_low"), (high + 0.5).alias("axis_high"))


def disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_diff"))


def ranked_features(attributions: DataFrame) -> DataFrame:
    """``feature, mean_abs`` of long attributions (``id, feature, phi``), the largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def top_features(attributions: DataFrame, categorical: tuple[str, ...] = (), n: int = 15) -> DataFrame:
    return ranked_features(attributions).where(~F.col("feature").isin(*categorical)).limit(n) if categorical else ranked_features(attributions).limit(n)
