"""Screening of candidates: filters with a funnel, top lists and de-duplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.rules import REDOX, flag_elements, has_all, has_any
from siftlode.operators.order import positions


@dataclass(frozen=True)
class ScreenFilter:
    """Conditions on candidates; None leaves a condition out.

    ``n_elements``, ``hull`` and ``gap`` are closed ranges, each end None or a
    number. ``cap``: rows that are taken, in the order of ``order_by``, after
    the other conditions and before flagged elements are dropped, as a query
    with a row limit does.
    """

    include: tuple[str, ...] = ("Li", "S")
    exclude: tuple[str, ...] = ("H",)
    n_elements: tuple[int | None, int | None] | None = (3, 5)
    hull: tuple[float | None, float | None] | None = (0.0, 0.05)
    gap: tuple[float | None, float | None] | None = (1.5, None)
    drop_flagged: tuple[str, ...] = REDOX
    cap: int | None = None
    order_by: str = "material_id"

    @classmethod
    def loose(cls) -> ScreenFilter:
        return cls(exclude=(), n_elements=None, gap=(0.5, None), drop_flagged=())

    def conditions(self) -> list[tuple[str, Column]]:
        el = F.col("elements")
        found = []
        if self.include:
            found.append(("include", has_all(el, *self.include)))
        if self.exclude:
            found.append(("exclude", ~has_any(el, *self.exclude)))
        for name, column, ends in (("n_elements", F.size(el), self.n_elements), ("hull", F.col("e_above_hull"), self.hull), ("gap", F.col("band_gap"), self.gap)):
            if ends:
                low, high = ends
                found.append((name, (column >= low if low is not None else F.lit(True)) & (column <= high if high is not None else F.lit(True))))
        if self.drop_flagged:
            found.append(("flagged", ~flag_elements(el, self.drop_flagged)))
        return found

    def folders(self, names: list[str]) -> Column:
        """What the conditions say of the columns that candidates lie in folders by (``has_<element>``, ``n_elements``), as far as they are among ``names``."""
        met = F.lit(True)
        for wanted, elements in ((True, self.include), (False, self.exclude)):
            for e in elements:
                if f"has_{e}" in names:
                    met &= F.col(f"has_{e}") == F.lit(wanted)
        for end, low in zip(self.n_elements or (), (True, False), strict=False):
            if end is not None and "n_elements" in names:
                met &= F.col("n_elements") >= end if low else F.col("n_elements") <= end
        return met

    def selected(self, df: DataFrame) -> DataFrame:
        """The rows that meet every condition but the one on flagged elements, up to the cap. Ranges of plain columns reach the scan, and of a table in folders only those that can meet them are read; a null meets none."""
        df = df.where(self.folders(df.columns))
        for name, c in self.conditions():
            if name != "flagged":
                df = df.where(c)
        return df.orderBy(self.order_by).limit(self.cap) if self.cap is not None else df

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that meet every condition."""
        df = self.selected(df)
        return df.where(dict(self.conditions())["flagged"]) if self.drop_flagged else df

    def funnel(self, df: DataFrame) -> DataFrame:
        """``step, stage, n_candidates, dropped``: rows left after each condition, counted in one pass."""
        conditions = self.conditions()
        sums, met = [F.count(F.lit(1)).alias("s0")], F.lit(True)
        for k, (_, c) in enumerate(conditions, 1):
            met = met & F.coalesce(c, F.lit(False))
            sums.append(F.count_if(met).alias(f"s{k}"))
        names = ["all", *[n for n, _ in conditions]]
        rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(f"s{k}").alias("n_candidates"), (F.col(f"s{max(k - 1, 0)}") - F.col(f"s{k}")).alias("dropped")) for k, n in enumerate(names)])
        return df.agg(*sums).select(F.inline(rows))


def missing(score: str) -> Column:
    return F.col(score).isNull() | F.coalesce(F.isnan(F.col(score).cast("double")), F.lit(False))


def best_first(score: str, tie: str) -> list[Column]:
    """The order of descending scores, then of ``tie``; null and NaN scores come last."""
    return [missing(score).asc(), F.desc(score), F.asc(tie)]


def best_of_each(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best row of each key: the highest score, then the smallest ``tie``; a row whose score is null or NaN only where the key has no other. A ``min_by`` that sums up before the shuffle, no window."""
    names = df.columns
    place = F.struct(missing(score).alias("m"), F.when(~missing(score), -F.col(score)).alias("s"), F.col(tie).alias("t"))
    top = df.groupBy(key).agg(F.min_by(F.struct(*names), place).alias("_row"))
    return top.select(*[F.col("_row")[n].alias(n) for n in names])


def top_list(df: DataFrame, n: int, score: str = "pred", tie: str = "material_id", key: str = "formula", dedupe: str | None = "after") -> DataFrame:
    """The ``n`` highest scores. ``dedupe='after'`` keeps the best row of each key among them, so fewer may be left; ``'before'`` takes the ``n`` best keys."""
    if dedupe == "before":
        df = best_of_each(df, key, score, tie)
    top = df.orderBy(*best_first(score, tie)).limit(n)
    if dedupe == "after":
        top = best_of_each(top, key, score, tie)
    return top.orderBy(*best_first(score, tie))


def with_rank(df: DataFrame, score: str, tie: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of descending scores."""
    return positions(df, best_first(score, tie)).withColumnRenamed("_position", "rank").drop("_total")


def with_highlight(df: DataFrame, names: list[str], column: str = "formula") -> DataFrame:
    """``df`` with ``highlight``: whether the row is one of ``names``; a null is not."""
    return df.withColumn("highlight", F.coalesce(F.col(column).isin(*names), F.lit(False)))
