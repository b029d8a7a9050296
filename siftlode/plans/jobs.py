"""Whole jobs: training, screening, known answers and calibration, each one plan from its scan to its sinks."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftlode.functions.composition import composition_features, parse_formulas
from siftlode.functions.parse import crystal_features, measured
from siftlode.functions.rules import assign_family, flag_elements
from siftlode.operators import metrics, model
from siftlode.operators.screen import ScreenFilter, top_list, with_rank
from siftlode.sources.tables import write_result

CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def feature_frame(rows: DataFrame, props: DataFrame, key: str, formula: str = "formula", family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of every row, and the rows whose formula cannot be parsed.

    ``rows`` has the key, the formula, the cell's six numbers and
    ``spacegroup_no``; the result adds 37 composition features, the cell's
    volume, its crystal system and the family, to the columns there are.
    """
    good, bad = parse_formulas(rows, formula)
    composed = composition_features(good, props, key)
    return assign_family(crystal_features(good), family).join(composed, key, "left"), bad


@dataclass
class ScreenConfig:
    """``out``: folder of the result tables; ``seen``: what the last run counted, filled in by it."""

    out: str
    screen: ScreenFilter = field(default_factory=ScreenFilter)
    top: int = 20
    dedupe: str | None = "after"
    seen: dict = field(default_factory=dict)


def screen_job(candidates: DataFrame, props: DataFrame, fitted: PipelineModel, features: model.Features, config: ScreenConfig) -> DataFrame | None:
    """Filter, build features, score, write the pool, and return the top list; None if nothing is left.

    Counted without another scan: rows scanned, rows dropped for flagged
    elements among those that meet the other conditions and the cap, and rows
    whose formula cannot be parsed among those left.
    """
    if candidates.isEmpty():
        return None
    scanned, selected = Observation("scanned"), Observation("selected")
    flagged = flag_elements(F.col("elements"), config.screen.drop_flagged) if config.screen.drop_flagged else F.lit(False)
    rows = config.screen.selected(candidates.observe(scanned, F.count(F.lit(1)).alias("scanned")))
    kept = rows.observe(selected, F.count_if(flagged).alias("flagged")).where(~flagged).drop("elements")
    good, bad = feature_frame(kept.select("*", *[F.col(f"lattice.{x}").alias(x) for x in CELL]).drop("lattice"), props, "material_id")
    aligned = model.align_features(good, features, ("material_id", "formula", "e_above_hull", "band_gap"))
    family = good.select("material_id", F.col("Family").alias("family_label"))
    scored = model.score(fitted, aligned).select("material_id", "formula", "e_above_hull", "band_gap", "pred", "pred_sigma").join(family, "material_id")
    write_result(scored, f"{config.out}/pool")
    write_result(bad.select("material_id", "formula"), f"{config.out}/not_parsed")
    not_parsed = candidates.sparkSession.read.parquet(f"{config.out}/not_parsed").count()
    config.seen.update(scanned.get | selected.get | {"not_parsed": not_parsed})
    pool = candidates.sparkSession.read.parquet(f"{config.out}/pool")
    if pool.isEmpty():
        return None
    top = top_list(pool, config.top, dedupe=config.dedupe)
    write_result(top, f"{config.out}/top", "csv")
    return top


def known_answer_screen(known: DataFrame, props: DataFrame, fitted: PipelineModel, features: model.Features) -> DataFrame:
    """``label, Family, pred``, the best first, of materials whose answer is known: ``label, formula``, the cell, ``spacegroup_no`` and a ``note``.

    With a ``note`` such as ``~1e-3`` also its logarithm, the distance of the
    prediction from it, and both ranks.
    """
    good, _ = feature_frame(known, props, "label")
    scored = model.score(fitted, model.align_features(good, features, ("label",))).select("label", "pred")
    if "note" not in known.columns:
        return good.select("label", F.col("Family").alias("Family")).join(scored, "label").orderBy(F.desc("pred"), "label")
    noted = F.log10(measured(F.col("note")))
    both = good.select("label", F.col("Family").alias("Family"), "note", noted.alias("noted")).join(scored, "label").withColumn("distance", F.col("pred") - F.col("noted"))
    ranked = with_rank(with_rank(both, "noted", "label").withColumnRenamed("rank", "noted_rank"), "pred", "label")
    return ranked.orderBy("rank")


def train_job(rows: DataFrame, builders: dict[str, Callable[[], Estimator]], key: str, k: int = 5) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Cross-validate each builder on the train rows, refit it on all of them and score the test rows once.

    ``rows`` has ``split`` (train or test) and ``y``. Returns the models and a
    table of one nested metrics row for each.
    """
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    folds, fitted, tables = train.withColumn("fold", metrics.hashed_fold(F.col(key), k)), {}, []
    for name, build in builders.items():
        _, summary = model.cross_validate(folds, build, k)
        fitted[name] = build().fit(train)
        once = model.holdout_metrics(fitted[name], test)
        tables.append(summary.select(F.lit(name).alias("model"), F.struct(*summary.columns).alias("cv")).crossJoin(F.broadcast(once.select(F.struct(*once.columns).alias("test")))))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return fitted, out


def calibration_job(models: list[PipelineModel], test: DataFrame, key: str, bins: int = 5) -> tuple[DataFrame, float, float]:
    """Error by bins of the ensemble's spread, and their rank correlation with its p-value."""
    scored = model.score_ensemble(models, test, (key, "y")).withColumn("err", F.abs(F.col("y") - F.col("ens_mean")))
    return metrics.calibration(scored, "ens_std", "err", bins), *metrics.spearman(scored, "ens_std", "err")


def spreads_agree(make_virtual: Callable[[], DataFrame], seeds: DataFrame, key: str = "id") -> tuple[float, float] | None:
    """Rank correlation, with its p-value, of a virtual ensemble's spread (``key, virtual_std``) and that of an ensemble of seeds (``key, ens_std``).

    A cross-check: if the virtual ensemble cannot be made, it is left out with
    a warning and None is returned.
    """
    try:
        both = make_virtual().select(key, "virtual_std").join(seeds.select(key, "ens_std"), key)
        return metrics.spearman(both, "virtual_std", "ens_std")
    except Exception as error:  # noqa: BLE001
        warnings.warn(f"no virtual ensemble to compare with: {error}", stacklevel=2)
        return None
