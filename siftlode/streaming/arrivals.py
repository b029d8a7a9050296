"""Stateless steps over arriving rows: cleaning, screening and scoring of streams.

Nothing here keeps state: each row is parsed and judged on its own, so the same
functions serve tables and streams.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siftlode.functions.composition import amounts
from siftlode.functions.parse import parse_measurements
from siftlode.functions.rules import assign_family
from siftlode.operators import model
from siftlode.operators.order import kept
from siftlode.operators.screen import ScreenFilter
from siftlode.plans.jobs import feature_frame


def cleaned(arriving: DataFrame, raw_col: str = "raw_value") -> DataFrame:
    """Measurements with ``sigma``, ``censored`` and ``y``."""
    return parse_measurements(arriving, raw_col)


def screened(arriving: DataFrame, screen: ScreenFilter | None = None, formula_col: str = "formula") -> DataFrame:
    """Candidates that meet the screen's conditions, with amounts, elements and family; a screen with a row cap cannot run on a stream."""
    screen = screen or ScreenFilter()
    if screen.cap is not None:
        raise ValueError("a row cap needs the whole table")
    parsed = arriving.withColumn("amounts", amounts(F.col(formula_col))).where("amounts IS NOT NULL").withColumn("elements", F.array_sort(F.map_keys("amounts")))
    return assign_family(screen.apply(parsed))


def written(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a parquet table, then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Arrived(StreamingQueryListener):
    """Counts what each named query has read: add it to ``spark.streams`` before the query starts."""

    def __init__(self):
        self.rows: Counter = Counter()
        self.ended: dict[str, str | None] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows[event.progress.name or str(event.progress.id)] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[self._names.get(str(event.id), str(event.id))] = event.exception


def scored(arriving: DataFrame, props: DataFrame, fitted: PipelineModel, features: model.Features, key: str, out: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Score candidates as they arrive, then stop: predictions to ``out/scored``, rows whose formula cannot be parsed to ``out/not_parsed``.

    Each batch is joined with the element dimension and given features, and the
    model reads them, all by the functions that serve tables. A batch is
    written to folders of its own number, over what an earlier try of it left,
    so each row is there once however often a batch is tried.
    """

    def batch(rows: DataFrame, number: int) -> None:
        good, bad = feature_frame(kept(rows), props, key)  # the source is read once
        found = model.score(fitted, model.align_features(good, features, (key, "formula"))).select(key, "formula", "pred", "pred_sigma")
        found.write.mode("overwrite").parquet(f"{out}/scored/batch={number}")
        bad.select(key, "formula").write.mode("overwrite").parquet(f"{out}/not_parsed/batch={number}")

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()
