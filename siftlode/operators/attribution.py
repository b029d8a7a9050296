"""Attributions and per-tree outputs of tree models, over Arrow batches.

The model's trees, as it saves them, become paths: for each leaf the features
on its way with the interval they must lie in and the share of training rows
that went that way. They are as many as the model has leaves, whatever the
table's size, and each task gets them with its code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Path:
    """A leaf: its value and, for each feature on the way, its bounds or categories and its share."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    categories: list[frozenset | None]
    share: list[float]


def tree_paths(spark: SparkSession, saved: str) -> tuple[list[list[Path]], list[float]]:
    """Paths of each tree of a saved tree model, and the trees' weights.

    A leaf is reached if each feature is above ``low`` and at most ``high``, or
    among ``categories``. A feature met twice on a way is one entry.
    """
    data = spark.read.parquet(f"{saved}/data")
    rows = data.select("treeID", "nodeData.*").collect() if "treeID" in data.columns else data.select(F.lit(0).alias("treeID"), "*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    paths: list[list[Path]] = []
    for t in sorted(trees):
        nodes, found = trees[t], []

        def walk(k: int, held: dict, nodes: dict = nodes, found: list = found) -> None:
            r = nodes[k]
            if r["leftChild"] < 0:
                keys = list(held)
                found.append(Path(r["prediction"], keys, *[[held[f][i] for f in keys] for i in range(4)]))
                return
            split = r["split"]
            f, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
            low, high, cats, share = held.get(f, (-np.inf, np.inf, None, 1.0))
            for child, left in ((r["leftChild"], True), (r["rightChild"], False)):
                part = share * nodes[child]["rawCount"] / r["rawCount"]
                if split["numCategories"] < 0:
                    new = (low, min(high, values[0]), cats, part) if left else (max(low, values[0]), high, cats, part)
                else:
                    every = frozenset(range(split["numCategories"])) if cats is None else cats
                    new = (low, high, every & frozenset(int(v) for v in values) if left else every - frozenset(int(v) for v in values), part)
                walk(child, held | {f: new})

        walk(0, {})
        paths.append(found)
    meta = spark.read.parquet(f"{saved}/treesMetadata").toDF("treeID", "metadata", "weights")
    return paths, [r["weights"] for r in meta.orderBy("treeID").collect()]


def _meets(path: Path, x: np.ndarray) -> np.ndarray:
    """Rows by features on the path: whether each lies as the path needs it."""
    out = np.empty((x.shape[0], len(path.features)), bool)
    for j, f in enumerate(path.features):
        v = x[:, f]
        out[:, j] = np.isin(v, list(path.categories[j])) if path.categories[j] is not None else (v > path.low[j]) & (v <= path.high[j])
    return out


def tree_outputs(paths: list[list[Path]], x: np.ndarray) -> np.ndarray:
    """Each tree's output for each row."""
    out = np.zeros((x.shape[0], len(paths)))
    for t, tree in enumerate(paths):
        for p in tree:
            out[:, t] += p.value * _meets(p, x).all(1)
    return out


def _by_player(path: Path, x: np.ndarray, players: list[int]) -> tuple[list[int], list[float], np.ndarray]:
    """A leaf's players, each one's share of the training rows, and whether each row goes the leaf's way in all columns of a player."""
    whole = list(dict.fromkeys(players[f] for f in path.features))
    columns = [[j for j, f in enumerate(path.features) if players[f] == p] for p in whole]
    met = _meets(path, x)
    return whole, [float(np.prod([path.share[j] for j in js])) for js in columns], np.stack([met[:, js].all(1) for js in columns], 1).astype(float) if whole else met.astype(float)


def shapley(paths: list[list[Path]], weights: list[float], x: np.ndarray, players: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Shapley values of every player for each row, and the base value.

    ``players``: the player that each column of ``x`` belongs to, numbered from
    0; without it each column is one. Columns made of one feature (its value and
    whether it is missing, or a column for each category) come and go together
    in a coalition.

    A leaf's share in a coalition is the product over its players of 1 or 0
    (known: the row does or does not go its way) and of the share of training
    rows (not known). Summed over coalitions by size this is the product of
    ``share + met * t`` over the other players, a polynomial in ``t``, whose
    coefficients are weighted by the coalitions' weights.
    """
    players = list(range(x.shape[1])) if players is None else players
    phi, base = np.zeros((x.shape[0], max(players, default=-1) + 1)), 0.0
    for tree, w in zip(paths, weights, strict=True):
        for p in tree:
            who, share, met = _by_player(p, x, players)
            k = len(who)
            base += w * p.value * float(np.prod(share))
            weight = [factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)]
            for j in range(k):
                poly = np.zeros((x.shape[0], k))
                poly[:, 0] = 1.0
                for i in range(k):
                    if i != j:
                        poly[:, 1:] = poly[:, 1:] * share[i] + poly[:, :-1] * met[:, [i]]
                        poly[:, 0] *= share[i]
                phi[:, who[j]] += w * p.value * (poly @ weight) * (met[:, j] - share[j])
    return phi, base


def attribute(df: DataFrame, paths: list[list[Path]], weights: list[float], names: list[str], key: str = "id", features: str = "features") -> DataFrame:
    """``key, feature, phi``: long attributions of each row of ``df`` (``key`` and its feature vector), the base left out.

    ``names``: the feature of each place of the vector; places of one name are one player (see ``model.players``).
    """
    found = list(dict.fromkeys(names))
    players = [found.index(n) for n in names]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                phi, _ = shapley(paths, weights, np.array(b["x"].tolist(), float), players)
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(found)), "feature": found * len(b), "phi": phi.ravel()})

    rows = df.select(F.col(key).cast("long").alias(key), vector_to_array(features).alias("x"))
    return rows.mapInPandas(of, f"{key} long, feature string, phi double")


def virtual_ensemble(df: DataFrame, paths: list[list[Path]], weights: list[float], k: int = 10, key: str = "id", features: str = "features") -> DataFrame:
    """``key, members, virtual_std``: the model cut off after each of ``k`` equal runs of trees of its second half, and the members' population deviation."""
    n = len(paths)
    cuts = np.unique(np.linspace(max(1, n // 2), n, k).round().astype(int))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sums = np.cumsum(tree_outputs(paths, np.array(b["x"].tolist(), float)) * np.array(weights), 1)
                members = sums[:, cuts - 1]
                yield pd.DataFrame({key: b[key].to_numpy(), "members": list(members), "virtual_std": members.std(1)})

    rows = df.select(F.col(key).cast("long").alias(key), vector_to_array(features).alias("x"))
    return rows.mapInPandas(of, f"{key} long, members array<double>, virtual_std double")
