"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles, ASCII letters in lower
case. Sets with a Jaccard similarity of at least ``percent`` / 100 are linked,
and a document's component is what it reaches over links.

Documents with the same set share one node. A node has 64 minwise tokens. The
join walks trees (Christiani, Pagh, Sivertsen 2018): at each place of a tree
two of the tokens are chosen, the same for all nodes there, and each node goes
on to a child for each of their values. Two sets meet in a child with a chance
of their similarity, so with two children for each place, a linked pair keeps
meeting in a tree with a chance above 0.9 at any depth; ``trees`` independent
trees leave it unmet with a chance of about 1e-7.

* Places with few nodes are compared exhaustively: first 64 bytes of the
  tokens, then, for pairs that agree often enough (five and a half standard
  deviations below the threshold), the full sets.
* In a large place all are first compared with one node, the one that agrees
  best with the most frequent tokens. Places all of whose nodes are in one
  component by then are done; others branch further. What is still large at
  the last depth is compared block by block, so nothing is left out.

Pairs already in one component are not compared; no list of pairs is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.graph import components
from siftlode.llm.hashing import mixed, run_hashes, word_hashes
from siftlode.llm.shared import bounded, bucketed, dropped, importable, released, stored, unlisted, work_dir

TOKENS = 64
#: Nodes of a place that are compared exhaustively.
LEAF = 4_096
DEPTH = 5
#: Bytes of the sets that are compared in one task; places with more are compared block by block.
CELL = 64 << 20
NO_ID = -(1 << 63)
_SEEDS = np.random.default_rng(5_081_993).integers(0, 1 << 32, (3, TOKENS), np.uint32)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, one of them all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(run_hashes(hashes, min(width, len(words))))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of 64 hash functions over a set."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for k in range(0, low.size, 2_048):
        part = (low[k : k + 2_048, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint32(1)) + high[k : k + 2_048, None] * (_SEEDS[2] | np.uint32(1))
        np.minimum(out, part.min(0), out)
    return out


def profiles(docs: DataFrame, trees: int) -> DataFrame:
    """``key, doc_id, text_id, n_shingles, node, sketch, paths`` of every row: ``node`` stands for the set, ``paths`` for the places below the roots."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                hashes = shingles(text)
                if hashes.size:
                    tokens = minwise(hashes)
                    places = mixed(tokens[: 2 * trees].astype(np.uint64) | (np.arange(2 * trees, dtype=np.uint64) << np.uint64(32)))
                    row = (hashes.size, xxhash.xxh3_128_digest(hashes.tobytes()), tokens.astype(np.uint8).tobytes(), places.view(np.int64).tolist())
                else:
                    row = (0, None, None, None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["key", "doc_id", "text_id", "n_shingles", "node", "sketch", "paths"])

    keyed = _keyed(docs).select("key", "doc_id", "text", _text_id().alias("text_id"))
    return keyed.mapInArrow(of, "key long, doc_id long, text_id long, n_shingles long, node binary, sketch binary, paths array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_keys()[0], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _text_id() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keys() -> tuple[Column, Column]:
    """``key`` and ``text_id`` of a row of documents."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), _text_id().alias("text_id")


def _agreement(sketches: np.ndarray, i: int) -> np.ndarray:
    """In how many bytes row ``i`` agrees with each later row: equal bytes are ones, added up eight at a time."""
    ones = (sketches[i + 1 :] == sketches[i]).view(np.uint64).sum(1)
    return (ones * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _numbered(labels: list[bytes]) -> np.ndarray:
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(x, len(first)) for x in labels], np.int64)


class _Shared:
    """Sizes of the intersections of a place's sets, by bits for the elements that two or more have."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([x.size for x in sets], np.int64)
        every = np.concatenate(sets)
        values, which, n = np.unique(every, return_inverse=True, return_counts=True)
        bit = np.cumsum(n > 1) - 1
        width = (int(bit[-1]) + 64) // 64 if values.size else 0
        self.bits = None
        if len(sets) * width <= 25_000_000:
            keep = (n > 1)[which]
            row, column = np.repeat(np.arange(len(sets)), self.sizes)[keep], bit[which][keep]
            self.bits = np.zeros((len(sets), max(width, 1)), np.uint64)
            np.bitwise_or.at(self.bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))

    def linked(self, i: int, at: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets ``at`` are linked with set ``i``."""
        if self.bits is None:
            return at[[linked(self.sets[i], self.sets[j], percent) for j in at.tolist()]]
        both = np.bitwise_count(self.bits[at] & self.bits[i]).sum(1, dtype=np.int64)
        return at[100 * both >= percent * (self.sizes[i] + self.sizes[at] - both)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as ``percent`` says, in whole numbers."""
    small, large = sorted((a, b), key=len)
    if 100 * small.size < percent * large.size:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, large.size - 1)] == small).sum())
    return 100 * both >= percent * (a.size + b.size - both)


def _least_agreement(percent: int) -> int:
    s = percent / 100
    return int(np.floor(TOKENS * s - 5.5 * (TOKENS * s * (1 - s)) ** 0.5))


def _candidates(places: DataFrame, percent: int) -> DataFrame:
    """Of places with few members (``path, node, sketch, label``): the members with a partner that may be linked and is not in their component."""
    least = _least_agreement(percent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, nodes = [], []
            for path, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label, sketches = _numbered([x["label"] for x in members]), _matrix([x["sketch"] for x in members])
                near = np.zeros(label.size, bool)
                for i in range(label.size - 1):
                    may = (_agreement(sketches, i) >= least) & (label[i + 1 :] != label[i])
                    if may.any():
                        near[i] = True
                        near[i + 1 :] |= may
                found = np.flatnonzero(near).tolist()
                paths += [path] * len(found)
                nodes += [members[i]["node"] for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), pa.array(nodes, pa.binary())], ["path", "node"])

    grouped = places.groupBy("path").agg(F.collect_list(F.struct("node", "sketch", "label")).alias("members"))
    return grouped.mapInArrow(of, "path long, node binary")


def _verified(places: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join the components of the members (``path, node, sketch, label, shingles``) of each place, confirmed on full sets."""
    least = _least_agreement(percent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for members in batch.column(1).to_pylist():
                label, sketches = _numbered([x["label"] for x in members]), _matrix([x["sketch"] for x in members])
                shared = _Shared([np.frombuffer(x["shingles"], np.uint64) for x in members])
                for i in range(label.size - 1):
                    at = np.flatnonzero((_agreement(sketches, i) >= least) & (label[i + 1 :] != label[i])) + i + 1
                    at = shared.linked(i, at, percent) if at.size else at
                    if at.size:
                        joined, first = np.unique(label[at], return_index=True)
                        links += [(members[i]["node"], members[j]["node"]) for j in at[first].tolist()]
                        label[np.isin(label, joined)] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*links, strict=True) if links else ((), ()))], ["a", "b"])

    grouped = places.groupBy("path").agg(F.collect_list(F.struct("node", "sketch", "label", "shingles")).alias("members"))
    return grouped.mapInArrow(of, "a binary, b binary")


def _leaders(large: DataFrame) -> DataFrame:
    """``path, leader, leader_label``: the member that agrees best with the most frequent values of 32 of the bytes."""
    places = range(1, TOKENS + 1, 2)
    byte = lambda i: F.substring("sketch", i, 1)
    usual = large.groupBy("path").agg(*[F.mode(byte(i)).alias(f"u{i}") for i in places])
    agree = sum((byte(i) == F.col(f"u{i}")).cast("int") for i in places)
    best = large.join(usual, "path").groupBy("path").agg(F.max_by(F.struct("node", "label"), F.struct(agree.alias("n"), F.col("node"))).alias("best"))
    return best.select("path", F.col("best.node").alias("leader"), F.col("best.label").alias("leader_label"))


def _stars(large: DataFrame, sets: DataFrame, percent: int, folder: str, name: str) -> DataFrame:
    """Links ``a, b`` of the members of large places with one member each, where they are not in one component yet."""
    pairs = large.select("path", "node", "label").join(_leaders(large), "path").where("label <> leader_label").select("node", "leader").distinct()
    pairs = stored(pairs, folder, name)
    #: One leader for each large place, so they are few beside the members, whose sets would else be dealt by leader.
    leaders = bounded(pairs.select(F.col("leader").alias("node")).distinct())
    others = stored(sets.join(leaders, "node").select(F.col("node").alias("leader"), F.col("shingles").alias("others")), folder, f"{name}-leaders")
    pairs = pairs.hint("merge").join(sets, "node").join(bounded(others), "leader")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = [k for k in range(len(a)) if linked(np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary())], ["a", "b"])

    return pairs.select("node", "leader", "shingles", "others").mapInArrow(of, "a binary, b binary")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (``path, node, size, sketch, label``) of places with more than one component, and ``n``, the place's members."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("path", "n")
    return rows.join(sizes, "path")


def _branched(rows: DataFrame) -> DataFrame:
    """Each row goes on to two children: by the bytes of two tokens that the place chooses."""
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(TOKENS))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(TOKENS - 1)), F.lit(TOKENS))
    child = [F.xxhash64("path", x, F.substring("sketch", (x + 1).cast("int"), F.lit(1))) for x in (one, two)]
    return rows.select(F.explode(F.array(*child)).alias("path"), "node", "size", "sketch").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of places with few members, those whose sets take more than ``CELL`` bytes dealt into cells of two blocks each, so that every pair of members meets in one."""
    n = F.greatest(F.ceil(2 * 8 * F.sum("size").over(Window.partitionBy("path")) / F.lit(CELL)).cast("int"), F.lit(2))
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.xxhash64("path", F.least(k, block), F.greatest(k, block)))
    cells = F.when(F.col("n") > 2, F.array_distinct(mates)).otherwise(F.array("path"))
    return rows.withColumn("n", n).select(F.explode(cells).alias("path"), "node", "sketch", "label")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of large places dealt into cells of two blocks each, so that every pair of members meets in one."""
    n = F.ceil(F.col("n") / LEAF).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    mates = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64("path", F.least(k, block), F.greatest(k, block)))
    return rows.select(F.explode(mates).alias("path"), "node", "size", "sketch", "label").distinct()


def _judged(docs: DataFrame, percent: int, trees: int, folder: str) -> DataFrame:
    """``key, text_id, doc_id, n_shingles, label, own`` of every row: ``label`` is the same for all rows of a component and null without shingles, ``own`` the component's smallest key."""
    spark = docs.sparkSession
    importable(spark)
    every = stored(profiles(docs, trees), folder, "profiles")
    nodes = every.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("key", "text_id")).alias("one"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    nodes = stored(nodes.select("node", "one.*", "size", "sketch", "paths"), folder, "nodes")

    rows = nodes.select(F.posexplode("paths").alias("tree", "path"), "node")
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "path").join(nodes.select("node", "size", "sketch"), "node").select("path", F.expr("tree div 2").alias("tree"), "node", "size", "sketch", "n")
    rows = stored(rows, folder, "rows")
    small, large = rows.where(F.col("n") <= LEAF), rows.where(F.col("n") > LEAF).drop("n", "tree")

    near = stored(_candidates(small.withColumn("label", F.col("node")), percent), folder, "near")
    wanted = near.select("node").union(large.select("node")).distinct()
    keys = stored(wanted.join(nodes.select("node", "key", "text_id"), "node").select("node", "key", "text_id"), folder, "keys")
    released(spark)
    #: Every round joins few nodes with the sets, so these are dealt by node once.
    table = f"sets_{uuid.uuid4().hex}"
    sets = bucketed(_sets(docs, keys), "node", table, f"{folder}/sets")
    released(spark)

    labels = None

    def compared(places: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
        """Links of places with few members; ``known``: those that may have a partner. Only their sets travel, the others' stay."""
        known = _candidates(places, percent) if known is None else known
        found = stored(_cells(places.join(known, ["path", "node"])), folder, f"found-{name}")
        out = stored(_verified(found.hint("merge").join(sets, "node"), percent), folder, f"links-{name}")
        dropped(spark, f"{folder}/found-{name}")
        released(spark)
        return out

    def linked_now(found: DataFrame, name: str) -> DataFrame:
        """Components of all links so far: the known ones are stars already, so only what is new takes rounds."""
        edges = found if labels is None else found.union(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        return stored(components(edges, folder, f"c-{name}"), folder, f"labels-{name}")

    labels = linked_now(compared(small.where("tree = 0").select("path", "node", "size", "sketch").withColumn("label", F.col("node")), "first", near), "first")
    #: Only members that may be linked with another component.
    rest = _sized(_labelled(small.where("tree > 0").select("path", "node", "size", "sketch").join(near, ["path", "node"]), labels)).drop("n")
    rest = stored(rest, folder, "places-rest")
    labels = linked_now(compared(rest, "rest"), "rest")
    dropped(spark, f"{folder}/places-rest")

    depth = 0
    while not large.isEmpty():
        large = stored(_sized(_labelled(large, labels)), folder, f"large-{depth}")
        if large.isEmpty():
            break
        stars = stored(_stars(large, sets, percent, folder, f"pairs-{depth}"), folder, f"links-stars-{depth}")
        labels = linked_now(stars, f"stars-{depth}")
        left = stored(_sized(_labelled(large.select("path", "node", "size", "sketch"), labels)), folder, f"left-{depth}")
        released(spark)
        if depth == DEPTH:
            labels = linked_now(compared(_blocks(left), "blocks"), "blocks")
            break
        below = stored(_sized(_labelled(_branched(left), labels)), folder, f"below-{depth}")
        dropped(spark, f"{folder}/left-{depth}", f"{folder}/pairs-{depth}")
        labels = linked_now(compared(below.where(F.col("n") <= LEAF).drop("n"), f"below-{depth}"), f"below-{depth}")
        large, depth = below.where(F.col("n") > LEAF).select("path", "node", "size", "sketch"), depth + 1

    unlisted(spark, table, f"{folder}/sets")
    of_node = nodes.select("node", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("key").alias("component"))
    found = of_node.join(least, "label").select("node", "label", "component")
    return every.join(found, "node", "left").select("key", "text_id", "doc_id", "n_shingles", "label", F.coalesce("component", "key").alias("own"))


def near_duplicates(docs: DataFrame, percent: int = 80, trees: int = 5, folder: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest ``doc_id`` that the document reaches, its
    own included; ``kept`` says that it is the document's own. A null, empty or
    blank text has no shingles and is linked with nothing. A null ``doc_id``
    counts as smaller than any other. Rows that repeat a ``doc_id`` are judged
    by their own texts; those with the same text get the same answer. Other
    columns are not read.
    """
    found = _judged(docs, percent, trees, folder or work_dir(docs.sparkSession, "neardup"))
    return found.select("doc_id", "n_shingles", F.when(F.col("own") != NO_ID, F.col("own")).alias("component_id"), (F.col("own") == F.col("key")).alias("kept"))


def _sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``node, shingles``: the full set of each wanted node, from the texts of its key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingles(text).tobytes()
                if xxhash.xxh3_128_digest(hashes) == node:
                    nodes.append(node)
                    sets.append(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    #: Shuffled whatever the number of keys, so that a small input runs the plan of a large one.
    #: By id and text, as many rows may share an id or have none.
    found = _keyed(docs).select("key", _text_id().alias("text_id"), "text").join(keys.hint("merge"), ["key", "text_id"]).select("node", "text")
    return found.mapInArrow(of, "node binary, shingles binary").dropDuplicates(["node"])


def without_near_duplicates(docs: DataFrame, percent: int = 80, trees: int = 5, folder: str | None = None) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, with its columns: the one with the smallest ``doc_id``.

    A null ``doc_id`` is the smallest. Of several texts of a component that
    have that ``doc_id`` the one with the least hash stays, and of rows that
    repeat both ``doc_id`` and text one stays, any of them if other columns
    differ. Rows without shingles are linked with nothing, so all of them stay.
    """
    folder = folder or work_dir(docs.sparkSession, "neardup")
    found = stored(_judged(docs, percent, trees, folder), folder, "judged")
    texts = found.where("n_shingles > 0 AND own = key").groupBy("label", "key", "text_id").agg(F.count(F.lit(1)).alias("n"))
    one = texts.groupBy("label").agg(F.min(F.struct("text_id", "key", "n")).alias("one")).select("one.key", "one.text_id", "one.n")
    loose = found.where("n_shingles = 0").select("key", "text_id", F.lit(1).cast("long").alias("n")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys())
    kept = rows.join(one.union(loose), ["key", "text_id"])
    #: Repeated rows, a third of all perhaps, are made one before they are shuffled; the others are not shuffled again.
    repeated = kept.where("n > 1").select("row", F.struct("key", "text_id").alias("of")).dropDuplicates(["of"])
    return kept.where("n = 1").select("row").union(repeated.select("row")).select("row.*")
