"""Packing of token sequences as a cutting-stock problem.

Documents are cut into pieces of at most a sequence's length. The histogram of
piece lengths, in classes of eight tokens, is the demand of a linear program
whose columns are patterns: how many pieces of each class share a sequence.
Column generation (Gilmore and Gomory 1961) finds them: the program's prices go
into a knapsack, solved by dynamic programming, whose best filling is the next
column. Patterns are used as often as their rounded-down values say; pieces
left over, a few for each class, are placed by first fit. Only the histogram
and the patterns, which have at most 512 classes whatever the input, reach the
driver; pieces are numbered within their class and find their sequence by
number. Each sequence is then built from its pieces' ids and padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.shared import bounded, importable, stored, work_dir
from siftlode.llm.tokenization import encoder, release

UNIT = 8
#: Characters of text that are encoded at a time.
BATCH = 6_000_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = 4096, width: int = 4) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of each piece of each row of ``docs`` (``doc_id, text``); ``ids`` as little-endian unsigned integers of ``width`` bytes, 2 for vocabularies of up to 65,536 ids.

    ``_task`` and ``_own`` number the pieces of each class within the task that cut them. A null or empty text is the end token alone. Rows that repeat a ``doc_id``
    and rows without one are cut like any other. Other columns are not read.
    """
    importable(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(vocabulary), np.array([end_id], "<u4")
        if tokens.tokenizer.get_vocab_size() > 1 << (8 * width):
            raise ValueError(f"ids of this vocabulary do not fit into {width} bytes")
        task, met = TaskContext.get().partitionId(), np.zeros(-(-length // UNIT) + 1, np.int64)

        def of(ids: list, texts: list) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, x in zip(ids, tokens.encode(texts), strict=True):
                whole = np.concatenate([x, end])
                for start in range(0, whole.size, length):
                    piece = whole[start : start + length]
                    size = -(-piece.size // UNIT)
                    for column, value in zip(out, (doc_id, start, piece.size, whole.size, piece.astype(f"<u{width}").tobytes(), task, int(met[size])), strict=True):
                        column.append(value)
                    met[size] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids", "_task", "_own"])

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
                if chars >= BATCH:
                    yield of(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield of(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary, _task int, _own long")


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` that fits into ``room``, by dynamic programming."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(sizes, c, "right"))
        if fit:
            values = best[c - sizes[:fit]] + prices[:fit]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], last[c] = values[k], k
    counts, c = np.zeros(sizes.size), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 4_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: the linear program's optimum, within ``gap`` of it, by column generation.

    A revised simplex holds the inverse of the basis, one column for each
    size; columns that take a size away from an overfull pattern stand for
    demand that is more than met.
    """
    m = sizes.size
    basis = [np.eye(m)[k] * (room // sizes[k]) for k in range(m)]
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    used = inverse @ demand
    for _ in range(rounds):
        prices = cost @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:
            column, price = -np.eye(m)[worst], 0.0
        else:
            value, column = knapsack(prices, sizes, room)
            if value <= 1 + 1e-9 or 1 - 1 / value < gap:
                break
            price = 1.0
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        ratio = used[up] / step[up]
        out = int(up[ratio.argmin()])
        used = used - step * ratio.min()
        used[out] = ratio.min()
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        basis[out], cost[out] = column, price
    return [(a, float(x)) for a, x, c in zip(basis, used, cost, strict=True) if c and x > 1e-9]


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """``(size, first rank, rank after the last, first sequence, pieces in each)``: where the ranked pieces of each size go."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not sizes.size:
        return []
    demand = np.array([histogram[int(k)] for k in sizes], np.float64)
    taken, next_sequence, slots = np.zeros(sizes.size, np.int64), 0, []
    for column, x in patterns(sizes, demand, room):
        times = int(np.floor(x + 1e-6))
        per = column.astype(np.int64)
        if times:
            for k in np.flatnonzero(per).tolist():
                slots.append((int(sizes[k]), int(taken[k]), int(taken[k] + times * per[k]), next_sequence, int(per[k])))
            taken += times * per
            next_sequence += times
    #: What the rounding left, largest first, each into the fullest sequence with room.
    free: list[list[int]] = []
    for k in range(sizes.size - 1, -1, -1):
        for rank in range(int(taken[k]), int(demand[k])):
            fits = [x for x in free if x[0] >= sizes[k]]
            if fits:
                place = min(fits)
            else:
                place = [room, next_sequence]
                free.append(place)
                next_sequence += 1
            place[0] -= int(sizes[k])
            slots.append((int(sizes[k]), rank, rank + 1, place[1], 1))
    return slots


def packed(cut: DataFrame, length: int = 4096, folder: str | None = None) -> DataFrame:
    """``cut`` (one row for each piece, as :func:`pieces` gives them) with ``sequence_id`` and ``offset``.

    Pieces of one class are numbered in two steps, within the tasks that cut
    them and by the tasks' counts, so a class that a third of the pieces have
    is never one task's, and the ids travel once, to their sequence. Rows that
    repeat each other are placed apart. Columns of ``cut`` stay, but those two
    names are replaced. An empty table stays empty.
    """
    spark = cut.sparkSession
    folder = folder or work_dir(spark, "packing")
    rows = stored(cut.drop("sequence_id", "offset").withColumn("_size", F.ceil(F.col("length") / UNIT).cast("int")), folder, "pieces")
    counts = stored(rows.groupBy("_size", "_task").agg(F.count(F.lit(1)).alias("_n")), folder, "counts")
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}  # length / 8 rows at most
    slots = plan(histogram, length // UNIT)
    values = ", ".join(f"({a}, {b}L, {c}L, {d}L, {e}L)" for a, b, c, d, e in slots) or "(0, 0L, 0L, 0L, 1L)"
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(_size, _from, _to, _first, _per)")

    before = F.sum("_n").over(Window.partitionBy("_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_size", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.join(bounded(counts), ["_size", "_task"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    #: At most a few thousand ranges, set by the number of classes.
    placed = ranked.join(F.broadcast(table), "_size").where("_rank >= _from AND _rank < _to").withColumn("sequence_id", F.expr("_first + (_rank - _from) div _per"))
    upto = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(upto), F.lit(0))
    return placed.withColumn("offset", offset).drop("_size", "_task", "_own", "_before", "_rank", "_from", "_to", "_first", "_per")


def built(placed: DataFrame, length: int = 4096, pad_id: int = 0, width: int = 4) -> DataFrame:
    """``sequence_id, n_tokens, tokens, pieces`` of each sequence: its ids as little-endian unsigned integers of ``width`` bytes, padded to ``length`` unless their number is a power of two, and its pieces' places."""
    names = ("offset", "doc_id", "start", "length", "doc_tokens")
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*names, "ids"))).alias("all"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    padded = F.rpad(ids, F.lit(width * length), F.lit(pad_id.to_bytes(width, "little")))
    return grouped.select("sequence_id", "n_tokens", F.when(F.bit_count("n_tokens") == 1, ids).otherwise(padded).alias("tokens"), F.transform("all", lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("pieces"))


def written(placed: DataFrame, length: int = 4096, pad_id: int = 0, width: int = 4, folder: str | None = None) -> DataFrame:
    """The sequences of :func:`built`, as a table in a shared folder."""
    return stored(built(placed, length, pad_id, width), folder or work_dir(placed.sparkSession, "sequences"), "sequences")


def pieces_of(sequences: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of each piece, read from the sequences that hold them; ``ids`` as 32-bit integers."""
    each = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    ids = F.substring("tokens", (width * F.col("p.offset") + 1).cast("int"), (width * F.col("p.length")).cast("int"))
    found = each.select("p.doc_id", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", ids.alias("ids"))
    importable(found.sparkSession)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column(6).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], ids], batch.schema.names)
        #: All texts are encoded by now.
        release()

    return found.mapInArrow(wide, found.schema) if width != 4 else found


def sequences(placed: DataFrame, length: int = 4096, pad_id: int = 0, width: int = 4) -> DataFrame:
    """``sequence_id, n_tokens, tokens`` of each sequence, its ids as an array of integers."""
    importable(placed.sparkSession)

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, f"<u{width}").astype(np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "tokens"])

    return built(placed, length, pad_id, width).select("sequence_id", "n_tokens", "tokens").mapInArrow(loose, "sequence_id long, n_tokens long, tokens array<long>")
