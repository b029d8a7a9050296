"""Removal of repeated passages, by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word goes if a
window that covers it has the same words as one that starts earlier (in a
smaller ``doc_id``, or in the same document before it).

Positions are taken modulo 13, and runs of 8 words are hashed only where that
gives 0, 1, 3 or 9. These four have every difference modulo 13, so two equal
windows of at least 20 words, wherever they start, have a hashed run at the
same place in both. A run that occurs twice is extended: every window that holds it
is read whole, and windows of the same words meet under 96 bits of two hashes,
so that even among 10 ** 12 windows none goes by chance.

Hashes travel packed: each task sends one row to a bucket of the hash space
with the runs it met for the first time, and keeps what repeats within its own
batch, so a passage that a third of all documents share reaches its bucket once
for each batch, not once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.hashing import run_checks, run_hashes, split, word_hashes
from siftlode.llm.shared import groups, importable

PERIOD, COVER, RUN = 13, (0, 1, 3, 9), 8
#: Words hashed at a time in a task.
BATCH = 1_500_000
PACKED = "bucket int, hashes binary, checks binary, twice binary, docs binary, rows binary, at binary"
NO_ID = -(1 << 63)


def _packed(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, rows: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows for the buckets; entries come in the order of documents and places."""
    order = np.argsort(hashes, kind="stable")
    if ((hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] != checks[order][:-1])).any():
        order = np.lexsort((checks, hashes))
    hashes, checks, docs, rows, at = (x[order] for x in (hashes, checks, docs, rows, at))
    first = np.ones(hashes.size, bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    twice = np.zeros(hashes.size, bool)
    twice[:-1] = ~first[1:]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (docs != docs[start]) | (at != at[start])
    if later.any():
        #: Known to repeat here: sent on only to be gathered by document.
        yield int(docs[0] % buckets), b"", b"", b"", docs[later].tobytes(), rows[later].tobytes(), at[later].tobytes()
    #: Back in the order of documents and places, in which both compress well.
    back = np.argsort(order[~later])
    hashes, checks, docs, rows, at, twice = (x[~later][back] for x in (hashes, checks, docs, rows, at, twice))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
    start = 0
    for k, end in enumerate(ends.tolist()):
        if end > start:
            part = order[start:end]
            yield k, *(x[part].tobytes() for x in (hashes, checks, twice, docs, rows, at))
        start = end


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 6]
    columns = zip(*rows, strict=True) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["bucket", "hashes", "checks", "twice", "docs", "rows", "at"])


def _packed_batches(got: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """``got``: key, number of the row among those of its key, hashes, checks and places."""
    if got:
        got = sorted(got, key=lambda x: x[0])
        keys, sizes = np.array([x[0] for x in got], np.int64), [x[2].size for x in got]
        docs, numbers = np.repeat(keys, sizes), np.repeat(np.array([x[1] for x in got], np.int32), sizes)
        hashes, checks, at = (np.concatenate([x[k] for x in got]) for k in (2, 3, 4))
        if (keys[1:] == keys[:-1]).any():
            order = np.lexsort((at, docs))
            hashes, checks, docs, numbers, at = (x[order] for x in (hashes, checks, docs, numbers, at))
        rows = list(_packed(hashes, checks, docs, numbers, at, buckets))
        for k in range(0, len(rows), 32):
            yield _rows(rows[k : k + 32])


def _in_batches(batches: Iterator[pa.RecordBatch], entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """``entries(row)`` gives a document's hashes and their places; batches of documents are packed."""
    waiting: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            hashes, at = entries(row)
            if hashes.size:
                waiting.append((row[0], 0, hashes, np.zeros(hashes.size, np.uint32), at.astype(np.int32)))
                n += hashes.size
                if n >= BATCH:
                    yield from _packed_batches(waiting, buckets)
                    waiting, n = [], 0
    yield from _packed_batches(waiting, buckets)


def _repeated(batches: Iterator[pa.RecordBatch], keep_first: bool, groups: int) -> Iterator[pa.RecordBatch]:
    """Of a task's buckets: the places whose hash repeats, by groups of documents; all but the first of each hash if ``keep_first``."""
    got: list[list[np.ndarray]] = [[], [], [], [], [], []]
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, hashes, checks, twice, docs, numbers, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            docs, numbers, at = np.frombuffer(docs, np.int64), np.frombuffer(numbers, np.int32), np.frombuffer(at, np.int32)
            if hashes:
                for out, x in zip(got, (np.frombuffer(hashes, np.uint64), np.frombuffer(checks, np.uint32), np.frombuffer(twice, bool), docs, numbers, at), strict=True):
                    out.append(x)
            else:
                known.append((docs, numbers, at))
    if got[0]:
        hashes, checks, twice, docs, numbers, at = map(np.concatenate, got)
        order = np.lexsort((at, docs, checks, hashes) if checks.any() else (at, docs, hashes))
        hashes, checks, twice, docs, numbers, at = (x[order] for x in (hashes, checks, twice, docs, numbers, at))
        first = np.ones(hashes.size, bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        if keep_first:
            hit = (docs != docs[starts][group]) | (at != at[starts][group])
        else:
            hit = (twice | (np.diff(np.append(starts, hashes.size))[group] > 1)).astype(bool)
        known.append((docs[hit], numbers[hit], at[hit]))
    if not known:
        return
    docs, numbers, at = (np.concatenate(x) for x in zip(*known, strict=True))
    group = _group(docs, groups)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(groups), "right")
    rows, start = [], 0
    for g, end in enumerate(ends.tolist()):
        if end > start:
            part = order[start:end]
            rows.append((g, docs[part].tobytes(), numbers[part].tobytes(), at[part].tobytes()))
        start = end
    for k in range(0, len(rows), 64):
        columns = zip(*rows[k : k + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["g", "docs", "rows", "at"])


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys ^ (keys >> 7) ^ (keys >> 17)) % groups


def _places(packed: DataFrame, n: int, keep_first: bool) -> DataFrame:
    """``g, docs, rows, at``: the places found, one row for each task and group of documents."""
    return packed.repartition(n, "bucket").mapInArrow(lambda batches: _repeated(batches, keep_first, n), "g int, docs binary, rows binary, at binary")


def _by_row(found: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """A group's places by key and number of the row."""
    if not found.num_rows:
        return {}
    docs, rows, at = (np.concatenate([np.frombuffer(x, t) for x in found[c].to_pylist()]) for c, t in (("docs", np.int64), ("rows", np.int32), ("at", np.int32)))
    order = np.lexsort((rows, docs)) if rows.any() else np.argsort(docs, kind="stable")
    docs, rows, at = docs[order], rows[order], at[order]
    starts = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1])))
    return dict(zip(zip(docs[starts].tolist(), rows[starts].tolist(), strict=True), np.split(at, starts[1:]), strict=True))


def _numbers(keys: list[int], texts: list[str | None]) -> list[int]:
    """The number of each row's text among the different texts of its key, the same however the rows come."""
    if len(set(keys)) == len(keys):
        return [0] * len(keys)
    of: dict[int, set[str]] = {}
    for k, text in zip(keys, texts, strict=True):
        of.setdefault(k, set()).add(text or "")
    number = {k: {text: n for n, text in enumerate(sorted(found))} for k, found in of.items()}
    return [number[k][text or ""] for k, text in zip(keys, texts, strict=True)]


def repeated_windows(docs: DataFrame, window: int = 20) -> tuple[DataFrame, DataFrame]:
    """The documents (``g, key, text``), dealt by groups ``g`` of keys, and by
    group the documents and starts of windows that occur earlier too."""
    if window < PERIOD + RUN - 1:
        raise ValueError(f"windows of fewer than {PERIOD + RUN - 1} words can miss the anchors")
    spark = docs.sparkSession
    importable(spark)
    n = groups(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    group = F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", 7)).bitwiseXOR(F.shiftright("key", 17)), F.lit(n)).cast("int")

    def anchors(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        words = split(row[1])
        if len(words) < window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes = run_hashes(word_hashes(words), RUN)
        at = np.arange(hashes.size)
        at = at[np.isin(at % PERIOD, COVER)]
        return hashes[at], at

    def windows(text: str | None, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = split(text)
        hashes, checks = run_hashes(word_hashes(words), window), run_checks(words, window)
        #: Rows of one key share their anchors, also those beyond the end of a shorter text.
        at = at[at < hashes.size + window]
        near = np.zeros(hashes.size + window + 1, np.int32)
        np.add.at(near, np.maximum(at - (window - RUN), 0), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(near)[: hashes.size] > 0)
        return hashes[starts], checks[starts], starts.astype(np.int32)

    def whole(table: pa.Table, found: pa.Table) -> pa.Table:
        places, got, done = _by_row(found), [], set()
        keys, texts = table["key"].to_pylist(), table["text"].to_pylist()
        for k, number, text in zip(keys, _numbers(keys, texts), texts, strict=True):
            if (k, 0) in places and (k, number) not in done:
                done.add((k, number))
                hashes, checks, at = windows(text, places[k, 0])
                if hashes.size:
                    got.append((k, number, hashes, checks, at))
        return pa.Table.from_batches(list(_packed_batches(got, n)), _rows([]).schema)

    some = rows.mapInArrow(lambda batches: _in_batches(batches, anchors, n), PACKED)
    dealt = rows.select(group.alias("g"), "key", "text").repartition(n, "g")
    near = dealt.groupBy("g").cogroup(_places(some, n, False).groupBy("g")).applyInArrow(whole, PACKED)
    return dealt, _places(near, n, True)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each row of ``docs`` (``doc_id, text``).

    A null or empty text has no words and keeps an empty text. A null
    ``doc_id`` counts as smaller than any other; of rows that repeat a
    ``doc_id``, the same place in each counts as one, so none of them loses it
    to another. Other columns are not read.
    """
    dealt, found = repeated_windows(docs, window)

    def kept(table: pa.Table, found: pa.Table) -> pa.Table:
        places, out = _by_row(found), [[], [], [], []]
        keys, texts = table["key"].to_pylist(), table["text"].to_pylist()
        for key, number, text in zip(keys, _numbers(keys, texts), texts, strict=True):
            words = split(text)
            n = len(words)
            if (key, number) in places:
                change = np.zeros(n + 1, np.int32)
                at = places[key, number]
                at = at[at + window <= n]
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:n] == 0).tolist()]
            for column, x in zip(out, (None if key == NO_ID else key, n, n - len(words), b" ".join(words)), strict=True):
                column.append(x)
        arrays = [pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
        return pa.table([*arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")
