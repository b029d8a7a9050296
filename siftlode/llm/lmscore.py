"""Stupid-backoff scores of every document under the corpus' own n-gram counts.

Documents are dealt into groups by a hash of their id. A group asks for the
counts of the n-grams it has: each distinct hash goes once, with the group's
own count, to the bucket of the hash space that holds that part of the count
table. A bucket adds up what all groups send and answers each in the order
asked. Answers meet their group again, and each document's scores are summed.

n-grams of two and three words count only from ``min_count`` on, so trigrams
are asked for only where both bigrams within are frequent enough. A frequent
n-gram reaches its bucket once for each group, never once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.hashing import mixed, split, word_hashes
from siftlode.llm.shared import groups, importable, stored, work_dir

ASK = "bucket int, g int, n int, hashes binary, counts binary"
ANSWER = "g int, n int, bucket int, counts binary"
NO_ID = -(1 << 63)
BACKOFF = 0.4
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; rising ones by their differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _loose(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


class _Group:
    """The words of a group's documents and the hashes of their n-grams, by the place of the last word."""

    def __init__(self, table: pa.Table):
        self.keys = table["key"].to_numpy()
        each = [word_hashes([x.lower() for x in split(t)]) for t in table["text"].to_pylist()]
        self.lengths = np.array([x.size for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(self.lengths.size), self.lengths)
        self.place = np.arange(self.words.size) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose word ends an n-gram within its document, and the n-grams' hashes."""
        at = np.flatnonzero(self.place >= n - 1)
        if n == 1:
            return at, self.words
        out = self.words[at] * _ODD[0] + np.uint64(n)
        for k in range(1, n):
            out += self.words[at - k] * _ODD[k]
        return at, mixed(out)


class _Distinct:
    """Distinct hashes in the order of their buckets."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        order = np.argsort(hashes)
        first = np.ones(hashes.size, bool)
        first[1:] = hashes[order[1:]] != hashes[order[:-1]]
        starts = np.flatnonzero(first)
        self.own = np.diff(np.append(starts, hashes.size)).astype(np.int64)
        self.hashes = hashes[order][starts]
        self.which = np.empty(hashes.size, np.int64)
        self.which[order] = np.cumsum(first) - 1
        bucket = (self.hashes % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.ends = np.searchsorted(bucket[self.order], np.arange(buckets), "right")

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        start = 0
        for k, end in enumerate(self.ends.tolist()):
            if end > start:
                yield k, self.order[start:end]
            start = end

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """The corpus' count of each n-gram asked about, by place."""
        counts = np.zeros(self.hashes.size, np.int64)
        for k, part in self.parts():
            counts[part] = _loose(answers[k], np.int64)
        return counts[self.which]


def _asked(g: int, orders: list[tuple[int, _Distinct]]) -> pa.Table:
    rows = [(k, g, n, _squeezed(x.hashes[part], rising=True), _squeezed(x.own[part])) for n, x in orders for k, part in x.parts()]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["bucket", "g", "n", "hashes", "counts"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up what the groups ask of a task's buckets, and answer each."""
    asks = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if not asks:
        return
    each = [_loose(x[3], np.uint64, rising=True) for x in asks]
    hashes = np.concatenate(each)
    counts = np.concatenate([_loose(x[4], np.int64) for x in asks])
    order = np.argsort(hashes)
    first = np.ones(hashes.size, bool)
    first[1:] = hashes[order[1:]] != hashes[order[:-1]]
    sums = np.add.reduceat(counts[order], np.flatnonzero(first))
    total = np.empty(hashes.size, np.int64)
    total[order] = sums[np.cumsum(first) - 1]
    start, rows = 0, []
    for (bucket, g, n, _, _), asked in zip(asks, each, strict=True):
        end = start + asked.size
        rows.append((g, n, bucket, _squeezed(total[start:end])))
        start = end
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], ["g", "n", "bucket", "counts"])


def _by_order(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {1: {}, 2: {}, 3: {}}
    for n, bucket, counts in zip(table["n"].to_pylist(), table["bucket"].to_pylist(), table["counts"].to_pylist(), strict=True):
        out[n][bucket] = counts
    return out


def backoff_scores(docs: DataFrame, min_count: int = 2, backoff: float = BACKOFF, folder: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_trigram, n_bigram, n_unigram, score`` of each row of ``docs`` (``doc_id, text``).

    ``score`` is the sum of natural logarithms of the stupid-backoff scores of
    the document's words, ASCII letters in lower case; the three counts say how
    many words were scored by which order. A word is scored by the longest
    n-gram within its document that the corpus has ``min_count`` times; each
    step back from the longest that would fit costs a factor ``backoff``. A
    null or empty text has no words and the score 0. Repeated rows count as
    often as they are there. Other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    folder = folder or work_dir(spark, "lmscore")
    buckets = groups(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(buckets)).cast("int").alias("g"), key.alias("key"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition(buckets, "g")

    def first(table: pa.Table) -> pa.Table:
        group = _Group(table)
        return _asked(table["g"][0].as_py(), [(n, _Distinct(group.hashes(n)[1], buckets)) for n in (1, 2)])

    def counted(group: _Group, answers: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of unigrams and bigrams by place, and the places whose trigram may be frequent."""
        one, two = _Distinct(group.words, buckets).answered(answers[1]), np.zeros(group.words.size, np.int64)
        at, hashes = group.hashes(2)
        two[at] = _Distinct(hashes, buckets).answered(answers[2])
        may = np.flatnonzero(group.place >= 2)
        return one, two, may[(two[may] >= min_count) & (two[may - 1] >= min_count)]

    def trigrams(group: _Group, may: np.ndarray) -> np.ndarray:
        at, hashes = group.hashes(3)
        return hashes[np.searchsorted(at, may)]

    def second(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _asked(0, [])
        group = _Group(table)
        may = counted(group, _by_order(got))[2]
        return _asked(table["g"][0].as_py(), [(3, _Distinct(trigrams(group, may), buckets))])

    def last(table: pa.Table, got: pa.Table) -> pa.Table:
        group, answers = _Group(table), _by_order(got)
        one, two, may = counted(group, answers)
        three = np.zeros(group.words.size, np.int64)
        three[may] = _Distinct(trigrams(group, may), buckets).answered(answers[3])
        before = np.concatenate([[1], one[:-1]]), np.concatenate([[1], two[:-1]])
        by = np.where(three >= min_count, 3, np.where(two >= min_count, 2, 1))
        top, under = np.where(by == 3, three, np.where(by == 2, two, one)), np.where(by == 3, before[1], np.where(by == 2, before[0], 1))
        steps = np.minimum(group.place + 1, 3) - by
        logs = np.log(top / under) + steps * np.log(backoff) if top.size else np.empty(0)
        n = group.lengths.size
        sums = {f"n{k}": np.bincount(group.doc[by == k], minlength=n) for k in (3, 2, 1)}
        return pa.table({"key": group.keys, "n_words": group.lengths, **{k: pa.array(x, pa.int64()) for k, x in sums.items()}, "logs": np.bincount(group.doc, weights=logs, minlength=n)})

    asks = dealt.groupBy("g").applyInArrow(first, ASK).repartition(buckets, "bucket")
    low = asks.mapInArrow(_answers, ANSWER)
    more = dealt.groupBy("g").cogroup(low.groupBy("g")).applyInArrow(second, ASK).repartition(buckets, "bucket")
    high = more.mapInArrow(_answers, ANSWER)
    sums = dealt.groupBy("g").cogroup(low.union(high).groupBy("g")).applyInArrow(last, "key long, n_words long, n3 long, n2 long, n1 long, logs double")
    sums = stored(sums, folder, "sums")
    total = sums.agg(F.sum("n_words")).first()[0] or 1
    doc_id = F.when(F.col("key") != NO_ID, F.col("key"))
    return sums.select(doc_id.alias("doc_id"), "n_words", F.col("n3").alias("n_trigram"), F.col("n2").alias("n_bigram"), F.col("n1").alias("n_unigram"), (F.col("logs") - F.col("n1") * F.log(F.lit(float(total)))).alias("score"))
