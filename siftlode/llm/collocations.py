"""Phrases of two to four words whose words belong together, by language.

Toivonen's way to the frequent phrases: a sample of documents proposes phrases
under a lowered threshold. One pass over all documents counts the proposed
phrases and their negative border exactly: every phrase that was not proposed
although all shorter phrases in it were (each word that was not proposed is on
it). A phrase of the border that turns out frequent is a failure of the sample;
it joins the proposals, and a further pass counts what it adds to the border,
until no pass finds a failure. Then the frequent phrases are complete, whatever
the sample was.

These passes count 64-bit hashes, which may only count too much; a last pass
counts the phrases that got through by 96 bits of two hashes, which stand for
the phrase. It also finds, of the segments of texts that have a phrase, the one
with the least tag (a hash of the segment), and only this one tells the
phrase's text, so texts do not travel from every task that met them. Tasks know
proposals, and which segment is to tell what, by filters of bounded size, which
may only let too much be counted or told.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlode.llm.filters import Members, members_of
from siftlode.llm.hashing import mixed
from siftlode.llm.lmscore import _loose, _squeezed
from siftlode.llm.shared import importable, parts, stored, work_dir

LONGEST = 4
#: Bytes of text that a task looks at together, and hashes that it counts together.
BLOCK, TOGETHER = 256 << 10, 500_000
#: Bytes of text whose phrases are made one together, and phrases that a task keeps before it sends them.
MET, KNOWN = 3 << 20, 600_000
PACKED = "bucket int, hashes binary, counts binary"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What a byte is: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.array([2 if c in b".,;:!?\n\x0b\x0c\r" else 1 if c in b" \t" else 0 for c in range(256)], np.uint8)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BASES = (0x100000001B3 * 0x9E3779B1 | 1, 0xA24BAED4963EE407)


class _Powers:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            of = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b % (1 << 64), np.uint64)))
            self.up, self.down = of(self.base), of(pow(self.base, -1, 1 << 64))
        return self.up, self.down


_POWERS = tuple(map(_Powers, _BASES))


class _Words:
    """The words of a block of segments, with their hashes.

    ``segments``: text in lower case, language and how many words at its start were counted with the segment before.
    """

    def __init__(self, segments: list[tuple[bytes, str, int]], second: bool = False):
        self.data = b"\n".join([s for s, _, _ in segments]) + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        kind = _KIND[data]
        word = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2].astype(np.int32), edge[1::2].astype(np.int32)
        #: Each segment ends with a break, so no piece goes beyond it.
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        sizes = np.array([len(s) + 1 for s, _, _ in segments])
        begins = np.cumsum(sizes) - sizes
        self.segment = (np.searchsorted(begins, self.start, "right") - 1).astype(np.int32)
        first = np.searchsorted(self.start, begins)
        carried = np.array([c for _, _, c in segments])
        self.own = np.arange(self.start.size) - first[self.segment] >= carried[self.segment]
        self.langs = [lang for _, lang, _ in segments]
        seeds = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang in self.langs], np.uint64)
        self.hash = self._hashes(data, 0) + seeds[self.segment]
        self.other = self._hashes(data, 1) + seeds[self.segment] if second else None

    def _hashes(self, data: np.ndarray, k: int) -> np.ndarray:
        up, down = _POWERS[k].to(data.size + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size])))
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def ends(self, n: int) -> np.ndarray:
        """Of which words a phrase of ``n`` words is the last, within a piece."""
        out = np.zeros(self.start.size, bool)
        out[n - 1 :] = self.piece[n - 1 :] == self.piece[: self.piece.size - n + 1]
        return out

    def phrases(self, at: np.ndarray, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the phrases of ``n`` words that end at ``at``."""
        hashes = self.hash if hashes is None else hashes
        out = hashes[at] * _ODD[0] + np.uint64(n)
        for k in range(1, n):
            out += hashes[at - k] * _ODD[k]
        return mixed(out)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join([self.data[self.start[k] : self.end[k]] for k in range(at - n + 1, at + 1)])


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[bytes, str, int]]]:
    """Blocks of some ``size`` bytes of texts (``lang, text`` as bytes); a longer text is cut between words and goes on with the three words before the cut."""
    block, n = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            lang = batch["lang"][k].as_py()
            text, begin, carried = batch["text"][k].as_py().translate(_LOWER), 0, 0
            while len(text) - begin > size:
                end = begin + size
                while end < len(text) and not _KIND[text[end]]:
                    end += 1
                part = text[begin:end]
                yield [(part, lang, carried)]
                back = _Words([(part, lang, 0)]).start[1 - LONGEST :]
                begin, carried = (begin + int(back[0]) if back.size else end), back.size
            block.append((text[begin:], lang, carried))
            n += len(text) - begin
            if n >= size:
                yield block
                block, n = [], 0
    if block:
        yield block


def _to_count(words: _Words, orders: Iterable[int], members: Members | None, new: Members | None) -> Iterator[np.ndarray]:
    """Hashes of phrases of ``orders`` whose two longest parts are members, and one of them new if ``new`` is given."""
    at = np.arange(words.start.size)
    before = fresh = None
    for n in range(1, max(orders) + 1):
        if n > 1:
            both = words.ends(n)
            both[1:] &= before[1:] & before[:-1]
            at = np.flatnonzero(both)
        hashes = words.phrases(at, n)
        if n in orders:
            wanted = words.own[at]
            if new is not None:
                wanted &= (fresh[at] | fresh[at - 1]) if n > 1 else False
            yield hashes[wanted]
        if n < max(orders):
            before = np.zeros(words.start.size, bool)
            before[at] = members.has(hashes)
            if new is not None:
                fresh = np.zeros(words.start.size, bool)
                fresh[at] = new.has(hashes)


def _packed(waiting: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    if not waiting:
        return
    hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
    bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets), "right").tolist()
    rows, start = [], 0
    for k, end in enumerate(ends):
        if end > start:
            rows.append((k, _squeezed(hashes[start:end], rising=True), _squeezed(counts[start:end].astype(np.int32))))
        start = end
    columns = zip(*rows, strict=True) if rows else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["bucket", "hashes", "counts"])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of a task's buckets: hashes that come to ``least`` or more."""
    by_bucket: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for k, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_bucket.setdefault(k, []).append((hashes, counts))
    for rows in by_bucket.values():
        hashes = np.concatenate([_loose(h, np.uint64, rising=True) for h, _ in rows])
        counts = np.concatenate([_loose(c, np.int32) for _, c in rows])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        total = np.add.reduceat(counts, first, dtype=np.int64)
        found = hashes[first][total >= least]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])


def _counted(read: DataFrame, orders: tuple[int, ...], least: int, members: Members | None = None, new: Members | None = None) -> DataFrame:
    """``h``: hashes of phrases that ``read`` (``lang, text`` as bytes) has ``least`` times."""
    n = parts(read.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for block in _segments(batches, BLOCK):
            for hashes in _to_count(_Words(block), orders, members, new):
                waiting.append(hashes)
                size += hashes.size
            if size >= TOGETHER:
                yield from _packed(waiting, 4 * n)
                waiting, size = [], 0
        yield from _packed(waiting, 4 * n)

    return read.mapInArrow(hashed, PACKED).repartition(n, "bucket").mapInArrow(lambda batches: _summed(batches, least), "h long")


def _tags(segments: list[tuple[bytes, str, int]]) -> np.ndarray:
    """A number for each segment, by its language and text alone."""
    return np.array([xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(lang.encode())) for text, lang, _ in segments], np.uint64)


def _found(words: _Words, members: Members) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last words, lengths and both hashes (64 and 32 bits) of a block's phrases that are members."""
    out, before = [], None
    for n in range(1, LONGEST + 1):
        both = words.ends(n)
        if n > 1:
            both[1:] &= before[1:] & before[:-1]
        at = np.flatnonzero(both)
        hashes = words.phrases(at, n)
        is_in = members.has(hashes)
        before = np.zeros(words.start.size, bool)
        before[at[is_in]] = True
        is_in &= words.own[at]
        at = at[is_in]
        out.append((at.astype(np.int32), np.full(at.size, n, np.int8), hashes[is_in], (words.phrases(at, n, words.other) >> np.uint64(32)).astype(np.uint32)))
    at, lengths, hashes, others = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, lengths, hashes, others


#: Both hashes of phrases, how often they were met and the least tag of a segment that has them.
_Met = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _one_each(met: list[_Met]) -> _Met:
    """Phrases made one, in the order of their hashes."""
    hashes, others, counts, tags = (np.concatenate(x) for x in zip(*met, strict=True))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    if (same & (others[order][1:] != others[order][:-1])).any():
        order = np.lexsort((others, hashes))
    hashes, others = hashes[order], others[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1]))) if order.size else order
    if not first.size:
        return hashes, others, counts, tags
    return hashes[first], others[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(tags[order], first)


def _pairs(hashes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One hash for a phrase and the tag of a segment."""
    return mixed(hashes ^ (tags.astype(np.uint64) * _ODD[2]))


def _witnesses(read: DataFrame, members: Members, least: int) -> DataFrame:
    """``h, o, n, pair``: phrases (by 96 bits of two hashes) that ``read`` has ``least`` times, how often, and the phrase with the least tag of a segment that has it."""
    n = parts(read.sparkSession)
    buckets = 4 * n
    kinds = [("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "others", "counts", "tags"))]

    def given(met: _Met) -> pa.RecordBatch:
        hashes, others, counts, tags = met
        bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        rows, start = [], 0
        for k, end in enumerate(np.searchsorted(bucket, np.arange(buckets), "right").tolist()):
            if end > start:
                part = slice(start, end)
                rows.append((k, _squeezed(hashes[part], rising=True), *(_squeezed(x[part]) for x in (others, counts, tags))))
            start = end
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = [], [], 0
        for block in _segments(batches, BLOCK):
            words = _Words(block, second=True)
            at, _, hashes, others = _found(words, members)
            tags = (_tags(block) >> np.uint64(32)).astype(np.uint32)
            waiting.append((hashes, others, np.ones(at.size, np.int64), tags[words.segment[at]]))
            size += len(words.data)
            if size >= MET:
                known = [_one_each([*known, _one_each(waiting)])]
                waiting, size = [], 0
                if known[0][0].size >= KNOWN:
                    yield given(known[0])
                    known = []
        if waiting or known:
            yield given(_one_each([*known, *waiting]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple]] = {}
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_bucket.setdefault(k, []).append(row)
        for rows in by_bucket.values():
            met = [(_loose(h, np.uint64, rising=True), _loose(o, np.uint32), _loose(c, np.int64), _loose(t, np.uint32)) for h, o, c, t in rows]
            hashes, others, counts, tags = _one_each(met)
            own = counts >= least
            columns = [hashes[own].view(np.int64), others[own].view(np.int32), counts[own], _pairs(hashes, tags)[own].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "o", "n", "pair"])

    packed = read.mapInArrow(counted, "bucket int, hashes binary, others binary, counts binary, tags binary")
    return packed.repartition(n, "bucket").mapInArrow(summed, "h long, o int, n long, pair long")


def _texts(read: DataFrame, members: Members, pairs: Members) -> DataFrame:
    """``h, o, lang, phrase, k, n``: phrases of the segments that are to tell their texts; ``k`` 0, no phrase and ``n`` for all words of a language in a task."""
    kinds = [("h", pa.int64()), ("o", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        #: Segments that this task has seen; copies tell nothing more.
        seen: set[int] = set()
        for block in _segments(batches, BLOCK):
            words = _Words(block, second=True)
            for lang, n in zip(words.langs, np.bincount(words.segment[words.own], minlength=len(block)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            tags = _tags(block)
            fresh = np.array([t not in seen and not seen.add(t) for t in tags.tolist()])
            at, lengths, hashes, others = _found(words, members)
            tells = fresh[words.segment[at]]
            tells &= pairs.has(_pairs(hashes, (tags >> np.uint64(32)).astype(np.uint32)[words.segment[at]]))
            at, lengths, hashes, others = (x[tells] for x in (at, lengths, hashes, others))
            _, one = np.unique(hashes ^ (others.astype(np.uint64) * _ODD[1]), return_index=True)
            rows = zip(hashes[one].view(np.int64).tolist(), others[one].view(np.int32).tolist(), at[one].tolist(), lengths[one].tolist(), strict=True)
            yield given([(h, o, words.langs[words.segment[a]], words.text(a, n), n, None) for h, o, a, n in rows])
        yield given([(None, None, lang, None, 0, n) for lang, n in totals.items()])

    return read.mapInArrow(told, "h long, o int, lang string, phrase string, k int, n long")


def _bytes_of(docs: DataFrame) -> DataFrame:
    lang, text = (F.col(f"`{c}`").cast("string") for c in ("lang", "text"))
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))


def frequent_phrases(docs: DataFrame, least: int = 30, share: float = 0.25, lowered: float = 0.5, folder: str | None = None, trace: list | None = None) -> DataFrame:
    """``lang, phrase, k, n``: every phrase of one to four words (``k``) that its language has ``least`` times or more; ``k`` 0 for all words of a language.

    ``share`` of the texts, by their hash, propose phrases that come to
    ``lowered`` times what is to be expected of one at the threshold. Both only
    decide how many passes follow, never the result. ``trace`` gets the number
    of proposals and, for each pass, of its failures.
    """
    spark: SparkSession = docs.sparkSession
    importable(spark)
    folder = folder or work_dir(spark, "collocations")
    trace = [] if trace is None else trace
    read = _bytes_of(docs)
    sample = read.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    enough = max(2, int(share * least * lowered))
    proposed, members = None, None
    for n in range(1, LONGEST + 1):
        found = stored(_counted(sample, (n,), enough, members), folder, f"proposed-{n}")
        proposed = found if proposed is None else proposed.union(found)
        members = members_of(proposed)
    trace.append(proposed.count())
    frequent = stored(_counted(read, tuple(range(1, LONGEST + 1)), least, members), folder, "counted-0")
    new = stored(frequent.join(proposed, "h", "left_anti"), folder, "failed-0")
    passes = 0
    while failed := new.count():
        trace.append(failed)
        passes += 1
        proposed = proposed.union(new)
        found = stored(_counted(read, tuple(range(2, LONGEST + 1)), least, members_of(proposed), members_of(new)), folder, f"counted-{passes}")
        new = stored(found.join(proposed, "h", "left_anti").distinct(), folder, f"failed-{passes}")
        frequent = frequent.union(found)
    members = members_of(frequent.distinct())
    counts = stored(_witnesses(read, members, least), folder, "witnesses")
    told = stored(_texts(read, members, members_of(counts.select(F.col("pair").alias("h")))), folder, "texts")
    totals = told.where(F.col("k") == 0).groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("k"), "n")
    texts = told.where(F.col("k") > 0).groupBy("h", "o").agg(F.min(F.struct("lang", "phrase", "k")).alias("x"))
    return counts.join(texts, ["h", "o"]).select("x.lang", "x.phrase", "x.k", "n").union(totals)


def _exact(x: Column) -> Column:
    return x.cast("decimal(25,0)")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, most: int = 2_000, share: float = 0.25, folder: str | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``most`` best phrases of each language of ``docs`` (``lang, text``).

    Texts are split at ``.,;:!?`` and line ends into pieces, and those at spaces
    and tabs into words, ASCII letters in lower case. A candidate is a phrase of
    two to four words that its language has ``least`` times or more (``a``,
    overlaps included). Cut into two parts that occur ``l`` and ``r`` times it
    scores ``floor(2000000 * a / (l + r))``; its lowest cut counts, of equal ones
    the first. A candidate goes if it lies within a longer one that occurs at
    least ``covered`` in 100 times as often. ``n`` is the number of all words of
    the language. Order: score, then ``a``, descending, then phrase by bytes.

    A null language counts as ``und``, a null text as empty. Repeated rows count
    as often as they are there. A language without candidates has no row, an
    empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "collocations")
    counts = stored(frequent_phrases(docs, least, share, folder=folder), folder, "phrases")
    words = F.split("phrase", " ")
    candidates = counts.where(F.col("k") > 1).select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    known = counts.where(F.col("k") > 0)
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr("cast((2000000 * cast(a as decimal(25,0))) div (cast(l as decimal(25,0)) + cast(r as decimal(25,0))) as bigint)")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda b: F.array_join(F.slice("w", b, s), " "))))
    within = candidates.where(F.col("k") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    covering = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covering, ["lang", "phrase"], "left").where(F.coalesce(_exact(F.col("longer")) * 100 < _exact(F.col("a")) * covered, F.lit(True)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(32)).cast("int"))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    total = counts.where(F.col("k") == 0).select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
