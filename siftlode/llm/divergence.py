"""How the terms of each source differ from other sources of its language.

Single-pass in-memory indexing: a task reads its documents once and builds a
block of postings (term to source and count) until the block is full. The full
block leaves as one run for each shard of the terms' hash space, its terms in
order, and the task begins the next. Runs travel through Spark's shuffle, so
they are on disk and can be made again when an executor is lost. A shard merges
its runs with a heap into the frequencies of its terms, and keeps those that
enough documents have.

Two sources are compared over all kept terms of their language, but most terms
are in neither. So each pair starts from what it would come to if all terms
were absent, and the shards stream corrections to that: one for each term of
either source, by distinct counts, and one for each term that both have.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.shared import importable, parts, stored, work_dir

#: Postings that a task's block holds at most, besides those of one document (some 150 bytes each).
BLOCK = 500_000
#: Cells of the table of terms by sources that a task looks at together.
CELLS = 1_000_000
ONE = 1_000_000_000
RUNS = "shard int, lang string, sources array<string>, terms binary, docs binary, sizes binary, places binary, counts binary"
FREQUENCIES = "lang string, term string, sources array<int>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"
#: What holds terms apart becomes a space, and ASCII letters lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


class _Block:
    """Postings in memory: by language, the documents of each term and, by source, its occurrences."""

    def __init__(self):
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.size = 0

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        own = self.counts[lang][source]
        before = len(own)
        own.update(terms)
        self.size += len(own) - before
        self.docs[lang].update(set(terms))

    def runs(self, shards: int) -> Iterator[tuple]:
        """A run for each shard and language, its terms in order."""
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            rank = {t: k for k, t in enumerate(terms)}
            shard = np.fromiter((zlib.crc32(t) % shards for t in terms), np.int32, len(terms))
            sources = list(self.counts[lang])
            each = [self.counts[lang][s] for s in sources]
            term = np.concatenate([np.fromiter(map(rank.__getitem__, c), np.int64, len(c)) for c in each])
            place = np.repeat(np.arange(len(each), dtype=np.int32), [len(c) for c in each])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in each])
            of_docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            order = np.lexsort((term, shard[term]))
            term, place, count = term[order], place[order], count[order]
            by_shard = np.argsort(shard, kind="stable")
            sizes = np.bincount(term, minlength=len(terms)).astype(np.int32)
            ends, postings = np.searchsorted(shard[by_shard], np.arange(shards), "right"), np.searchsorted(shard[term], np.arange(shards), "right")
            start = begin = 0
            for k, (end, stop) in enumerate(zip(ends.tolist(), postings.tolist(), strict=True)):
                if end > start:
                    own = by_shard[start:end]
                    packed = zstandard.ZstdCompressor(level=1).compress(b" ".join([terms[i] for i in own.tolist()]))
                    yield k, lang, sources, packed, of_docs[own].tobytes(), sizes[own].tobytes(), place[begin:stop].tobytes(), count[begin:stop].tobytes()
                start, begin = end, stop


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


_RUN = [("shard", pa.int32()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), *((n, pa.binary()) for n in ("terms", "docs", "sizes", "places", "counts"))]
_FREQUENCY = [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
_FINDING = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]


def _in_parts(rows, kinds: list, size: int) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= size:
            yield _batch(waiting, kinds)
            waiting = []
    if waiting:
        yield _batch(waiting, kinds)


def _indexed(batches: Iterator[pa.RecordBatch], shards: int, block: int) -> Iterator[pa.RecordBatch]:
    """The runs of a task's documents (``lang, source, text`` as bytes)."""
    held = _Block()
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if terms := text.translate(_FOLD).split():
                held.add(lang, source, terms)
                if held.size >= block:
                    yield from _in_parts(held.runs(shards), _RUN, 64)
                    held = _Block()
    yield from _in_parts(held.runs(shards), _RUN, 64)


def _gathered(kept: list[bytes], runs: list[tuple], hits: list[tuple[int, int, int]]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Terms with their sources and counts, added up over runs. ``hits``: place of the term in ``kept``, run, place in the run."""
    term, run, at = np.array(hits, np.int64).reshape(-1, 3).T
    found = []
    for r in np.unique(run).tolist():
        _, _, starts, places, counts = runs[r]
        which = run == r
        begin, size = starts[at[which]], starts[at[which] + 1] - starts[at[which]]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        postings = np.repeat(begin, size) + step
        found.append((np.repeat(term[which], size), places[postings], counts[postings]))
    term, place, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, term))
    term, place, count = term[order], place[order], count[order]
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])))
    term, place, count = term[new], place[new], np.add.reduceat(count, new)
    ends = np.searchsorted(term, np.arange(len(kept)), "right").tolist()
    start = 0
    for t, end in zip(kept, ends, strict=True):
        yield t, place[start:end].tolist(), count[start:end].tolist()
        start = end


def _merged(batches: Iterator[pa.RecordBatch], names: dict[str, dict[str, int]], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a task's shards by a heap; the frequencies of terms in ``least_docs`` documents or more."""
    by_key = defaultdict(list)
    for batch in batches:
        for shard, lang, sources, terms, docs, sizes, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            number = np.array([names[lang][s] for s in sources], np.int32)
            starts = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)))
            by_key[lang, shard].append((terms, np.frombuffer(docs, np.int64), starts, number[np.frombuffer(places, np.int32)], np.frombuffer(counts, np.int64)))

    def entries(run: int, packed: bytes) -> Iterator[tuple[bytes, int, int]]:
        return ((t, run, k) for k, t in enumerate(zstandard.ZstdDecompressor().decompress(packed).split(b" ")))

    def of(lang: str, runs: list[tuple]) -> Iterator[tuple]:
        docs = [x[1] for x in runs]
        kept, hits = [], []
        for term, same in groupby(heapq.merge(*(entries(r, x[0]) for r, x in enumerate(runs)), key=itemgetter(0)), itemgetter(0)):
            same = list(same)
            if sum(int(docs[r][k]) for _, r, k in same) >= least_docs:
                hits += [(len(kept), r, k) for _, r, k in same]
                kept.append(term)
                if len(hits) >= CELLS:
                    yield from ((lang, t.decode(), *x) for t, *x in _gathered(kept, runs, hits))
                    kept, hits = [], []
        if kept:
            yield from ((lang, t.decode(), *x) for t, *x in _gathered(kept, runs, hits))

    for (lang, _), runs in sorted(by_key.items(), key=lambda x: x[0]):
        yield from _in_parts(of(lang, runs), _FREQUENCY, 5_000)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10 ** 9 * (count + 2) / total)`` exactly, for totals up to 9 * 10 ** 15: three digits at a time."""
    rest, out = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1_000
        out, rest = out * 1_000 + rest // total, rest % total
    return 1 + out


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Corrections:
    """What a task's terms of one language add to pairs of its sources, and each source's best terms."""

    def __init__(self, totals: np.ndarray, terms: int, most: int):
        self.totals, self.whole, self.most = totals + 2 * terms, int(totals.sum()) + 2 * terms, most
        self.absent = _share(np.zeros_like(totals), self.totals)
        self.pairs = np.zeros((totals.size, totals.size), np.int64)
        self.alone: list[Counter] = [Counter() for _ in totals]
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in totals]

    def add(self, terms: list[str], row: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        """``row``: place of each posting's term in ``terms``."""
        names = [t.encode() for t in terms]
        table = np.zeros((len(terms), self.totals.size), np.int64)
        table[row, source] = count
        q = _share(table.sum(axis=1), np.int64(self.whole))
        shares = _share(table, self.totals[None, :])
        for g in range(self.totals.size):
            mine = np.flatnonzero(table[:, g])
            if mine.size:
                self.alone[g].update(table[mine, g].tolist())
                p, other = shares[mine, g][:, None], shares[mine]
                both = _apart(p, other) - _apart(p, self.absent[None, :]) - _apart(self.absent[g], other) + _apart(self.absent[g], self.absent)[None, :]
                self.pairs[g] += np.where(table[mine] > 0, both, 0).sum(axis=0)
                more = mine[shares[mine, g] > q[mine]]
                value = _apart(shares[more, g], q[more])
                if more.size > self.most:
                    least = np.partition(value, more.size - self.most)[more.size - self.most]
                    more, value = more[value >= least], value[value >= least]
                found = self.best[g] + [(-v, names[k]) for k, v in zip(more.tolist(), value.tolist(), strict=True)]
                self.best[g] = heapq.nsmallest(self.most, found)

    def rows(self, lang: str, sources: list[str]) -> Iterator[tuple]:
        for g, alone in enumerate(self.alone):
            if alone:
                counts, times = np.array(list(alone), np.int64), np.array(list(alone.values()), np.int64)
                p = _share(counts, self.totals[g])
                for h in range(len(sources)):
                    change = int(((_apart(p, self.absent[h]) - _apart(self.absent[g], self.absent[h])) * times).sum())
                    if g != h:
                        self.pairs[g, h] += change
                        self.pairs[h, g] += change
        for g, h in zip(*np.nonzero(self.pairs), strict=True):
            if g != h:
                yield lang, sources[g], "pair", sources[h], int(self.pairs[g, h])
        for g, best in enumerate(self.best):
            for value, term in best:
                yield lang, sources[g], "term", term.decode(), -value


def _corrected(batches: Iterator[pa.RecordBatch], names: dict[str, dict[str, int]], totals: dict[str, list[int]], terms: dict[str, int], most: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, _Corrections] = {}
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            if lang not in found:
                found[lang] = _Corrections(np.array(totals[lang], np.int64), terms[lang], most)
            own = batch.take(pa.array(np.flatnonzero(langs == lang)))
            step = max(1, CELLS // len(names[lang]))
            for k in range(0, own.num_rows, step):
                part = own.slice(k, step)
                sources, counts = part["sources"], part["counts"]
                row = np.repeat(np.arange(part.num_rows), sources.value_lengths().to_numpy())
                found[lang].add(part["term"].to_pylist(), row, sources.flatten().to_numpy(), counts.flatten().to_numpy())
    for lang, x in found.items():
        yield from _in_parts(x.rows(lang, list(names[lang])), _FINDING, 10_000)


def term_frequencies(docs: DataFrame, names: dict[str, dict[str, int]], least_docs: int = 10, block: int = BLOCK) -> DataFrame:
    """``lang, term, sources, counts`` of every term that ``least_docs`` documents of its language have; ``sources`` are numbers in ``names``."""
    spark = docs.sparkSession
    importable(spark)
    shards = parts(spark)
    runs = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(lambda batches: _indexed(batches, shards, block), RUNS)
    return runs.repartition(shards, "shard").mapInArrow(lambda batches: _merged(batches, names, least_docs), FREQUENCIES)


def divergences(docs: DataFrame, least_docs: int = 10, most: int = 10, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every language and source of ``docs`` (``lang, source, text``).

    Null texts, languages and sources count as empty. Terms are runs of
    characters other than ASCII ones that are no letters, ASCII letters in lower
    case; a language keeps the terms that at least ``least_docs`` of its
    documents (rows) have. With ``N`` occurrences of kept terms in a source and
    ``V`` kept terms, a term's share is ``1 + floor(10 ** 9 * (count + 2) / (N +
    2 * V))``, and two shares differ by ``floor((p - q) ** 2 / (p + q))``.

    Part ``pair``: ``item`` is another source of the language, ``value`` the
    difference summed over all kept terms (0 if there are none). Part ``term``:
    ``item`` is one of the ``most`` kept terms that the source has and whose
    share differs most from the language's and exceeds it. ``rank`` counts from
    1, ties by ``item`` in the order of UTF-8 bytes. A source without terms has
    its pairs; a language of one source has none; an empty table gives no rows.
    Repeated rows count as often as they are there, other columns are not read.

    The names of all sources go to every task, as the result has a row for each
    pair of them anyway.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "divergence")
    read = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    listed = read.select("lang", "source").distinct()
    names: dict[str, dict[str, int]] = {}
    for lang, source in sorted(map(tuple, listed.collect())):
        of = names.setdefault(lang, {})
        of[source] = len(of)
    frequencies = stored(term_frequencies(read, names, least_docs, block), folder, "frequencies")
    totals, terms = {lang: [0] * len(of) for lang, of in names.items()}, dict.fromkeys(names, 0)
    for lang, n in frequencies.groupBy("lang").count().collect():
        terms[lang] = n
    posting = frequencies.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    for lang, source, n in posting.groupBy("lang", "x.sources").agg(F.sum("x.counts")).collect():
        totals[lang][source] = n

    known = [(lang, source, totals[lang][k], terms[lang]) for lang, of in names.items() for source, k in of.items()]
    sources = spark.createDataFrame(known, "lang string, source string, total long, terms long")
    lowest = F.expr("1 + (2000000000 div (total + 2 * terms))")
    side = sources.select("lang", "source", "terms", F.when(F.col("terms") > 0, lowest).alias("p"))
    other = side.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = F.expr("terms * (((p - q) * (p - q)) div (p + q))")
    absent = side.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(apart, F.lit(0)).alias("value"))
    found = frequencies.mapInArrow(lambda batches: _corrected(batches, names, totals, terms, most), FOUND)
    value = absent.unionByName(found).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = value.withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most)).select("lang", "source", "part", "item", "value", "rank")
