"""Removal of byte strings that stand in an earlier document, by sorted suffixes.

A string is ``width`` bytes of one document; every byte that it covers goes if
the same string starts in a document with a smaller ``doc_id``.

Only suffixes whose first ``width`` bytes may occur in two documents are sorted.
The least hash of the short runs within a string depends on the string alone,
so equal strings have the same one, and neighbouring strings mostly share
theirs: such stretches of starts are *regions*. A first pass sends the hashes
of regions, by hash, and learns which ones two documents have. A second pass
sends those regions with their bytes. Regions of the same bytes count as one,
with the smallest of their documents; that is done in each task before they
travel. Of whole texts that are copies only the first is looked at.

The suffixes of the regions that are left are sorted to the depth of ``width``
bytes, deep-shallow: a multikey sort, eight bytes at a time and each time only
within ties, to a shallow depth; groups that are still tied share a long prefix
and are put in order by blind tries, which keep only how deep the members of a
node agree and the byte that tells them apart. Tries of all groups grow a level
at a time. Suffixes that no byte tells apart are the matches.

A hash that very many places share would bring them all into one task. Strings
of such regions go alone, by a hash of all their bytes.

What a task holds does not grow with the table or with the partitions set for
shuffles: partitions are as many as the bytes of text ask for, with two buckets
each, a bucket is unpacked some megabytes of whole hashes at a time, and long
texts and hot regions are sent in pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.filters import Members, members_of
from siftlode.llm.hashing import mixed
from siftlode.llm.lmscore import _loose, _squeezed
from siftlode.llm.shared import groups, importable, released, stored, work_dir

#: Bytes of the runs whose hashes are compared.
RUN = 20
#: Depth of the multikey sort.
SHALLOW = 24
#: Regions that a task holds at most before it sends them, and bytes of text.
BATCH, TEXT = 400_000, 8 << 20
#: Bytes of text for each partition in the mean, bytes of regions unpacked at a time, and rows read at a time.
SHARE, UNPACKED, ROWS = 20_000_000, 32 << 20, 256
#: Bytes of a text hashed at a time.
CHUNK = 1 << 20
#: Places of one hash from which on its strings go alone.
HOT = 20_000
NO_ID = -(1 << 63)
ASKED = "bucket int, keys binary, sizes binary, hashes binary, twice binary, at binary"
SENT = "bucket int, regions binary, marks binary"
MARKS = "doc long, key long, at int, size int"
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


#: A number for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes, by its start, from those of runs of half the size."""
    h = _BYTES[data]
    known, n = {1: h}, 1
    while 2 * n <= size:
        h = h[:-n] * _ODD[n.bit_length() % 6] + h[n:] if h.size > n else h[:0]
        n *= 2
        known[n] = h
    done = n
    while done < size:
        more = max(k for k in known if k <= size - done)
        m = max(0, data.size - done - more + 1)
        h = h[:m] * _ODD[more.bit_length() % 6] + known[more][done : done + m]
        done += more
    return (h ^ (h >> np.uint64(32))) * _ODD[0]


def least_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """For each string of ``width`` bytes, by its start, the least hash of the runs within."""
    low = run_hashes(data, RUN)
    n, span = 1, width - RUN + 1
    while 2 * n <= span:
        low = np.minimum(low[:-n], low[n:]) if low.size > n else low[:0]
        n *= 2
    return np.minimum(low[: low.size - (span - n)], low[span - n :]) if low.size > span - n else low[:0]


def regions(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (48 bits), first start and number of starts of each region; long texts a chunk at a time."""
    found = []
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, data.size - width + 1, CHUNK):
        low = least_hashes(data[begin : begin + CHUNK + width - 1], width) >> np.uint64(16)
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        found.append((low[at], at + begin, np.diff(np.append(at, low.size))))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _record(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_ASKED = [("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "sizes", "hashes", "twice", "at"))]
_SENT = [("bucket", pa.int32()), ("regions", pa.binary()), ("marks", pa.binary())]
_MARK = [("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32())]


def _is_hot(hashes: np.ndarray, hot: Members) -> np.ndarray:
    """``hot`` has mixed hashes: a filter's words go by the upper bits, which are all zero in hashes of 48 bits."""
    return hot.has(mixed(hashes))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Not by the size of the hash: the least of many hashes are small."""
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int32)


def _asked(waiting: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets, with each hash once. ``waiting``: key of the document, hashes and starts of its regions."""
    if not waiting:
        return
    number = np.repeat(np.arange(len(waiting)), [h.size for _, h, _ in waiting])
    keys = np.array([k for k, _, _ in waiting], np.int64)
    hashes, at = np.concatenate([h for _, h, _ in waiting]), np.concatenate([a for _, _, a in waiting]).astype(np.int32)
    order = np.argsort(hashes, kind="stable")
    first = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
    starts = np.flatnonzero(first)
    times = np.zeros(hashes.size, np.int32)
    #: How many places the hash has here, at the first of them; below zero if they are of two documents.
    last = order[np.append(starts[1:], hashes.size) - 1]
    n = np.diff(np.append(starts, hashes.size))
    times[order[starts]] = np.where(keys[number[last]] != keys[number[order[starts]]], -n, n)
    bucket = _bucket(hashes, buckets)
    #: In the order of documents within a bucket, so that a document's key goes once.
    by = np.lexsort((np.arange(hashes.size), bucket))
    ends = np.searchsorted(bucket[by], np.arange(buckets), "right").tolist()
    rows, start = [], 0
    for k, end in enumerate(ends):
        if end > start:
            part = by[start:end]
            new = np.flatnonzero(np.append(True, number[part][1:] != number[part][:-1]))
            sizes = np.diff(np.append(new, part.size)).astype(np.int32)
            rows.append((k, keys[number[part][new]].tobytes(), _squeezed(sizes), _squeezed(hashes[part]), _squeezed(times[part]), _squeezed(at[part], rising=True)))
        start = end
    for k in range(0, len(rows), 32):
        yield _record(rows[k : k + 32], _ASKED)


def _values(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows as Python values, some at a time: as such they stand in memory once more."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield from zip(*(part[c].to_pylist() for c in columns), strict=True)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's buckets, one after the other: the places whose hash two documents have, with the mixed hash where it is hot."""
    packed: dict[int, list[tuple]] = defaultdict(list)
    for bucket, *row in _values(batches, "bucket", "keys", "sizes", "hashes", "twice", "at"):
        packed[bucket].append(row)
    while packed:
        yield from _shared_places(packed.popitem()[1])


def _shared_places(packed: list[tuple]) -> Iterator[pa.RecordBatch]:
    got: list[tuple[np.ndarray, ...]] = []
    for keys, sizes, hashes, times, at in packed:
        key = np.repeat(np.frombuffer(keys, np.int64), _loose(sizes, np.int32))
        got.append((key, _loose(hashes, np.uint64), _loose(times, np.int32), _loose(at, np.int32, rising=True)))
    key, hashes, times, at = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.argsort(hashes, kind="stable")
    key, hashes, times, at = key[order], hashes[order], times[order], at[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    ends = np.append(starts[1:], hashes.size)
    places = ends - starts
    two = np.minimum.reduceat(times, starts) < 0
    two |= np.maximum.reduceat(key, starts) != np.minimum.reduceat(key, starts)
    hit = np.repeat(two, places)
    hot = np.repeat(two & (places >= HOT), places)[hit]
    key, at, hashes = key[hit], at[hit], mixed(hashes[hit]).view(np.int64)
    order = np.lexsort((at, key))
    for k in range(0, order.size, 100_000):
        part = order[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(at[part]), pa.array(hashes[part], mask=~hot[part])], ["key", "at", "hot"])


def _gathered(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, slice_: int = 1 << 20) -> np.ndarray:
    """Stretches of ``text`` one after the other; some at a time, as places take eight times the bytes."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if ends.size else 0, np.uint8)
    start = filled = 0
    while start < lengths.size:
        stop = max(start + 1, int(np.searchsorted(ends, filled + slice_, "right")))
        n = lengths[start:stop]
        shift = begin[start:stop] - (ends[start:stop] - n - filled)
        size = int(ends[stop - 1]) - filled
        out[filled : filled + size] = text[np.repeat(shift, n) + np.arange(size)]
        start, filled = stop, filled + size
    return out


class _Regions:
    """Regions with their bytes, one after the other in ``text``."""

    FIELDS = (("hash", np.uint64), ("doc", np.int64), ("key", np.int64), ("at", np.int32), ("size", np.int32))

    def __init__(self, columns: dict[str, np.ndarray], text: np.ndarray, width: int):
        self.columns, self.text, self.width = columns, text, width
        lengths = columns["size"].astype(np.int64) + width - 1
        self.begin = np.cumsum(lengths) - lengths
        self.lengths = lengths

    def __len__(self) -> int:
        return self.lengths.size

    def taken(self, rows: np.ndarray) -> _Regions:
        return _Regions({c: x[rows] for c, x in self.columns.items()}, _gathered(self.text, self.begin[rows], self.lengths[rows]), self.width)

    def packed(self) -> bytes:
        head = np.array([len(self)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(self.columns[c].tobytes() for c, _ in self.FIELDS) + self.text.tobytes())

    @classmethod
    def of(cls, packed: list[bytes], width: int, k: int = 0, slices: int = 1) -> _Regions:
        """Regions of the ``k``-th of ``slices`` parts of all hashes."""
        columns, texts = {c: [] for c, _ in cls.FIELDS}, []
        for data in packed:
            data = zstandard.ZstdDecompressor().decompress(data)
            n, place, own = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
            for c, kind in cls.FIELDS:
                own[c] = np.frombuffer(data, kind, n, place)
                place += n * np.dtype(kind).itemsize
            text = np.frombuffer(data, np.uint8, offset=place)
            if slices > 1:
                #: By bits that a bucket's number, a remainder, leaves free.
                part = cls(own, text, width).taken(np.flatnonzero((mixed(own["hash"]) >> np.uint64(32)) % np.uint64(slices) == k))
                own, text = part.columns, part.text
            for c, x in own.items():
                columns[c].append(x)
            texts.append(text)
        return cls({c: np.concatenate(x) for c, x in columns.items()}, np.concatenate(texts), width)

    def merged(self) -> tuple[_Regions, tuple[np.ndarray, ...]]:
        """Regions of different bytes, each with its smallest document, and as marks (document, key, start, number) the starts of those that gave way to a smaller one.

        Of one document and the same bytes all stay, so that each gets its own marks.
        """
        c = self.columns
        whole = _text_hashes(self.text, self.begin, self.lengths)
        order = np.lexsort((c["doc"], whole, c["hash"]))
        sorted_ = self.taken(order)
        c, whole = sorted_.columns, whole[order]
        same = np.zeros(len(self), bool)
        if len(self) > 1:
            same[1:] = (c["hash"][1:] == c["hash"][:-1]) & (whole[1:] == whole[:-1]) & (sorted_.lengths[1:] == sorted_.lengths[:-1])
            same = _equal_bytes(sorted_.text, sorted_.begin, sorted_.lengths, same)
        starts = np.flatnonzero(~same)
        first = np.repeat(starts, np.diff(np.append(starts, len(self))))
        gone = c["doc"] > c["doc"][first]
        return sorted_.taken(np.flatnonzero(~gone)), tuple(c[x][gone] for x in ("doc", "key", "at", "size"))


def _text_hashes(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``text``."""
    data = text.tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[b:e]) for b, e in zip(begin.tolist(), (begin + lengths).tolist(), strict=True)), np.uint64, begin.size)


def _equal_bytes(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of stretches as long as the one before them: whether their bytes are equal, too."""
    rows = np.flatnonzero(which) - 1
    out = np.zeros(which.size, bool)
    if rows.size:
        n = lengths[rows]
        same = _gathered(text, begin[rows], n) == _gathered(text, begin[rows + 1], n)
        out[rows + 1] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _words_at(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``depth`` of each suffix as a number that sorts like them; ``text`` is long enough."""
    out = np.zeros(at.size, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + (depth + k)].astype(np.uint64)
    return out


def _refined(order: np.ndarray, tied: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by ``value`` within ties. ``tied``: for each place of ``order`` whether it is tied with the one before; ``value`` by place."""
    group = np.cumsum(~tied)
    by = np.lexsort((value, group))
    value = value[by]
    still = tied.copy()
    still[1:] &= value[1:] == value[:-1]
    return order[by], still


def _in_ties(tied: np.ndarray) -> np.ndarray:
    """Places that are tied with a neighbour."""
    return np.flatnonzero(tied | np.append(tied[1:], False))


def sorted_suffixes(text: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at``, in the order of their first ``width`` bytes (which ``text`` holds for each), and which of them equal the one before in these."""
    text = np.append(text, np.zeros(8, np.uint8))
    order, tied = np.arange(at.size), np.append(False, np.ones(max(at.size - 1, 0), bool))[: at.size]
    depth = 0
    while depth + 8 <= min(SHALLOW, width):
        places = _in_ties(tied)
        if places.size == 0:
            return order, tied
        order[places], tied[places] = _refined(order[places], tied[places], _words_at(text, at[order[places]], depth))
        depth += 8
    places = _in_ties(tied)
    if places.size:
        order[places], tied[places] = _blind_tries(text, at, order[places], tied[places], depth, width)
    return order, tied


def _blind_tries(text: np.ndarray, at: np.ndarray, order: np.ndarray, tied: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order groups of suffixes that agree in ``depth`` bytes. Each group is the root of a trie; a round finds for every open node how deep its members agree and branches on the byte there."""
    order, tied = order.copy(), tied.copy()
    reached = np.full(order.size, depth, np.int64)
    open_ = _in_ties(tied)
    while open_.size:
        group = np.cumsum(~tied[open_]) - 1
        starts = np.flatnonzero(~tied[open_])
        suffix = at[order[open_]]
        leader = suffix[starts][group]
        agree = _agreement(text, suffix, leader, reached[open_], width)
        node = np.minimum.reduceat(agree, starts)[group]
        done = node >= width
        byte = np.where(done, 0, text[np.minimum(suffix + node, text.size - 1)])
        by = np.lexsort((byte, group))
        order[open_], byte, node = order[open_][by], byte[by], node[by]
        reached[open_] = np.minimum(node + 1, width)
        still = tied[open_]
        still[1:] &= byte[1:] == byte[:-1]
        tied[open_] = still
        left = open_[reached[open_] < width]
        open_ = left[_in_ties(tied[left])] if left.size else left
    return order, tied


def _agreement(text: np.ndarray, suffix: np.ndarray, leader: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """In how many bytes each suffix agrees with its leader, ``width`` at most."""
    out = depth.copy()
    left = np.flatnonzero((suffix != leader) & (depth < width))
    out[suffix == leader] = width
    while left.size:
        same = text[suffix[left] + out[left]] == text[leader[left] + out[left]]
        left = left[same]
        out[left] += 1
        left = left[out[left] < width]
    return out


def _pieces(hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray, hot: Members) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The regions of a text, so many at a time as are sent at once, after the number of rows they make: a hot one goes as its strings."""
    ends, start, before = np.cumsum(np.where(_is_hot(hashes, hot), sizes, 1)), 0, 0
    while start < ends.size:
        stop = max(start + 1, int(np.searchsorted(ends, before + BATCH // 2, "right")))
        yield int(ends[stop - 1]) - before, hashes[start:stop], at[start:stop], sizes[start:stop]
        start, before = stop, int(ends[stop - 1])


def _sent(waiting: list[tuple], buckets: int, hot: Members, width: int) -> Iterator[tuple[str, tuple]]:
    """``waiting``: document, key, text from its first region on, hashes, starts and sizes of its regions. Merged regions by bucket, and marks."""
    if not waiting:
        return
    hashes, at, sizes = (np.concatenate([w[k] for w in waiting]) for k in (3, 4, 5))
    number = np.repeat(np.arange(len(waiting)), [w[3].size for w in waiting])
    lengths = np.array([len(w[2]) for w in waiting])
    begin = (np.cumsum(lengths) - lengths - np.array([w[4][0] for w in waiting]))[number] + at
    alone = _is_hot(hashes, hot)
    if alone.any():
        #: Each string on its own.
        n = np.where(alone, sizes, 1)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number, begin, at, hashes = (np.repeat(x, n) for x in (number, begin, at, hashes))
        sizes, begin, at = np.where(np.repeat(alone, n), 1, np.repeat(sizes, n)), begin + step, at + step
        alone = np.repeat(alone, n)
    text = np.frombuffer(b"".join([w[2] for w in waiting]), np.uint8)
    columns = {"hash": hashes, "doc": np.array([w[0] for w in waiting], np.int64)[number], "key": np.array([w[1] for w in waiting], np.int64)[number], "at": at.astype(np.int32), "size": sizes.astype(np.int32)}
    found = _Regions(columns, _gathered(text, begin, sizes + width - 1), width)
    if alone.any():
        columns["hash"] = np.where(alone, _text_hashes(found.text, found.begin, found.lengths), hashes)
    found, marks = found.merged()
    yield "marks", marks
    bucket = _bucket(found.columns["hash"], buckets)
    order = np.argsort(bucket, kind="stable")
    ends, start = np.searchsorted(bucket[order], np.arange(buckets), "right").tolist(), 0
    for k, end in enumerate(ends):
        if end > start:
            yield "regions", (k, found.taken(order[start:end]).packed())
        start = end


def _marked(packed: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Marks of a bucket, some of its hashes at a time: starts whose string stands in a smaller document."""
    slices = -(-sum(zstandard.frame_content_size(x) for x in packed) // UNPACKED)
    for k in range(slices):
        yield from _region_marks(_Regions.of(packed, width, k, slices), width)


def _region_marks(found: _Regions, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    found, marks = found.merged()
    yield marks
    #: Regions of one hash but different bytes, or of one document, may still share strings.
    hashes = found.columns["hash"]
    rows = _in_ties(np.append(False, hashes[1:] == hashes[:-1])) if len(found) else np.empty(0, np.int64)
    #: Whole groups of a hash, some at a time.
    new = np.flatnonzero(np.append(True, hashes[rows][1:] != hashes[rows][:-1])) if rows.size else rows
    load = np.cumsum(found.columns["size"][rows].astype(np.int64))
    start = 0
    while start < rows.size:
        end = int(np.searchsorted(load, (load[start - 1] if start else 0) + BATCH, "left")) + 1
        after = new[new >= end]
        end = int(after[0]) if after.size else rows.size
        some = found.taken(rows[start:end])
        start = end
        sizes = some.columns["size"].astype(np.int64)
        region = np.repeat(np.arange(len(some)), sizes)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, tied = sorted_suffixes(some.text, some.begin[region] + step, width)
        doc = some.columns["doc"][region][order]
        starts = np.flatnonzero(~tied)
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, doc.size)))
        gone = np.zeros(doc.size, bool)
        gone[order] = doc > least
        #: Starts of one region that follow each other make one mark.
        gone_at = np.flatnonzero(gone)
        if gone_at.size:
            begin = np.append(True, (gone_at[1:] != gone_at[:-1] + 1) | (region[gone_at[1:]] != region[gone_at[:-1]]))
            first = np.flatnonzero(begin)
            head = gone_at[first]
            yield some.columns["doc"][region[head]], some.columns["key"][region[head]], (some.columns["at"][region[head]] + step[head]).astype(np.int32), np.diff(np.append(first, gone_at.size)).astype(np.int32)


def _mark_rows(marks: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for k in range(0, marks[0].size, 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k : k + 100_000]), t) for x, (_, t) in zip(marks, _MARK, strict=True)], [c for c, _ in _MARK])


def _met(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """All marks of a task's buckets, one after the other; those made before are handed on."""
    packed: dict[int, list[bytes]] = defaultdict(list)
    for bucket, regions_, marks in _values(batches, "bucket", "regions", "marks"):
        if regions_ is not None:
            packed[bucket].append(regions_)
        else:
            found = np.frombuffer(marks, np.int64).reshape(4, -1)
            yield from _mark_rows((found[0], found[1], found[2].astype(np.int32), found[3].astype(np.int32)))
    while packed:
        for marks in _marked(packed.popitem()[1], width):
            yield from _mark_rows(marks)


def _later_copy() -> Column:
    """Whether a text stands in a smaller document as a whole."""
    return F.coalesce(F.exists("copies", lambda x: (x["check"] == F.col("check")) & (x["first"] < F.col("doc"))), F.lit(False))


def copied_texts(docs: DataFrame) -> DataFrame:
    """``key, copies``: texts that several documents have, with the smallest one of these."""
    same = docs.groupBy("key", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last"))
    return same.groupBy("key").agg(F.collect_list(F.struct("check", "first")).alias("copies"))


def earlier_strings(docs: DataFrame, copies: DataFrame, width: int = 50, folder: str | None = None) -> DataFrame:
    """``doc, key, at, size``: starts of strings of ``docs`` (``doc, key, check, text`` as bytes) that also start in a smaller ``doc``, as runs. Texts that stand in a smaller ``doc`` as a whole (``copies``) are left out."""
    if not RUN <= width:
        raise ValueError(f"strings have {RUN} bytes at least")
    spark = docs.sparkSession
    importable(spark)
    folder = folder or work_dir(spark, "suffixes")
    n = groups(docs, size=SHARE)

    def dealt(rows: DataFrame) -> DataFrame:
        """Two buckets for each partition."""
        return rows.repartitionById(n, F.col("bucket") % n)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for key, text in _values(batches, "key", "text"):
            hashes, at, _ = regions(text, width)
            if hashes.size:
                waiting.append((key, hashes, at))
                size += hashes.size
                if size >= BATCH:
                    yield from _asked(waiting, 2 * n)
                    waiting, size = [], 0
        yield from _asked(waiting, 2 * n)

    places = dealt(docs.select("key", "text").mapInArrow(asked, ASKED)).mapInArrow(_shared, "key long, at int, hot long")
    #: Stored by text: fewer files than tasks.
    by_key = stored(places.groupBy("key").agg(F.collect_list("at").alias("at"), F.collect_set("hot").alias("hot")), folder, "places")
    #: A hash that the filter takes for a hot one goes alone everywhere, so that costs time at most.
    hot = members_of(by_key.select(F.explode("hot").alias("h")).distinct())
    released(spark)
    found = docs.join(by_key.drop("hot").join(copies, "key", "left"), "key").where(~_later_copy()).select("doc", "key", "text", "at")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, held = [], 0, 0

        def given() -> Iterator[pa.RecordBatch]:
            for what, x in _sent(waiting, 2 * n, hot, width):
                if what == "regions":
                    yield _record([(*x, None)], _SENT)
                else:
                    table = np.stack([c.astype(np.int64) for c in x])
                    for k in range(0, table.shape[1], 100_000):
                        #: Any bucket will do, but not one for all.
                        part = np.ascontiguousarray(table[:, k : k + 100_000])
                        yield _record([(int(part[1, 0]) % (2 * n), None, part.tobytes())], _SENT)

        for doc, key, text, at in _values(batches, "doc", "key", "text", "at"):
            found_ = regions(text, width)
            own = np.isin(found_[1], np.array(at, np.int64))
            for load, hashes, starts, sizes in _pieces(*(x[own] for x in found_), hot):
                part = text[starts[0] : starts[-1] + sizes[-1] + width - 1]
                waiting.append((doc, key, part, hashes, starts, sizes))
                size, held = size + load, held + len(part)
                if size >= BATCH // 2 or held >= TEXT:
                    yield from given()
                    waiting, size, held = [], 0, 0
        yield from given()

    return dealt(found.mapInArrow(sent, SENT)).mapInArrow(lambda batches: _met(batches, width), MARKS)


def without_earlier(docs: DataFrame, width: int = 50, folder: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of each row of ``docs`` (``doc_id, text``); ``kept`` are the bytes left, which need not be UTF-8 any more.

    A null or empty text has no bytes and keeps none. A null ``doc_id`` counts
    as smaller than any other. Rows that share a ``doc_id``, or have none, never
    take anything from each other; rows that repeat one with its text get the
    same result each. ``n_spans`` counts runs of removed bytes. An empty table
    gives an empty one. Other columns are not read.
    """
    folder = folder or work_dir(docs.sparkSession, "suffixes")
    doc = F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    read = docs.select(doc.alias("doc"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text, F.length(text)).alias("check"), text.cast("binary").alias("text"))
    copies = stored(copied_texts(read), folder, "copies")
    marks = earlier_strings(read, copies, width, folder).groupBy("key").agg(F.collect_list(F.struct("doc", "at", "size")).alias("marks"))
    info = marks.join(copies, "key", "full")
    own = F.filter("marks", lambda x: x["doc"] == F.col("doc"))
    met = read.join(info, "key", "left").select("doc", "text", _later_copy().alias("copy"), own["at"].alias("at"), own["size"].alias("size"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        rows, held = [], 0
        for doc, text, copy, at, size in _values(batches, "doc", "text", "copy", "at", "size"):
            left, spans, end = [], 0, 0
            if copy and len(text) >= width:
                at, size = [0], [len(text) - width + 1]
            if at:
                begins = np.array(at, np.int64)
                ends = begins + np.array(size, np.int64) + width - 1
                order = np.argsort(begins)
                #: A mark begins a span if it starts behind all before it.
                begins, reach = begins[order], np.maximum.accumulate(ends[order])
                new = np.flatnonzero(np.append(True, begins[1:] > reach[:-1]))
                spans = new.size
                for b, e in zip(begins[new].tolist(), reach[np.append(new[1:], begins.size) - 1].tolist(), strict=True):
                    left.append(text[end:b])
                    end = e
            left.append(text[end:])
            result = b"".join(left)
            rows.append((None if doc == NO_ID else doc, len(text), len(text) - len(result), int(spans), result))
            held += len(result)
            if held >= TEXT or len(rows) >= 10_000:
                yield _record(rows, kinds)
                rows, held = [], 0
        yield _record(rows, kinds)

    return met.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
