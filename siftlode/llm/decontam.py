"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations.

It is an overlap if some stretch of 13 words (the whole item, if it is shorter)
agrees in at least 80 of 100. A seed is a run of words of which a fixed mask
reads some and ignores the rest, so a substituted word leaves some seeds intact.
The masks are chosen so that in every stretch that is accepted, whichever words
differ, one of them reads equal words only. Every position of every benchmark
item and of every document is hashed under each mask. Equal hashes are hits;
hits on one alignment of a document and an item count once, and each alignment
is then read word by word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import bounded, stored, work_dir
from siftlode.llm.words import let, total, upto

#: Fixed values, found by search: for stretches of 13 words of which two may differ, the places that each mask reads.
MASKS_13 = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))


def masks(width: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one reads equal words only, at some place of any stretch of ``width`` words that agrees in ``percent`` of 100.

    The stretch is cut into more groups than words may differ, and each mask
    reads groups that may be the ones left intact.
    """
    differ = width - -(-width * percent // 100)
    if (width, differ) == (13, 2):
        return MASKS_13
    n = differ + 2 if 1 <= differ <= 3 else differ + 1
    groups = [range(width * g // n, width * (g + 1) // n) for g in range(n)]
    read = [[p for group in chosen for p in group] for chosen in combinations(groups, n - differ)] if n > 0 else []
    return tuple(sorted({tuple(p - places[0] for p in places) for places in read}))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: x != "")


def seeds(words: Column, read: dict[tuple[int, ...], list[int]], least_words: int | None = None) -> Column:
    """``(at, hash)`` of every position under each mask; with ``least_words``, under the masks of an item's width only."""
    if not read:
        return F.expr("cast(array() as array<struct<at: int, hash: bigint>>)")

    def of(w: Column) -> Column:
        def under(k: int, mask: tuple[int, ...], widths: list[int]) -> Column:
            n = F.size(w) - mask[-1]
            if least_words is not None:
                n = F.when(F.least(F.size(w), F.lit(least_words)).isin(widths), n).otherwise(0)
            return F.transform(upto(n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(w, i + p) for p in mask]).alias("hash")))

        return F.concat(*[under(k, mask, widths) for k, (mask, widths) in enumerate(read.items())])

    return let(words, of)


def agreement(doc: Column, item: Column, shift: Column, least_words: int) -> tuple[Column, Column]:
    """The best count of equal words in a stretch of ``least_words`` (or the whole item), and the stretch's length."""
    width = F.least(F.size(item), F.lit(least_words))

    def best(same: Column) -> Column:
        return F.array_max(F.transform(upto(F.size(same) - width + 1), lambda i: total(F.slice(same, i + 1, width))))

    def same(d: Column) -> Column:
        return F.transform(item, lambda x, k: F.when((shift + k >= 0) & F.coalesce(F.get(d, shift + k) == x, F.lit(False)), 1).otherwise(0))

    return let(let(doc, same), best), width


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, percent: int = 80, shortest: int = 11, folder: str | None = None) -> DataFrame:
    """``doc_id, item_id, n_same`` of each document and item that overlap; ``n_same`` is the best count of equal words in a stretch.

    Null and empty texts overlap with nothing. Items of fewer than ``shortest``
    words are left out; with 1 none is, and each is met by masks of its own
    length. Rows without a ``doc_id`` or ``item_id`` are not judged;
    rows that repeat one are judged as one. Other columns are not read. Empty
    tables give an empty result. ``percent`` is above 0. Neither side is ever
    paired row by row: the benchmark's seeds, the items and the hits are
    broadcast if they take few bytes, and shuffled by hash or id if not.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "decontam")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text").cast("string")).alias("item")).where("item_id is not null")
    items = stored(items.where(F.size("item") >= max(shortest, 1)), folder, "items")
    read: dict[tuple[int, ...], list[int]] = {}
    for (width,) in items.select(F.least(F.size("item"), F.lit(least_words)).alias("width")).distinct().orderBy("width").collect():
        for mask in masks(width, percent):
            read.setdefault(mask, []).append(width)
    held = stored(items.select("item_id", F.inline(seeds(F.col("item"), read, least_words))).select("item_id", F.col("at").alias("item_at"), "hash").distinct(), folder, "seeds")
    met = rows.select("doc_id", F.inline(seeds(tokens(F.col("text")), read))).join(bounded(held), "hash")
    hits = met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = stored(hits, folder, "hits")
    met = rows.join(bounded(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    #: Each text that is met is split once, whatever the number of its hits.
    met = stored(met.select("doc_id", tokens(F.col("text")).alias("doc")), folder, "met")
    there = bounded(hits).join(met, "doc_id").join(bounded(items), "item_id")
    same, width = agreement(F.col("doc"), F.col("item"), F.col("shift"), least_words)
    #: The best of all alignments first: a condition on each would be computed once more within the join.
    best = there.groupBy("doc_id", "item_id").agg(F.max(same).cast("long").alias("n_same"), F.max(width).alias("width"))
    return best.where(F.col("n_same") * 100 >= F.col("width") * percent).select("doc_id", "item_id", "n_same")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with their columns; rows without a ``doc_id`` stay."""
    found = stored(overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct(), work_dir(docs.sparkSession, "leaks"), "leaked")
    return docs.join(bounded(found), docs["doc_id"] == found["_leaked"], "left_anti")
