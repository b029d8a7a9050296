"""Word arrays and other column expressions that several operators share.

Words are the longest runs of characters other than the six ASCII white-space
characters; a null text has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
NO_WORDS = "cast(array() as array<string>)"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.expr(NO_WORDS)).otherwise(F.split(inner, GAP))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """The integers from 0 to ``n - 1``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(values: Column, add: Callable[[Column, Column], Column], kind: str = "bigint") -> Column:
    """What the elements before each one come to, 0 before the first; ``add`` is associative.

    In blocks of about the root of the array's size: an array that grows by one
    element is copied each time, which for whole arrays would take the square
    of their size.
    """

    def scan(block: Column, start: Column) -> Column:
        state = F.struct(start.cast(kind).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        step = lambda s, x: F.struct(add(s["at"], x).cast(kind).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(block, state, step, lambda s: s["out"])

    def of(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        blocks = F.transform(upto(F.ceil(F.size(v) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast(kind), lambda s, x: add(s, x).cast(kind)))
            return let(scan(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, k: scan(b, F.get(starts, k)))))

        return let(blocks, joined)

    return F.when(F.size(values) > 1, let(values, of)).otherwise(F.transform(values, lambda _: F.lit(0).cast(kind)))


def count_below(ordered: Column, field: str, limit: Column) -> Column:
    """How many structs of an array ordered by ``field`` have it below ``limit``, by halving."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & F.coalesce(F.get(ordered, middle)[field] < limit, F.lit(False))
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(F.least(middle, s["hi"])).alias("hi"))

    halvings = F.ceil(F.log2(F.size(ordered).cast("double") + 1)).cast("int")
    return F.aggregate(upto(halvings), F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), step, lambda s: s["lo"])


def cut_out(text: Column, ranges: Column, width: int = 4_096) -> Column:
    """The parts of ``text`` in ``ranges``, an array of structs ``(start, end)`` of code points, ends exclusive.

    The text is first cut into chunks, as finding a place takes time in
    proportion to what stands before it.
    """

    def part(chunks: Column, r: Column) -> Column:
        first, last = F.floor(r["start"] / width).cast("int"), F.floor((r["end"] - 1) / width).cast("int")
        piece = lambda c: F.substring(F.get(chunks, c), (F.greatest(r["start"] - c * width, F.lit(0)) + 1).cast("int"), (F.least(r["end"], (c + 1) * width) - F.greatest(r["start"], c * width)).cast("int"))
        return F.when(r["end"] > r["start"], F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), "")).otherwise("")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), lambda chunks: F.transform(ranges, lambda r: part(chunks, r)))
