"""Quality rules as a short-circuit cascade of column expressions.

A rule rejects a document by some features of its text. A sample gives each
rule's cost (seconds) and selectivity (share rejected); rules are then tried in
the order of rejections per cost, and the first that rejects ends the trial, so
features of later rules are not computed for it. The order changes what is
spent, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.words import BLANKS, let, total, upto, words

SYMBOLS = r"[#*$%&|<>]"


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which the text has twice or more.

    Windows are sorted by a 64-bit hash of their words; those beside an equal
    one are kept, and the words they cover are counted by their starts.
    """

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(upto(F.size(w) - (width - 1)), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))))

    def repeated(a: Column) -> Column:
        near = lambda k, h: F.coalesce(F.get(a, k)["h"] == h, F.lit(False))
        starts = F.transform(a, lambda x, k: F.when(near(k - 1, x["h"]) | near(k + 1, x["h"]), x["i"]))
        return F.sort_array(F.filter(starts, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))))

    return let(words(text), lambda w: let(windows(w), lambda a: let(repeated(a), covered))).cast("long")


#: Each feature as an expression of a text; a null text has no words, lines or symbols.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.concat_ws("", words(t))).cast("long"),
    "n_symbols": lambda t: F.coalesce(F.regexp_count(t, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
    "n_upper": lambda t: F.coalesce(F.regexp_count(t, F.lit("[A-Z]")), F.lit(0)).cast("long"),
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true of a text to be rejected; it gets its features' columns by name."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, given: Callable[[str], Column]) -> Column:
        return F.coalesce(self.rejects(**{x: given(x) for x in self.features}), F.lit(False))


#: The base rules of the contract, then those of the method. The thresholds leave prose, lists of short lines and licence texts alone.
BASE = (
    Rule("short", ("n_words",), lambda n_words: n_words < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n_words, n_repeat_words: 100 * n_repeat_words > 50 * n_words),
)
MORE = (
    Rule("symbols", ("n_words", "n_symbols"), lambda n_words, n_symbols: 5 * n_symbols > n_words),
    Rule("capitals", ("word_chars", "n_upper"), lambda word_chars, n_upper: 3 * n_upper > word_chars),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n_lines, n_dup_lines: 2 * n_dup_lines > n_lines),
)


def with_features(docs: DataFrame, names: tuple[str, ...], text: str = "text") -> DataFrame:
    return docs.withColumns({x: FEATURES[x](F.col(text)) for x in names})


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = 2_000, seed: int = 17, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """The rules in the order of rejections per second, each with its cost and selectivity on a sample.

    The next rule is the one that rejects most per second of what the rules
    before it left. The sample is a random share of the rows, ``sample_rows``
    of them in the mean, and only sets the order. A rule's cost is the least of
    three timings, less that of an empty one; features among ``known`` are
    columns and cost nothing. Of an empty table or a tie, the given order
    stays.
    """
    n = docs.count()
    if not n:
        return [(x, 0.0, 0.0) for x in rules]
    held = docs.select(F.col(text).alias("text"), *[x for x in known if x != text])
    sample = held.sample(min(1.0, sample_rows / n), seed).cache()
    there = max(1, sample.count())
    given = lambda x: F.col(x) if x in known else FEATURES[x](F.col("text"))

    def spent(rejects: Column) -> float:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            sample.where(rejects).count()
            times.append(time.perf_counter() - began)
        return min(times)

    idle = spent(F.length("text") < 0)
    cost = {x.name: max(spent(x.on(given)) - idle, 1e-3) for x in rules}
    #: Which rules reject together: 2 ** len(rules) rows at most.
    met = [(set(r["met"]), r["n"]) for r in sample.groupBy(F.array_compact(F.array(*[F.when(x.on(given), x.name) for x in rules])).alias("met")).agg(F.count(F.lit(1)).alias("n")).collect()]
    sample.unpersist()
    left, found = list(rules), []
    while left:
        rejected = {x.name: sum(k for names, k in met if x.name in names) for x in left}
        best = max(left, key=lambda x: rejected[x.name] / cost[x.name])
        found.append((best, cost[best.name], rejected[best.name] / there))
        left.remove(best)
        met = [(names, k) for names, k in met if best.name not in names]
    return found


def verdict(rules: list[Rule], given: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, null for a document to keep."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.on(given), F.lit(rule.name)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", known: tuple[str, ...] = (), name: str = "rejected_by", **sampling) -> DataFrame:
    """``docs`` with a column ``name``: the rule that rejects the document, or null.

    A null or empty text has no words, and the base rules reject it. Rows are
    judged one by one, so repeated rows get the same verdict; columns of
    ``docs`` stay, but one called ``name`` is replaced. ``known``: features
    that ``docs`` has as columns.
    """
    order = [x[0] for x in order_rules(docs, rules, text, known=known, **sampling)]
    return docs.withColumn(name, verdict(order, lambda x: F.col(x) if x in known else FEATURES[x](F.col(text))))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", **sampling) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    order = [x[0] for x in order_rules(docs, rules, text, **sampling)]
    return docs.where(verdict(order, lambda x: FEATURES[x](F.col(text))).isNull())
