"""Personal data by weak supervision, in DataFrame operations.

Base spans come from patterns and checks. Wider patterns give candidates of the
same kinds; a candidate may also be a base span. Four labelers vote on each
candidate, or abstain: the base pattern, a check of its digits or its domain, a
gazetteer, and cue words before it. Expectation-maximisation over the counts of
votes in the whole corpus estimates each labeler's reliability and each vote
pattern's chance of being personal data. With these as soft labels a logistic
regression, the final span classifier, is trained on what a span looks like:
its digits and how they are grouped, its letters and marks, and the characters
on either side. Candidates that it holds for personal data join the base spans,
which always stay.

Every text is searched once: candidates with votes and features are a table,
from which the classifier is trained and the answer is read. All steps take
time about in proportion to a text's length and its number of matches.

Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import stored, work_dir
from siftlode.llm.words import count_below, cut_out, let, running, total, upto

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written without needless backtracking; \G and the look-behinds let a match start only where the first one of its run can.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of further candidates.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+])(?<![0-9+][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(])(?<![0-9][\x20.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
}
#: What a text must hold for a kind's patterns to be tried.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}[\x20.-][0-9]{4}"}
#: Gazetteers. Endings of domains; addresses that are no host's; first digits of card issuers; country calling codes and area codes.
GAZETTEER = {
    "email": r"(?i)[.\x20)\]](com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|tv|app|dev|ai|eu|at|au|be|br|ca|ch|cl|cn|cz|de|dk|es|fi|fr|gr|hk|hu|ie|il|in|is|it|jp|kr|lt|lu|lv|mx|nl|no|nz|pl|pt|ro|ru|se|sg|si|sk|tr|tw|ua|uk|us|za)$",
    "ip": r"^(?!0+\.|0*127\.|0*169\.0*254\.|0*22[4-9]\.|0*2[34][0-9]\.|0*25[0-5]\.)",
    "card": r"^(4|5[0-8]|2[2-7]|3[04-9]|6)",
    "phone": r"^(\+(1|7|20|21[1-368]|22|23|24|25|26|27|29[0179]|3[0-469]|35|37|38|4[013-9]|42[013]|5[1-8]|50|59|6[0-6]|67|68|69[0-2]|8[1246]|85[02356]|88[06]|9[0-58]|96|97|99)|\(?[2-9])",
}
CUES = {
    "email": r"(?i)\b(mail|e-mail|email|contact|write|correo|courriel)\W{0,4}$",
    "ip": r"(?i)\b(ip|address|host|server|from)\W{0,4}$",
    "card": r"(?i)\b(card|visa|mastercard|amex|carte|karte|tarjeta)\W{0,4}$",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|mobil|telefon)\W{0,4}$",
}
AGAINST = r"(?i)\b(version|isbn|id|no|order|token|v|nr|issue|part)\W{0,4}$"
VOTES = ("pattern", "check", "gazetteer", "context")
CONTEXT = 24
#: Features of a span and the number of their values, from 0 on; the last value stands for all above it.
FEATURES = {"digits": 21, "groups": 9, "letters": 9, "marks": 9, "mark_kinds": 4, "glued_before": 2, "colon_before": 2, "line_start": 2, "glued_after": 2, "stop_after": 2}
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
CANDIDATE = f"array<struct<start:int,end:int,{','.join(f'{n}:int' for n in (*VOTES, *FEATURES))}>>"


def matches(text: Column, pattern: str) -> Column:
    """``(start, end, value, before, after)`` of each leftmost match, from the matches and what lies between them."""

    def placed(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            sizes = F.transform(found, lambda x, i: (F.length(F.get(gaps, i)) + F.length(x)).cast("bigint"))

            def span(at: Column, i: Column) -> Column:
                start = (at + F.length(F.get(gaps, i))).cast("int")
                value = F.get(found, i)
                return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

            return F.transform(running(sizes, lambda a, x: a + x), span)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    def worth(k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return total(F.transform(upto(F.length(digits)), worth)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a base match passes its kind's check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) <= 3) & (F.coalesce(y.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    return F.when(text.rlike(NEEDS[kind]), F.filter(matches(text, BASE[kind]), lambda x: holds(kind, x["value"]))).otherwise(none)


def candidates(kind: str, text: Column, base: Column) -> Column:
    """The base spans and the wider ones of a kind that lie apart from them, each with its votes and features."""

    def voted(x: Column, pattern: int) -> Column:
        value, before = x["value"], x["before"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        n = F.length(digits)
        if kind == "card":
            check = F.when(luhn(digits), 1).otherwise(-1)
        elif kind == "phone":
            check = F.when(n.between(10, 13), 1).when(n.between(8, 15), 0).otherwise(-1)
        elif kind == "ip":
            check = F.when(value.contains(":") | holds("ip", value), 1).otherwise(-1)
        else:
            check = F.when(value.rlike(r"[A-Za-z]{2,}$"), 1).otherwise(-1)
        context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
        votes = (F.lit(pattern), check, F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1), context)
        marks = F.regexp_replace(value, "[A-Za-z0-9]", "")
        looks = {
            "digits": n,
            "groups": F.regexp_count(value, F.lit("[0-9]+")),
            "letters": F.floor((F.length(F.regexp_replace(value, "[^A-Za-z]", "")) + 3) / 4),
            "marks": F.length(marks),
            "mark_kinds": F.size(F.array_distinct(F.split(marks, ""))),
            "glued_before": before.rlike(r"[\p{L}\p{N}_]$"),
            "colon_before": before.rlike(r"[:=]\s*$"),
            "line_start": (before == "") | before.endswith("\n"),
            "glued_after": x["after"].rlike(r"[\p{L}\p{N}_]"),
            "stop_after": (x["after"] == "") | x["after"].rlike(r"[\s.,;!?)]"),
        }
        features = [F.least(v.cast("int"), F.lit(FEATURES[k] - 1)).alias(k) for k, v in looks.items()]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), *[v.cast("int").alias(k) for k, v in zip(VOTES, votes, strict=True)], *features)

    def meets(x: Column) -> Column:
        """Base spans lie apart in the order of their starts, so the last that starts before ``x`` ends is the one to look at."""
        return let(count_below(base, "start", x["end"]), lambda k: F.coalesce(F.get(base, k - 1)["end"] > x["start"], F.lit(False)))

    wider = F.transform(F.filter(matches(text, WIDER[kind]), lambda x: ~meets(x)), lambda x: voted(x, -1))
    both = F.concat(F.transform(base, lambda x: voted(x, 1)), wider)
    return F.when(text.rlike(NEEDS[kind]), both).otherwise(F.expr(f"cast(array() as {CANDIDATE})"))


def with_candidates(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``row`` (the named columns) and an array of candidates of each kind; a null text is an empty one. The table has no column of ``docs`` outside ``row``."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0)
    based = docs.select(row.alias("row"), whole.alias("whole")).select("row", "whole", *[base_spans(k, F.col("whole")).alias(f"base_{k}") for k in KINDS])
    return based.select("row", *[candidates(k, F.col("whole"), F.col(f"base_{k}")).alias(k) for k in KINDS])


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation (Dawid and Skene 1979) over vote patterns and
    their counts: each pattern's chance of being personal data.

    A labeler's chances of each vote, given the truth, start from the majority
    and are smoothed by one count, so a labeler that always says the same stays
    harmless. The table has 81 patterns at most for each kind.
    """
    belief = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in counts}
    for _ in range(rounds):
        sums = {True: [{-1: 1.0, 0: 1.0, 1: 1.0} for _ in VOTES], False: [{-1: 1.0, 0: 1.0, 1: 1.0} for _ in VOTES]}
        mass = {True: 1.0, False: 1.0}
        for v, n in counts:
            for truth in (True, False):
                w = n * (belief[v] if truth else 1 - belief[v])
                mass[truth] += w
                for k, x in enumerate(v):
                    sums[truth][k][x] += w
        chance = {}
        for v, _ in counts:
            logs = {t: math.log(mass[t]) + sum(math.log(sums[t][k][x] / (mass[t] + 2)) for k, x in enumerate(v)) for t in (True, False)}
            top = max(logs.values())
            weight = {t: math.exp(x - top) for t, x in logs.items()}
            chance[v] = weight[True] / sum(weight.values())
        belief = chance
    return belief


def _width() -> int:
    return sum(FEATURES.values())


def trained(found: DataFrame, folder: str) -> dict[str, dict[str, list[float]]] | None:
    """Weights of the span classifier, by kind, feature and value, from the candidates in ``found``; None if there are none.

    Candidates that look alike and have the same votes are one row of the
    training table, with their number; it is bounded by the features' values.
    """
    looks = [*VOTES, *FEATURES]
    of_kind = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), *[x[c].alias(c) for c in looks]))
    every = found.select(F.inline(F.concat(*map(of_kind, KINDS))))
    counts = stored(every.groupBy("kind", *looks).agg(F.count(F.lit(1)).alias("n")), folder, "looks")
    rows = counts.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect()  # one row for each kind and pattern of four votes: 324 at most
    if not rows:
        return None
    chances = F.lit(0.5)
    for kind in KINDS:
        votes_of = [(tuple(r[n] for n in VOTES), r["n"]) for r in rows if r["kind"] == kind]
        for votes, p in (reliabilities(votes_of) if votes_of else {}).items():
            same = F.col("kind") == kind
            for n, v in zip(VOTES, votes, strict=True):
                same &= F.col(n) == v
            chances = F.when(same, F.lit(p)).otherwise(chances)
    soft = counts.withColumn("p", chances).groupBy("kind", *FEATURES).agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    first = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i * (_width() + 1))) for i, k in enumerate(KINDS)])
    offsets, at = [], 1
    for name, values in FEATURES.items():
        offsets.append((name, at))
        at += values
    ones = F.array(first, *[first + o + F.col(n) for n, o in offsets])
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) * (_width() + 1) - 1)), lambda i: F.when(F.array_contains(ones, i), 1.0).otherwise(0.0))
    labels = F.array(*[F.struct(F.lit(x).alias("label"), F.col(w).alias("weight")) for x, w in ((1.0, "yes"), (0.0, "no"))])
    training = stored(soft.select(dense.alias("dense"), F.inline(labels)).where("weight > 0"), folder, "soft").withColumn("features", array_to_vector("dense"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(training)
    flat, out = [float(x) for x in model.coefficients], {}
    for i, kind in enumerate(KINDS):
        own = flat[i * (_width() + 1) : (i + 1) * (_width() + 1)]
        out[kind] = {"": [float(model.intercept) + own[0]]} | {n: own[o : o + FEATURES[n]] for n, o in offsets}
    return out


def accepted(kind: str, model: dict[str, dict[str, list[float]]] | None, threshold: float) -> Column:
    """``(kind, start, end)`` of a kind's base spans and of its candidates that the classifier accepts, in the order of starts."""

    def score(x: Column) -> Column:
        out = F.lit(model[kind][""][0])
        for name in FEATURES:
            out = out + F.get(F.array(*map(F.lit, model[kind][name])), x[name])
        return 1 / (1 + F.exp(-out))

    keep = lambda x: (x["pattern"] == 1) | ((score(x) >= threshold) if model else F.lit(False))
    return _named(kind, F.array_sort(F.transform(F.filter(kind, keep), lambda x: F.struct(x["start"], x["end"]))))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _judged(docs: DataFrame, text: str, columns: list[str], threshold: float) -> DataFrame:
    """``row`` (the named columns), ``base_spans`` and ``spans``."""
    folder = work_dir(docs.sparkSession, "pii")
    found = stored(with_candidates(docs, text, columns), folder, "candidates")
    model = trained(found, folder)
    base = F.concat(*[_named(k, F.filter(k, lambda x: x["pattern"] == 1)) for k in KINDS])
    return found.select("row", base.alias("base_spans"), F.concat(*[accepted(k, model, threshold) for k in KINDS]).alias("spans"))


def personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.9, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``base_spans`` and ``spans``, arrays of ``(kind, start, end)``.

    A null or empty text has none. Rows are judged one by one, repeated ones
    too; columns of ``docs`` stay, but those two names are replaced. An empty
    table and one without candidates train no classifier, and the base spans
    are all.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("base_spans", "spans")]
    out = _judged(docs, text, kept, threshold)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "base_spans", "spans")


def listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as in ``[email]``; spans that overlap are replaced as one, by the kind of the first. A null text stays null; all other columns stay as they are, whatever their names."""
    out = _judged(docs, text, docs.columns, threshold)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    old = F.col("row")[text].cast("string")

    def clean(spans: Column) -> Column:
        def between(ends: Column) -> Column:
            """``ends``: where the spans before each one end; one that starts there or later is replaced."""
            every = F.transform(spans, lambda x, i: F.struct(F.get(ends, i).alias("start"), x["start"].cast("bigint").alias("end"), x["kind"].alias("kind")))
            kept = F.filter(every, lambda x: x["end"] >= x["start"])
            tail = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).cast("bigint").alias("start"), F.length(old).cast("bigint").alias("end"), F.lit(None).cast("string").alias("kind"))
            return let(F.array_append(kept, tail), lambda cuts: F.array_join(F.zip_with(cut_out(old, cuts), cuts, lambda t, x: F.concat(t, F.coalesce(F.concat(F.lit("["), x["kind"], F.lit("]")), F.lit("")))), ""))

        return let(running(F.transform(spans, lambda x: x["end"].cast("bigint")), F.greatest), between)

    new = F.when(F.size("spans") > 0, let(ordered, clean)).otherwise(old)
    return out.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
