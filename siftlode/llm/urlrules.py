"""URL filters: a host and path list, and association rules mined from labels.

A URL is a set of tokens: its scheme, the parts of its host, the segments of
its path and the names of its query's fields, digits made alike. FP-growth over
the labelled URLs finds the token combinations that are frequent on their own
and together with a bad label; tokens that always stand together are one item. A combination is a rule if it is frequent enough
and the lower bound of its confidence (Wilson's, at 95 %) is high enough, and
if no smaller combination within it is as sure. Rules match by an inverted
index: each is listed under its rarest token, so a URL only meets rules whose
rarest token it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import bounded, stored, work_dir

BAD = "=bad"
#: Tasks that pages with the same tokens are dealt to.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
LISTED = (ListRule("net", "/", "block"), ListRule("example.net", "/en/", "allow"), ListRule("example.com", "/de/", "block"), ListRule("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules: tuple[ListRule, ...] = LISTED) -> Column:
    """``(rule, verdict)`` of the longest rule that fits the host or one above it and starts the path; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda x: (len(x.text), x.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; a null URL has none."""
    url = F.coalesce(url, F.lit(""))
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    marked = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))
    fields = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(marked("s:", scheme), marked("h:", F.split(host_of(url), r"\.")), marked("p:", F.split(path_of(url), "/")), marked("q:", fields))))


def alike_tokens(labelled: DataFrame, min_support: float = 0.005, min_rows: int = 10) -> dict[str, str]:
    """Frequent tokens that always stand together in the labelled rows (``tokens``), each but the first of them with the first.

    As one item they give the same rules; as many, every combination of the
    tokens of one template would be frequent on its own. Tokens are compared by
    the number and the hashes of the token sets they lie in. There are fewer
    frequent tokens than a row has tokens in the mean, divided by
    ``min_support``, whatever the number of rows.
    """
    rows = labelled.where("size(tokens) > 0 AND bad IS NOT NULL")
    support = max(min_support * rows.count(), min_rows)
    each = rows.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("h"))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).where(F.col("n") >= support)
    sets = marks.groupBy("n", "s", "x").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where("size(tokens) > 1")
    return {t: r["tokens"][0] for r in sets.collect() for t in r["tokens"][1:]}


def with_first_of_alike(rows: DataFrame, first: dict[str, str]) -> DataFrame:
    """``rows`` with each of ``tokens`` that is like another replaced by the first of them."""
    if not first:
        return rows
    known = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return rows.withColumn("tokens", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(known, t), t)))))


def mined_rules(labelled: DataFrame, min_support: float = 0.005, min_rows: int = 10, min_confidence: float = 0.7) -> DataFrame:
    """``tokens, confidence, support_rows, rarest`` of each rule that says bad, from ``labelled`` (``tokens``, ``bad``).

    Rows without tokens or label are not used. Without any rows, or any bad
    ones, there are no rules. All labelled rows are mined.
    """
    rows = labelled.where("size(tokens) > 0 AND bad IS NOT NULL").select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    n = rows.count()
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support_rows long, rarest string")
    if n < min_rows:
        return empty
    support = max(min_support, min_rows / n)
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(rows).freqItemsets
    found = stored(found.select(F.array_sort("items").alias("items"), "freq"), work_dir(spark, "itemsets"), "found")
    alone = found.where(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), F.col("freq").alias("support_rows"))
    both = found.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("hits"))
    p, m = F.col("hits") / F.col("support_rows"), F.col("support_rows")
    z2 = 1.96**2
    lower = (p + z2 / (2 * m) - F.sqrt(z2 * (p * (1 - p) + z2 / (4 * m)) / m)) / (1 + z2 / m)
    sure = both.join(alone, "tokens").withColumn("confidence", lower).where(F.col("confidence") >= min_confidence)
    #: A rule goes if leaving out one of its tokens gives a rule that is as sure.
    shorter = sure.select("tokens", "confidence", F.explode("tokens").alias("out")).withColumn("tokens_less", F.array_remove("tokens", F.col("out")))
    as_sure = shorter.alias("a").join(sure.alias("b"), (F.col("a.tokens_less") == F.col("b.tokens")) & (F.col("b.confidence") >= F.col("a.confidence"))).select("a.tokens").distinct()
    kept = sure.join(as_sure, "tokens", "left_anti").select("tokens", "confidence", "support_rows")
    single = alone.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("support_rows").alias("of_token"))
    by_token = kept.select("tokens", "confidence", "support_rows", F.explode("tokens").alias("token")).join(single, "token")
    return by_token.groupBy("tokens", "confidence", "support_rows").agg(F.min_by("token", F.struct("of_token", "token")).alias("rarest"))


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, confidence`` of each distinct token set that some rule lies within; the surest rule's confidence."""
    sets = token_sets.select("tokens").distinct()
    index = rules.select(F.col("rarest").alias("token"), F.col("tokens").alias("rule_tokens"), "confidence")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(bounded(index), "token")
    return met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judged_urls(pages: DataFrame, labels: DataFrame, listed: tuple[ListRule, ...] = LISTED, **mining) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, confidence`` of each row of ``pages`` (``page_id, url``).

    ``labels`` (``doc_id, quality, toxic``) label the pages of their ids; a page
    is bad if its quality is 0 or it is toxic. The listed rules' verdict comes
    first; else a mined rule that fits blocks, and all else is allowed. A null
    URL, or one without ``://``, has an empty host and path, fits no listed
    rule and is allowed unless mined rules on its other tokens fit. Rows that
    repeat a ``page_id`` are judged one by one. A page with several labels
    counts once for each. Other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    folder = work_dir(pages.sparkSession, "urlrules")
    labelled = stored(rows.join(marks, "page_id").select("tokens", "bad"), folder, "labelled")
    first = alike_tokens(labelled, **{k: v for k, v in mining.items() if k != "min_confidence"})
    rows = with_first_of_alike(rows, first)
    rules = stored(mined_rules(with_first_of_alike(labelled, first), **mining), folder, "rules")
    found = matched(rows, rules)
    fits = list_rule(F.col("host"), F.col("path"), listed)
    #: Pages with the same tokens, a third of all perhaps, are dealt to several tasks; the few sets that were found go to each.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = salted.join(found, ["tokens", "salt"], "left").withColumn("_fits", fits)
    verdict = F.coalesce("_fits.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", F.col("_fits.rule").alias("rule"), verdict.alias("verdict"), "confidence")
