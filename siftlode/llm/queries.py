"""Registered queries of the operators for training data, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import collocations, decontam, divergence, lmscore, neardup, packing, pii, quality, substring, suffixes, tokenplanes, urlrules, warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as byte planes and read back."""
    return tokenplanes.token_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS target FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to
FROM q LEFT JOIN g USING (payload_digest)
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judged(quality.with_features(docs, known), known=known)
    base = quality.BASE[0].on(F.col) | quality.BASE[1].on(F.col)
    return judged.select("doc_id", *known, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


ORACLES["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
             len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, w FROM w),
p AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM f WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE g.n > 1 GROUP BY 1),
b AS (SELECT f.* EXCLUDE (w), coalesce(r.n, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words
            OR 3 * n_upper > word_chars OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand earlier in the corpus."""
    return substring.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM d WHERE len(w) > 19),
k AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS run FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(20)) AS o) WHERE n > 1),
u AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with items of the benchmark."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


#: From the definition, without seeds: equal words at one distance lie on one alignment; a stretch begins at one of them.
ORACLES["op8_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d WHERE doc_id IS NOT NULL),
bw AS (SELECT item_id, least(13, len(w)) AS width, unnest(w) AS word, unnest(range(len(w))) AS k FROM b WHERE item_id IS NOT NULL),
e AS (SELECT doc_id, item_id, width, k, i - k AS shift FROM dw JOIN bw USING (word)),
s AS (SELECT doc_id, item_id, width, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM e)
SELECT doc_id, item_id, max(n)::BIGINT AS n_same FROM s WHERE n * 100 >= width * 80 GROUP BY 1, 2
"""


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents"), columns=("doc_id",))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens, read from the sequences."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), width=2)
    found = packing.pieces_of(packing.written(packing.packed(cut), width=2), width=2)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    judged = urlrules.judged_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents; scores to four places, as sums differ in their last ones."""
    return lmscore.backoff_scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


ORACLES["op2_backoff_scores"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM p),
n AS (SELECT doc_id, i, b IS NOT NULL AS has2, c IS NOT NULL AS has3, count(*) OVER (PARTITION BY a) AS n1,
             count(*) OVER (PARTITION BY a, b) AS n2, count(*) OVER (PARTITION BY a, b, c) AS n3 FROM g),
u AS (SELECT a, count(*) AS n FROM g GROUP BY 1), v AS (SELECT a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2),
x AS (SELECT n.*, u.n AS before1, v.n AS before2, (SELECT count(*) FROM g) AS total,
             CASE WHEN has3 AND n3 > 1 THEN 3 WHEN has2 AND n2 > 1 THEN 2 ELSE 1 END AS took
      FROM n JOIN g USING (doc_id, i) LEFT JOIN u ON u.a = g.b LEFT JOIN v ON v.a = g.b AND v.b = g.c),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (took = 3) AS n_trigram, count(*) FILTER (took = 2) AS n_bigram, count(*) FILTER (took = 1) AS n_unigram,
             sum(CASE took WHEN 3 THEN ln(n3 / before2) WHEN 2 THEN ln(n2 / before1) ELSE ln(n1 / total) END + (least(i, 3) - took) * ln(0.4)) AS score
      FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_trigram, 0) AS n_trigram, coalesce(n_bigram, 0) AS n_bigram,
       coalesce(n_unigram, 0) AS n_unigram, round(coalesce(score, 0), 4) AS score
FROM d LEFT JOIN s USING (doc_id)
"""


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that start in an earlier one."""
    found = suffixes.without_earlier(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 249) AS c FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 200)) AS o FROM d WHERE len(h) >= 100)),
k AS (SELECT doc_id, o + j AS i, substr(c, 2 * j + 1, 100) AS s FROM (SELECT doc_id, o, c, unnest(range(len(c) // 2 - 49)) AS j FROM c)),
m AS (SELECT s, min(doc_id) AS first FROM k GROUP BY 1),
x AS (SELECT doc_id, i FROM k JOIN m USING (s) WHERE doc_id > first),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM x),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS z FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (b - z)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept
      FROM g JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, w[i : i + k - 1] AS w FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, w, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, k, w, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.w, c.a, cut, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
      FROM c JOIN f AS x ON x.lang = c.lang AND x.w = c.w[1 : cut] JOIN f AS y ON y.lang = c.lang AND y.w = c.w[cut + 1 : c.k]),
b AS (SELECT lang, w, any_value(a) AS a, arg_min(l, score * 8 + cut) AS l, arg_min(r, score * 8 + cut) AS r, min(score) AS score FROM s GROUP BY 1, 2),
i AS (SELECT lang, f, k, w, unnest(range(2, k)) AS size FROM f WHERE k > 2),
j AS (SELECT lang, w[p : p + size - 1] AS w, max(f) AS longer FROM (SELECT *, unnest(range(1, k - size + 2)) AS p FROM i) GROUP BY 1, 2),
o AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN j ON j.lang = b.lang AND j.w = b.w WHERE longer IS NULL OR 100 * longer < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each one off."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM a GROUP BY 1, 2),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM a JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 2)) // (sum(sum(n)::HUGEINT) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM a JOIN v USING (lang) GROUP BY 1, 2),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
          FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 4),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
          FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs AS z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM every UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
