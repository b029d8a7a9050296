"""The operators on web pages."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from siftlode.llm import urlrules, warc
from siftlode.llm.shared import work_dir


def test_warc_round_trip(spark):
    big, other = "<html>é" + "x" * 1_200, "y" * 999
    rows = [(1, "http://a/é b\r\nX: y", big), (5, None, big), (3, "http://c", big), (4, "u", other), (6, "u", other), (7, "", None), (8, "z", ""), (5, "again", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = work_dir(spark, "warc")
    got = warc.read_warc(warc.write_warc(warc.assign_records(pages), folder), folder, with_payload=True).collect()
    assert len(got) == len(rows)
    digest = hashlib.sha1(big.encode()).hexdigest()
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest)
    assert kinds == [(-1, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "response", None)]
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert r["payload"] == (None if r["record_type"] == "revisit" else html.encode())
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_reader_finds_damage():
    payload = b"z" * 70_000
    digest = hashlib.sha1(payload).hexdigest()
    one = warc.page_member(1, "http://x", payload, len(payload), digest, "response", None, "2024-01-01T00:00:00Z")
    read = lambda raw: list(warc.read_records(io.BytesIO(raw), keep=True))
    assert [r["payload"] for r in read(one + one)] == [payload, payload] and read(b"") == []
    wrong = warc.page_member(1, "http://x", payload, len(payload), "0" * 40, "response", None, "2024-01-01T00:00:00Z")
    for raw in (one[:-20], one + b"junk", wrong):
        with pytest.raises((ValueError, OSError, Exception)):
            read(raw)


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urlrules.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_listed_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x#y", "http://example.net", "http://example.net/", "https://xnet/", "https://net/", "http://sub.net/fr", "http://a.org/fr/x", "http://org/fr/",
        "http://a.example.com/de/", "http://a.example.com/de", "http://notexample.com/de/", "ftp://x?y://z/en", "http://h#f/p", "a://b://c/d", "http://É.net/ü",
    ]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlrules.judged_urls(pages, labels).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow")
    assert urlrules.judged_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_find_bad_combinations(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        host, path = rng.choice(["good", "pills", "news"]), rng.choice(["buy", "read"])
        rows.append((i, f"http://{host}.example.com/{path}/{i}"))
        bad = host == "pills" and path == "buy" and rng.random() < 0.97
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1, 0 if i % 4 else None))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = urlrules.judged_urls(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    for r in judged:
        assert (r["verdict"] == "block") == ("pills" in r["url"] and "/buy/" in r["url"])


def test_templates_of_many_tokens_are_one_item(spark):
    fields = "&".join(f"{c}{d}=1" for c in "abcde" for d in "vwxyz")
    rows = [(i, f"http://shop.example.com/deal/?{fields}" if i % 3 else f"http://news.example.com/{'abc'[i % 2]}/") for i in range(300)]
    rows += [(300, "http://other.example.org/?av=1"), (301, "http://other.example.org/?zz=1"), (None, None), (302, rows[1][1]), (302, rows[3][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("salt", F.lit("own")).withColumn("confidence", F.lit("own"))
    marks = [(i, 0 if i % 3 else 1, None) for i in range(300)] + [(None, 0, 1), (1, 0, None), (1, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("tokens", F.lit("own"))
    first = urlrules.alike_tokens(pages.limit(300).select(urlrules.url_tokens(F.col("url")).alias("tokens"), F.lit(True).alias("bad")))
    assert set(first.values()) == {"h:shop", "h:com"} and len(first) == 28
    judged = urlrules.judged_urls(pages, labels).collect()
    assert len(judged) == len(rows)
    assert all((r["verdict"] == "block") == (r["url"] is not None and ("shop" in r["url"] or "av=1" in r["url"])) for r in judged)
