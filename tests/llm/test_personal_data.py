"""Personal data: the span classifier on held-out rows, long texts, and columns that clash."""

import random
import re
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from siftlode.llm import pii
from siftlode.llm.words import count_below, cut_out, running

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import VOCABULARY, frame  # noqa: E402


def test_running_sums_and_largest(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100)]
    for add, brute in ((lambda a, x: a + x, sum), (F.greatest, lambda v: max(v, default=0))):
        df = spark.createDataFrame(rows, "v array<long>").select("v", running(F.col("v"), add).alias("r"))
        assert all(r["r"] == [brute(r["v"][:i]) for i in range(len(r["v"]))] for r in df.collect())


def test_halving_and_cutting(spark):
    rows = [([{"start": 3 * k + 1} for k in range(n)],) for n in range(9)]
    df = spark.createDataFrame(rows, "v array<struct<start:int>>").select("v", *[count_below(F.col("v"), "start", F.lit(x)).alias(f"c{x}") for x in range(30)])
    assert all(r[f"c{x}"] == sum(e["start"] < x for e in r["v"]) for r in df.collect() for x in range(30))
    text = "".join(random.Random(3).choices("ab\né中\U0001f600", k=200))
    ranges = [{"start": a, "end": b} for a in range(0, 200, 7) for b in range(a, 200, 11)]
    got = spark.createDataFrame([(text, ranges)], "t string, r array<struct<start:bigint,end:bigint>>").select(cut_out(F.col("t"), F.col("r"), 16).alias("p")).first()["p"]
    assert got == [text[x["start"] : x["end"]] for x in ranges]


def call(rng, cue, good):
    """A line with a telephone number in a national form, or with another number that looks like one to the wider pattern."""
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    number = f"({rng.randint(2, 9)}{d(2)}) {d(3)}-{d(4)}" if good else f"{rng.choice('01')}{d(2)}.{d(3)}.{d(4)}"
    return f"{words(6)} {cue}{number} {words(4)}", number


def test_classifier_learns_the_look_of_spans_from_cues(spark):
    rng = random.Random(8)
    train, held = [], []
    for k in range(600):
        good = k % 2 == 0
        cue = rng.choice(["call ", "phone: ", "tel "]) if good else rng.choice(["version ", "order ", "isbn ", "part "])
        train.append(call(rng, cue, good)[0] + (f" or +1 202 555 {rng.randint(1000, 9999)}" if good else ""))
    for k in range(200):
        #: No cue at all: the look decides.
        text, number = call(rng, "", k % 2 == 0)
        held.append((text, number, k % 2 == 0))
    docs = frame(spark, train + [t for t, _, _ in held])
    got = {r["doc_id"]: {tuple(x)[1:] for x in r["spans"] if x["kind"] == "phone"} for r in pii.personal_data(docs, columns=("doc_id",), threshold=0.5).collect()}
    right = 0
    for k, (text, number, good) in enumerate(held):
        at = text.index(number)
        right += ((at, at + len(number)) in got[len(train) + k]) == good
    assert right >= 0.95 * len(held)


def test_columns_with_clashing_names_keep_their_values(spark):
    text = "write me@here.example.com and then_at 10.0.0.1@x.org now"
    names = ("spans", "base_spans", "row", "whole", "email", "ip", "card", "phone", "kind", "_base_email", "_cand_ip", "n", "dotted.name")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert all(r[c] == f"own {c}" for r in rows.values() for c in names)
    assert rows[1]["text"] == "write [email] and then_at [ip] now" and rows[2]["text"] is None
    assert pii.redacted(docs).columns == docs.columns
    found = pii.personal_data(docs)
    assert set(found.columns) == set(docs.columns) and all(r["row"] == "own row" for r in found.collect())


def test_long_texts_take_time_in_proportion(spark):
    line = "from 10.20.30.40 by +1 202 555 0143 é\n"
    texts = [line * 40_000, "x " * 3_000_000, "\U0001f600" + "ab " * 5_000 + "me@here.org"]
    began = time.perf_counter()
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame(spark, texts)).collect()}
    assert time.perf_counter() - began < 240
    assert clean[0] == "from [ip] by [phone] é\n" * 40_000 and clean[1] == texts[1]
    assert clean[2] == re.sub("me@here.org", "[email]", texts[2])
