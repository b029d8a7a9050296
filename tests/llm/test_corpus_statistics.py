"""Suffixes, collocations and divergences against brute force, on small tables with odd rows."""

import random
import sys
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlode.llm import collocations, divergence, suffixes
from siftlode.llm.filters import Members, members_of

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import CLASHING, VOCABULARY  # noqa: E402

WIDE = (*CLASHING, "hash", "marks", "copies", "check", "first", "phrase", "term", "value", "item", "part")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    return df.withColumns({c: F.lit("own") for c in WIDE}).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Suffixes


def brute_suffixes(rows, width):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - width + 1):
            first[data[k : k + width]] = min(first.get(data[k : k + width], doc), doc, key=lambda x: -1 if x is None else x)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            least = first[data[k : k + width]]
            if (-1 if least is None else least) < (-1 if doc is None else doc):
                gone[k : k + width] = b"\1" * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def suffix_rows():
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    shared, other = words(40), words(25)
    texts = [words(rng.randint(1, 80)) for _ in range(15)] + [f"{words(9)} {shared} {words(k)}" for k in range(6)]
    texts += [shared[k:] + words(3) for k in (0, 1, 17, 60)] + [shared, shared, shared.upper(), f"{shared}{shared}", other * 3, other * 2]
    texts += ["ab" * 90, "ab" * 40, "a" * 200, "a" * 49, "a" * 50, "é" * 60, "xé" + "é" * 40, "\0" * 70, "\0" * 60, "", None, words(600), "中文 " * 40]
    rows = list(enumerate(texts))
    return rows + [(None, shared), (None, words(5) + shared), (7, shared), (7, shared), (2, f"{other} {shared}"), (70, None)]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("width", [50, 24])
def test_suffixes_equal_brute_force(spark, monkeypatch, small, width):
    if small:  # batches of few regions, chunks of few bytes, and every shared hash a hot one
        monkeypatch.setattr(suffixes, "BATCH", 8)
        monkeypatch.setattr(suffixes, "CHUNK", 64)
        monkeypatch.setattr(suffixes, "HOT", 2)
    rows = suffix_rows()
    got = suffixes.without_earlier(table(spark, [(d, "en", "s", t) for d, t in rows]), width).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == brute_suffixes(rows, width)


def test_suffixes_of_an_empty_table(spark):
    assert suffixes.without_earlier(table(spark, [])).count() == 0


def bucket_rows(packed):
    return iter([pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(len(packed))], pa.int32()), pa.array(packed, pa.binary()), pa.array([None] * len(packed), pa.binary())], ["bucket", "regions", "marks"])])


def test_memory_of_a_task_that_sorts_suffixes_is_bounded(monkeypatch):
    monkeypatch.setattr(suffixes, "UNPACKED", 4 << 20, raising=False)
    rng, n, size = np.random.default_rng(5), 1_000, 1_000
    packed = []
    for k in range(64):
        numbers = np.arange(k * n, (k + 1) * n)
        columns = {"hash": numbers.astype(np.uint64), "doc": numbers, "key": numbers, "at": np.zeros(n, np.int32), "size": np.full(n, size, np.int32)}
        packed.append(suffixes._Regions(columns, np.array([97, 98], np.uint8)[rng.integers(0, 2, n * (size + 49))], 50).packed())
    tracemalloc.start()
    assert sum(b.num_rows for b in suffixes._met(bucket_rows(packed), 50)) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * n * size


def test_suffixes_of_some_hashes_at_a_time(monkeypatch):
    waiting = []
    for key, (doc, text) in enumerate((d, t.encode()) for d, t in suffix_rows() if d is not None and t):
        found = suffixes.regions(text, 50)
        waiting += [(doc, key, text[at[0] : at[-1] + sizes[-1] + 49], hashes, at, sizes) for _, hashes, at, sizes in suffixes._pieces(*found, Members(np.zeros(16, np.uint64)))]
    packed = [x[1] for w in waiting for what, x in suffixes._sent([w], 1, Members(np.zeros(16, np.uint64)), 50) if what == "regions"]
    got = []
    for most in (32 << 20, 200):
        monkeypatch.setattr(suffixes, "UNPACKED", most)
        rows = [r for b in suffixes._met(bucket_rows(packed), 50) for r in b.to_pylist()]
        got.append({(r["doc"], r["key"], r["at"] + k) for r in rows for k in range(r["size"])})
    assert got[0] and got[0] == got[1]


def test_few_regions_are_taken_for_hot_ones(spark, monkeypatch):
    """However many hashes are hot, others stay regions and do not go as strings, each with its bytes."""
    monkeypatch.setattr(suffixes, "HOT", 2)
    text = lambda seed: np.random.default_rng(seed).integers(97, 123, 20_000).astype(np.uint8).tobytes()
    shared, own = text(1)[:1_200], text(2)
    asked = [b for key in (1, 2) for b in suffixes._asked([(key, *suffixes.regions(shared, 50)[:2])], 1)]
    found = {h for b in suffixes._shared(iter(asked)) for h in b["hot"].to_pylist() if h is not None}
    assert len(found) > 50
    hot = members_of(spark.createDataFrame([(h,) for h in found], "h long"))
    regions = suffixes.regions(own, 50)
    sent = [suffixes._Regions.of([x[1]], 50) for what, x in suffixes._sent([(1, 1, own, *regions)], 1, hot, 50) if what == "regions"]
    assert sum(map(len, sent)) < 1.1 * regions[0].size
    both = [suffixes._Regions.of([x[1]], 50) for what, x in suffixes._sent([(1, 1, shared, *suffixes.regions(shared, 50))], 1, hot, 50) if what == "regions"]
    assert sum(map(len, both)) == len(shared) - 49


def test_long_texts_and_hot_regions_go_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 20)
    for word, full in ((0, False), (~np.uint64(0), True)):  # no hash is hot, or all are
        hashes, at, sizes = suffixes.regions(" ".join(f"{k * k}" for k in range(200)).encode(), 50)
        pieces = list(suffixes._pieces(hashes, at, sizes, Members(np.full(16, word, np.uint64))))
        assert all(load <= 10 or h.size == 1 for load, h, _, _ in pieces)
        assert sum(load for load, *_ in pieces) == (sizes.sum() if full else sizes.size)
        for k, whole in enumerate((hashes, at, sizes), 1):
            assert np.array_equal(np.concatenate([p[k] for p in pieces]), whole)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_deep_shallow_order(alphabet):
    rng = np.random.default_rng(5)
    text = np.array(list(alphabet), np.uint8)[rng.integers(0, len(alphabet), 3_000)]
    text[1_000:1_400] = text[200:600]
    at = rng.permutation(np.arange(2_900))
    order, tied = suffixes.sorted_suffixes(text, at, 50)
    found = [text[k : k + 50].tobytes() for k in at[order].tolist()]
    assert found == sorted(found)
    assert tied.tolist() == [False, *(a == b for a, b in zip(found[1:], found[:-1], strict=True))]


# Collocations


def brute_phrases(rows, least):
    counts = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        piece = lower(text)
        for c in ",;:!?\n\x0b\x0c\r":
            piece = piece.replace(c, ".")
        for p in piece.split("."):
            words = [w for w in p.replace("\t", " ").split(" ") if w]
            counts[lang, 0, None] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    counts[lang, n, " ".join(words[k : k + n])] += 1
    return {k: n for k, n in counts.items() if n >= least or k[1] == 0}


def brute_collocations(rows, least, most):
    f = brute_phrases(rows, least)
    found = defaultdict(list)
    for (lang, n, phrase), a in f.items():
        if n > 1:
            w = phrase.split(" ")
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, n) for x, y in [(f[lang, k, " ".join(w[:k])], f[lang, n - k, " ".join(w[k:])])])
            inside = any(m > n and v * 100 >= 80 * a and f" {phrase} " in f" {p} " for (g, m, p), v in f.items() if g == lang and p)
            if not inside:
                found[lang].append((-score, -a, phrase.encode(), left, right))
    return sorted((lang, k, p.decode(), -a, x, y, f[lang, 0, None], -s) for lang, best in found.items() for k, (s, a, p, x, y) in enumerate(sorted(best)[:most], 1))


def phrase_rows():
    rng = random.Random(4)
    words = VOCABULARY[:12]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + rng.choice(["", ".", "!\n"]) for _ in range(60)]
    texts += ["New York, new york; NEW  YORK\tnew york"] * 9 + ["again " * 50, "the é É ß 中文. the é", "x\0y x\0y", "", None, " . ,", "a.b.c"]
    return [(rng.choice(["en", "de", None, ""]), t) for t in texts]


@pytest.mark.parametrize(("block", "share"), [(512 << 10, 0.25), (40, 0.25), (300, 0.0), (512 << 10, 1.0)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, share):
    monkeypatch.setattr(collocations, "BLOCK", block)
    if block < 1_000:
        monkeypatch.setattr(collocations, "TOGETHER", 64)
        monkeypatch.setattr(collocations, "MET", 200)
    rows = phrase_rows()
    got = collocations.collocations(table(spark, [(k, lang, "s", t) for k, (lang, t) in enumerate(rows)]), least=6, most=25, share=share).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_collocations(rows, 6, 25)


def test_what_the_sample_misses_is_found_by_further_passes(spark):
    rows = [(k, "en", "s", "one two three four") for k in range(20)]
    trace = []
    found = {r["phrase"]: r["n"] for r in collocations.frequent_phrases(table(spark, rows), least=10, share=0.0, trace=trace).collect()}
    assert trace == [0, 4, 3, 2, 1] and found["one two three four"] == 20 and len(found) == 11


def test_a_full_filter_lets_too_much_through_but_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "members_of", lambda hashes: collocations.Members(np.full(16, 2**64 - 1, np.uint64)))
    rows = phrase_rows()
    got = collocations.frequent_phrases(table(spark, [(k, lang, "s", t) for k, (lang, t) in enumerate(rows)]), least=6).collect()
    assert {(r["lang"], r["k"], r["phrase"]): r["n"] for r in got} == brute_phrases(rows, 6)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, "s", None), (2, "en", "s", "")])).count() == 0


# Divergences


def brute_divergences(rows, least_docs, most):
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source, folded = lang or "", source or "", lower(text)
        terms = "".join(c if c > "\x7f" or "a" <= c <= "z" else " " for c in folded).split(" ")
        terms = [t for t in terms if t]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs.update({(lang, t) for t in terms})
    kept = {k for k, n in docs.items() if n >= least_docs}
    out = []
    for lang, sources in groups.items():
        terms = sorted((t for g, t in kept if g == lang), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        share = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * len(terms))  # noqa: B023, E731
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            found = [(-sum(apart(share(counts[lang, s][t], total[s]), share(counts[lang, o][t], total[o])) for t in terms), o.encode()) for o in sources if o != s]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(found), 1)]
            best = []
            for t in terms:
                p, q = share(counts[lang, s][t], total[s]), share(sum(counts[lang, o][t] for o in sources), sum(total.values()))
                if counts[lang, s][t] and p > q:
                    best.append((-apart(p, q), t.encode()))
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(6)
    rows = [(rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", " ".join(rng.choices(VOCABULARY, [1 / (k + 1) for k in range(len(VOCABULARY))], k=rng.randint(0, 80)))) for _ in range(90)]
    rows += [("en", None, "Ban BAN ban7ban ban_ban é中"), (None, "a", "ban"), (None, "b", None), ("fr", "s1", "un"), ("en", "silent", "1 2 3"), ("en", "silent", None), ("zz", "only", "é " * 900)]
    return rows + [rows[0]] * 5


@pytest.mark.parametrize(("block", "cells"), [(500_000, 1_000_000), (20, 7)])
def test_divergences_equal_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = audit_rows()
    got = divergence.divergences(table(spark, [(k, *r) for k, r in enumerate(rows)]), least_docs=5, most=4, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_divergences(rows, 5, 4)


def test_divergences_without_kept_terms(spark):
    assert divergence.divergences(table(spark, [])).count() == 0
    got = divergence.divergences(table(spark, [(1, "en", "a", "one"), (2, "en", "b", "two")])).collect()
    assert sorted(tuple(r) for r in got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    for count, total in ((0, 3), (10**13, 10**13 + 2), (7, 9 * 10**15), (10**15 + 1, 9 * 10**15 - 7)):
        assert divergence._share(np.array([count]), np.int64(total))[0] == 1 + 10**9 * (count + 2) // total
