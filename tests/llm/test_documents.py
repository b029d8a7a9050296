"""The operators on documents against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlode.llm import decontam, graph, lmscore, neardup, packing, pii, quality, substring, tokenization, tokenplanes
from siftlode.llm.shared import work_dir

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "s", "r")]
#: Columns whose names the operators use themselves.
CLASHING = ("key", "g", "node", "at", "path", "label", "start", "bucket", "kept", "rank", "spans", "hash", "item", "doc", "n")


def some_texts(seed=1):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    passage = words(60)
    texts = [words(rng.randint(1, 150)) for _ in range(25)]
    texts += [words(30) + " " + passage + " " + words(20) for _ in range(4)]
    base = words(120)
    texts += [base, base, base.upper()] + [base.replace(" ", "\n", 1) + " " + words(k) for k in (1, 2, 3, 30)]
    texts += [None, "", " \t\n ", "one", "a b c d", "x" * 5_000, " ".join(["again"] * 300), "Zeile eins\nZeile eins\n\nZeile zwei\x0bend", "É é ß 中文 \u00a0 nbsp"]
    texts += [words(30) + "\n" + words(3_000)]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(texts, file):
    path = public_tokenizers.path(file)
    odd = ["a  b\n\nc <|endoftext|> d", " x", "\n", "y ", "it's 'S  can't\tgo 12 345 ", "<|startoftext|>hi<|endoftext|> \n x", "ΑΣ Σ", "a\x1cb \x85", "\x00a b\x00 c\x00", "x\n\ny\u2028z", "\x01 a \x01b", "e\u0301 \u0308x"]
    every = [t or "" for t in texts] + odd
    whole = [x.ids for x in Tokenizer.from_file(path).encode_batch(every, add_special_tokens=False)]
    tokens = tokenization.ChunkEncoder(path, bound=50)
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode(every)] == whole


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_of_random_texts_with_blanks_and_marks(file):
    path, rng = public_tokenizers.path(file), random.Random(13)
    alphabet = [*" \n\0\t\x01ab1é'", " \0", "\0 ", "\n\0", "  ", "<|endoftext|>", "\u3000", "don't", "12 345", "\ufeff", "\u0301"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(6_000)]
    whole = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    tokens = tokenization.ChunkEncoder(path)
    got = [x.tolist() for k in range(0, len(texts), 500) for x in tokens.encode(texts[k : k + 500])]
    assert [t for t, a, b in zip(texts, got, whole, strict=True) if a != b] == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for ids in (np.array([], "<u4"), np.array([0], "<u4"), np.array([1, 2**31, 2**32 - 1, 65_536, 7], "<u4"), np.arange(1_001, dtype="<u4")):
        assert tokenplanes.from_planes(tokenplanes.to_planes(ids, kind), ids.size, kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_planes(spark, texts, docs, kind):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = work_dir(spark, "planes")
    manifest = tokenplanes.write_token_planes(docs, path, folder, block=97, kind=kind, shards=3)
    got = by_id(tokenplanes.read_token_planes(manifest, folder, with_ids=True))
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, ids.size, zlib.crc32(ids.tobytes()), ids.tolist())
        start += ids.size
    assert tokenplanes.token_planes(empty(spark), path).count() == 0
    odd = frame(spark, ["b", "a", "a", None], [None, 1, 1, 1])
    assert sorted((r["doc_id"] is not None, r["start"]) for r in tokenplanes.token_planes(odd, path).collect()) == [(False, 0), (True, 2), (True, 3), (True, 5)]


# ---- 2


def test_backoff_scores(spark, texts, docs):
    words = [SPLIT.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(map(len, words))
    got = by_id(lmscore.backoff_scores(docs))
    for k, w in enumerate(words):
        score, took = 0.0, Counter()
        for i in range(len(w)):
            longest = min(i + 1, 3)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[n - 1][gram] >= 2:
                    under = total if n == 1 else counts[n - 2][gram[:-1]]
                    score += np.log(counts[n - 1][gram] / under) + (longest - n) * np.log(0.4)
                    took[n] += 1
                    break
        r = got[k]
        assert (r["n_words"], r["n_trigram"], r["n_bigram"], r["n_unigram"]) == (len(w), took[3], took[2], took[1])
        assert r["score"] == pytest.approx(score, abs=1e-6)
    assert lmscore.backoff_scores(empty(spark)).count() == 0
    assert sorted(r["n_words"] for r in lmscore.backoff_scores(frame(spark, ["a b", "a b", None], [None, 1, 1])).collect()) == [0, 2, 2]


# ---- 3


def features(t):
    t = t or ""
    w, lines = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
    n3 = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if n3[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_cascade(spark, texts):
    texts = [*texts, "The &&& big *** words ### here $$$ " * 3 + " ".join(VOCABULARY[:60]), "LOUD WORDS EVERYWHERE " + " ".join(x.upper() for x in VOCABULARY[:60])]
    docs = frame(spark, texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(quality.with_features(docs, names))
    assert all(tuple(got[i][n] for n in names) == features(t) for i, t in enumerate(texts))
    judged = {r["doc_id"]: r["rejected_by"] for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, _, repeats = features(t)
        capitals = sum("A" <= c <= "Z" for c in t or "")
        bad = n < 50 or 2 * repeats > n or 5 * symbols > n or 3 * capitals > chars
        assert (judged[i] is not None) == bad
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in judged.items() if x is None}
    order = quality.order_rules(docs, quality.BASE + quality.MORE)
    assert {x[0].name for x in order} == {x.name for x in quality.BASE + quality.MORE}
    assert quality.keep_good(empty(spark)).count() == 0


# ---- 4


def near(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def chain_texts(n=60, seed=7):
    """Near copies that drift away from each other, around one common text."""
    rng = random.Random(seed)
    words = [rng.choice(VOCABULARY) for _ in range(100)]
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(100)] = rng.choice(VOCABULARY)
        out.append(" ".join(copy))
        if rng.random() < 0.1:
            words = copy
    return out


@pytest.mark.parametrize(("leaf", "cell"), [(4_096, 64 << 20), (8, 64 << 20), (4_096, 5_000)])
@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, texts, monkeypatch, leaf, cell, percent):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    every = texts + chain_texts()
    got = by_id(neardup.near_duplicates(frame(spark, every), percent))
    want = near(every, percent)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(every))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(VOCABULARY[:40])
    odd = frame(spark, [text, text, text, None, "", "other words"], [5, 5, None, 1, 2, 3])
    rows = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(odd).collect())
    assert rows == [(-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True), (5, -1, False), (5, -1, False)]
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.without_near_duplicates(frame(spark, [text, text, "", None], [4, 2, 6, 7]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 7] and kept.columns[:2] == ["doc_id", "text"]


@pytest.mark.parametrize("key", [3, None])
def test_one_row_of_each_component_stays(spark, key):
    a, b, c = (" ".join(VOCABULARY[k : k + 40]) for k in (0, 40, 80))
    #: Repeated rows; near copies under the same id; another text under that id; a row whose id is kept elsewhere but which is not the one to stay.
    rows = [(a, key), (a, key), (a, key), (f"{a} end", key), (b, key), (b, 9), (c, 4), (c, 9), (c, 4), ("", key), ("", key), (None, 8)]
    docs = frame(spark, [t for t, _ in rows], [k for _, k in rows]).withColumns({"key": F.lit("own"), "row": F.lit("own"), "label": F.lit("own")})
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, (r["text"] or "").removesuffix(" end")) for r in kept.collect())
    assert got == sorted([(key or -1, a), (key or -1, b), (4, c), (key or -1, ""), (key or -1, ""), (8, "")])
    assert neardup.without_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "cc"), "t").collect()}
    assert all(got.get(i, i) == find(i) for i in up)


# ---- 5


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = frame(spark, texts * 3)
    placed = packing.packed(packing.pieces(docs, path, length=512).withColumn("rank", F.lit("own")), length=512).cache()
    rows = placed.collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts * 3)}
    for i, want in ids.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == want.tobytes() and all(r["doc_tokens"] == want.size for r in own)
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) <= 512
    n = placed.select("sequence_id").distinct().count()
    assert sum(x.size for x in ids.values()) / (512 * n) > 0.9 and placed.columns[-2:] == ["sequence_id", "offset"]
    for r in packing.sequences(placed, 512).collect():
        assert len(r["tokens"]) in (512, r["n_tokens"])
    whole = {r["sequence_id"]: r for r in packing.sequences(placed, 512, pad_id=7).collect()}
    assert all(r["tokens"][r["n_tokens"] :] == [7] * (0 if r["n_tokens"].bit_count() == 1 else 512 - r["n_tokens"]) for r in whole.values())
    assert all(np.array(whole[r["sequence_id"]]["tokens"][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes() == bytes(r["ids"]) for r in rows)
    again = packing.pieces_of(packing.written(placed, 512)).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"], bytes(r["ids"]))
    assert sorted(map(key, again)) == sorted(map(key, rows))
    narrow = packing.pieces_of(packing.written(packing.packed(packing.pieces(docs, path, length=512, width=2), length=512), 512, width=2), width=2)
    assert sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in narrow.collect()) == sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in rows)
    assert packing.packed(packing.pieces(empty(spark), path)).count() == 0
    assert packing.packed(packing.pieces(frame(spark, ["a", "a", None], [1, 1, None]), path)).count() == 3


def test_patterns_meet_the_demand():
    rng = np.random.default_rng(1)
    sizes, demand = np.arange(1, 65), rng.integers(0, 40, 64) + 1
    used = packing.patterns(sizes, demand.astype(float), 64)
    assert (sum(a * x for a, x in used) >= demand - 1e-6).all()
    assert sum(x for _, x in used) <= 1.05 * (sizes * demand).sum() / 64 + 1
    value, counts = packing.knapsack(np.array([1.0, 5.0, 9.0]), np.array([1, 3, 5]), 9)
    assert value == pytest.approx(15.0) and (counts * [1, 3, 5]).sum() <= 9


# ---- 7


def without_repeats(texts, ids=None, window=20):
    ids = list(range(len(texts))) if ids is None else ids
    words = {i: SPLIT.findall(t or "") for i, t in zip(ids, texts, strict=True)}
    first, gone = {}, {i: set() for i in ids}
    for i in sorted(ids):
        for k in range(len(words[i]) - window + 1):
            if first.setdefault(tuple(words[i][k : k + window]), (i, k)) != (i, k):
                gone[i] |= set(range(k, k + window))
    return {i: " ".join(w for k, w in enumerate(words[i]) if k not in gone[i]) for i in ids}


@pytest.mark.parametrize("batch", [1_500_000, 40])
def test_substring_dedup(spark, texts, docs, monkeypatch, batch):
    monkeypatch.setattr(substring, "BATCH", batch)
    got, want = by_id(substring.without_repeats(docs)), without_repeats(texts)
    for i, t in enumerate(texts):
        n = len(SPLIT.findall(t or ""))
        assert (got[i]["n_words"], got[i]["kept_text"], got[i]["n_removed"]) == (n, want[i], n - len(SPLIT.findall(want[i])))


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(VOCABULARY[:30])
    rows = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.without_repeats(frame(spark, [text, text, text, None], [None, 4, 4, 9])).collect())
    assert rows == [(-1, 0), (4, 30), (4, 30), (9, 0)]
    assert substring.without_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substring.without_repeats(empty(spark), window=19)


# ---- 8


def overlaps(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, t in docs.items():
        d = words(t)
        for j, b in items.items():
            b = words(b)
            width = min(13, len(b))
            for shift in range(-len(b) + 1, len(d)):
                same = [0 <= shift + k < len(d) and d[shift + k] == b[k] for k in range(len(b))]
                if len(b) >= 11 and any(sum(same[k : k + width]) * 100 >= width * 80 for k in range(len(b) - width + 1)):
                    found.add((i, j))
    return found


def test_decontamination(spark):
    rng = random.Random(11)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = {1: words(15), 2: words(40), 3: words(5), 4: words(30)}
    changed = list(items[2])
    changed[20] = "other"
    docs = {
        1: words(30) + items[1] + words(9), 2: changed, 3: words(80), 4: words(7) + items[4][3:25] + words(3), 5: items[3] * 2, 6: items[4][:9] + words(60),
        7: [x.upper() + "," for x in items[2]], 9: words(11),
    }
    texts = {k: " ".join(v) for k, v in docs.items()} | {10: None, 11: "", 12: " ".join(docs[3] * 20)}
    benchmark = spark.createDataFrame([*((k, " ".join(v), "own") for k, v in items.items()), (5, None, "x"), (6, "", "x"), (None, "a", "x")], "item_id long, text string, shift string")
    df = frame(spark, list(texts.values()), list(texts))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(df, benchmark).collect()}
    assert got == overlaps(texts, {k: " ".join(v) for k, v in items.items()}) == {(1, 1), (2, 2), (4, 4), (7, 2)}
    kept = decontam.decontaminated(df, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {1, 2, 4, 7} and kept.columns == df.columns
    assert decontam.overlaps(empty(spark), benchmark).count() == 0 and decontam.overlaps(df, benchmark.limit(0)).count() == 0


# ---- 10

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        worth = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in worth) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data(spark, texts):
    odd = [
        "a@b.c%x@d.e f@g", "x..y@z-.q.r.s, mail me@here.com.", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 0001.02.3.255 and 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "411111111111111142 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1 (017) 555-7713 or +49 30 1234567 or +1 23 or +12345678901234567890", "call (555) 123-4567 or 555-123-4567", "é中+1 202 555 0143 ü x@y.de",
        "@@@ a@ @b.c +++1 +", "4539 1488 0343 6467\n+1 (017) 555-7713\n10.0.0.1", "name (at) host (dot) com", "9" * 3_000, "a" * 3_000 + "@b.c", "1." * 2_000, "x@y.z " * 200,
    ]
    every = [*texts, *odd]
    docs = frame(spark, every)
    got = by_id(pii.personal_data(docs))
    for i, t in enumerate(every):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        assert [tuple(x) for x in got[i]["base_spans"]] == want
        assert set(want) <= {tuple(x) for x in got[i]["spans"]}
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    cleaned = {r["doc_id"]: r["text"] for r in clean.collect()}
    n = len(texts)
    assert cleaned[n + 9] == "[card]\n[phone]\n[ip]" and cleaned[texts.index(None)] is None and cleaned[0] == texts[0]
    assert pii.personal_data(empty(spark)).count() == 0


def test_labelers_are_weighed():
    counts = [((1, 1, 1, 0), 500), ((1, 1, -1, 0), 60), ((-1, -1, -1, 0), 400), ((-1, -1, 1, -1), 50), ((-1, 1, 1, 1), 20)]
    belief = pii.reliabilities(counts)
    assert belief[(1, 1, 1, 0)] > 0.95 and belief[(1, 1, -1, 0)] > 0.8 and belief[(-1, -1, -1, 0)] < 0.05
    assert pii.reliabilities([]) == {}


def test_digest_is_of_spans(spark):
    found = pii.personal_data(spark.createDataFrame([(1, "x@y.de 10.0.0.1")], "doc_id long, text string"))
    r = found.select(pii.listed("base_spans").alias("s"), F.sha2(pii.listed("base_spans"), 256).alias("h")).first()
    assert r["s"] == "email:0:6,ip:7:15" and r["h"] == hashlib.sha256(r["s"].encode()).hexdigest()
