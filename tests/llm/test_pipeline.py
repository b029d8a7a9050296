"""The pipeline against brute force: what each stage keeps, and the pieces of what is left."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siftlode.llm.shared import work_dir

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import VOCABULARY, features, near, overlaps  # noqa: E402


def corpus():
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    item = words(30)
    base = words(200)
    texts = [words(rng.randint(60, 300)) for _ in range(12)] + [words(20), None, "", " ".join(["spam eggs ham"] * 40), "%%% ### $$$ " * 40 + words(60)]
    texts += [base, base + " tail", words(3) + " " + base, base]
    texts += [words(80) + " " + item + " " + words(40), words(90) + " write me@here.example.com or +1 (202) 555-0143 now " + words(20)]
    return texts, item


def test_pipeline_against_brute_force(spark):
    texts, item = corpus()
    folder = work_dir(spark, "tables")
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    good = []
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeats = features(t)
        if n >= 50 and 2 * repeats <= n and 5 * symbols <= n:
            good.append(i)
    groups = near([texts[i] for i in good], 80)
    one = [i for k, i in enumerate(good) if groups[k][1] == k]
    leaked = {d for d, _ in overlaps({i: texts[i] for i in one}, {1: item})}
    want = {i: texts[i].replace("me@here.example.com", "[email]").replace("+1 (202) 555-0143", "[phone]") for i in one if i not in leaked}
    assert len(want) == 14 and leaked == {len(texts) - 2}

    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(got[i], key=lambda r: r["start"])
        assert [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own] == [r["ids_crc32"] for r in own]
        assert sum(r["length"] for r in own) == ids.size == own[0]["doc_tokens"]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "packing"]
