"""Decontamination against the definition of an overlap."""

import random
import sys
from itertools import combinations
from pathlib import Path

import pytest

import corpus_pipeline
from siftlode.llm import decontam, queries
from siftlode.llm.shared import work_dir

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import VOCABULARY, frame  # noqa: E402


@pytest.mark.parametrize("percent", [60, 80, 100])
@pytest.mark.parametrize("width", range(1, 15))
def test_masks_cover_every_accepted_stretch(width, percent):
    read = [{p + s for p in mask} for mask in decontam.masks(width, percent) for s in range(width - mask[-1])]
    for differ in combinations(range(width), width * (100 - percent) // 100):
        assert any(not places & set(differ) for places in read), differ


def found(spark, item, passages, **options):
    """Which passages are met at each offset modulo 4, in documents of other words."""
    rng = random.Random(5)
    texts = {}
    for k, passage in enumerate(passages):
        for before in range(4):
            texts[4 * k + before] = " ".join([f"x{rng.random()}" for _ in range(before)] + passage + [f"y{rng.random()}" for _ in range(9)])
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    return {r["doc_id"]: r["n_same"] for r in decontam.overlaps(frame(spark, list(texts.values()), list(texts)), benchmark, **options).collect()}


def changed(passage, places):
    return ["other" if k in places else w for k, w in enumerate(passage)]


def test_exact_and_substituted_passages_at_every_offset(spark):
    item = random.Random(3).sample(VOCABULARY, 30)
    passage = item[9:22]
    sets = [(), *combinations(range(13), 1), *combinations(range(13), 2)]
    want = {4 * k + before: 13 - len(places) for k, places in enumerate(sets) for before in range(4)}
    got = found(spark, item, [changed(passage, places) for places in sets])
    assert got == want
    assert found(spark, item, [changed(passage, (2, 6, 10))]) == {}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 10, 11, 12])
def test_short_items_at_every_offset(spark, n):
    item = random.Random(n).sample(VOCABULARY, n)
    sets = [x for k in range(n // 5 + 1) for x in combinations(range(n), k)]
    want = {4 * k + before: n - len(places) for k, places in enumerate(sets) for before in range(4)}
    assert found(spark, item, [changed(item, places) for places in sets], shortest=1) == want


def test_query_and_stage_meet_short_items(spark):
    folder = work_dir(spark, "tables")
    frame(spark, ["who wrote the second letter", "Well: who wrote this second letter?", "who wrote to them"], [1, 2, 3]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, "Who wrote the second letter?")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted(tuple(r) for r in queries.op8_decontamination(spark, folder).collect()) == [(1, 7, 5), (2, 7, 4)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()] == [3]
