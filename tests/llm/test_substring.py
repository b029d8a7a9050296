"""Repeated passages where rows share a ``doc_id``."""

import sys
from pathlib import Path

import pytest

from siftlode.llm import substring

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import VOCABULARY, frame  # noqa: E402

A, B, C, D = (" ".join(VOCABULARY[k : k + 30]) for k in (0, 30, 60, 90))


def kept(spark, rows):
    out = substring.without_repeats(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["kept_text"]) for r in out)


@pytest.mark.parametrize("key", [4, None])
def test_the_same_row_twice_loses_nothing(spark, key):
    assert kept(spark, [(key, A), (key, A)]) == [(key or -1, A)] * 2


@pytest.mark.parametrize("batch", [1_500_000, 40])
def test_places_apply_to_their_own_row(spark, monkeypatch, batch):
    monkeypatch.setattr(substring, "BATCH", batch)
    long = f"{C} {D} {VOCABULARY[130]} {B}"
    rows = [(4, f"{A} {B}"), (4, f"{C} {A}"), (4, A), (7, long), (7, D), (8, B)]
    #: Under 4 both A of one place stay and the later one goes; under 7 the place of D differs, so it goes where it comes later.
    assert kept(spark, rows) == sorted([(4, f"{A} {B}"), (4, C), (4, A), (7, VOCABULARY[130]), (7, D), (8, "")])
