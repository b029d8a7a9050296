"""Near-duplicates where many rows share a ``doc_id`` or have none."""

import sys
from pathlib import Path

import pytest

from siftlode.llm import neardup

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import frame  # noqa: E402


@pytest.mark.parametrize("key", [None, 7])
def test_sets_are_made_once_for_each_row(spark, monkeypatch, key):
    n = 400
    texts = [" ".join(f"w{k}-{j}" for j in range(12)) for k in range(n // 2)] * 2
    joined = []
    whole = neardup._sets

    def watched(docs, keys):
        found = neardup._keyed(docs).select("key", neardup._text_id().alias("text_id"))
        joined.append((keys.count(), found.join(keys, ["key", "text_id"]).count()))
        return whole(docs, keys)

    monkeypatch.setattr(neardup, "_sets", watched)
    #: Each text is there twice; one word more makes a near copy of each.
    rows = frame(spark, [*texts, *[f"{t} more" for t in texts[: n // 2]]], [key] * (n + n // 2))
    got = neardup.near_duplicates(rows, percent=80).collect()
    assert len(got) == n + n // 2 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(key, key, True)}
    assert joined == [(n, n + n // 2)]
