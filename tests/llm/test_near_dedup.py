import random

import pytest
from cases import frame, near_groups, odd_documents, rows_of, words

from tessera.llm import near_dedup as module
from tessera.llm.near_dedup import near_dedup


@pytest.mark.parametrize("n", [4, 5])
def test_equals_all_pairs(spark, n):
    rows = odd_documents()
    got = rows_of(near_dedup(frame(spark), shingle=n), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(near_groups(rows, n, 80), key=repr)


def edited(rng, base, share):
    return " ".join(w if rng.random() >= share else "".join(rng.choice("xyz") for _ in range(6)) for w in base)


@pytest.mark.parametrize("block", [2048, 40])
def test_large_group_of_edited_copies(spark, monkeypatch, block):
    """A key of more than a hundred members, many of them linked to few others."""
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i * 3 + 1, edited(rng, base, rng.choice([0.01, 0.03, 0.05])), "en", "a", 1, "x", 1, 1) for i in range(160)]
    rng.shuffle(rows)
    got = rows_of(near_dedup(frame(spark, rows), shingle=4), "doc_id", "n_shingles", "component_id", "kept")
    want = sorted(near_groups(rows, 4, 80), key=repr)
    assert got == want
    assert 1 < len({r[2] for r in got}) < 160


def test_lower_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        near_dedup(frame(spark), percent=70)


def test_empty(spark):
    assert near_dedup(frame(spark, [])).collect() == []
    assert near_dedup(frame(spark, [(1, None, None, None, None, None, None, None)])).count() == 1
