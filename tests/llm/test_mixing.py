import random
from collections import defaultdict

import numpy as np
import pytest
from cases import SCHEMA, frame, odd_documents, rows_of

from tessera.llm import mixing
from tessera.llm.mixing import mix_sources, pivot, settle_large


def shared(sizes: dict, cap=3.0):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    t, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            for s in open_:
                t[s] = left * w[s] / total
            break
        for s in over:
            t[s] = cap * sizes[s]
        left -= sum(t[s] for s in over)
        open_ -= over
    return t


def documents(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = int(rng.paretovariate(1.2) * 5) % 3000
        source = None if rng.random() < 0.05 else rng.choice(["hot"] * 6 + ["b", "c", "Z", "é"])
        rows.append((i, "w " * size if rng.random() > 0.02 else None, "en", source, 1, "x", 1, 1))
    rows.append((n, "tiny source", "en", "q", 1, "x", 1, 1))
    return rows


@pytest.mark.parametrize("block", [4096, 64])
def test_targets_and_taken(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = documents()
    got = mix_sources(frame(spark, rows)).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sums, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sums[r[3]] += size[r[0]]
    want = shared(sums)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 5), s
    again = mix_sources(frame(spark, rows, parts=7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    p, w = rng.random(9), rng.integers(1, 30, 9).astype(float)
    mean = np.zeros(9)
    for _ in range(4000):
        q, done = pivot(p, w, rng.random(9), False)
        assert (~done).sum() <= 1 and set(q[done].tolist()) <= {0.0, 1.0}
        assert (q * w).sum() == pytest.approx((p * w).sum())
        mean += q
    assert np.abs(mean / 4000 - p).max() < 0.05


def test_large_units_first():
    rng = np.random.default_rng(2)
    w = np.array([20000.0, 300, 200, 90, 40, 10, 9, 8, 3, 2, 1, 1, 1])
    for _ in range(50):
        out = settle_large(w, 0.5 * (w.sum() + 30_000), 30_000, rng.random(len(w)))
        assert set(out.tolist()) <= {0.0, 1.0}


def test_odd_rows(spark):
    rows = odd_documents()
    want = sorted(((r[0], len((r[1] or "").encode().split())) for r in rows), key=repr)
    assert [(d, s) for d, s, _ in rows_of(mix_sources(frame(spark)), "doc_id", "size", "taken")] == want
    assert mix_sources(frame(spark, [])).collect() == []
    assert [tuple(r) for r in mix_sources(spark.createDataFrame([(1, None, None, None, None, None, None, None)], SCHEMA)).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


@pytest.mark.parametrize("same", [False, True])
def test_null_and_repeated_ids_are_drawn_apart(spark, same):
    """Half of the rows without an id, or all with one: the source still comes to its target."""
    rng = np.random.default_rng(6)
    rows = [((None if i % 2 else i) if not same else 1, " ".join(["w"] * int(rng.integers(20, 60)) + [str(i)]), "en", ("a", "b", "c")[i % 3], 1, "x", 1, 1) for i in range(600)]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == 600
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert len({r.copies for r in own if r.doc_id is None or same}) > 1 or own[0].target == 3 * own[0].source_size or own[0].target == own[0].source_size
    assert sorted(got, key=repr) == sorted(mix_sources(frame(spark, rows, parts=5)).collect(), key=repr)


def test_repeated_rows_are_numbered(spark):
    rows = [(5, "one two three four", "en", "a" if i % 2 else "b", 1, "x", 1, 1) for i in range(300)]
    got = mix_sources(frame(spark, rows)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert len(own) == 150 and abs(sum(r.taken for r in own) - own[0].target) <= 4
