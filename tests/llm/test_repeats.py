import numpy as np
import pytest
from cases import covered, frame, odd_documents, rows_of

from tessera.llm import repeats
from tessera.llm.line_dedup import line_dedup
from tessera.llm.repeats import Form, _answers, _unpack, with_spans
from tessera.llm.spans import SpanHash, Words, owned, winnowed
from tessera.llm.substring_dedup import OUT, _cut_words, extend_both_ways, substring_dedup
from tessera.llm.suffix_dedup import END, SEP, _cut_bytes, expand_intervals, repeated_intervals, suffix_dedup


def test_substring_dedup_equals_brute_force(spark):
    rows = odd_documents()
    got = rows_of(substring_dedup(frame(spark)), "doc_id", "n_words", "n_removed", "kept_text")
    want = sorted(((d, n, m, k.decode()) for d, n, m, k in covered(rows, bytes.split, 50, b" ")), key=repr)
    assert got == want
    assert sum(r[2] for r in got) > 1000


def test_substring_dedup_small_windows(spark):
    rows = odd_documents(4)
    got = rows_of(substring_dedup(frame(spark, rows), window=6, seed=2), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(((d, n, m, k.decode()) for d, n, m, k in covered(rows, bytes.split, 6, b" ")), key=repr)


@pytest.mark.parametrize("split", [0, 1, 3])
def test_split_grams(spark, split):
    """Grams in more than so many contexts are dealt by context and compared by windows."""
    rows = odd_documents(6) + odd_documents(7)[:40]
    docs = frame(spark, rows, parts=2).select("doc_id", "text")
    for units, cut, window, seed, resolve, split_at, join in ((Words, _cut_words, 12, 3, extend_both_ways, bytes.split, b" "), (None, _cut_bytes, 50, 20, expand_intervals, lambda t: t, b"")):
        out = OUT if units else "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
        got = with_spans(docs, Form(window, seed, units, resolve, split)).mapInArrow(cut, out).collect()
        want = covered(rows, split_at, window, join)
        assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == sorted(((d, n, m) for d, n, m, _ in want), key=repr)


def test_suffix_dedup_equals_brute_force(spark):
    rows = odd_documents()
    got = [(d, n, m, bytes(k)) for d, n, m, k in rows_of(suffix_dedup(frame(spark)), "doc_id", "n_bytes", "n_removed", "kept")]
    want = sorted(covered(rows, lambda t: t, 50, b""), key=repr)
    assert sorted(got, key=repr) == want
    spans = rows_of(suffix_dedup(frame(spark)), "doc_id", "n_removed", "spans")
    assert all(sum(s["end"] - s["start"] for s in r[2]) == r[1] for r in spans)


def test_line_dedup(spark):
    got = {r[0]: r[1:] for r in rows_of(line_dedup(frame(spark)), "doc_id", "n_lines", "n_removed", "kept_text")}
    assert got[50] == (7, 3, "a b c\nd e f\ng h i\nlast line")
    assert got[51] == (4, 3, "\nother")
    assert got[40] == (0, 0, None) and got[41] == (0, 0, "") and got[42] == (0, 0, " \t\n")
    assert got[7][1] == 0


def test_empty_and_single(spark):
    for op in (substring_dedup, suffix_dedup, line_dedup):
        assert op(frame(spark, [])).collect() == []
        assert op(frame(spark, [(1, None, None, None, None, None, None, None)])).count() == 1


def test_intervals_are_the_repeats():
    rng = np.random.default_rng(3)
    for _ in range(20):
        parts = [rng.integers(0, 2, rng.integers(1, 60)).astype(np.uint16) for _ in range(6)]
        text = np.concatenate([np.append(p, np.uint16(SEP)) for p in parts] + [np.array([END], np.uint16)])
        at, interval = repeated_intervals(text, 16)
        own: dict = {}
        for i in range(len(text) - 15):
            w = tuple(text[i : i + 16].tolist())
            if max(w) < SEP:
                own.setdefault(w, []).append(i)
        want = sorted(tuple(v) for v in own.values() if len(v) > 1)
        got: dict = {}
        for i, g in zip(at.tolist(), interval.tolist()):
            got.setdefault(g, []).append(i)
        assert sorted(tuple(sorted(v)) for v in got.values()) == want


@pytest.mark.parametrize("w", [1, 2, 3, 5, 8, 9, 31])
def test_every_window_has_one_owner(w):
    g = np.random.default_rng(w).integers(1, 6, 200).astype(np.uint64)
    ok = np.ones(len(g), dtype=bool)
    at = winnowed(g, ok, w)
    before, after = owned(g, at, w)
    for j in range(len(g) - w + 1):
        own = [i for i, b, a in zip(at.tolist(), before.tolist(), after.tolist()) if max(i - b, i - w + 1, 0) <= j and j + w - 1 <= min(i + a, i + w - 1)]
        assert own == [j + int(g[j : j + w].argmin())]


def test_span_hash_is_content():
    data = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    h = SpanHash(data).of(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_answers_of_many_documents():
    """Spans of documents far behind in a partition stay apart, as do those of neighbours in a long text."""
    for base in (0, (1 << 23) - 1, 1 << 24):
        n = base + 4
        ids, th = np.arange(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        d = np.array([base, base, base + 1, base + 2, base + 3])
        lo, hi = np.array([5, 9, 3, 1 << 31, 0]), np.array([10, 20, 8, (1 << 31) + 7, 2])
        got = {}
        for batch in _answers(d, lo, hi, ids, th, False, 3):
            for blob in batch.column("blob").to_pylist():
                own, _, count, at, size = _unpack(blob, np.int64, np.int32, np.uint32, np.uint32, np.uint32)
                for i, x, y in zip(np.repeat(own, count).tolist(), at.tolist(), size.tolist()):
                    got.setdefault(i - base, []).append((x, x + y))
        assert got == {0: [(5, 20)], 1: [(3, 8)], 2: [(1 << 31, (1 << 31) + 7)], 3: [(0, 2)]}


def test_several_buckets_in_a_partition(spark, monkeypatch):
    """Where there are more buckets than partitions, each is worked off by itself."""
    monkeypatch.setattr(repeats, "PART_BYTES", 512)
    monkeypatch.setattr(repeats, "MOST_PARTS", 3)
    rows = odd_documents(8)
    got = rows_of(substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(((d, n, m, k.decode()) for d, n, m, k in covered(rows, bytes.split, 50, b" ")), key=repr)
    got = [(d, n, m, bytes(k)) for d, n, m, k in rows_of(suffix_dedup(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "kept")]
    assert sorted(got, key=repr) == sorted(covered(rows, lambda t: t, 50, b""), key=repr)
