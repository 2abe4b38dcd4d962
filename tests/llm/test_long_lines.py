import random

import pytest
from cases import frame, odd_documents, rows_of, words

import corpus_pipeline
from tessera.llm.line_dedup import line_dedup


def long_documents():
    """Copies of one and two lines, long lines within other texts and twice in one text, and short lines that repeat."""
    rng = random.Random(11)
    line = lambda n: " ".join(words(rng, n))
    a, b, c, d, short = line(107), line(96), line(30), line(25), line(5)
    texts = [a + "\n" + b, b, "\n".join([short, a, short]), c + "\n\n  " + d, "x\n" + c + "\n" + d + " \ny", c, d + "\n" + c, "\n".join([line(60)] * 2), "\n".join([c] * 4), short, "\n".join([short, c, d, a])]
    return [(3000 + i, t, "en", "a", 1, "x", 1, 1) for i, t in enumerate(texts)]


def brute(rows, run, least):
    """n_removed and kept lines of each row by comparing all runs."""
    cut = [(r[0], [x.strip() for x in (r[1] or "").encode().split(b"\n") if x.strip()]) for r in rows]
    runs = lambda u: [(i, k, tuple(u[i : i + k])) for k in range(1, run + 1) for i in range(len(u) - k + 1) if k == run or sum(len(x.split()) for x in u[i : i + k]) >= least]
    first: dict = {}
    for d, u in cut:
        if d is not None:
            for _, _, w in runs(u):
                first[w] = min(first.get(w, d), d)
    out = []
    for d, u in cut:
        gone, seen = [False] * len(u), set()
        for i, k, w in runs(u):
            if w in seen or d is not None and first[w] < d:
                gone[i : i + k] = [True] * k
            seen.add(w)
        out.append((d, len(u), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 40, 50])
def test_long_runs_equal_brute_force(spark, least):
    rows = long_documents() + odd_documents()
    got = rows_of(line_dedup(frame(spark, rows), least=least), "doc_id", "n_lines", "n_removed")
    assert got == brute(rows, 3, least)


def test_pipeline_drops_long_repeats_of_one_or_two_lines(spark):
    docs = frame(spark, long_documents()).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert 3001 not in got and got[3002].count("\n") == 1 and "\n" not in got[3007] and got[3004] == "x\ny"
    assert 3000 in got and 3005 in got and 3009 in got
