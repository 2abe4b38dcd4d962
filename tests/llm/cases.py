"""A small table with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, th long, h int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def odd_documents(seed: int = 1) -> list[tuple]:
    """Null and empty texts, nulls in any column, exact and near copies, shared passages, repeated rows, a long text; clashing columns."""
    rng = random.Random(seed)
    base, passage = words(rng, 160), words(rng, 70)
    rows: list[tuple] = []

    def add(i, text, lang="en", source="a"):
        rows.append((i, text, lang, source, len(text) if text is not None else None, "x", 5, 1))

    add(7, " ".join(base))
    add(3, " ".join(base))
    add(12, "  ".join(base) + "\n")
    for i in range(20, 30):
        near = list(base)
        for j in rng.sample(range(len(near)), 6):
            near[j] = "zz"
        add(i, " ".join(near), source="b")
    for i in range(30, 40):
        add(i, " ".join(words(rng, rng.randint(0, 30)) + passage + words(rng, rng.randint(0, 30))))
    add(40, None), add(41, ""), add(42, " \t\n"), add(43, "one two"), add(44, "one two"), add(45, "ONE Two three", None, None)
    add(46, "12 34 !! ##"), add(47, " ".join(words(rng, 6000))), add(48, "ä" * 300 + " é" * 120), add(49, "na " * 200)
    add(50, "\n".join(["a b c", "d e f", "g h i", "a b c", "d e f", "g h i", "last line"]), source=None)
    add(51, "a b c\nd e f\n\n  g h i  \nother")
    add(52, "x" * 60 + "y" * 60), add(53, "y" * 60 + "x" * 60)
    add(None, " ".join(base), "de", "b")
    rows += [rows[0], rows[-3], rows[14]]
    return rows


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(parts)


def covered(rows, split, window: int, join: bytes):
    """(doc_id, units, removed, kept) per row, where a window that starts in a document of smaller doc_id removes its units."""
    first: dict = {}
    cut = [(r[0], split((r[1] or "").encode())) for r in rows]
    key = lambda u, i: tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]
    for d, u in cut:
        if d is not None:
            for i in range(len(u) - window + 1):
                k = key(u, i)
                first[k] = min(first.get(k, d), d)
    out = []
    for d, u in cut:
        gone = [False] * len(u)
        if d is not None:
            for i in range(len(u) - window + 1):
                if first[key(u, i)] < d:
                    gone[i : i + window] = [True] * window
        kept = join.join([x for x, g in zip(u, gone) if not g]) if isinstance(u, list) else bytes(x for x, g in zip(u, gone) if not g)
        out.append((d, len(u), sum(gone), kept))
    return out


def near_groups(rows, n: int, percent: int):
    """(doc_id, set size, component_id, kept) per row by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    out = []
    for r, s in zip(rows, sets):
        c = None if r[0] is None and s else find(r[0]) if r[0] is not None else None
        out.append((r[0], len(s), c, True if r[0] is None else c == r[0]))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
