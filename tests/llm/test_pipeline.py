import random

import pytest
from cases import SCHEMA, near_groups, odd_documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.mixing import mix_sources


def corpus(spark, tmp_path):
    rng = random.Random(9)
    rows = odd_documents()
    rows += [(1000 + i, "\n".join(" ".join(words(rng, 12)) for _ in range(8)), "en", ("a", "b", "c")[i % 3], 1, "x", 1, 1) for i in range(60)]
    rows += [(2000, rows[-1][1], "en", "a", 1, "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def without_later_runs(rows, run=3, least=50):
    """Rows (doc_id, text) as the line stage leaves them: every run of up to three lines, its first place by (doc_id, line)."""
    white = b" \t\n\v\f\r"
    split = [(d, [(j, x.strip(white)) for j, x in enumerate((t or "").encode().split(b"\n")) if x.strip(white)], t) for d, t in rows]
    first, runs = {}, []
    for d, lines, _ in split:
        for k in range(1, run + 1):
            for i in range(len(lines) - k + 1):
                w = tuple(x for _, x in lines[i : i + k])
                if k == run or sum(len(x.split()) for x in w) >= least:
                    runs.append((d, i, w))
                    if d is not None:
                        first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, lines, t in split:
        gone = {}
        own = set()
        for i, w in sorted({(i, w) for e, i, w in runs if e == d and tuple(x for _, x in lines[i : i + len(w)]) == w}):
            if (first[w] < (d, i)) if d is not None else w in own:
                gone |= {lines[i + k][0]: True for k in range(len(w))}
            own.add(w)
        if not gone or len(gone) < len(lines):
            out.append((d, t if not gone else b"\n".join(x for j, x in enumerate(t.encode().split(b"\n")) if j not in gone).decode()))
    return out


def test_stages_take_effect(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        seen[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    told = {r.doc_id for r in seen["language_id"]}
    assert not told & {40, 41, 42, 46} and {7, 3, 47, 1001} <= told
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert 2000 not in lines and 1059 in lines  # all lines of the copy stand in the other
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    # by brute force: lines of runs that start earlier, then one document of each group
    assert sorted(((r.doc_id, r.text) for r in seen["line_dedup"]), key=repr) == sorted(without_later_runs([(r.doc_id, r.text) for r in seen["language_id"]]), key=repr)
    groups = near_groups([(r.doc_id, r.text) for r in seen["line_dedup"] if r.doc_id is not None], 5, 80)
    assert {r.doc_id for r in seen["minhash_near_dedup"]} - {None} == {d for d, _, c, _ in groups if d == c}
    assert sum(r.doc_id is None for r in seen["minhash_near_dedup"]) == sum(r.doc_id is None for r in seen["line_dedup"])
    ids = [r.doc_id for r in seen["minhash_near_dedup"] if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 3 in ids and 7 not in ids and 12 not in ids
    left = [r for r in seen["minhash_near_dedup"] if r.doc_id is not None]
    assert all(r[2] == r[0] for r in near_groups(left, 5, 80))  # no two of them are near copies
    mixed = [r.doc_id for r in seen["mix_sources"]]
    assert set(mixed) <= {r.doc_id for r in seen["minhash_near_dedup"]} and max(mixed.count(i) for i in set(mixed)) <= 3
    pieces = seen["curve_packing"]
    assert {r.doc_id for r in pieces} == set(mixed)
    assert sum(r.start == 0 for r in pieces) == len(mixed)


def test_run(spark, tmp_path):
    corpus(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.length > 0 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


CLASHING = ["id", "copies", "copy", "row", "th", "spans", "n_lines", "held_out", "lang_pred", "score", "carried", "kept", "group", "size", "taken", "kept_row", "mixed_row", "mixed_copies"]


def test_clashing_names_and_null_ids(spark, tmp_path):
    """Columns named like the stages' own go through; rows without an id keep their own copies; no different text is dropped."""
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(words(rng, 12)) for _ in range(5))
    rows = [(None if i % 2 else i, text(), "en", "ab"[i % 4 // 2], 1, *CLASHING) for i in range(240)]
    rows += [(500, text(), "en", "a", 1, *CLASHING), (500, text(), "en", "a", 1, *CLASHING)]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        seen[name] = docs.collect()
        assert all(r[c] == c for r in seen[name] for c in CLASHING)
    assert len(seen["language_id"]) == 243 and len(seen["line_dedup"]) == 243
    assert sum(r.doc_id == 500 for r in seen["minhash_near_dedup"]) == 2 and len(seen["minhash_near_dedup"]) == 242
    before = spark.read.parquet(str(tmp_path / "2"))
    told = {r.source: (r.target, r.words) for r in mix_sources(before).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("words")).collect()}
    for s, (target, taken) in told.items():
        own = sum(len(r.text.split()) for r in seen["mix_sources"] if r.source == s)
        assert own == taken and abs(own - target) <= 60


@pytest.mark.parametrize("i", range(5))
def test_stage_of_an_empty_table(spark, tmp_path, i):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string")
    assert corpus_pipeline.STAGES[i][1](spark, docs, str(tmp_path)).collect() == []
