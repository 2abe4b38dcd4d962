import datetime

import numpy as np
import pytest
from cases import frame, odd_documents, rows_of
from pyspark.sql import functions as F

from tessera.llm.quality_rules import measured, quality_rules, quantiles, sketches, text_stats, thresholds
from tessera.llm.url_filters import host_of, url_filter
from tessera.llm.vector_search import odds_within, stopping_share, vector_search


def brute(text: str) -> tuple:
    b = text.encode()
    w = b.split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(cover)


def test_measures():
    texts = [r[1] or "" for r in odd_documents() if r[0] != 47] + ["# a |b| <c> ü\n\n a\n a", "a b a b a b c"]
    assert [tuple(int(v) for v in x) for x in zip(*measured([t.encode() for t in texts]))] == [brute(t) for t in texts]


def test_adaptive_thresholds(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    plain = lambda k: " ".join(word() + ("#" if j < k else "") for j in range(80))
    rows = [(i, plain(0), "en", "clean", 1, "x", 1, 1) for i in range(100)] + [(200 + i, plain(60), "en", "code", 1, "x", 1, 1) for i in range(100)]
    rows += [(500, plain(60), "en", "clean", 1, "x", 1, 1), (501, plain(60), "fr", "few", 1, "x", 1, 1), (502, "short", None, None, 1, "x", 1, 1), (503, None, "en", "clean", 1, "x", 1, 1)]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(100)) and all(got[200 + i].kept for i in range(100))  # usual in this source
    assert not got[500].kept and got[500].failed_rules == ["symbol_share", "mean_word"]
    assert got[502].base_failed and got[503].base_failed and got[503].n_words == 0


def test_thresholds_by_group_and_fallback(spark):
    """Large groups have their own thresholds, small ones their language's, small languages those of all; a tie is kept."""
    rng = np.random.default_rng(4)
    text = lambda letters: " ".join("x" * max(1, int(rng.normal(letters, 0.4))) + str(i) for i in range(60))
    rows, n = [], 0
    for lang, source, count, letters in (("en", "a", 120, 4), ("en", "b", 120, 7), ("en", "c", 5, 4), ("de", "a", 400, 12), ("fr", "a", 7, 4), (None, None, 3, 4)):
        rows += [(n + i, text(letters), lang, source, 1, "x", 1, 1) for i in range(count)]
        n += count
    got = {(r.lang, r.source): r for r in thresholds(stats_of(spark, rows)).collect()}
    a, b, c, fr, none = (got[k].max_mean_word for k in (("en", "a"), ("en", "b"), ("en", "c"), ("fr", "a"), (None, None)))
    assert a < b - 2 and c not in (a, b) and fr == none and c != fr
    tied = stats_of(spark, rows).withColumn("word_chars", F.lit(0)).withColumn("n_words", F.lit(60))
    assert all(r.max_mean_word == 0 for r in thresholds(tied).collect())
    kept = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(i, " ".join(f"w{i:03d}{j:02d}" for j in range(60)), "en", "a") for i in range(120)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.kept for r in kept.values())  # every text ties with its threshold


def stats_of(spark, rows):
    return text_stats(frame(spark, rows).select("doc_id", "lang", "source", "text")).withColumn("base_failed", F.lit(False))


def test_clashing_names(spark):
    """Input columns named like the operator's own."""
    df = frame(spark)
    for c in ("n_words", "base_failed", "kept", "failed_rules", "max_mean_word", "t_lang", "rule", "bucket"):
        df = df.withColumn(c, F.lit("q"))
    plain = rows_of(quality_rules(frame(spark)), "doc_id", "n_words", "kept")
    assert rows_of(quality_rules(df), "doc_id", "n_words", "kept") == plain


def test_odd_rows(spark):
    rows = odd_documents()
    got = rows_of(quality_rules(frame(spark)), "doc_id", "n_words", "base_failed")
    assert len(got) == len(rows)
    for d, n, failed in got:
        assert failed or n >= 50
    assert quality_rules(frame(spark, [])).collect() == []


def test_sketches_merge_and_approximate(spark):
    rng = np.random.default_rng(2)
    v = [("a" if i % 3 else "b", "r", float(x)) for i, x in enumerate(rng.lognormal(0, 1, 3000))]
    df = spark.createDataFrame(v, "g string, rule string, value double")
    whole = quantiles(sketches(df, [], 0.01), [], {"q": 0.75}, 0.01).first()
    merged = sketches(df, ["g"], 0.01).groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    assert quantiles(merged, [], {"q": 0.75}, 0.01).first() == whole and whole.rows == 3000
    assert whole.q == pytest.approx(np.quantile([x for _, _, x in v], 0.75, method="inverted_cdf"), rel=0.011)


def test_chi_square_test():
    """The share of a squared length in some directions, against simulated chi-square variables."""
    rng = np.random.default_rng(3)
    for dims, width in ((8, 65), (32, 65), (1, 3)):
        a, b = rng.chisquare(dims, 200_000), rng.chisquare(width - dims, 200_000)
        share = a / (a + b)
        for q in (0.1, 0.3, 0.6):
            assert odds_within(np.array(q), dims, width) == pytest.approx((share <= q).mean(), abs=0.006)
        assert (share <= stopping_share(dims, width, 0.95)).mean() == pytest.approx(0.95, abs=0.005)


def test_few_points_are_verified(spark):
    """20,000 vectors without structure: at least 0.9 of the nearest are found by verifying less than a fifth."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    got, verified = {}, {}
    for r in vector_search(df, lambda i: i % 200 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.verified / r.indexed
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -9
        hit += len(found & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 100 and hit / 2000 >= 0.9
    assert sum(verified.values()) / 100 < 0.2


VECTORS = "vec_id long, embedding array<float>, label int"


def search(rows, k, every):
    """Brute force over rows that take part."""
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16:
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            out[q] = sorted(((-float((v * x).sum()), i) for i, x in ok.items() if i != q))[:k]
    return out


def vectors(n=400):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((8, 16))
    rows = [(i, (centre[i % 8] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 0) for i in range(60)]  # one vector many times
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, [1.0, 2.0], 0), (2005, [float("inf")] + [0.0] * 15, 0), (None, [1.0] * 16, 0), (2006, [], 0)]
    return rows + [rows[0], rows[20]]


def test_vector_search(spark):
    rows = vectors()
    got = {}
    for r in vector_search(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = search(rows, 20, 20)
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, 21)) and q not in {x[1] for x in g}
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
        hit += len({x[1] for x in g} & {i for _, i in w})
    assert hit / sum(map(len, want.values())) > 0.9
    # among the copies of one vector the smallest ids are found, without the query itself
    copies = [i for _, i, _ in sorted(got[400]) if i == 3 or 400 <= i < 460]
    assert copies == [3, *range(401, 460)][: len(copies)]


def test_vector_search_over_leaves(spark, monkeypatch):
    from tessera.llm import vector_search as module

    monkeypatch.setattr(module, "LEAF", 40)
    rows = vectors()
    got = {}
    for r in vector_search(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0, k=20, sure=0.99).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = search(rows, 20, 20)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values())) > 0.95


def test_vector_search_small(spark):
    assert vector_search(spark.createDataFrame([], VECTORS), lambda i: i % 20 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (7, [2.0, 1.0], 0)], VECTORS)
    assert [tuple(r) for r in vector_search(two, lambda i: i % 20 == 0).collect()] == [(0, 1, 7, 4.0, 2, 2)]


def day(s):
    return datetime.date.fromisoformat(s)


def test_list_as_of_fetch(spark):
    entries = spark.createDataFrame(
        [("bad.com", day("2024-01-10"), "block"), ("bad.com", day("2024-03-01"), "drop"), ("ok.bad.com", day("2024-01-15"), "allow"), ("t.org", day("2024-02-01"), "allow"), ("t.org", day("2024-02-01"), "block"), (None, day("2024-01-01"), "block"), ("late.net", None, "block")],
        "key string, listed date, action string",
    )
    urls = [
        (1, "http://bad.com/x", "2024-01-09", True), (2, "https://user@WWW.BAD.com:80/x", "2024-01-10", False), (3, "http://ok.bad.com", "2024-01-14", False), (4, "http://ok.bad.com?q", "2024-01-15", True),
        (5, "http://a.ok.bad.com/", "2024-02-29", True), (6, "http://bad.com/", "2024-03-01", True), (7, "http://t.org", "2024-12-31", False), (8, "http://nott.org", "2024-12-31", True),
        (9, None, "2024-02-01", True), (10, "mailto:x", "2024-02-01", True), (11, "http://bad.com", None, True), (12, "http://late.net", "2024-05-05", True), (1, "http://bad.com/x", "2024-01-09", True),
    ]
    caps = spark.createDataFrame([(i, u, d and day(d), "clash", "x") for i, u, d, _ in urls], "id long, url string, fetched date, host string, key string")
    got = sorted((r.id, r.kept) for r in url_filter(caps, entries).collect())
    assert got == sorted((i, k) for i, _, _, k in urls)
    assert url_filter(caps, entries.limit(0)).where("not kept").isEmpty()
    assert url_filter(caps.limit(0), entries).isEmpty()
    assert caps.where("id = 2").select(host_of(F.col("url")).alias("h")).first().h == "www.bad.com"


def test_large_leaves_and_many_queries(spark, monkeypatch):
    """Leaves beyond what the sample can split are dealt into parts, and queries of a part into groups."""
    from tessera.llm import vector_search as module

    monkeypatch.setattr(module, "LEAF", 20)
    monkeypatch.setattr(module, "ASKED", 3)
    monkeypatch.setattr(module, "SAMPLE_ROWS", 24)
    rows = vectors()
    got = {}
    for r in vector_search(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0, k=20, sure=0.99).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = search(rows, 20, 20)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values())) > 0.95


def test_clashing_capture_columns(spark):
    entries = spark.createDataFrame([("bad.com", day("2024-01-10"), "block")], "key string, listed date, action string")
    names = ["action", "day", "h", "row", "salt", "v", "bucket", "cut", "until", "listed"]
    caps = spark.createDataFrame([(1, "http://bad.com/", day("2024-02-01"), *names), (2, "http://bad.com/", day("2024-01-01"), *names)], "id long, url string, fetched date, " + ", ".join(f"{n} string" for n in names))
    got = sorted(url_filter(caps, entries).collect())
    assert [(r.id, r.kept) for r in got] == [(1, False), (2, True)] and all(r[n] == n for r in got for n in names)
