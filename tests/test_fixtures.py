"""Micro-fixtures whose values follow from the definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import compare, parse, similarity, text
from tessera.operators import blocking, collective, context, decide, graph, metrics, mining, models


def test_metric(spark):
    pred = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 10), (5, 11)], "s1_uid long, rec_uid long")
    true = spark.createDataFrame([(1, 10), (1, 12), (4, 13), (5, 12)], "s1_uid long, rec_uid long")
    ent = spark.createDataFrame([(1, "a", 2), (2, "a", 0), (3, "a", 0), (4, "b", 1), (5, "b", 1)], "s1_uid long, prof string, n_true long")
    got = {r.s1_uid: round(r.f05, 6) for r in metrics.entity_scores(ent, pred.union(pred), true).collect()}
    assert got == {1: 0.714286, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    rep = {(r.slice, r.value): r.entities for r in metrics.report(metrics.entity_scores(ent, pred, true)).collect()}
    assert rep[("all", "")] == 5 and rep[("prof", "b")] == 2 and rep[("kind", "singleton")] == 2 and rep[("size", "2")] == 1
    loss = metrics.loss_table(metrics.entity_scores(ent, pred, true)).agg(F.sum("macro_loss")).first()[0]
    assert loss == pytest.approx(1 - sum(got.values()) / 5, abs=1e-6)


def test_addition_thresholds():
    want = [0.7273, 0.7586, 0.7711, 0.7778, 0.7820, 0.7848, 0.7869, 0.7885, 0.7897, 0.7907, 0.7915]
    assert [round(decide.addition_threshold(k), 4) for k in range(1, 12)] == want


def test_score_context(spark):
    e = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.4), (2, 10, 0.7), (2, 11, 0.4), (2, 12, 0.1)], "s1_uid long, rec_uid long, s double").repartition(3)
    got = {(r.s1_uid, r.rec_uid): r for r in context.score_context(e, "s", "c").collect()}
    r = got[1, 10]
    assert (r.c_s1_rank, r.c_rec_rank, r.c_s1_other, r.c_rec_comp, r.c_s1_n, r.c_rec_n, r.c_rec_n50, r.c_s1_n50) == (1, 1, 0.4, 0.7, 2, 2, 2, 1)
    assert round(r.c_rec_share, 6) == 0.5625 and round(r.c_s1_share, 6) == 0.692307 and round(r.c_rec_margin, 9) == 0.2
    assert got[1, 11].c_rec_rank == 1 and got[2, 11].c_rec_rank == 2  # the tie goes to the smaller entity
    assert got[2, 12].c_rec_comp == 0.0 and got[2, 12].c_s1_rank == 3


def _one(spark, g, members):
    arr = [{"q": q, "src": s, "rec_uid": i} for i, (q, s) in enumerate(members)]
    return spark.createDataFrame([(1, "p", g, arr)], "s1_uid long, prof string, g double, list array<struct<q:double,src:int,rec_uid:bigint>>")


def test_heuristic_selection(spark):
    picked = lambda g, m: decide.select_heuristic(_one(spark, g, m)).first().picked
    assert picked(0.95, [(0.9, 2), (0.75, 2), (0.74, 2)]) == [0, 1]
    assert picked(0.5, [(0.5, 2)]) == []
    assert picked(0.99, [(0.99, 2)] * 6 + [(0.99, 3)]) == [0, 1, 2, 3, 4, 6]
    assert picked(0.9, []) == []


def test_expected_selection(spark):
    for q, g, want in (([0.9, 0.6], 0.95, [0.05, 0.821186, 0.785405]), ([0.5, 0.2], 0.55, [0.45, 0.498538, 0.391326]), ([0.3], 0.2, [0.8, 0.2])):
        assert decide.expected_f_half(np.array(q), g) == pytest.approx(want, abs=1e-6)
    assert decide.select_expected(_one(spark, 0.95, [(0.9, 2), (0.6, 2)])).first().picked == [0]


@pytest.mark.parametrize("u", [0.0, 0.2])
def test_expected_value_by_enumeration(u):
    p, g = np.array([0.8, 0.5, 0.3, 0.1]), 0.9
    outside = np.array([u**i for i in range(4)]) / np.array([1, 1, 2, 6])
    outside /= outside.sum()
    for k in range(1, 5):
        e = 0.0
        for bits in itertools.product([0, 1], repeat=4):
            w = np.prod([x if b else 1 - x for b, x in zip(bits, p)])
            for m, o in enumerate(outside):
                tp, n = sum(bits[:k]), sum(bits) + m
                e += w * o * (1.25 * tp / (k + 0.25 * n) if tp else 0.0)
        assert decide.expected_f_half(p, g, u, False)[k] == pytest.approx(e)


def test_similarity_kernels():
    assert [round(similarity.jaro_winkler(a, b), 6) for a, b in (("martha", "marhta"), ("dixon", "dicksonx"), ("street", "stret"))] == [0.961111, 0.813333, 0.966667]
    assert similarity.levenshtein_distance("kitten", "sitting") == 3
    assert round(similarity.indel("kitten", "sitting"), 6) == 0.615385
    assert similarity.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert similarity.token_set("", "a") == 0.0 and similarity.partial("bear", "a bear it was") == 1.0


def test_lcs_by_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert similarity.lcs_length(a, b) == t[-1, -1]
        for f in (similarity.indel, similarity.token_sort, similarity.partial, similarity.jaro_winkler):
            assert 0 <= f(a, b) <= 1 and f(a, a) == 1 and f(a, b) == pytest.approx(f(b, a))


def test_partial_is_best_window():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abcd"), n)) for n in sorted(rng.integers(1, 9, 2)))
        windows = {b[max(i, 0) : i + len(a)] for i in range(1 - len(a), len(b))}
        if len(a) == len(b):
            best = max([similarity.indel(a, w) for w in windows] + [similarity.indel(a[max(i, 0) : i + len(b)], b) for i in range(1 - len(b), len(a))])
        else:
            best = max(similarity.indel(a, w) for w in windows)
        assert similarity.partial(a, b) == pytest.approx(best)


def test_skeletons(spark):
    words = ["private", "traders", "phone", "checker", "quality", "45", "", "aaa", "zhong", "x"]
    want = ["prpt", "trtrs", "fn", "kr", "klt", "45"]
    assert [text.skeleton(w) for w in words[:6]] == want
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.skeleton_column(F.col("w")).alias("s"), text.unleet_column(F.col("w")).alias("l"))
    assert all(r.s == text.skeleton(r.w) for r in df.collect())
    for w in ("n0se", "5ervices", "3m", "45", "a1b"):
        assert spark.range(1).select(text.unleet_column(F.lit(w)).alias("l")).first().l == text.unleet(w)


def test_romanised_words_share_skeletons():
    assert text.skeleton(text.romanize_token("टिरेडर्स")) == text.skeleton("tiredars")
    for w, body in (("https://www.ab-c.co.in/", "abc"), ("www.x9.shop", "x9"), ("#tagname", "tagname"), ("#ab", None), ("a b.com", None), ("shop.ab.com", "shopab")):
        assert text.domain_body(w) == body
    assert text.clean("Łódź ÞÓR Ǆ e\u0301") == "lodz thor dz e"
    assert text.romanize("राम 12") == "raam 12" and text.romanize("abc") == "abc"
    assert text.clean("Straße ÉCOLE") == "strasse ecole" and text.tokens("a-b, c.d") == ["a", "b", "c", "d"]
    assert text.join_letters(["s", "a", "s", "dupont", "x", "1", "y", "z"]) == ["sas", "dupont", "x", "1", "yz"]


def test_parsed_fields(spark):
    n = parse.parse_name("M/s Acme & Sons Pvt. Ltd. dba www.acme.co.in", "india")
    assert (n["name_core"], n["legal"], n["is_domain"], n["domain_body"]) == ("acme and sons", "pvt_ltd", True, "acme")
    a = parse.parse_address("H.No. 12-3, 2nd Floor, MG Rd, opp. City Mall, Bengaluru 560001, ph 98450 12345", "india")
    assert (a["nums"], a["pin"], a["phone"], a["landmark"]) == (["12", "3"], "560001", "9845012345", "city mall")
    assert parse.parse_address("null, N/A", "us")["addr_missing"] and parse.parse_address(None)["addr_comps"] == []
    assert parse.parse_address("9 B rue X, 75001 Paris", "france")["bis"]
    df = spark.createDataFrame([(1, "Acme Inc", "1 Main St, 12345", "us", "US", 1)], "uid long, name_raw string, addr_raw string, prof string, country string, src int")
    r = parse.normalize(df).first()
    assert (r.name_core, r.legal, r.addr_latin, r.num_primary) == ("acme", "inc", "1 main street", "1") and r.pin == "12345"


def test_diff_signature():
    found = compare.difference(["acme", "trading", "12", "of"], ["acme", "tradin", "13", "inc"], {"of": 0.5}, 2.0, 1.5, frozenset(), {"inc"})
    out = dict(zip(compare.DIFFERENCE, found))
    assert (out["exact"], out["typo"], out["numchg"], out["miss_generic"], out["extra_legal"]) == (1, 1, 1, 1, 1)
    assert (out["miss_idf"], out["extra_idf"]) == (0.5, 2.0)
    out = dict(zip(compare.DIFFERENCE, compare.difference(["a1", "x", "x"], ["x", "rare"], {"rare": 3.0}, 1.0, 2.0, {"rare"})))
    assert (out["exact"], out["miss_generic"], out["extra_affix"], out["miss_idf"], out["extra_idf"]) == (1, 2, 1, 2.0, 3.0)


def test_pair_features(spark):
    rows = [(1, 1, "US", "Acme Trading Ltd", "12 Main St, 12345"), (2, 2, "US", "Acme Tradin Limited", "12 Main Street, 12345"), (3, 2, "US", "www.acmetrading.com", None), (4, 2, "US", "", "no 7")]
    norm = parse.normalize(spark.createDataFrame([(*r, "us") for r in rows], "uid long, src int, country string, name_raw string, addr_raw string, prof string"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "s1_uid long, rec_uid long")
    name, addr = compare.token_weights(norm, F.array_distinct(F.split("name_core", " "))), compare.token_weights(norm, F.array_distinct("addr_tokens"))
    got = {r.rec_uid: r for r in compare.pair_features(pairs, norm, name, addr).collect()}
    a, b, c = got[2], got[3], got[4]
    assert set(compare.NAMES) < set(a.asDict()) and len(compare.NAMES) == len(set(compare.NAMES))
    assert (a.lg_same, a.nm_first_eq, a.nd_typo, a.nd_exact, a.pin_eq, a.no_hit, a.ad_tset, a.dm_has, a.nm_tok_cov_s) == (1, 1, 1, 1, 1, 1, 1, 0, 1)
    idf = {r.tok: r.w for r in name.table.collect()}
    assert a.nm_tok_jacc == pytest.approx(idf["acme"] / (idf["acme"] + idf["trading"] + idf["tradin"]))
    assert (b.dm_has, b.dm_eq, b.dm_pre2, b.dm_ratio, b.lg_s_only, b.ac_mean, b.pin_s_only) == (1, 1, 1, 1, 1, None, 1)
    assert (c.nm_tok_jacc, c.no_hit, c.no_logdiff, c.no_edit) == (None, 0, pytest.approx(np.log1p(5)), 2)
    by = compare.pair_features(pairs.withColumn("pin_eq", F.lit(7)), norm, compare.Weights(), compare.Weights()).where("rec_uid = 2").first()
    assert by.pin_eq == 7 and by.nm_tok_jacc == pytest.approx(1 / 3)


def test_mined_mappings(spark):
    rows = [(i, "india", "Manufactory Rama", "12 A Road, Bangalore", "Mnfy राम", "12 A Road, Bengaluru") for i in range(3)]
    rows += [(9, "india", "Intl Trade House", None, "International Trade House Delhi", None), (10, "india", "Rama", None, "राम", None)]
    pairs = spark.createDataFrame(rows, "s1_uid long, prof string, sn string, sa string, rn string, ra string")
    seen = {(r.kind, r.src, r.dst) for r in mining.token_mappings(pairs).collect()}
    assert seen == {("token", "राम", "rama"), ("name", "intl", "international")}
    assert {(r.src, r.dst, r.s1_uid) for r in mining.component_mappings(pairs, parse.EMPTY).collect()} == {("bengaluru", "bangalore", i) for i in range(3)}
    extra = {(r.kind, r.tok): r.is_extra for r in mining.added_tokens(pairs, parse.EMPTY).collect()}
    assert extra["name", "delhi"] and not extra["name", "trade"] and extra["addr", "bengaluru"] and not extra["addr", "road"] and ("addr", "12") not in extra


def test_block_caps(spark):
    keys = [("c", i, 1, 0, "big") for i in range(51)] + [("c", 100 + i, 2, 0, "big") for i in range(3)]
    keys += [("c", i, 1, 0, "fit") for i in range(50)] + [("c", 200 + i, 2, 0, "fit") for i in range(100)]
    keys += [("c", i, 1, 0, "over") for i in range(50)] + [("c", 400 + i, 2, 0, "over") for i in range(101)]
    got = blocking.key_pairs(spark.createDataFrame(keys, "country string, uid long, src int, kt int, key string"))
    assert got.count() == 5000 and got.where("block = 5000").count() == 5000


def test_union_does_not_count_a_kind_twice(spark):
    p = spark.createDataFrame([(1, 2, 3, 8), (1, 2, 3, 4), (1, 2, 0, 6)], "s1_uid long, rec_uid long, kt int, block long")
    r = blocking.key_union(p).first()
    assert (r.key_mask, r.key_block, r.key_n) == (9, 4, 2)


def test_components_of_a_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (3, 2)], "u long, v long").repartition(4)
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_canonical_groups(spark):
    e = spark.createDataFrame([("blr", "bengaluru"), ("bangalore", "bengaluru"), ("blore", "bangalore")], "src string, dst string")
    assert {r.src: r.dst for r in graph.canonical_groups(e).collect()} == {"blr": "bengaluru", "bangalore": "bengaluru", "blore": "bengaluru"}
    assert graph.canonical_groups(e, max_group=3).count() == 0


def test_mining_counts_entities_once(spark):
    rows = [(s, "name", "n") for s in range(25)] * 3 + [(s, "name", "m") for s in range(5)] + [(1, "rare", "x")] * 50
    obs = spark.createDataFrame(rows, "s1_uid long, src string, dst string")
    got = [tuple(r) for r in mining.dominant(obs, keys=[]).collect()]
    assert got == [("name", "n", 25, 25 / 30)]
    forms = spark.createDataFrame([("mnfy", "manufactory", True), ("city", "ccity", False), ("a.", "abcdef", False), ("bnk", "abnormk", False), ("intl", "international", True)], "a string, b string, fits boolean")
    assert forms.where(mining.abbreviates(F.col("a"), F.col("b")) != F.col("fits")).isEmpty()


def test_calibration_and_bags(spark):
    x = [0.0, 0.2, 0.5, 1.0]
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.1, 0.35, 0.75, 2)], "x double")
    got = [r.y for r in df.select(models.interpolated(F.col("x"), x, [0.0, 0.1, 0.4, 0.9]).alias("y")).collect()]
    assert got == pytest.approx([0.0, 0.0, 0.05, 0.25, 0.65, 0.9])
    b = spark.createDataFrame([(0.2, float("nan"), None), (None, None, None)], "a double, b double, c double")
    assert [r.q for r in models.bag_mean(b, ["a", "b", "c"], "q").collect()] == [0.2, None]
    assert round(spark.range(1).select(decide.logit_shift(F.lit(0.5), 0.0)).first()[0], 9) == 0.5
    assert spark.range(1).select(decide.logit_shift(F.lit(0.0), 1.0)).first()[0] == 0.0


def test_auc_matches_built_in(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(s, 2)), int(rng.random() < s)) for s in rng.random(400)]
    df = spark.createDataFrame(rows, "p double, label int")
    assert models.auc(df, "p").first().auc == pytest.approx(models.built_in_auc(df, "p"), abs=1e-9)


def test_dense_topk_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    df = spark.createDataFrame(v, "uid long, vec array<double>")
    x = np.array([b for _, b in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    for block in (1000, 16):
        got = {(r.query, r["rank"]): r.item for r in blocking.dense_topk(df, df, 3, block=block).collect()}
        assert got == {(i, k + 1): int(np.argsort(-s[i], kind="stable")[k]) for i in range(60) for k in range(3)}


def test_consensus_leaves_the_record_out(spark):
    e = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.85, 0), (1, 12, 0.3, 1)], "s1_uid long, rec_uid long, p1 double, num_hit int")
    r = spark.createDataFrame([(10, "ab", "x", "5", ["5"], "p"), (11, "ab", "y", "5", ["5"], ""), (12, "ac", "x", "6", ["6"], "q")], "uid long, name string, addr string, num string, nums array<string>, pin string")
    got = {x.rec_uid: x for x in collective.consensus(e, r, similarity.levenshtein_sim).collect()}
    assert (got[10].cons_n, got[12].cons_n, got[10].cons_name_max, got[12].cons_name_max) == (1, 2, 1.0, 0.5)
    assert (got[10].cons_numhit_rate, got[12].cons_num_agree, got[11].cons_pin_agree, got[12].cons_pin_agree) == (0.0, 0, None, 0)


def test_sparse_topk_in_blocks(spark):
    """Few large or many small blocks, within a group: the same as all inner products."""
    rng = np.random.default_rng(5)
    rows = [(["x", "y"][i % 2], i, int(g), float(w)) for i in range(40) for g, w in zip(rng.choice(30, 6, replace=False), rng.random(6))]
    df = spark.createDataFrame(rows, "country string, uid long, gram long, w double")
    dense = np.zeros((40, 30))
    for _, i, g, w in rows:
        dense[i, g] = w
    s = np.round(dense @ dense.T, 9)
    want = {}
    for i in range(40):
        best = [j for j in sorted(range(40), key=lambda j: (-s[i, j], j)) if j != i and j % 2 == i % 2 and s[i, j] > 0][:3]
        want |= {(i, r + 1): j for r, j in enumerate(best)}
    for grams in (0, 25):
        got = {(r.query, r["rank"]): r.item for r in blocking.sparse_topk(df, df, 3, by=("country",), exclude_self=True, block_grams=grams).collect()}
        assert got == want
    v = spark.createDataFrame([("xy"[i % 2], i, dense[i].tolist()) for i in range(40)], "country string, uid long, vec array<double>")
    assert all(r.query % 2 == r.item % 2 for r in blocking.dense_topk(v, v, 3, by=("country",), block=7).collect())


def test_combined_rows(spark):
    name = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0)], "uid long, gram long, w double")
    addr = spark.createDataFrame([(1, 5, 1.0), (2, 9, 1.0)], "uid long, gram long, w double")
    rows = blocking.combined(name, addr)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1)], "s1_uid long, rec_uid long")
    got = {r.rec_uid: r.n1_cos for r in blocking.row_cosine(pairs, rows, out="n1_cos").collect()}
    assert got == {2: pytest.approx(1 / 1.25), 3: pytest.approx(1 / 1.25**0.5), 1: pytest.approx(1.0)}


def test_expected_selection_in_batches(spark):
    """All entities of a batch at once, under caps, as one by one."""
    rng = np.random.default_rng(8)
    rows = [(i, "p", float(rng.random()), [{"q": float(round(q, 2)), "src": int(s), "rec_uid": int(100 * i + j)} for j, (q, s) in enumerate(zip(np.sort(rng.random(n) * rng.integers(0, 2, n))[::-1], rng.integers(2, 4, n)))]) for i, n in enumerate(rng.integers(0, 9, 80))]
    df = spark.createDataFrame(rows, "s1_uid long, prof string, g double, list array<struct<q:double,src:int,rec_uid:bigint>>")
    got = {r.s1_uid: (r.picked, r.expected) for r in decide.select_expected(df, caps={2: 2, 3: 1}).collect()}
    for i, _, g, members in rows:
        room, can = {2: 2, 3: 1}, []
        for m in members:
            if m["q"] > 0 and room[m["src"]] > 0:
                room[m["src"]] -= 1
                can.append(m)
        e = decide.expected_f_half(np.clip([m["q"] for m in can], 1e-6, 1 - 1e-6), g) if can else np.array([1 - min(max(g, 1e-6), 1.0)])
        k = int(e.argmax())
        assert got[i][0] == [m["rec_uid"] for m in can[:k]] and got[i][1] == pytest.approx(e[k])


def test_entity_sample_keeps_whole_entities(spark):
    e = spark.createDataFrame([(i, 100 * i + j) for i in range(50) for j in range(i % 5 + 1)], "s1_uid long, rec_uid long")
    got = context.entity_sample(e, 40).groupBy("s1_uid").count().collect()
    assert 20 <= sum(r["count"] for r in got) <= 40 and all(r["count"] == r.s1_uid % 5 + 1 for r in got)
