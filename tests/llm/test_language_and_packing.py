import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import frame, odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.language_id import Ftrl, Model, counted, fit_temperature, grams, language_id
from tessera.llm.packing import encoder, hilbert, pack

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "a  b\n\n c\t\r\n", "l'été <|endoftext|> 12 34", "日本語 テスト 😀", "x y z\x1cq!\x1c?", "it's we'll I'D don't", "\x00\x01", "   lead", "trail   ", "a" * 5000, "?!" * 300]


def own_ids(text: str, ordinary: bool = False) -> list[int]:
    """By the tokenizer as it comes."""
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = ordinary
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ordinary", [False, True])
def test_encoders_are_the_tokenizer(ordinary):
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|"]
    want = [own_ids(t, ordinary) for t in texts]
    assert encoder(JSON, None, ordinary)(texts) == want == encoder(JSON, RANKS, ordinary)(texts)
    assert (own_ids("a <|endoftext|> b") == [64, 220, 50256, 275]) and 50256 not in own_ids("a <|endoftext|> b", True)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_steps_to_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert set(np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).tolist()) == {1}


@pytest.mark.parametrize("length", [16, 2048])
def test_pack_round_trip(spark, length):
    rows = odd_documents() + [(900 + i, t, "en", "a", 1, "x", 1, 1) for i, t in enumerate(TEXTS)]
    out = pack(frame(spark, rows), JSON, RANKS, length=length).select("*", F.crc32("ids").alias("crc")).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(own_ids(r[1] or "") + [1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in out) == total
    by, seq = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        n = r.length
        assert zlib.crc32(bytes(r.ids)) == r.crc and bytes(r.ids) == struct.pack(f"<{n}I", *ids[r.doc_id][0][r.start : r.start + n])
        assert r.doc_tokens == len(ids[r.doc_id][0])
    for d, copies in ids.items():
        starts = sorted((r.start, r.length) for r in by[d])
        assert sum(n for _, n in starts) == sum(map(len, copies))
    full = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0
        full += at == length
    assert full == total // length and sorted(seq) == list(range(len(seq)))


def test_pack_empty(spark):
    assert pack(frame(spark, []), JSON, RANKS).collect() == []
    r = pack(frame(spark, [(None, None, None, None, None, None, None, None)]), JSON, RANKS).collect()
    assert [(x.doc_id, x.length, bytes(x.ids)) for x in r] == [(None, 1, b"\1\0\0\0")]


def test_copies_are_neighbours(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"], 60)) for _ in range(30)]
    rows = [(i, texts[i % 30], "en", "a", 1, "x", 1, 1) for i in range(90)]
    out = pack(frame(spark, rows), JSON, RANKS, length=512).collect()
    at = {r.doc_id: r.sequence_id * 512 + r.offset for r in out if r.start == 0}
    order = sorted(at, key=at.get)
    assert sum(order[i] % 30 == order[i + 1] % 30 for i in range(89)) >= 60


def sentences(rng, letters, n):
    return [" ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(25)) for _ in range(n)]


def test_language_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, ("aa", "bb", "cc")[i % 3], "s", 1, "x", 1, 1) for i, t in enumerate(x for three in zip(sentences(rng, "abcdefg", 150), sentences(rng, "defghij", 150), sentences(rng, "ñáéíghijk", 150)) for x in three)]
    rows += [(5000, None, "aa", "s", 1, "x", 1, 1), (5001, "123 !? \n", "aa", "s", 1, "x", 1, 1), (5002, "", None, None, 1, "x", 1, 1), (5003, "abc abc cab", None, None, 1, "x", 1, 1), (None, "abc", "bb", None, 1, "x", 1, 1), (5004, "abcabc " * 30000, "aa", "s", 1, "x", 1, 1)]
    out = {r.doc_id: r for r in language_id(frame(spark, rows)).collect()}
    lang = {r[0]: r[2] for r in rows}
    held = [(lang[r.doc_id], r.lang_pred) for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    for i in (5000, 5001, 5002):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert out[5003].lang_pred == "aa" and 0 < out[5003].score <= 1 and out[5004].lang_pred == "aa"
    assert len(out) == len({r[0] for r in rows})
    # labels of held-out rows are never looked at
    other = [(*r[:2], "zz" if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], *r[3:]) for r in rows]
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id(frame(spark, other)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in out.items()}


def test_language_id_without_labels(spark):
    out = language_id(frame(spark, [(1, "abc", None, None, None, None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert language_id(frame(spark, [])).collect() == []


def test_features_count_all_grams():
    for text in ("Ab c", "x" * 9000 + " yz"):
        at, n = counted(grams(text))
        assert n.sum() == len(grams(text)) and (np.diff(at) > 0).all()
    assert len(grams("12 .")) == 0


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(4)
    f = Ftrl(2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.unique(np.append(rng.integers(10, 60000, 5), y))
        f.step(at, np.ones(len(at)) / len(at), y)
    w = f.weights(np.arange(60000))
    assert w[0, 0] > 0 > w[0, 1] and (w[10:] != 0).mean() < 0.01


def test_temperature_is_found():
    rng = np.random.default_rng(5)
    z = rng.standard_normal((4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert fit_temperature(z * 4, y) == pytest.approx(4, rel=0.1)


def test_language_id_ties_repeats_and_names(spark):
    """Repeated rows alike; input columns named like the results; of equal scores the first language by code point."""
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "en" if i % 2 else "fr", "a", 1, "x", 1, 1) for i in range(80)]
    df = frame(spark, rows + rows[:5])
    for c in ("held_out", "lang_pred", "score", "carried", "h", "key", "row"):
        df = df.withColumn(c, F.lit("q"))
    got = language_id(df, carry=True).collect()
    assert len(got) == 85 and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got)
    assert all(r.carried.score == "q" and r.carried.doc_id == r.doc_id for r in got)
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 80
    both = [(i, "same text", lang, "a", 1, "x", 1, 1) for i in range(40) for lang in ("de", "en")]
    assert {r.lang_pred for r in language_id(frame(spark, both)).collect()} <= {"de", "en"}
    assert Model(["de", "en"], np.zeros((1 << 16, 2)), np.zeros(2), np.ones(1 << 16), 1.0).predict("abc") == ("de", 0.5)


def test_long_rows_and_rare_languages_are_bounded(spark):
    rows = [(i, "".join(chr(0x4E00 + (i * 997 + j) % 9000) for j in range(3000)), "zh", "a", 1, "x", 1, 1) for i in range(30)]
    rows += [(100 + i, "abc def", "en", "a", 1, "x", 1, 1) for i in range(30)] + [(200, "ghi", "rare", "a", 1, "x", 1, 1)]
    got = {r.doc_id: r.lang_pred for r in language_id(frame(spark, rows), sample_features=64, most_langs=2).collect()}
    assert got[1] == "zh" and got[101] == "en" and "rare" not in got.values()


def plain_features(text: str) -> Counter:
    """The hashed n-grams by one-character steps over Python integers."""
    out, m = "", 1 << 32
    for c in text.lower():
        out += c if c.isalpha() else " " if out and out[-1].isalpha() else ""
    if not any(c.isalpha() for c in out):
        return Counter()
    code = [ord(c) for c in f" {out} "]
    one = [c * 0x9E3779B1 % m for c in code]
    two = [((a ^ (a >> 15)) * 0x85EBCA77 + b) % m for a, b in zip(one, one[1:])]
    three = [((a ^ (a >> 13)) * 0xC2B2AE3D + b) % m for a, b in zip(two, one[2:])]
    return Counter(((h ^ (h >> 16)) * 0x7FEB352D % m) >> 16 for h in [(x + 1) % m for x in one] + two + three)


def plain_model(rows):
    """Learnable rows, languages, TF-IDF vectors as dictionaries, and an empty FTRL state with its weights."""
    learn = [r for r in rows if r[1] is not None and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)]
    df = Counter(f for r in learn for f in plain_features(r[1]))
    idf = defaultdict(lambda: math.log(1 + len(learn)) + 1, {f: math.log((1 + len(learn)) / (1 + n)) + 1 for f, n in df.items()})

    def vector(text):
        x = {f: (1 + math.log(n)) * idf[f] for f, n in plain_features(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / norm for f, v in x.items()}

    langs = sorted({r[2] for r in learn})
    z, n = defaultdict(lambda: [0.0] * len(langs)), defaultdict(lambda: [0.0] * len(langs))

    def weight(f, k):
        if abs(z[f][k]) <= 0.02:
            return 0.0
        return -(z[f][k] - math.copysign(0.02, z[f][k])) / ((1 + math.sqrt(n[f][k])) / 0.5 + 0.02)

    return learn, langs, vector, z, n, weight


def test_language_model_against_plain_python(spark):
    """Features, training steps and predictions, worked out again without arrays."""
    rng = np.random.default_rng(12)
    rows = [(i, t, ("aa", "bb")[i % 2]) for i, t in enumerate(x for two in zip(sentences(rng, "abcdé", 25), sentences(rng, "cdefg", 25)) for x in two)]
    for t in ("", "a", "É1b  c!", "123", "  x", rows[0][1]):
        assert dict(zip(*(x.tolist() for x in counted(grams(t))))) == dict(plain_features(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn, langs, vector, z, n, weight = plain_model(rows)
    keys = {r.doc_id: (r.h, r.held) for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).alias("h"), (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)) == 0).alias("held")).collect()}
    learn.sort(key=lambda r: keys[r[0]][0])
    order = np.random.default_rng(5).permutation(len(learn))
    for _ in range(3):
        for i in order:
            doc, text, lang = learn[i]
            if keys[doc][1]:
                continue
            x = vector(text) | {"bias": 1.0}
            w = {f: [weight(f, k) for k in range(len(langs))] for f in x}
            s = [sum(v * w[f][k] for f, v in x.items()) for k in range(len(langs))]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(len(langs)):
                p = e[k] / sum(e) - (langs[k] == lang)
                for f, v in x.items():
                    g = v * p
                    sigma = (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / 0.5
                    z[f][k] += g - sigma * w[f][k]
                    n[f][k] += g * g
    logit = lambda t: [sum(v * weight(f, k) for f, v in (vector(t) | {"bias": 1.0}).items()) for k in range(len(langs))]
    held = [r for r in learn if keys[r[0]][1]]
    temperature = fit_temperature(np.array([logit(r[1]) for r in held]), np.array([langs.index(r[2]) for r in held]))
    got = {r.doc_id: r for r in language_id(docs).collect()}
    for doc, text, _ in rows:
        s = [v / temperature for v in logit(text)]
        e = [math.exp(v - max(s)) for v in s]
        assert got[doc].lang_pred == langs[int(np.argmax(e))] and got[doc].score == pytest.approx(max(e) / sum(e), abs=1e-6)
