"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, with a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.spans import as_binary

#: Hashed features of character 1- to 3-grams.
BITS = 16
SIZE = 1 << BITS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams (n = 1, 2, 3) of the lower-cased letters, other runs of characters standing as one space; empty without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, dtype=np.uint16)
    code = np.where(letter, code, np.uint32(0x20))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([np.uint32(0x20)], code[keep], [np.uint32(0x20)])).astype(np.uint32)
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = code * a
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * b + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * c + one[2:]
    out = np.concatenate((one + np.uint32(1), two, three))
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x7FEB352D)
    return (out >> np.uint32(32 - BITS)).astype(np.uint16)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs."""
    if len(h) > 8192:
        n = np.bincount(h, minlength=SIZE)
        at = np.flatnonzero(n)
        return at, n[at]
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    return h[at].astype(np.int64), np.diff(np.append(at, len(h)))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def features(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = counted(h)
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return at, x / norm if norm else x

    def logits(self, h: np.ndarray) -> np.ndarray:
        at, x = self.features(h)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        h = grams(text) if text else np.zeros(0, dtype=np.uint16)
        if not len(h) or not self.langs:
            return "und", 0.0
        z = self.logits(h) / self.temperature
        z -= z.max()
        p = np.exp(z)
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


class Ftrl:
    """Follow the regularised leader, proximal, per coordinate, with elastic-net penalties, for a softmax."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, SIZE), np.append(x, 1.0)  # the last feature is the bias
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[str, bytes, bytes, bool]], idf: np.ndarray, epochs: int = 3) -> Model:
    """From (language, features, counts, whether it calibrates), in an order that is fixed."""
    langs = sorted({r[0] for r in rows})
    model = Model(langs, np.zeros((SIZE, len(langs))), np.zeros(len(langs)), idf, 1.0)
    if not langs:
        return model
    index = {x: i for i, x in enumerate(langs)}
    prepared = []
    for lang, at, n, held in rows:
        at, n = np.frombuffer(at, dtype="<u2").astype(np.int64), np.frombuffer(n, dtype="<u4")
        x = (1 + np.log(n)) * idf[at]
        prepared.append((index[lang], at, x / max(np.sqrt((x * x).sum()), 1e-12), held))
    ftrl = Ftrl(len(langs))
    order = np.random.default_rng(5).permutation(len(prepared))
    for _ in range(epochs):
        for i in order:
            label, at, x, held = prepared[i]
            if not held:
                ftrl.step(at, x, label)
    every = ftrl.weights(np.arange(SIZE + 1))
    model.weights, model.bias = every[:SIZE], every[SIZE]
    logits = np.array([x @ model.weights[at] + model.bias for _, at, x, held in prepared if held])
    labels = np.array([y for y, _, _, held in prepared if held])
    if len(labels):
        model.temperature = fit_temperature(logits, labels)
    return model


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm.

    As in Platt scaling each label keeps 1 / (rows + 2) of doubt, so that rows without an error don't drive it to 0.
    """
    doubt = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        nll = np.log(np.exp(z).sum(axis=1))[:, None] - z
        return float(((1 - doubt) * nll[np.arange(len(labels)), labels] + doubt * nll.mean(axis=1)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(SIZE, dtype=np.int64), 0
    for batch in batches:
        for raw in as_binary(batch.column("text")):
            at, _ = counted(grams(raw.as_py().decode("utf-8", "replace")))
            df[at] += 1
            rows += 1
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, SIZE).astype(np.int32)), pa.array(np.append(df[at], rows))], names=["feature", "df"])


def _sampled(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in as_binary(batch.column("text")):
                at, n = counted(grams(raw.as_py().decode("utf-8", "replace")))
                if len(at) > most:  # the most frequent ones, ties by number
                    own = np.sort(np.lexsort((at, -n))[:most])
                    at, n = at[own], n[own]
                out.append((at.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            yield pa.record_batch(
                [batch.column("lang"), pa.array([a for a, _ in out], pa.binary()), pa.array([n for _, n in out], pa.binary()), batch.column("held"), batch.column("h")],
                names=["lang", "at", "n", "held", "h"],
            )

    return run


def fit(training: DataFrame, *, sample_rows: int = 4000, sample_features: int = 4096, most_langs: int = 100) -> Model:
    """A model of training (text, lang, key): document frequencies count all its rows; the classifier is fitted on ``sample_rows``.

    The sample is bounded, the same share of it for each language as far as there are rows, and chosen by a hash of
    ``key``; a fifth of it sets the temperature.  A sampled row brings its ``sample_features`` most frequent features, 6 bytes
    each, so the driver gets 100 MB at most; the ``most_langs`` most frequent languages (ties by code point) are learned.
    """
    training = training.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    df = np.zeros(SIZE + 1, dtype=np.int64)
    for r in training.select("text").mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():  # SIZE + 1 rows at most
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1
    if not counts:
        return train([], idf)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_rows / len(counts) / n))])
    h = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30))
    sample = training.withColumn("h", h).where(F.col("h") < F.try_element_at(share, F.col("lang")) * (1 << 30)).withColumn("held", F.pmod(F.xxhash64("key", F.lit(4)), F.lit(5)) == 0)
    # repeated keys draw alike, so more rows than wanted may pass; the least hashes stay
    rows = sample.select("text", "lang", "held", "h").mapInArrow(_sampled(sample_features), "lang string, at binary, n binary, held boolean, h long").orderBy("h", "lang", "at", "n").limit(sample_rows).collect()
    rows.sort(key=lambda r: (r["h"], r["lang"], r["at"], r["n"]))
    return train([(r["lang"], r["at"], r["n"], r["held"]) for r in rows], idf)


def _predict(model: Broadcast[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(raw.as_py().decode("utf-8", "replace")) for raw in as_binary(batch.column("text"))]
            rest = batch.drop_columns(["text"])
            yield pa.record_batch([*rest.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*rest.schema.names, "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, *, carry: bool = False, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the calibrated probability) of each row; with ``carry`` the whole row as a struct ``carried``.

    Learns only from text and non-null lang of rows that aren't ``held_out``; predictions see the text alone.  Null text or
    text without letters: ``und`` with score 0.  Ties between languages: the first by code point.  Null doc_id: learned
    from, not held out.  Repeated rows: predicted each.  Very long texts are read whole.  Without a labelled row every text
    is ``und``; an empty table gives none.  Other columns, whatever their names, are ignored or carried.  ``options``: ``fit``.
    """
    learn = docs.where(~held_out()).select("text", "lang", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("key"))
    # SIZE weights a learned language: 50 MB at most
    model = docs.sparkSession.sparkContext.broadcast(fit(learn, **options))
    marked = docs.select("doc_id", "text", held_out().alias("held_out"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] if carry else []))
    out = StructType([f for f in marked.schema.fields if f.name != "text"]).add("lang_pred", "string").add("score", "double")
    return marked.mapInArrow(_predict(model), out)
