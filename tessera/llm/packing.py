"""Packing along a space-filling curve: hashed token vectors, projected to few dimensions, in Hilbert order."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import cut, parts_for
from tessera.llm.spans import U64, chunks, mix64

FEATURES, DIMS, BITS = 512, 4, 12


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None, ordinary: bool = False):
    """texts -> lists of ids, as the JSON's tokenizer gives them: the string of an added token becomes its id.

    ``ordinary``: such strings are text like any other.  With the same vocabulary as ranks, texts without such a string go
    through the faster library; ids are the same.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = ordinary
    slow.no_truncation(), slow.no_padding()
    if ranks_path is None:
        return lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    import tiktoken
    from public_tokenizers import PATTERN

    added = [] if ordinary else [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [slow.encode(t, add_special_tokens=False).ids if any(x in t for x in added) else fast.encode_ordinary(t) for t in texts]


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((FEATURES, DIMS))


def projected(ids: list[np.ndarray]) -> np.ndarray:
    """Each document's hashed vector (log counts, unit length) in ``DIMS`` random directions; coordinates in 0 .. 2**BITS - 1."""
    counts = np.stack([np.bincount((mix64(x.astype(U64)) >> U64(55)).astype(np.int64), minlength=FEATURES) for x in ids])
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    p = 1 / (1 + np.exp(-1.702 * (v @ _projection())))
    return np.minimum((p * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of points of n coordinates below 2**bits (Skilling's transform, all points at once)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenise(json_path: str, ranks_path: str | None, end: int, ordinary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path, ordinary)
        for (ids,), texts in chunks(batches, ["doc_id"], "text"):
            own = [np.array([*t, end], dtype=np.uint32) for t in encode([t.decode("utf-8", "replace") for t in texts])]
            key = hilbert(projected(own))
            narrow = "<u2" if max(int(x.max()) for x in own) < 1 << 16 else "<u4"
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(key), pa.array([len(x) for x in own], pa.int64()), pa.array([int(narrow[-1])] * len(own), pa.int32()), pa.array([x.astype(narrow).tobytes() for x in own], pa.binary())],
                names=["doc_id", "curve", "n", "width", "ids"],
            )

    return run


def _pieces(length: int, total: int):
    full = total // length
    # what is left at the end makes sequences of powers of two, which need no padding
    starts, at = [], full * length
    for b in range(length.bit_length() - 1, -1, -1):
        if (total - full * length) >> b & 1:
            starts.append(at)
            at += 1 << b
    tail = np.array(starts, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, width, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "width", "ids"))):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                n = len(ids)
                cuts = np.arange((at // length + 1) * length, min(at + n, full * length + 1), length)
                cuts = np.concatenate(([at], cuts[cuts < at + n], tail[(tail > max(at, full * length)) & (tail < at + n)], [at + n]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if a < full * length:
                        seq, off = divmod(a, length)
                    else:
                        i = int(np.searchsorted(tail, a, side="right")) - 1
                        seq, off = full + i, a - int(tail[i])
                    for o, x in zip(out, (doc, a - at, b - a, n, seq, off, ids[a - at : b - at].tobytes())):
                        o.append(x)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, *, length: int = 2048, end: int = 1, ordinary: bool = False) -> DataFrame:
    """Sequences of at most ``length`` tokens, cut from all documents laid end to end along a Hilbert curve.

    A document is its token ids (``encoder``) and then ``end``.  Its hashed vector is projected to 4 dimensions; documents are range-sorted by
    Hilbert key (ties by doc_id), so neighbours on the curve share sequences.  Positions come from running sums
    per range partition plus the sums of the partitions before.  All sequences are full but those at the very end, whose
    lengths are powers of two: nothing is padded.  One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit).

    Null or empty text: the one id ``end``.  Repeated rows and null doc_ids: packed each.  Ids are integers.  Very long texts span many sequences.
    Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_tokenise(json_path, ranks_path, end, ordinary), "doc_id long, curve long, n long, width int, ids binary")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    total = int(size["n"] or 0)
    # each range holds whole rows of a few numbers; keys that many documents share are told apart by doc_id and row
    parts = parts_for(spark, size["rows"] * 40, 64 << 20)
    order = ["curve", "doc_id", "row"]
    small = cut(rows.select(*order, "n").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = small.groupBy("part").agg(F.sum("n").alias("in_part")).withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).select("part", "before")
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    # one row a range partition, so the size of this broadcast is known
    at = small.withColumn("within", within).join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("within")).alias("at"))
    return rows.join(at, "row").select("doc_id", "at", "width", "ids").mapInArrow(_pieces(length, total), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
