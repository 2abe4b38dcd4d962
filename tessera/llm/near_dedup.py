"""Near-duplicate detection by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 128 values of 16 bits.  The first 48 are indexed: 12 chunks of 4 values.  Two signatures that differ in at
most 23 of these 48 places have a chunk with at most one error (pigeonhole: 12 chunks with two errors each make 24), so
each chunk is looked up with each of its 4 values left out: 48 keys a document, and every pair within that distance meets.
At Jaccard 0.8 a place differs with probability 0.2, so more than 23 of 48 are 5.2 standard deviations away.  All 128
values test the distance of a pair before its full sets are compared; links rest on full sets alone.

Groups of copies need no pairs: equal sets are collapsed first; then each text is compared with one leader only, the one
that heads most of its keys.  Links so found give labels by pointer jumping: equal labels are surely connected.  Only members
of keys that still hold several labels are compared with each other, in blocks of bounded size: first by signature, which
tells the members that have a partner at all, then, these alone, by full sets in place, telling only the links that join
labels.  A pair is judged at the first key that it shares, so its sets travel for that key alone.  No pair within the
distance is skipped, whatever the leaders were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import cut, parts_for
from tessera.llm.spans import U64, SpanHash, Words, chunks, mix64
from tessera.operators.graph import components

PLACES, INDEXED, CHUNK = 128, 48, 4
#: Of 128 places, at Jaccard 0.8: 25.6 differ, with a standard deviation of 4.5; 5 of these more are allowed.
FARTHEST = 48
#: Members of a key, and their shingles, that make a block.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Groups up to this size are compared many at a time.
SMALL = 64

_MUL = mix64(np.arange(1, PLACES + 1, dtype=U64)) | U64(1)
_XOR = mix64(np.arange(1001, PLACES + 1001, dtype=U64))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes, by text and ascending, and each text's count."""
    w = Words([t.lower() for t in texts])
    h, at = w.grams(n)
    of = w.text_of[at]
    short = np.flatnonzero((w.n > 0) & (w.n < n))
    if len(short):
        s = SpanHash(w.data).of(w.start[w.first[short]], w.end[w.first[short + 1] - 1])
        h, of = np.concatenate((h, s)), np.concatenate((of, short))
    o = np.lexsort((h, of))
    h, of = h[o], of[o]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], np.bincount(of[keep], minlength=len(texts))


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row of 16-bit values for each text with a shingle."""
    starts = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(starts), PLACES), dtype=np.uint16)
    for i in range(PLACES if len(starts) else 0):
        least = np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], starts)
        out[:, i] = (mix64(least) >> U64(48)).astype(np.uint16)
    return out


def _both_sums(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a text's set from others, in two halves; 0 for texts without a shingle."""
    some, starts = n > 0, np.cumsum(n) - n
    a, b = np.zeros(len(n), dtype=U64), np.zeros(len(n), dtype=U64)
    if some.any():
        a[some], b[some] = np.add.reduceat(mix64(h), starts[some]), np.add.reduceat(mix64(h ^ _XOR[0]), starts[some])
    return a.view(np.int64), b.view(np.int64)


def _sign(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, rows), texts in chunks(batches, ["doc_id", "row"], "text", 1 << 19):
            h, n = shingle_sets(texts, n_words)
            sig = np.zeros((len(texts), PLACES), dtype="<u2")
            sig[n > 0] = signatures(h, n)
            a, b = _both_sums(h, n)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc_id", "row", "n_shingles", "s1", "s2", "sig"],
            )

    return run


def keys_of(sig: np.ndarray) -> np.ndarray:
    """48 keys of each signature: every chunk with each one of its values left out."""
    s = sig[:, :INDEXED].astype(U64)
    out = np.empty((len(sig), INDEXED), dtype=U64)
    for c in range(INDEXED // CHUNK):
        for e in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + e, dtype=U64)
            for i in range(CHUNK):
                if i != e:
                    key = (key << U64(16)) | s[:, c * CHUNK + i]
            out[:, c * CHUNK + e] = key
    return mix64(out)


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            if not len(rep):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(len(rep), PLACES)
            key = keys_of(sig).reshape(-1)
            who = np.repeat(rep, INDEXED)
            bucket = (key % U64(buckets)).astype(np.int32)
            o = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[o], prepend=-1))
            ends = np.append(edges[1:], len(o))
            yield pa.record_batch([pa.array(bucket[o][edges]), pa.array([key[o[a:b]].tobytes() + who[o[a:b]].tobytes() for a, b in zip(edges, ends)], pa.binary())], names=["bucket", "blob"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of keys that several documents have, with the key's least document."""
    parts = [b for batch in batches for b in batch.column("blob").to_pylist()]
    if not parts:
        return
    key = np.concatenate([np.frombuffer(p, dtype=U64, count=len(p) // 16) for p in parts])
    who = np.concatenate([np.frombuffer(p, dtype=np.int64, offset=len(p) // 2) for p in parts])
    o = np.lexsort((who, key))
    key, who = key[o], who[o]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(starts, len(key)))
    many = np.repeat(size > 1, size)
    head = np.repeat(who[starts], size)
    key, who, head = key[many].view(np.int64), who[many], head[many]
    for a in range(0, len(key), 100_000):
        s = slice(a, a + 100_000)
        yield pa.record_batch([pa.array(key[s]), pa.array(who[s]), pa.array(head[s])], names=["key", "rep", "head"])


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, s1, s2), texts in chunks(batches, ["rep", "s1", "s2"], "text", 1 << 19):
            h, n = shingle_sets(texts, n_words)
            a, b = _both_sums(h, n)
            own = (a == np.array(s1, dtype=np.int64)) & (b == np.array(s2, dtype=np.int64))  # an id may stand for several texts
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch([pa.array(ids, pa.int64()), sets], names=["rep", "shingles"]).filter(pa.array(own))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """Whole groups, many at a time: (keys, rep, comp, side, signatures, group starts and ends).  Rows come sorted by key."""
    names, held = [*keys, "rep", "comp", "side"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        columns.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(-1, PLACES))
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        n = len(columns[0])
        new = np.ones(n, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[: len(keys)]])
        at = np.flatnonzero(new)
        last = at[-1]  # may go on in the next batch
        if last:
            yield [c[:last] for c in columns[: len(keys)]], *[c[:last] for c in columns[len(keys) :]], at[:-1], at[1:]
        held = [c[last:] for c in columns]
    if held is not None:
        yield held[: len(keys)], *held[len(keys) :], np.array([0]), np.array([len(held[0])])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first of the 48 keys that two signatures share."""
    miss = (a[:, :INDEXED] != b[:, :INDEXED]).reshape(len(a), INDEXED // CHUNK, CHUNK)
    chunk = (miss.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * CHUNK + miss[np.arange(len(a)), chunk].argmax(axis=1)


def _partners(key: int, rep, comp, side, sig, one_block: bool) -> np.ndarray:
    """Which members of a block (or of two) have one in another component near enough whose first shared key this is."""
    has, key = np.zeros(len(rep), dtype=bool), np.int64(key).astype(U64)
    for x in range(len(rep) - 1):
        y = np.flatnonzero(comp[x + 1 :] != comp[x]) + x + 1
        if has[x]:
            y = y[~has[y]]
        if not one_block:
            y = y[side[y] != side[x]]
        y = y[(sig[y] != sig[x]).sum(axis=1) <= FARTHEST] if len(y) else y
        if len(y):
            y = y[keys_of(sig[x : x + 1])[0][_first_shared(sig[y], np.broadcast_to(sig[x], (len(y), PLACES)))] == key]
            has[y] = True
            has[x] |= len(y) > 0
    return has


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, i, j): members of a block, or of two, that have a partner by signature."""
    for (key, i, j), rep, comp, side, sig, starts, ends in _groups(batches, ["key", "i", "j"]):
        size, has = ends - starts, np.zeros(len(rep), dtype=bool)
        for n in np.unique(size[(size > 1) & (size <= SMALL)]):  # small groups of one size at once
            at = starts[size == n]
            x, y = np.triu_indices(int(n), 1)
            step = max(1, (1 << 16) // len(x))
            for lo in range(0, len(at), step):
                own = at[lo : lo + step, None]
                u, v = (own + x).reshape(-1), (own + y).reshape(-1)
                fit = (comp[u] != comp[v]) & ((i[u] == j[u]) | (side[u] != side[v]))
                u, v = u[fit], v[fit]
                near = (sig[u] != sig[v]).sum(axis=1) <= FARTHEST
                u, v = u[near], v[near]
                if len(u):
                    mine = keys_of(sig[u])[np.arange(len(u)), _first_shared(sig[u], sig[v])].view(np.int64) == key[u]
                    has[u[mine]] = has[v[mine]] = True
        for a, b in zip(starts[size > SMALL], ends[size > SMALL]):
            has[a:b] = _partners(key[a], rep[a:b], comp[a:b], side[a:b], sig[a:b], i[a] == j[a])
        at = np.flatnonzero(has)
        if len(at):
            yield pa.record_batch([*(pa.array(c[at]) for c in (key, i.astype(np.int32), j.astype(np.int32), rep, comp, side.astype(np.int32))), pa.array([r.tobytes() for r in sig[at]], pa.binary())], names=["key", "i", "j", "rep", "comp", "side", "sig"])


def _settle(percent: int):
    """Links between components within blocks of a key: full sets are compared here, and a link that joins two components is told."""

    def links(key: int, rep, comp, side, sig, sets: list[np.ndarray], one_block: bool) -> list[tuple[int, int]]:
        out, comp = [], comp.copy()
        n = np.array([len(x) for x in sets])
        for x in range(len(rep) - 1):
            y = np.flatnonzero(comp[x + 1 :] != comp[x]) + x + 1
            if not one_block:
                y = y[side[y] != side[x]]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            y = y[(sig[y] != sig[x]).sum(axis=1) <= FARTHEST] if len(y) else y
            if not len(y):
                continue
            y = y[keys_of(sig[x : x + 1])[0][_first_shared(sig[y], np.broadcast_to(sig[x], (len(y), PLACES)))].view(np.int64) == key]
            if not len(y):
                continue
            every = np.concatenate([sets[i] for i in y])
            at = np.minimum(np.searchsorted(sets[x], every), n[x] - 1)
            both = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.cumsum(n[y]) - n[y])
            for i in y[100 * both >= percent * (n[x] + n[y] - both)]:
                if comp[i] != comp[x]:
                    comp[comp == comp[i]] = comp[x]
                    out.append((min(rep[x], rep[i]), max(rep[x], rep[i])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            shingles = batch.column("shingles")
            offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(U64)
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "rep", "comp", "side", "sig")]
            for r, (key, i, j, *row) in enumerate(zip(*columns)):
                if (key, i, j) != at:
                    yield from done(held, at)
                    held, at = [], (key, i, j)
                held.append((*row, values[offsets[r] : offsets[r + 1]].copy()))
        yield from done(held, at)

    def done(held: list[tuple], at) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        rep, comp, side = (np.array([x[c] for x in held], dtype=np.int64) for c in range(3))
        sig = np.frombuffer(b"".join(x[3] for x in held), dtype="<u2").reshape(-1, PLACES)
        found = links(at[0], rep, comp, side, sig, [x[4] for x in held], at[1] == at[2])
        if found:
            yield pa.record_batch([pa.array([int(a) for a, _ in found]), pa.array([int(b) for _, b in found])], names=["a", "b"])

    return run


def _open_members(met: DataFrame, near: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, rep, comp, blocks, sig) of the members of keys that still hold more than one component.

    blocks: so many that each has about BLOCK members and BLOCK_SHINGLES shingles at most.
    """
    member = met.select("key", "rep").join(reps.select("rep", "n_shingles"), "rep").join(near, "rep", "left").select("key", "rep", "n_shingles", F.coalesce("root", "rep").alias("comp"))
    keys = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    return member.drop("n_shingles").join(keys.select("key", blocks.alias("blocks")), "key").join(reps.select("rep", "sig"), "rep")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    na, nb = F.size("sa"), F.size("sb")
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        .where(100 * both >= percent * (na + nb - both))
        .select("a", "b")
    )


def _jumped(parent: DataFrame) -> DataFrame:
    """(rep, root) with each root replaced by its own root, where it has one."""
    above = parent.select(F.col("rep").alias("root"), F.col("root").alias("up"))
    return parent.join(above, "root", "left").select("rep", F.coalesce("up", "root").alias("root"))


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """Groups of near copies: documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets.

    Words are runs of non-white characters after lower-casing A-Z; a set holds the distinct ``shingle``-word runs, or the whole
    sequence if there are fewer words.  One row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links), kept (whether it is that document), group (a number of the component, null without one; it holds
    for this result alone) and, if ``row`` names a column of integers, that column as ``row``.  Ids are integers.

    Null or empty text, or text without words: n_shingles 0, linked with nothing, kept.  Null doc_id: linked with
    nothing, component_id null, kept.  Repeated rows of one document stay repeated, each with the same result; rows of one
    doc_id with different texts are compared like different documents.  Very long texts: whole, as sets of 64-bit hashes.
    Documents of equal sets and pairs just at the threshold are linked.  Other columns are ignored; an empty table gives
    none.  The signature is made for ``percent`` of 80 and more.
    """
    if percent < 80:
        raise ValueError("the signature's distance is made for 80 percent and more")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.col(f"`{row}`") if row else F.lit(None)).cast("long").alias("row"))
    signed = cut(docs.mapInArrow(_sign(shingle), "doc_id long, row long, n_shingles long, s1 long, s2 long, sig binary"))
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # one node for each distinct set; its number is fixed by the written rows
    reps = cut(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).withColumn("rep", F.monotonically_increasing_id()))
    nb = parts_for(spark, reps.count() * INDEXED * 16, 16 << 20)
    met = cut(reps.select("rep", "sig").mapInArrow(_deal(nb), "bucket int, blob binary").repartitionById(nb, F.col("bucket")).select("blob").mapInArrow(_meet, "key long, rep long, head long"))
    wanted = met.select("rep").distinct().join(reps.select("rep", "s1", "s2", F.col("first_doc").alias("doc_id")), "rep")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(wanted, "doc_id").dropDuplicates(["doc_id", "rep", "th"])
    sets = cut(texts.select("rep", "s1", "s2", "text").mapInArrow(_sets(shingle), "rep long, shingles array<long>"))
    headed = met.where("rep <> head").repartition("rep").groupBy("rep", "head").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max(F.struct("n", (-F.col("head")).alias("h"))).alias("x"))
    links = cut(_verified(headed.select((-F.col("x.h")).alias("a"), F.col("rep").alias("b")), sets, percent))
    near = cut(_jumped(_jumped(links.select(F.col("b").alias("rep"), F.col("a").alias("root")))))
    # a row goes to every pair of blocks that its own is in
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    at = _open_members(met, near, reps).withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = at.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", F.col("own").alias("side"), "sig")
    partnered = sided.repartition(nb, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_candidates, "key long, i int, j int, rep long, comp long, side int, sig binary")
    judged = partnered.join(sets, "rep").repartition(nb, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_settle(percent), "a long, b long")
    final = components(near.select(F.col("root").alias("u"), F.col("rep").alias("v")).unionByName(judged.toDF("u", "v")))
    roots = reps.select("s1", "s2", "first_doc", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "first_doc", F.coalesce("root", "rep").alias("group"))
    least = roots.groupBy("group").agg(F.min("first_doc").alias("least"))
    out = signed.drop("sig").join(roots.join(least, "group").select("s1", "s2", "group", "least"), ["s1", "s2"], "left")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(some, F.col("least")).otherwise(F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    names = ["doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(some, F.col("group")).alias("group")]
    return out.select(*names, *(["row"] if row else []))
