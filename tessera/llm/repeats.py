"""Exact repeated spans across documents, shared by the word, line and byte forms of removal.

A unit (word, line or byte) is removed where it is covered by a window of L consecutive units whose content also starts
in a document with a smaller doc_id.  Both forms run the same five steps:

1. *Anchors.*  Winnowing over k-unit grams with window L - k + 1 selects at least one gram in every L-window, by the
   window's content alone.  Each window has one owner, its least gram (the leftmost of equals), so equal windows have
   equal owners at the same offset, and a gram's context is the text of the windows that it owns.  An anchor travels as
   (gram hash, context hash).  Before the shuffle each task collapses equal (gram, context) pairs: later documents are
   settled there, one row for the first document goes on.
2. *Join on anchors.*  Rows are dealt by gram.  A document whose context equals that of a smaller document is settled
   at once (all windows that the anchor owns repeat).  First documents of grams with two or more different contexts
   remain open.
3. *Contexts.*  Open anchors meet their text again and send their context to the gram's partition.
4. *Extension.*  The ``resolve`` function of the form finds every L-window of those contexts that an earlier document
   has too.
5. *Cover.*  Settled and extended spans are united per document and cut from the text.

Nothing is sampled or capped.  A hot gram (a passage in a third of all documents) costs one row per task and distinct
context, not one per document.  If a task meets a gram in more than ``split`` different contexts, it deals those rows by gram
and context instead, over all partitions, and tells the gram's own partition with one row; all contexts of such a gram
are then compared window by window, dealt by the hash of the window.

A form may also have units of their own (``more``): spans shorter than a window that repeat as a whole or not at all.  They
travel as anchors whose context is the span itself, so step 2 settles them and they are never open or hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import cut, parts_for, text_bytes
from tessera.llm.spans import U64, SpanHash, Words, chunks, mix64, owned, winnowed

ANSWERS = "bucket int, open boolean, blob binary"
#: Anchors that a task gathers before it deals them out; more where there are many partitions, so that each gets rows enough.
FLUSH, MOST_FLUSH = 600_000, 12_000_000
#: Text that makes a bucket of grams, and the most partitions: beyond them a partition has several buckets, one after another.
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
#: Marks the left size of an anchor whose gram is split, and the size of an open context of one.
HOT, HOT_SPAN = 1 << 7, 1 << 31


@dataclass(frozen=True)
class Form:
    """What differs between words and bytes."""

    window: int  # L
    gram: int  # k
    units: type[Words] | None  # None: bytes
    #: (gram hash, document order, context rows) -> (row, first unit of a repeated window within the context)
    resolve: Callable
    #: Different contexts of one gram in one task from which on the gram is split over partitions.
    split: int = 64
    #: words -> (first unit, units) of spans shorter than the window that count as repeated by themselves.
    more: Callable | None = None

    @property
    def by_word(self) -> bool:
        return self.units is not None

    @property
    def reach(self) -> int:
        return self.window - self.gram


# ---------------------------------------------------------------- step 1


def _anchors_of(form: Form, texts: list[bytes]):
    """Of a chunk: text index, position in the text, gram hash, context hash, units of the context before the anchor and from it on."""
    L, k = form.window, form.gram
    if form.by_word:
        words = form.units(texts)
        n, of, first, total = words.n, words.text_of, words.first[:-1], len(words.start)
        data = words.data
    else:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        first, total = np.concatenate(([0], np.cumsum(n)))[:-1], len(data)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    none = np.zeros(0, dtype=np.int64)
    extra = _shorter(form, words) if form.more else (none, none, none.astype(U64), none.astype(U64), none, none)
    if total < L:
        return extra
    h = SpanHash(data)
    if form.by_word:
        g = h.of(words.start[: total - k + 1], words.end[k - 1 :])
    else:
        g = h.width(k)
    ok = np.zeros(len(g), dtype=bool)
    ok[: total - L + 1] = of[: total - L + 1] == of[L - 1 :]
    at = winnowed(g, ok, L - k + 1)
    t = of[at]
    before, after = owned(g, at, L - k + 1)
    lo = np.maximum(first[t], at - before)
    hi = np.minimum(first[t] + n[t], at + after + k)
    mine = hi - lo >= L  # else equal grams further left own all its windows
    t, at, lo, hi = t[mine], at[mine], lo[mine], hi[mine]
    left = at - lo
    if form.by_word:
        c = h.of(words.start[lo], words.end[hi - 1])
    else:
        c = h.of(lo, hi)
    own = t, at - first[t], g[at], mix64(c + left.astype(U64) * U64(0x9E3779B97F4A7C15)), left, hi - at
    return tuple(np.concatenate(x) for x in zip(own, extra)) if len(extra[0]) else own


def _shorter(form: Form, words: Words):
    """The form's own spans as anchors: two independent hashes of the whole span, nothing before it."""
    at, n = form.more(words)
    to = words.end[at + n - 1]
    g = mix64(SpanHash(words.data).of(words.start[at], to) ^ U64(0xA0761D6478BD642F))  # not the hash of an anchor of as many units
    t = words.text_of[at]
    return t, at - words.first[t], g, SpanHash(words.data, 1).of(words.start[at], to), np.zeros(len(at), dtype=np.int64), n


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], dtype=np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, dtype=np.int64, count=len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(blob, dtype=t, count=int(n), offset=at))
        at += int(n) * np.dtype(t).itemsize
    return out


def _planes(a: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each value, first bytes first: high bytes are then runs that the shuffle compresses."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _from_planes(b: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), dtype=np.uint8)
    out[:, :width] = b.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


#: Bytes of a gram that travel, besides the bits that its partition stands for.
_GRAM = 5
_ROW = (np.uint8, np.uint64, *[np.uint8] * 8, np.int64, np.int32)


class _Gathered:
    """Anchors of many chunks with the documents they stand in."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.docs = self.rows = 0

    def add(self, g, c, pos, d, left, right, ids, th):
        self.parts.append((g, c, pos.astype(np.int64), d.astype(np.int64) + self.docs, left.astype(np.int64), right.astype(np.int64), ids, th))
        self.docs += len(ids)
        self.rows += len(pos)

    def all(self):
        return [np.concatenate(x) for x in zip(*self.parts)]


def _grouped(g: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by gram (its low ``bits`` bits count) that mostly puts equal contexts together, and where a new (gram, context) starts.

    One sort on gram and the context's first bits: different contexts with equal first bits may alternate, which splits
    a group but never joins two; a split group is extended like different contexts.
    """
    o = np.argsort((g << U64(64 - bits)) | (c >> U64(bits)))
    new = np.ones(len(o), dtype=bool)
    new[1:] = (g[o][1:] != g[o][:-1]) | (c[o][1:] != c[o][:-1])
    return o, new


def _anchor_rows(form: Form, buckets: int):
    enough = max(FLUSH, min(128 * buckets, MOST_FLUSH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered()

        def flush():
            g, c, pos, d, left, right, ids, th = held.all()
            o, new = _grouped(g, c, 40)
            least = np.minimum.reduceat(ids[d[o]], np.flatnonzero(new))[np.cumsum(new) - 1]
            known = np.zeros(len(g), dtype=bool)
            known[o] = ids[d[o]] > least
            # grams in too many contexts: their first documents' rows are dealt by context, and one of them to the gram's partition too
            first = np.ones(len(o), dtype=bool)
            first[1:] = g[o][1:] != g[o][:-1]
            gram = np.cumsum(first) - 1
            many = np.zeros(len(g), dtype=bool)
            many[o] = (np.bincount(gram, weights=new) > form.split)[gram]
            many &= ~known & (left + right >= form.window)
            spread = np.where(many, mix64(g ^ (c >> U64(1))), g)
            if many.any():
                told = np.flatnonzero(many)
                told = told[np.unique(g[told], return_index=True)[1]]
                rows_at = np.concatenate((np.arange(len(g)), told))
                spread = np.concatenate((spread, g[told]))
                left = left + HOT * many
                g, c, pos, d, left, right, known = (x[rows_at] for x in (g, c, pos, d, left, right, known))
            bucket = np.where(known, mix64(d) % U64(buckets), spread % U64(buckets)).astype(np.int64)
            o = np.argsort((bucket << 1) | known, kind="stable")  # rows came by document and position, but for the few told twice
            edges = np.flatnonzero(np.diff(bucket[o], prepend=-1))
            out_b, out = [], []
            for lo, hi in zip(edges, np.append(edges[1:], len(o))):
                r = o[lo:hi]
                own, at = np.unique(d[r], return_inverse=True)
                k = known[r]
                rows, told = r[~k], r[k]
                out_b.append(int(bucket[r[0]]))
                spans = [x for r in (rows, told) for x in (_planes(pos[r], 4), left[r].astype(np.uint8), right[r].astype(np.uint8))]
                out.append(_pack(_planes(g[rows] // U64(buckets), _GRAM), c[rows], *spans[:3], _planes(at[~k], 4), *spans[3:], _planes(at[k], 4), ids[own], th[own].astype(np.int32)))
            yield pa.record_batch([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

        for (ids, th), texts in chunks(batches, ["doc_id", "th"], "text", 1 << 19):
            t, pos, g, c, left, right = _anchors_of(form, texts)
            if len(g):
                held.add(g, c, pos, t, left, right, np.array(ids, dtype=np.int64), np.array(th, dtype=np.int64))
            if held.rows >= enough:
                yield from flush()
                held = _Gathered()
        if held.rows:
            yield from flush()

    return run


# ---------------------------------------------------------------- step 2


def _answers(d, lo, hi, ids, th, is_open: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """(start, end) pairs, touching ones joined, dealt by document: one blob for each partition of documents."""
    if not len(d):
        return
    o = np.lexsort((lo, d))
    d, lo, hi = d[o], lo[o].astype(np.int64), hi[o].astype(np.int64)
    if not is_open:
        # each document's numbers lie above those of the one before
        base = np.cumsum(np.concatenate(([0], d[1:] != d[:-1]))) * (int(hi.max()) + 1)
        reach = np.maximum.accumulate(base + hi)
        new = np.ones(len(d), dtype=bool)
        new[1:] = (base + lo)[1:] > reach[:-1]
        at = np.flatnonzero(new)
        hi = (reach - base)[np.append(at[1:], len(d)) - 1]
        d, lo = d[at], lo[at]
    bucket = (mix64(ids[d].astype(U64) ^ (th[d].astype(np.int64).astype(U64) << U64(17))) % U64(buckets)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    bucket, d, lo, hi = bucket[o], d[o], lo[o], hi[o]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = []
    for x, y in zip(edges, np.append(edges[1:], len(d))):
        first = np.flatnonzero(np.diff(d[x:y], prepend=-1)) + x
        own = d[first]
        blobs.append(_pack(ids[own], th[own].astype(np.int32), np.diff(np.append(first, y)).astype(np.uint32), lo[x:y].astype(np.uint32), (hi - lo)[x:y].astype(np.uint32)))
    yield pa.record_batch([pa.array(bucket[edges].astype(np.int32)), pa.array([is_open] * len(blobs)), pa.array(blobs, pa.binary())], names=["bucket", "open", "blob"])


def _each_bucket(run: Callable) -> Callable:
    """``run`` (rows of one bucket, as tuples -> batches) for each bucket of a partition whose rows come sorted by bucket."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and held:
                    yield from run(held)
                    held = []
                at = bucket
                held.append(row)
        if held:
            yield from run(held)

    return every


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (bucket, ...) with each bucket in one partition, its rows together."""
    parts = min(buckets, MOST_PARTS)
    dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)))
    return dealt if parts == buckets else dealt.sortWithinPartitions("bucket")


def _by_document(rows: list[list]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its (start, end) pairs."""
    parts = [_unpack(b, np.int64, np.int32, np.uint32, np.uint32, np.uint32) for (b,) in rows]
    ids, th, n, lo, size = (np.concatenate(x) for x in zip(*parts))
    own = np.repeat(np.arange(len(ids)), n)
    o = np.lexsort((lo, th[own], ids[own]))
    pairs = np.stack([lo[o], lo[o] + size[o]], axis=1).astype("<u4")
    i, t = ids[own[o]], th[own[o]]
    first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]))))
    yield pa.record_batch([pa.array(i[first]), pa.array(t[first]), pa.array([pairs[x:y].tobytes() for x, y in zip(first, np.append(first[1:], len(o)))], pa.binary())], names=["doc_id", "th", "spans"])


def _join_anchors(form: Form, buckets: int):
    def run(blobs: list[list]) -> Iterator[pa.RecordBatch]:
        held, known = _Gathered(), _Gathered()
        blobs.reverse()
        while blobs:  # each is let go before the next is unpacked
            g, c, pos, left, right, d, pos_k, left_k, right_k, d_k, ids, th = _unpack(blobs.pop()[0], *_ROW)
            c, ids, th = c.copy(), ids.copy(), th.copy()
            none = np.zeros(0, dtype=U64)
            if len(c):
                held.add(_from_planes(g, _GRAM), c, _from_planes(pos, 4), _from_planes(d, 4), left, right, ids, th)
            if len(left_k):
                known.add(none, none, _from_planes(pos_k, 4), _from_planes(d_k, 4), left_k, right_k, ids, th)
        if known.docs:
            _, _, pos, d, left, right, ids, th = known.all()
            left &= HOT - 1
            yield from _answers(d, pos - left, pos + right, ids, th, False, buckets)
        if not held.rows:
            return
        g, c, pos, d, left, right, ids, th = held.all()
        o, new = _grouped(g, c, 8 * _GRAM)
        g, pos, d, left, right = g[o], pos[o], d[o], left[o], right[o]
        doc = ids[d]
        starts = np.flatnonzero(new)
        settled = doc > np.minimum.reduceat(doc, starts)[np.cumsum(new) - 1]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        gram = np.flatnonzero(first)
        hot = left >= HOT
        left = left & (HOT - 1)
        hot = np.logical_or.reduceat(hot, gram)[np.cumsum(first) - 1]
        several = (np.add.reduceat(new.astype(np.int64), gram) > 1) & (np.maximum.reduceat(doc, gram) > np.minimum.reduceat(doc, gram))
        yield from _answers(d[settled], (pos - left)[settled], (pos + right)[settled], ids, th, False, buckets)
        wide = (several[np.cumsum(first) - 1] | hot) & ~settled & (left + right >= form.window)
        # an open anchor's end also tells where in its context it stands, and whether its gram is split
        yield from _answers(d[wide], (pos - left)[wide], (pos + right + (left << 16) + HOT_SPAN * hot)[wide], ids, th, True, buckets)

    return _each_bucket(run)


# ---------------------------------------------------------------- steps 3 and 4


def _pairs(spans: bytes) -> np.ndarray:
    return np.frombuffer(spans, dtype="<u4").reshape(-1, 2).astype(np.int64)


def _contexts(form: Form, buckets: int):
    """Of open anchors: (gram hash, left units, units, content), dealt by gram."""
    width = form.window + form.reach
    kind = np.uint64 if form.by_word else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, th, spans), texts in chunks(batches, ["doc_id", "th", "spans"], "text"):
            if form.by_word:
                words = form.units(texts)
                first, n, total, data = words.first[:-1], words.n, len(words.start), words.data
                units = SpanHash(data).of(words.start, words.end) if total else np.zeros(0, dtype=U64)
            else:
                units = data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                n = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
                first = np.concatenate(([0], np.cumsum(n)))[:-1]
            told = [np.unique(_pairs(x), axis=0) for x in spans]
            d = np.repeat(np.arange(len(told)), [len(p) for p in told])
            lo, size = np.concatenate(told).T
            size = size - lo
            size &= 0xFFFFFFFF
            hot = size >= HOT_SPAN
            # an anchor may be told twice, once of them as hot
            lo, left = lo + first[d], (size >> 16) & 0x7FFF
            at, hi = lo + left, lo + (size & 0xFFFF)
            h = SpanHash(data)
            if form.by_word:
                g = h.of(words.start[at], words.end[at + form.gram - 1])
            else:
                g = h.of(at, at + form.gram)
            bucket = (g % U64(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            o = o[~hot[o]]
            edges = np.flatnonzero(np.diff(bucket[o], prepend=-1))
            ids_a, th_a = np.array(ids, dtype=np.int64), np.array(th, dtype=np.int32)
            out_b, out = [], []
            for a, b in zip(edges, np.append(edges[1:], len(o))):
                r = o[a:b]
                # units from lo to hi, laid out so that the anchor starts at `reach`
                rows = np.zeros((len(r), width), dtype=kind)
                cols = np.arange(width)[None, :] + (at[r] - form.reach)[:, None]
                inside = (cols >= lo[r][:, None]) & (cols < hi[r][:, None])
                rows[inside] = units[cols[inside]]
                out_b.append(int(bucket[r[0]]))
                out.append(_pack(g[r], ids_a[d[r]], th_a[d[r]], (at - first[d])[r].astype(np.uint32), (at - lo)[r].astype(np.uint8), (hi - at)[r].astype(np.uint8), rows.reshape(-1)))
            yield pa.record_batch([pa.array(out_b, pa.int32()), pa.array([False] * len(out), pa.bool_()), pa.array(out, pa.binary())], names=["bucket", "windows", "blob"])
            if hot.any():
                yield _windows(form, data, words if form.by_word else None, lo[hot], hi[hot], d[hot], first, ids_a, th_a, buckets)

    return run


def _windows(form: Form, data, words, lo, hi, d, first, ids, th, buckets: int) -> pa.RecordBatch:
    """Every window of contexts of split grams, once per document: (hash of 128 bits, document, first unit), dealt by hash."""
    n = hi - lo - form.window + 1
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    d = np.repeat(d, n)
    at, once = np.unique(at, return_index=True)
    d = d[once]
    spans = (words.start[at], words.end[at + form.window - 1]) if form.by_word else (at, at + form.window)
    h, k = SpanHash(data).of(*spans), SpanHash(data, 1).of(*spans)
    bucket = (h % U64(buckets)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[o], prepend=-1))
    cuts = list(zip(edges, np.append(edges[1:], len(o))))
    blobs = [_pack(h[r], k[r], ids[d[r]], th[d[r]], (at - first[d])[r].astype(np.uint32)) for r in (o[a:b] for a, b in cuts)]
    return pa.record_batch([pa.array(bucket[o[edges]].astype(np.int32)), pa.array([True] * len(blobs), pa.bool_()), pa.array(blobs, pa.binary())], names=["bucket", "windows", "blob"])


def _later_windows(form: Form, blobs: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    parts = [_unpack(b, np.uint64, np.uint64, np.int64, np.int32, np.uint32) for b in blobs]
    h, k, ids, th, at = (np.concatenate(x) for x in zip(*parts))
    o = np.lexsort((k, h))
    new = np.concatenate(([True], (h[o][1:] != h[o][:-1]) | (k[o][1:] != k[o][:-1])))
    later = o[ids[o] > np.minimum.reduceat(ids[o], np.flatnonzero(new))[np.cumsum(new) - 1]]
    if len(later):
        own, d = np.unique(np.stack([ids[later], th[later].astype(np.int64)], axis=1), axis=0, return_inverse=True)
        lo = at[later].astype(np.int64)
        yield from _answers(d.reshape(-1), lo, lo + form.window, own[:, 0], own[:, 1].astype(np.int32), False, buckets)


def _extend(form: Form, buckets: int):
    kind = np.uint64 if form.by_word else np.uint8
    width = form.window + form.reach

    def run(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if windows := [b for w, b in rows if w]:
            yield from _later_windows(form, windows, buckets)
        parts = [_unpack(b, np.uint64, np.int64, np.int32, np.uint32, np.uint8, np.uint8, kind) for w, b in rows if not w]
        if not parts:
            return
        g, ids, th, pos, left, right, rows = (np.concatenate(x) for x in zip(*parts))
        row, start = form.resolve(g, ids, left.astype(np.int64), right.astype(np.int64), rows.reshape(-1, width), form)
        if not len(row):
            return
        lo = pos[row].astype(np.int64) - form.reach + start
        key = np.stack([ids, th.astype(np.int64)], axis=1)
        own, d = np.unique(key, axis=0, return_inverse=True)
        yield from _answers(d.reshape(-1)[row], lo, lo + form.window, own[:, 0], own[:, 1].astype(np.int32), False, buckets)

    return _each_bucket(run)


# ---------------------------------------------------------------- all


def with_spans(docs: DataFrame, form: Form) -> DataFrame:
    """docs (doc_id long, text, others) with ``spans``: packed spans of repeated units, null where there are none."""
    if form.reach >= HOT or form.window >= 1 << 8:
        raise ValueError("windows of up to 255 units, with seeds at most 127 shorter")
    keyed = docs.withColumn("th", F.hash("text"))
    nb = parts_for(docs.sparkSession, text_bytes(docs), PART_BYTES)
    of_documents = lambda answers: _dealt(answers, nb).select("bucket", "blob").mapInArrow(_each_bucket(_by_document), "doc_id long, th int, spans binary")
    sent = keyed.where("doc_id is not null and text is not null").select("doc_id", "th", "text").mapInArrow(_anchor_rows(form, nb), "bucket int, blob binary")
    joined = cut(_dealt(sent, nb).mapInArrow(_join_anchors(form, nb), ANSWERS))
    opened = of_documents(joined.where("open"))
    contexts = keyed.join(opened, ["doc_id", "th"]).select("doc_id", "th", "spans", "text").mapInArrow(_contexts(form, nb), "bucket int, windows boolean, blob binary")
    extended = cut(_dealt(contexts, nb).mapInArrow(_extend(form, nb), ANSWERS))
    spans = of_documents(joined.where("not open").unionByName(extended))
    return keyed.join(spans, ["doc_id", "th"], "left").select(*docs.columns, "spans")


def cover(spans: bytes | None, n: int) -> np.ndarray:
    """Which of n units the packed spans cover."""
    if not spans:
        return np.zeros(n, dtype=bool)
    pairs = _pairs(spans)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as (start, end) rows."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
