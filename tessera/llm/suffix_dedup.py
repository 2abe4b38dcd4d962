"""Byte-level dedup by bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.repeats import Form, cover, runs, with_spans
from tessera.llm.runtime import texts_of
from tessera.llm.spans import as_binary

OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


#: Symbols are 9 bits wide, so that 7 of them make a sort key: bytes, the separator of texts, and one that ends all.
SEP, END, PACKED = 256, 257, 7
#: Common prefixes of so many symbols are known from the sort's second key; from there on intervals are expanded.
START = 2 * PACKED
#: Contexts are transformed in groups of whole grams of about so many symbols.
GROUP = 1 << 20


def bounded_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, and where the first ``START`` symbols differ from the one before.

    Prefix doubling from ``PACKED`` symbols; only suffixes that are not yet told apart are sorted again.  The last symbol
    is ``END`` and occurs once.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(PACKED, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for i in range(PACKED):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key).astype(np.int32)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first_new = None
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0
    done = PACKED
    while done < depth:
        at = np.flatnonzero(new)
        group = np.repeat(at, np.diff(np.append(at, n)))  # rank: where the group starts, so that later splits keep it in place
        rank[order] = group + 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        own = order[tied]
        key = (group[tied] << 32) | rank[np.minimum(own.astype(np.int64) + done, n)]
        o = np.argsort(key)
        order[tied] = own[o]
        key = key[o]
        new[tied[1:]] |= key[1:] != key[:-1]
        done *= 2
        if done == START:
            first_new = new.copy()
    return order, new if first_new is None else first_new


def repeated_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``length`` symbols another suffix shares: (positions, interval number), by interval.

    Breadth-first over intervals of the Burrows-Wheeler transform, by increasing common prefix: the intervals of
    prefixes of q symbols, each extended backwards by every symbol that precedes it, are those of q + 1.  The
    sort's own keys give the intervals of ``START`` symbols to begin with.  An interval of one suffix has no
    longer common prefix and is dropped; texts are never extended over their separators.  The expansion
    stops at ``length``: longer common prefixes are never derived.
    """
    n = len(text)
    order, new = bounded_order(text, length)
    before = text[order - 1]  # the transform
    to = np.empty(n, dtype=np.int32)
    to[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)  # LF: where the suffix one symbol longer stands
    first = text[order]
    where = np.empty(n, dtype=np.int32)
    active, interval = np.arange(n, dtype=np.int32), None
    ends = np.concatenate(([0], np.cumsum(text >= SEP), np.zeros(START, dtype=np.int64)))
    ends[n + 1 :] = ends[n]
    within = (ends[START : START + n] == ends[:n])[order]  # the first symbols hold no separator
    for q in range(START, length + 1):
        if q > START:
            go = before[active] < SEP
            j = to[active[go]]
            where[j] = interval[go]
            active = np.sort(j)
            g, c = where[active], first[active]
            new = np.ones(len(active), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        keep = ~(new & np.append(new[1:], True))
        if q == START:
            keep &= within
        interval = (np.cumsum(new, dtype=np.int32) - 1)[keep]
        active = active[keep]
        if not len(active):
            break
    return order[active], interval


def expand_intervals(g, doc, left, right, rows, form):
    """Windows of contexts that an earlier document's context has too, by interval expansion over all contexts."""
    o = np.argsort(g, kind="stable")
    units = np.cumsum((left + right + 1)[o])
    last = np.append(g[o][1:] != g[o][:-1], True)
    cuts, at = [0], 0
    for i in np.flatnonzero(last):
        if units[i] - at >= GROUP:
            cuts.append(int(i) + 1)
            at = units[i]
    if cuts[-1] < len(o):
        cuts.append(len(o))
    found = [_expand(o[a:b], doc, left, right, rows, form) for a, b in zip(cuts, cuts[1:])]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _expand(own, doc, left, right, rows, form):
    m, width = len(own), rows.shape[1]
    cells = np.full((m, width + 1), SEP, dtype=np.uint16)
    cells[:, :width] = rows[own]
    cols = np.arange(width + 1)[None, :]
    keep = (cols >= (form.reach - left[own])[:, None]) & (cols < (form.reach + right[own])[:, None])
    cells[:, width] = SEP
    keep[:, width] = True
    text = np.append(cells[keep], np.uint16(END))
    row = np.append(np.repeat(own, keep.sum(axis=1)), 0)
    col = np.append(np.broadcast_to(cols, keep.shape)[keep], 0)
    at, interval = repeated_intervals(text, form.window)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    d = doc[row[at]]
    edges = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.repeat(np.minimum.reduceat(d, edges), np.diff(np.append(edges, len(d))))
    later = at[d > least]
    return row[later], col[later]


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, lists = as_binary(batch.column("text")), batch.column("spans").to_pylist()
        n, gone, spans, kept = [], [], [], []
        for i, packed in enumerate(lists):
            t = raw[i].as_py()
            n.append(len(t))
            if not packed:
                gone.append(0), spans.append([]), kept.append(t)
                continue
            mask = cover(packed, len(t))
            gone.append(int(mask.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in runs(mask)])
            kept.append(np.frombuffer(t, dtype=np.uint8)[~mask].tobytes())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, seed: int = 20) -> DataFrame:
    """Removes each byte covered by ``window`` bytes of UTF-8 that also start in a document of smaller doc_id.

    One row per input row: doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes), kept (the other bytes, which
    need not be valid UTF-8).  Null text: empty.  Null doc_id: kept whole and never a source.  Repeated rows
    of one doc_id don't remove each other.  Very long texts: whole.  Ties: of equal windows those in the smallest doc_id stay, all of them.  Ids are
    integers.  Other columns are ignored, an empty table gives none.
    """
    form = Form(window, seed, None, expand_intervals)
    return with_spans(texts_of(docs, doc_id, text), form).mapInArrow(_cut_bytes, OUT)
