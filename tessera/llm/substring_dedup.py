"""Substring dedup by seed and extend, over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.repeats import Form, cover, runs, with_spans
from tessera.llm.runtime import texts_of
from tessera.llm.spans import Words, as_binary

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


def _classes(*keys: np.ndarray) -> np.ndarray:
    """A dense number for each distinct tuple."""
    o = np.lexsort(keys)
    new = np.ones(len(o), dtype=bool)
    new[1:] = np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])
    out = np.empty(len(o), dtype=np.int64)
    out[o] = np.cumsum(new) - 1
    return out


def extend_both_ways(g, doc, left, right, rows, form):
    """Windows of contexts that an earlier document's context on the same seed has too.

    The seeds' classes are refined unit by unit, leftwards and rightwards; after l steps left and r steps right, two
    seeds of one left class and one right class agree on l + k + r units.  Each window that holds the seed is such a
    pair with l + r = L - k, so all maximal repeats through the seed are found without comparing all pairs.
    """
    reach, k = form.reach, form.gram
    seed = _classes(g)
    lefts, rights = [seed], [seed]
    for i in range(1, reach + 1):
        lefts.append(_classes(rows[:, reach - i], left >= i, lefts[-1]))
        rights.append(_classes(rows[:, reach + k + i - 1], right >= k + i, rights[-1]))
    row_out, start_out = [], []
    for i in range(reach + 1):
        can = np.flatnonzero((left >= i) & (right >= form.window - i))
        if len(can) < 2:
            continue
        a, b, d = lefts[i][can], rights[reach - i][can], doc[can]
        o = np.lexsort((d, b, a))
        new = np.ones(len(o), dtype=bool)
        new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
        least = d[o][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = can[o[d[o] > least]]
        row_out.append(later)
        start_out.append(np.full(len(later), reach - i))
    if not row_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(row_out), np.concatenate(start_out)


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, lists = as_binary(batch.column("text")), batch.column("spans").to_pylist()
        n, gone, spans, kept = [], [], [], []
        for i, packed in enumerate(lists):
            words = raw[i].as_py().split()
            n.append(len(words))
            if not packed:
                gone.append(0), spans.append([]), kept.append(b" ".join(words))
                continue
            mask = cover(packed, len(words))
            gone.append(int(mask.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in runs(mask)])
            kept.append(b" ".join([w for w, m in zip(words, mask.tolist()) if not m]))
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
        )


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, seed: int = 12) -> DataFrame:
    """Removes each word covered by ``window`` consecutive words that also start in a document of smaller doc_id.

    Seeds are winnowed ``seed``-word grams (``repeats``), extended both ways; windows are judged on the input.  One row per
    input row: doc_id, n_words, n_removed, spans (maximal removed runs, in words), kept_text (kept words joined by one space).

    Null text: no words.  Fewer words than the window: kept as they are.  Null doc_id: kept whole and never a
    source.  Repeated rows of one doc_id don't remove each other.  Very long texts: whole.  Ties: of equal windows those in the smallest doc_id stay, all of them.  Ids are
    integers.  Other columns are ignored, an empty table gives none.
    """
    form = Form(window, seed, Words, extend_both_ways)
    return with_spans(texts_of(docs, doc_id, text), form).mapInArrow(_cut_words, OUT)
