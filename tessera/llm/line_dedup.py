"""Line dedup: winnowed line fingerprints, joined by position, extended both ways; later repeated runs go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.repeats import Form, cover, with_spans
from tessera.llm.spans import WHITE, Lines, as_binary
from tessera.llm.substring_dedup import extend_both_ways

OUT = "doc_id long, n_lines long, n_removed long, removed array<int>, kept_text string"


class LongRuns:
    """Runs of fewer than ``run`` lines that hold at least ``least`` words."""

    def __init__(self, run: int, least: int):
        self.run, self.least = run, least

    def __call__(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        white = WHITE[lines.data]
        starts = np.concatenate(([0], np.cumsum(~white & np.concatenate(([True], white[:-1])))))
        upto = np.concatenate(([0], np.cumsum(starts[lines.end] - starts[lines.start])))
        at, n = [], []
        for k in range(1, self.run):
            i = np.arange(max(0, len(lines.start) - k + 1))
            i = i[(lines.text_of[i] == lines.text_of[i + k - 1]) & (upto[i + k] - upto[i] >= self.least)]
            at.append(i)
            n.append(np.full(len(i), k))
        return np.concatenate([np.zeros(0, dtype=np.int64), *at]), np.concatenate([np.zeros(0, dtype=np.int64), *n])


def _later_runs(lines: list[bytes], run: int, least: int | None = None) -> np.ndarray:
    """Lines of this document covered by a run whose lines also start further up in it."""
    mask = np.zeros(len(lines), dtype=bool)
    seen: set[tuple] = set()
    for k in range(run if least is None else 1, run + 1):
        for i in range(len(lines) - k + 1):
            w = tuple(lines[i : i + k])
            if k < run and sum(len(x.split()) for x in w) < least:
                continue
            if w in seen:
                mask[i : i + k] = True
            seen.add(w)
    return mask


def _cut_lines(run: int, least: int | None, carry: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, spans = as_binary(batch.column("text")), batch.column("spans").to_pylist()
            nulls = batch.column("text").is_null().to_pylist()
            n, gone, removed, kept = [], [], [], []
            for i, packed in enumerate(spans):
                t = raw[i].as_py()
                lines = t.split(b"\n")
                at = [j for j, x in enumerate(lines) if x.strip()]
                n.append(len(at))
                mask = cover(packed, len(at))
                if len(at) > (run if least is None else 1):
                    mask |= _later_runs([lines[j].strip() for j in at], run, least)
                drop = {at[j] for j in np.flatnonzero(mask)}
                gone.append(len(drop))
                removed.append(sorted(drop))
                kept.append(None if nulls[i] else t if not drop else b"\n".join([x for j, x in enumerate(lines) if j not in drop]))
            yield pa.record_batch(
                [*([batch.column("carried")] if carry else []), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*(["carried"] if carry else []), "doc_id", "n_lines", "n_removed", "removed", "kept_text"],
            )

    return cut


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", run: int = 3, least: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each line covered by ``run`` consecutive lines whose sequence also starts earlier: in a document of smaller doc_id,
    or further up in the same one.  With ``least``, also each line covered by fewer lines than that which together hold at least
    ``least`` words and start earlier in the same sense.

    Lines are split at \\n and compared without white space at their ends; lines without a word don't count, are passed over
    and stay.  Fingerprints are winnowed hashes of ``run - 1`` lines, of which every run holds a window minimum (``repeats``).
    Runs are judged on the input.  One row per input row: doc_id, n_lines (with a word), n_removed, removed (line numbers from
    0), kept_text (other lines, as they were).

    Null text: no lines, kept_text null.  Null doc_id: compared with itself alone.  Repeated rows of one doc_id don't
    remove each other.  Very long texts: whole; their runs are compared like others.  Ties: of equal runs the first by doc_id, then
    by place, stays.  Ids are integers.  The columns in ``carry`` are handed on as fields of a struct ``carried``, so no name can clash;
    others are ignored.  An empty table gives none.
    """
    form = Form(run, run - 1, Lines, extend_both_ways, more=None if least is None else LongRuns(run, least))
    named = [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")]
    rows = docs.select(*named, *([F.struct(*[F.col(f"`{c}`") for c in carry if c != text]).alias("carried")] if carry else []))
    kind = [f for f in rows.schema.fields if f.name == "carried"]
    out = StructType([*kind, *StructType.fromDDL(OUT).fields])
    return with_spans(rows, form).mapInArrow(_cut_lines(run, least, bool(carry)), out)
