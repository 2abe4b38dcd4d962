"""Fingerprints of text spans, vectorised over many documents at once.

Every span hash is a polynomial prefix hash modulo 2**64 over bytes that went through a fixed random table,
then mixed.  Spans of equal bytes have equal hashes wherever they stand, so documents are concatenated and
all spans of a chunk are hashed with a few array operations.  Two independent hashes give 128 bits where a
decision rests on the hash alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: White space of the word definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLES = tuple(mix64(np.arange(1, 257, dtype=U64) * U64(b)) | U64(1) for b in _BASES)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(n, 1 << 16), _BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 1 << 23:  # a very long document: not kept
            return both[0], both[1]
        have = _powers[which] = (both[0], both[1])
    return have


class SpanHash:
    """Hashes of spans ``[start, end)`` of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _power(which, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(U64))

    def width(self, n: int) -> np.ndarray:
        """Of all spans of n bytes, by start."""
        return mix64((self.prefix[n:] - self.prefix[:-n]) * self.down[: len(self.prefix) - n] + U64(n))


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w consecutive values; the result is w - 1 shorter.  f is np.minimum or np.maximum."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def winnowed(g: np.ndarray, valid_window: np.ndarray, w: int) -> np.ndarray:
    """Where values stand that are the least of one of the valid windows of w values.

    ``valid_window[j]`` tells whether values j to j + w - 1 form a window; equal minima are all taken, so the
    choice depends on the window's content alone.
    """
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = sliding(g, w, np.minimum)
    seen = np.zeros(len(g) + w - 1, dtype=U64)
    seen[w - 1 : w - 1 + n] = np.where(valid_window[:n], least, U64(0))
    most = sliding(seen, w, np.maximum)
    return np.flatnonzero((most == g) & (most > 0))


def owned(g: np.ndarray, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values before each position are greater than its own in a row, and after it not less; w - 1 at most each.

    A window of w values belongs to its leftmost minimum: the windows of a position span just these values.
    """
    steps, mins = [1], [g]
    while steps[-1] * 2 < w:
        mins.append(np.minimum(mins[-1][: -steps[-1]], mins[-1][steps[-1] :]) if len(mins[-1]) > steps[-1] else mins[-1][:0])
        steps.append(steps[-1] * 2)
    own = g[at]
    before, after = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for step, least in zip(steps[::-1], mins[::-1]):
        for _ in range(2 if step == steps[-1] else 1):
            a = at - before - step
            ok = (a >= 0) & (before + step < w)
            ok[ok] = least[a[ok]] > own[ok]
            before[ok] += step
            b = at + after + 1
            ok = (b < len(least)) & (after + step < w)
            ok[ok] = least[b[ok]] >= own[ok]
            after[ok] += step
    return before, after


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column's UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.fill_null(b"")


def chunks(batches: Iterable[pa.RecordBatch], columns: list[str], text: str, limit: int = 1 << 20) -> Iterator[tuple[list[list], list[bytes]]]:
    """Rows in groups of about ``limit`` bytes of text: the other columns' values, and the texts as bytes."""
    held: list[list] = [[] for _ in columns]
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        raw = as_binary(batch.column(text))
        others = [batch.column(c).to_pylist() for c in columns]
        for i in range(len(raw)):
            t = raw[i].as_py()
            if texts and size + len(t) > limit:
                yield held, texts
                held, texts, size = [[] for _ in columns], [], 0
            for h, o in zip(held, others):
                h.append(o[i])
            texts.append(t)
            size += len(t)
    if texts:
        yield held, texts


class Words:
    """The words of many texts: joined by one separator each, with each word's span and each text's first word."""

    separator = 0x20

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        return text.split()

    def __init__(self, texts: list[bytes]):
        parts = [self.parts(t) for t in texts]
        sep = bytes([self.separator])
        self.n = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.data = np.frombuffer(sep.join([sep.join(p) for p in parts if p]), dtype=np.uint8)
        between = np.flatnonzero(self.data == self.separator)
        total = int(self.first[-1])
        self.start = np.zeros(total, dtype=np.int64)
        self.end = np.full(total, len(self.data), dtype=np.int64)
        if total:
            self.start[1:] = between + 1
            self.end[:-1] = between
        self.text_of = np.repeat(np.arange(len(texts)), self.n)

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the first word of each."""
        total = len(self.start)
        if total < k:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.text_of[: total - k + 1] == self.text_of[k - 1 :])
        return SpanHash(self.data, which).of(self.start[at], self.end[at + k - 1]), at


class Lines(Words):
    """Lines with a word, without white space at their ends."""

    separator = 0x0A

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        return [x for line in text.split(b"\n") if (x := line.strip())]
