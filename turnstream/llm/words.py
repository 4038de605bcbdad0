"""Words and hashes of words over Arrow batches, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D in the UTF-8 text. Its hash is the sum of
a random number for each byte at its place in the word. The hash of a range of words is made of two blocks
of a power of two words that cover it, and a block's of its halves, mixed at each step. So no pattern of
repeated words makes sums cancel, as it does in polynomials modulo 2**64. The same text gives the same hash
on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SALTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACES = 64  # places of a word with random numbers of their own; those of later places are mixed from them


def _bytes_table(seed: int, lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64), _SALTS[seed]).reshape(PLACES, 256)
    if lower:
        t[:, 65:91] = t[:, 97:123]
    return t.reshape(-1)


_TABLES = {(s, lo): _bytes_table(s, lo) for s in (0, 1) for lo in (False, True)}


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of two hashes in this order."""
    return mix((a ^ (a >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + b, salt)


class Words:
    """The words of some texts that lie behind each other in one buffer.

    start, end: byte ranges of words in ``raw``; first: index of each text's first word, with the
    number of words at the end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = ~_IS_SPACE[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)  # texts touch: a word ends with its text
        cut[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1 : len(raw)]
        ends[:-1] &= ~inside[1:] | cut[1 : len(raw)]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        n = len(self.raw)
        move = np.zeros(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        move[self.start] = np.diff(self.start, prepend=0)
        place = np.arange(n, dtype=move.dtype) - np.cumsum(move, dtype=move.dtype)
        values = _TABLES[seed, lower][((place & (PLACES - 1)) << 8) | self.raw]
        far = np.flatnonzero(place >= PLACES)
        values[far] = mix(values[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), _SALTS[seed])
        c = sums(values)
        return mix(c[self.end] - c[self.start], _SALTS[seed])

    def text(self, i: int, j: int) -> list[bytes]:
        raw = self.raw
        return [raw[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)]

    def ends_of_text(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.first[1:], np.diff(self.first))


class Ranges:
    """Hashes of ranges [i, j) of words: of the two blocks that cover it, and of its length."""

    def __init__(self, word_hashes: np.ndarray, seed: int = 0):
        self.salt, self.blocks = _SALTS[seed], [word_hashes]

    def _block(self, k: int) -> np.ndarray:
        """Hashes of 2**k words from each place on."""
        while len(self.blocks) <= k:
            half, below = 1 << (len(self.blocks) - 1), self.blocks[-1]
            self.blocks.append(joined(below[:-half], below[half:], self.salt) if len(below) > half else below[:0])
        return self.blocks[k]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = np.asarray(i), np.asarray(j)
        n = (j - i).astype(np.uint64)
        size = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
        out = mix(n, self.salt)
        for k in np.unique(size).tolist():
            at = np.flatnonzero((size == k) & (n > 0))
            block = self._block(k)
            out[at] = joined(joined(block[i[at]], block[j[at] - (1 << k)], self.salt), n[at], self.salt)
        return out


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """A batch in pieces of few bytes, so that arrays by byte stay small; one long text is one piece."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    raw, offsets = string_bytes(column)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
