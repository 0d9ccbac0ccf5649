"""Words and shingles of Arrow text columns, as numpy arrays over the bytes of many rows at once.

A class of word bytes is a table of 256 booleans. UTF-8 keeps every byte of a non-ASCII character at
0x80 or above, so classes that hold all of those or none never split a character.
A word's hash is a polynomial over its bytes modulo 2^64, cut out of one running sum for the whole chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once. A longer text is a chunk of its own, whose words are found in pieces of about this size.
CHUNK_BYTES = 1 << 17

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """The 256 booleans that are false in the given inclusive ranges."""
    keep = np.ones(256, dtype=bool)
    for low, high in ranges:
        keep[low : high + 1] = False
    return keep


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters its input (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = mix(np.arange(101, 165, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2^64."""
    if len(_powers.get(base, ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def word_end(data: np.ndarray, at: int, keep: np.ndarray) -> int:
    """The first place from `at` on where no word goes on, or the end."""
    while at < len(data):
        rest = np.flatnonzero(~keep[data[at : at + CHUNK_BYTES]])
        if len(rest):
            return at + int(rest[0])
        at += CHUNK_BYTES
    return len(data)


def _hashes(data: np.ndarray, cuts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some bytes starts, and its hash; no word goes on across a cut."""
    inside = keep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cuts] = inside[cuts]
    last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(data))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


class Words:
    """The words of some rows: hash, row and first byte of each, in order; counts of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        """data: the rows' bytes, one after another; offsets: where each starts, and the end."""
        self.rows = len(offsets) - 1
        found, at, a = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
        while a < len(data):
            b = word_end(data, a + CHUNK_BYTES, keep)
            low, high = np.searchsorted(offsets, [a, b], "left")
            starts, hashes = _hashes(data[a:b], np.unique(offsets[low:high]) - a, keep)
            found.append(hashes)
            at.append(starts + a)
            a = b
        self.hash, self.start = np.concatenate(found), np.concatenate(at)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word shingles, and where each row's begin. A row of fewer words has its whole sequence as one, a row without words none."""
        own = np.where(self.counts >= n, self.counts - n + 1, np.minimum(self.counts, 1))
        begin = np.concatenate(([0], np.cumsum(own)))
        out = np.empty(begin[-1], dtype=U64)
        if len(self.hash) >= n:
            held = self.row[: len(self.row) - n + 1] == self.row[n - 1 :]
            at = np.flatnonzero(held)
            total = np.zeros(len(at), dtype=U64)
            for k in range(n):
                total += self.hash[at + k] * _STEP[k % 64]
            into = begin[self.row[at]] + at - self.begin[self.row[at]]
            out[into] = mix(total)
        for r in np.flatnonzero((self.counts > 0) & (self.counts < n)):
            words = self.hash[self.begin[r] : self.begin[r + 1]]
            out[begin[r]] = mix((words * _STEP[: len(words)]).sum(dtype=U64, keepdims=True) + U64(len(words)))[0]
        return out, begin


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its offsets into them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with CHUNK_BYTES of text at most, or one row: the rows, their bytes, their offsets."""
    size = size or CHUNK_BYTES
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        del data
        pa.default_memory_pool().release_unused()


def signed(x: np.ndarray) -> pa.Array:
    """64-bit words as Spark's BIGINT."""
    return pa.array(x.view(np.int64))
