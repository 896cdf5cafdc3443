"""Tokens of whole Arrow batches as numpy arrays.

Texts arrive as UTF-8 bytes (``binary``), so a batch is one byte buffer and its offsets.  Byte
tables sort bytes into classes; a token is the longest run of one class other than 0.  Every token
gets a 64-bit hash of its bytes, ASCII letters in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = pow(int(_BASE), -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(*ranges: tuple[int, int, int]) -> np.ndarray:
    """A table of classes from (first byte, last byte, class); other bytes have class 0."""
    table = np.zeros(256, np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


#: Anything but ASCII blanks: ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = byte_classes((0, 255, 1), (9, 13, 0), (32, 32, 0))
#: ASCII letters and digits, and every character beyond ASCII.
ALPHANUMERIC = byte_classes((48, 57, 1), (65, 90, 1), (97, 122, 1), (128, 255, 1))
#: The same, and runs of visible ASCII punctuation as tokens of their own.
WORDS_AND_MARKS = byte_classes((33, 126, 2), (48, 57, 1), (65, 90, 1), (97, 122, 1), (128, 255, 1))


def utf8(column: str = "text") -> Column:
    """The text as bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values (a finalizer of two multiplications)."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D * (seed > 0)) & _MASK)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (int(_BASE), _INVERSE):
            p = np.full(BLOCK_BYTES, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


@dataclass
class Tokens:
    """Tokens of consecutive rows: byte spans, classes' hashes and the bounds of each row."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def token_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Starts and ends of the tokens in ``data``, and each row's first and last token."""
    kind = classes[data]
    before = np.empty_like(kind)
    before[:1] = 0
    before[1:] = kind[:-1]
    before[offsets[:-1][offsets[:-1] < len(kind)]] = 0
    after = np.empty_like(kind)
    after[-1:] = 0
    after[:-1] = kind[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    starts = np.flatnonzero((kind != before) & (kind != 0))
    ends = np.flatnonzero((kind != after) & (kind != 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_block(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER[data].astype(np.uint64) * _powers()[0][: len(data)] + np.uint64(0), out=sums[1:])
    return sums


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash each span in blocks of bounded size, however long the text or a token is."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right"))
        if j > i:
            low = int(starts[i])
            sums = _hash_block(data[low : int(ends[j - 1])])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * _powers()[1][s]
        else:  # one token longer than a block
            j, total, at = i + 1, 0, int(starts[i])
            while at < ends[i]:
                block = data[at : min(at + BLOCK_BYTES, int(ends[i]))]
                total += int(_hash_block(block)[-1]) * pow(int(_BASE), at - int(starts[i]), 1 << 64)
                at += len(block)
            out[i] = np.uint64(total & _MASK)
        i = j
    hashes = mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    hashes[hashes == 0] = 1  # 0 stands for "no token"
    return hashes


def tokenize(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Tokens:
    starts, ends, bounds = token_spans(data, offsets, classes)
    return Tokens(starts, ends, bounds, token_hashes(data, starts, ends))


def byte_slices(array: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a binary array holding about ``limit`` bytes: first, last, bytes, offsets.

    A longer text comes alone and whole.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, raw_offsets, raw = array.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        low, high = int(offsets[first]), int(offsets[last])
        yield first, last, data[low:high], offsets[first : last + 1] - low
        first = last


def shingles(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` tokens; a shorter row is one run of its own."""
    rows, h, counts = tokens.rows, tokens.hashes, np.diff(tokens.bounds)
    n = len(h) - size + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for j in range(size):
            grams = (grams ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
            grams ^= grams >> np.uint64(29)
        whole = rows[:n] == rows[size - 1 :]
        grams, at = mix(grams[whole]), rows[:n][whole]
    else:
        grams, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            x = np.uint64(counts[r])
            with np.errstate(over="ignore"):
                for w in h[tokens.bounds[r] : tokens.bounds[r + 1]]:
                    x = (x ^ w) * np.uint64(0xD1342543DE82EF95)
                    x ^= x >> np.uint64(31)
            extra[i] = x
        grams, at = np.concatenate([grams, mix(extra, 7)]), np.concatenate([at, short])
    return at, grams


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
