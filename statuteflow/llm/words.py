"""Words of whole texts as numpy arrays: places and 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Hashes are polynomials modulo 2**64 with a fixed odd
base, mixed with the length; two different words or word runs among n meet with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that they have inverses modulo 2**64
SLICE_BYTES, SPLIT_BYTES = 2 << 20, 1 << 20


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after another
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # index of the text that has the word
    key: np.ndarray  # uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a uint64 over all its bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def span_keys(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of values[start:end] for many spans at once, by differences of one running sum."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(STEP))


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    """The words of some texts (UTF-8; None is an empty text); lower: A-Z become a-z.

    Working arrays are eight times the size of the bytes, so texts are split a few at a time.
    """
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    group = np.cumsum(lengths) // SPLIT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    parts, doc, byte = [], 0, 0
    for low, high in zip(cuts[:-1], cuts[1:]):
        part = _split(texts[low:high], lengths[low:high], lower)
        parts.append(Words(part.data, part.start + byte, part.end + byte, part.doc + doc, part.key))
        doc, byte = high, byte + len(part.data)
    return parts[0] if len(parts) == 1 else Words(*(np.concatenate(field) for field in zip(*parts)))


def _split(texts: list[bytes], lengths: np.ndarray, lower: bool) -> Words:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(t for t in texts if t), dtype=np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, dtype=bool)  # positions that begin a text
    first[offsets] = True
    starts_here = inside[:-1].copy()
    starts_here[1:] &= ~inside[:-2] | first[1:-1]
    ends_here = inside[:-1] & (~inside[1:] | first[1:])
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, doc, span_keys(data, start, end))


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the first word) and hashes of all runs of k consecutive words of one text."""
    n = len(words.key)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return at, span_keys(words.key, at, at + k, STEP)


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, texts as bytes) for consecutive rows of about ``most`` bytes; one long text stands alone.

    Rows leave Arrow a few at a time, as a batch may be much larger than a slice.
    """
    texts, first, size = [], 0, 0
    for low in range(0, len(column), 64):
        for text in column.slice(low, 64).cast(pa.large_binary()).to_pylist():
            texts.append(text)
            size += len(text or b"")
            if size >= most:
                yield first, texts
                texts, first, size = [], first + len(texts), 0
    if texts:
        yield first, texts


def distinct_words(words: Words) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of its distinct word for each word, the distinct words, their counts)."""
    import pandas as pd

    codes, _ = pd.factorize(words.key)
    n = int(codes.max()) + 1 if len(codes) else 0
    at = np.zeros(n, dtype=np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]  # the first place of each
    raw = words.data.tobytes()
    return codes, [raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())], np.bincount(codes, minlength=n)
