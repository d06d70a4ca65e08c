"""Vectorised word splitting and hashing over Arrow text batches.

Everything here works on the UTF-8 bytes of a whole Arrow column at once
(numpy, no Python loop per row or per word) and runs inside Spark tasks.
Hashes are 64 bit and depend on nothing but the text, so that two tasks on
two machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most UTF-8 bytes that one numpy pass works on (a longer text is one pass of its own).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def byte_classes(is_word) -> np.ndarray:
    """256 values: 0 for a separator byte, else the byte lower-cased (A-Z only) plus one."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if is_word(low):
            out[b] = low + 1
    return out


#: Words are runs of anything but space, tab, line feed, VT, FF and CR.
SPACED = byte_classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, ASCII digits and all non-ASCII characters.
ALNUM = byte_classes(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(1 << 12)


def _power(i: np.ndarray) -> np.ndarray:
    """_BASE ** i, mod 2**64, for places in a word."""
    out = _LOW[i & 0xFFF]
    if len(i) and (high := i >> 12).any():
        steps = np.full(int(high.max()) + 1, _LOW[-1] * _BASE, np.uint64)
        steps[0] = 1
        out = out * np.multiply.accumulate(steps)[high]
    return out


def split_words(data: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the words of each text as cumulative counts (len(ends) + 1).

    data: bytes of all texts one after another; ends: where each text ends.
    """
    (words,), counts = split_prefixes(data, ends, classes, (None,))
    return words, counts


def split_prefixes(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, sizes: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """As split_words, with a hash of each word's first bytes for each of some sizes (None: of the whole word)."""
    c = classes[data]
    inside = c > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = np.concatenate(([0], ends[:-1])).astype(np.int64)
    starts_of_text = starts_of_text[starts_of_text < len(data)]
    first[starts_of_text] = inside[starts_of_text]
    starts = np.flatnonzero(first)
    counts = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in sizes], counts
    at = np.flatnonzero(inside)
    of = np.cumsum(first)[at] - 1
    place = at - starts[of]
    values = mix(c[at]) * _power(place)
    heads = np.searchsorted(at, starts)
    return [mix(np.add.reduceat(values if n is None else np.where(place < n, values, _U(0)), heads)) for n in sizes], counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, and the number of the text that it stands in.

    A text of fewer words, but not none, has its whole sequence as one run.
    """
    n = np.diff(counts)
    of = np.repeat(np.arange(len(n)), n)
    out_h, out_of = [], []
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            h = h * _BASE + words[k : len(words) - size + 1 + k]
        full = of[: len(h)] == of[size - 1 :]
        out_h.append(mix(h[full]))
        out_of.append(of[: len(h)][full])
    for i in np.flatnonzero((n > 0) & (n < size)):
        h = _U(n[i])
        with np.errstate(over="ignore"):
            for w in words[counts[i] : counts[i + 1]]:
                h = h * _BASE + w
        out_h.append(mix(np.array([h ^ _MIX2], np.uint64)))
        out_of.append(np.array([i]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_of)


def distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text and then by hash."""
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[new], o[new]
    return h, o


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `limit` bytes of text: (slice, bytes, ends). A null text has no bytes."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi
