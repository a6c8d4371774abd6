"""Word and shingle hashes of whole texts as array operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from bellwire.llm.state import per_worker

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
_MASK = (1 << 64) - 1
#: Text bytes handled at once; a longer text stands alone.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for places 0..n at least."""
    held = per_worker("powers", lambda: [np.ones(1, np.uint64)] * 2)
    if len(held[0]) <= n:
        for i, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            steps = np.full(max(n + 1, BLOCK_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            held[i] = np.multiply.accumulate(steps)
    return held


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes with a blank behind each text, end of each text) per block."""
    at, n = 0, len(texts)
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + sizes[end] <= BLOCK_BYTES):
            total += sizes[end] + 1
            end += 1
        data = b"".join(x for t in texts[at:end] for x in (t.as_buffer() if t.is_valid else b"", b" "))
        yield at, end, np.frombuffer(data, np.uint8), np.cumsum([s + 1 for s in sizes[at:end]])
        at = end


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words of each text.

    Words are the stretches without the blanks 0x20 and 0x09-0x0D; ``lower`` folds A-Z.
    """
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * _ODD)
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    return hashes, counts


def _long_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of one long text, in slices cut at blanks."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data):
            gap = np.flatnonzero(_BLANK[data[end : end + BLOCK_BYTES]])
            end += int(gap[0]) + 1 if len(gap) else min(BLOCK_BYTES, len(data) - end)
            if len(gap):
                break
        parts.append(word_hashes(data[at:end], np.array([end - at]))[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([len(words)])


def shingle_sets(texts: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one shingle, all its words; a null, empty or blank one has none.
    """
    factors = [mix(np.array([i + 1], np.uint64) * _ODD)[0] | _U(1) for i in range(width)]
    for _, _, data, ends in text_blocks(texts):
        words, counts = word_hashes(data, ends) if len(ends) > 1 or len(data) <= 2 * BLOCK_BYTES else _long_words(data)
        full = max(0, len(words) - width + 1)
        rolled = np.zeros(full, np.uint64)
        for i, f in enumerate(factors):
            rolled += words[i : i + full] * f
        rolled = mix(rolled)
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                short = (words[at : at + n] * np.array(factors[:n])).sum(dtype=np.uint64)
                yield mix(np.array([short + _U(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n
