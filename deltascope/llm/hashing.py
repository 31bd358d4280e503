"""Vectorised hashes of the words and word shingles of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are runs of ASCII letters, digits and of all characters beyond ASCII, in lower case.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
INSIDE_CODE = np.where(WORD_BYTE, BYTE_CODE, np.uint64(0))
PLACE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP_CODE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Characters hashed together: few enough that the arrays stay in the cache.
SLICE_CHARS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of all texts, and the words' bounds by text.

    Bytes are those of the lower-cased texts, each followed by a line end.
    """
    raw = ("\n".join(texts).lower() + "\n").encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = WORD_BYTE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = [len(t.lower().encode()) + 1 for t in texts]
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    spread = INSIDE_CODE[data]
    # place in the word, modulo 256; what stands between words has code 0
    begin = np.zeros(len(data), dtype=np.int32)
    begin[starts[0]:] = np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    spread *= PLACE_CODE[(np.arange(len(data), dtype=np.int32) - begin).astype(np.uint8)]
    return mix(np.add.reduceat(spread, starts) + (ends - starts).astype(np.uint64)), starts, ends, bounds


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter, non-empty list is one run."""
    n = len(words) - k + 1
    if len(words) == 0:
        return words
    if n < 1:
        return mix(np.array([np.sum(words * STEP_CODE[:len(words)]) + np.uint64(len(words))], dtype=np.uint64))
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += words[i:i + n] * STEP_CODE[i]
    return mix(total)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value joined with the number of its earlier occurrences, so that all differ."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return values
    at = np.arange(len(values))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
    nth = np.empty(len(values), dtype=np.uint64)
    nth[order] = (at - first).astype(np.uint64)
    return np.where(nth > 0, mix(values + nth * STEP_CODE[63]), values)


def text_slices(batch: pa.RecordBatch, text_at: int, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of pieces of a batch with about so many characters; NULL is an empty text."""
    texts, first, size = [], 0, 0
    column = batch.column(text_at)
    for i, t in enumerate(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > chars:
            yield first, i + 1, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, len(column), texts
