"""Sets of hashed word shingles, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are hashed in runs of about this many bytes, to bound the memory of a task.
RUN_BYTES = 1 << 18
# An odd base and odd factors of 64 bits.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
ONE_WORD = 0xD6E8FEB86659FD93
# Of each byte: whether words hold it, and its summand, with A-Z as a-z.
INSIDE = ~np.isin(np.arange(256), SPACES)
SUMMANDS = np.arange(1, 257, dtype=np.uint64)
SUMMANDS[0x41:0x5B] += np.uint64(0x20)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(MIX[0])
    values = (values ^ (values >> np.uint64(27))) * np.uint64(MIX[1])
    return values ^ (values >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `BASE` and of its inverse modulo 2^64, `n` or more."""
    size = max(2 * RUN_BYTES, 1 << n.bit_length())
    if size not in _powers:
        _powers.clear()
        pair = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def word_hashes(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that lie one behind the other, and words per text.

    `bounds` has the first byte of each text and the end of the last. A-Z count as a-z; words
    are runs without the characters of `SPACES`.
    """
    inside = np.append(INSIDE[codes], False)
    starts_text = np.zeros(len(codes) + 1, dtype=bool)
    starts_text[bounds] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | starts_text))
    ends = np.flatnonzero(before & (~inside | starts_text))
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(SUMMANDS[codes] * up[: len(codes)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text of each run, its bytes, and the bounds of its texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the two-word shingles of each text.

    A text of one word has that word as its only shingle, a text without words none.
    """
    for first, last, codes, bounds in runs(texts):
        words, counts = word_hashes(codes, bounds)
        ends = np.cumsum(counts)
        pairs = mixed(words[:-1] * np.uint64(MIX[1]) + mixed(words[1:] + np.uint64(BASE)))
        for i in range(last - first):
            n, end = int(counts[i]), int(ends[i])
            if n == 1:
                yield mixed(words[end - 1 : end] ^ np.uint64(ONE_WORD))
            else:
                yield np.unique(pairs[end - n : max(end - 1, end - n)])
