"""Token ids of many texts at once, each distinct word of a batch encoded a single time.

A space behind a character that is no white space always begins a pre-token, because white
space stands in a pre-token only at its front or as a run. Such a space may therefore cut a
text, and what it cuts off has the same ids wherever it stands. Texts with white space in
front of a space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldledger.llm.bpe import encoding

# Every white-space character (and some control characters) in front of a space.
RUN = (
    "[\\t\\n\\v\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
)

# Text encoded at a time; bounds the memory of a task, a longer text goes alone.
SLICE_BYTES = 8 << 20


def encode_all(texts: list[str], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of ids of each."""
    encode = encoding(ranks_path).encode_ordinary
    found = [encode(text) for text in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, counts.sum()), counts


def _gather(flat: np.ndarray, counts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs of `flat` that `picks` names, one behind the other."""
    starts, sizes = (np.cumsum(counts) - counts)[picks], counts[picks]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[shift + np.arange(ends[-1] if len(ends) else 0)]


def all_ids(texts: pa.Array, ranks_path: str) -> Iterator[np.ndarray]:
    """The ids of each text of a batch without nulls, a few megabytes of text at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield from batch_ids(texts.slice(start, stop - start), ranks_path)
        start = stop


def batch_ids(texts: pa.Array, ranks_path: str) -> list[np.ndarray]:
    """The ids of each text, all held at once."""
    split = pc.invert(pc.match_substring_regex(texts, RUN)).to_numpy(zero_copy_only=False)
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    rest = np.flatnonzero(~split)
    flat, counts = encode_all(texts.take(pa.array(rest)).to_pylist(), ranks_path)
    for place, ids in zip(rest, np.split(flat, np.cumsum(counts)[:-1]), strict=False):
        found[place] = ids
    places = np.flatnonzero(split)
    if not len(places):
        return found
    lists = pc.split_pattern(texts.take(pa.array(places)), " ")
    offsets = lists.offsets.to_numpy()
    words, sizes = lists.values, np.diff(offsets)
    first = np.zeros(len(words), dtype=bool)
    first[offsets[:-1]] = True
    # A text's first word has no space in front.
    spaced = pc.if_else(pa.array(first), words, pc.binary_join_element_wise("", words, " "))
    coded = spaced.dictionary_encode()
    flat, counts = encode_all(coded.dictionary.to_pylist(), ranks_path)
    codes = coded.indices.to_numpy()
    ids = _gather(flat, counts, codes)
    ends = np.cumsum(np.add.reduceat(counts[codes], offsets[:-1])) if sizes.size else []
    for place, own in zip(places, np.split(ids, ends[:-1]), strict=True):
        found[place] = own
    return found
