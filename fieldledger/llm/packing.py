"""Vector packing of training examples into sequences.

An example asks for tokens, one segment, and the tokens that bear loss; a sequence limits
all three. Each task keeps a bounded pool of examples and fills one sequence after the
other: among the examples that fit whole, the one whose demand has the largest dot product
with what the sequence has left goes in. When none fits, an example is cut to fill the
rest. A sequence that the other limits end early is trimmed to a power of two, a length that
needs no padding, and what was trimmed off goes back to the pool.

Tasks pack what they read, so nothing is shuffled and a retried task packs the same again.
A sequence's number holds the number of its task. The ids are those of the vocabulary's JSON
file read by `tokenizers`; the rank file gives the same ids several times faster, and
texts that hold one of the JSON file's added tokens are encoded around it.

Defined results: null and empty texts consist of the end id alone; repeated rows and ids
are packed row by row; a null id stays null; without rows there are no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.bpe import RANKS
from fieldledger.llm.common import on_workers, table, whole_text
from fieldledger.llm.word_ids import all_ids, encode_all

END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
SEQUENCES_PER_TASK = 1 << 40
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("loss_tokens", pa.int64()),
    ]
)
PIECES_SQL = ", ".join(f"{name} long" for name in PIECES.names)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how many examples a task weighs against each other."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2047
    pool: int = 512


@dataclass
class Example:
    """What is left of a document: its ids from `start` on; loss begins at `loss_from`."""

    doc_id: int | None
    ids: np.ndarray
    loss_from: int
    start: int = 0

    def left(self) -> int:
        return len(self.ids) - self.start

    def loss(self, tokens: int) -> int:
        """Loss-bearing ids among the next ones; the first of a piece has no context."""
        return max(0, self.start + tokens - max(self.start + 1, self.loss_from))


@dataclass
class Packer:
    """Fills sequences from a pool and collects the pieces."""

    limits: Limits
    first_sequence: int
    pool: list[Example] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    sequences: int = 0

    def add(self, example: Example) -> None:
        while example.left() > self.limits.tokens and self.alone(example):
            pass
        self.pool.append(example)
        if len(self.pool) >= 2 * self.limits.pool:
            self.drain(self.limits.pool)

    def alone(self, example: Example) -> bool:
        """Gives the next full length of a long example a sequence of its own."""
        if example.loss(self.limits.tokens) > self.limits.loss_tokens:
            return False
        self.emit([(example, example.start, self.limits.tokens)])
        example.start += self.limits.tokens
        return True

    def drain(self, keep: int) -> None:
        while len(self.pool) > keep:
            self.fill()

    def fill(self) -> None:
        """One sequence by the dot-product rule, its rest closed by cutting an example."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        want = np.array([(e.left(), 1, e.loss(e.left())) for e in self.pool], dtype=float)
        rest, placed, used = most.copy(), [], np.zeros(len(self.pool), dtype=bool)
        scaled = want / most
        while True:
            fits = ~used & (want <= rest).all(axis=1)
            if not fits.any():
                break
            pick = int(np.argmax(np.where(fits, scaled @ (rest / most), -1.0)))
            used[pick] = True
            rest -= want[pick]
            placed.append((self.pool[pick], self.pool[pick].start, self.pool[pick].left()))
        spare = [e for e, taken in zip(self.pool, used, strict=True) if not taken]
        if rest[0] >= 1 and rest[1] >= 1 and spare:
            self.cut(spare, placed, rest)
        self.pool = spare
        for example, start, length in placed:
            example.start = start + length
        self.trim(placed)
        self.emit(placed)

    def cut(self, spare: list[Example], placed: list, rest: np.ndarray) -> None:
        """Puts the front of the largest example that is left into the rest."""
        example = max(spare, key=Example.left)
        tokens = min(int(rest[0]), example.left())
        while tokens and example.loss(tokens) > rest[2]:
            tokens -= example.loss(tokens) - int(rest[2])
        if tokens > 0:
            placed.append((example, example.start, tokens))

    def trim(self, placed: list) -> None:
        """Shortens a sequence that is not full to a power of two."""
        length = sum(tokens for *_, tokens in placed)
        if length == self.limits.tokens:
            return
        excess = length - (1 << (length.bit_length() - 1))
        while excess:
            example, start, tokens = placed.pop()
            off = min(excess, tokens)
            excess -= off
            if off < tokens:
                placed.append((example, start, tokens - off))
            if example not in self.pool:
                self.pool.append(example)
            example.start = start + tokens - off

    def emit(self, placed: list) -> None:
        offset = 0
        for example, start, tokens in placed:
            ids = example.ids[start : start + tokens].astype("<u4").tobytes()
            loss = max(0, start + tokens - max(start + 1, example.loss_from))
            self.rows.append(
                (example.doc_id, start, tokens, zlib.crc32(ids), len(example.ids))
                + (self.first_sequence + self.sequences, offset, loss)
            )
            offset += tokens
        self.sequences += 1

    def take_rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in PIECES]
        self.rows = []
        return pa.record_batch(
            [pa.array(list(c), t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES
        )


def added_tokens(vocabulary_path: str) -> dict[str, int]:
    """The strings that a vocabulary's JSON file takes as one id wherever they stand."""
    with open(vocabulary_path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def ids_around(text: str, added: dict[str, int], ranks_path: str) -> np.ndarray:
    """Ids of a text that holds added tokens; the leftmost, then longest one counts."""
    tokens = "|".join(re.escape(token) for token in sorted(added, key=len, reverse=True))
    parts = re.split(f"({tokens})", text)
    flat, counts = encode_all(parts[::2], ranks_path)
    plain = np.split(flat, np.cumsum(counts)[:-1])
    found = [plain[0]]
    for token, ids in zip(parts[1::2], plain[1:], strict=True):
        found += [np.array([added[token]], np.uint32), ids]
    return np.concatenate(found)


def document_ids(texts: pa.Array, added: dict[str, int], ranks_path: str) -> Iterator[np.ndarray]:
    """The ids of each text, as the JSON file read by `tokenizers` gives them."""
    holds = np.zeros(len(texts), bool)
    for token in added:
        holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    for place, ids in enumerate(all_ids(texts, ranks_path)):
        yield ids_around(texts[place].as_py(), added, ranks_path) if holds[place] else ids


def pack_examples(
    docs: DataFrame,
    ranks_path: str,
    limits: Limits = Limits(),
    loss_from: Column | None = None,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of packed sequences; `loss_from` is the first id of a document that bears loss.

    `added` are strings that count as one id each.
    """
    begins = F.coalesce(loss_from, F.lit(0)) if loss_from is not None else F.lit(0)
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        whole_text().alias("text"),
        begins.cast("bigint").alias("loss_from"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
        for batch in batches:
            doc_ids, begin = batch.column("doc_id").to_pylist(), batch.column("loss_from").to_pylist()
            ids = document_ids(batch.column("text"), added or {}, ranks_path)
            for doc_id, own, first in zip(doc_ids, ids, begin, strict=True):
                whole = np.append(own, np.uint32(END_ID))
                packer.add(Example(doc_id, whole, first))
            yield packer.take_rows()
        packer.drain(0)
        yield packer.take_rows()

    return on_workers(texts).mapInArrow(pack, PIECES_SQL)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path(VOCABULARY))
    return pack_examples(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), added=added)
