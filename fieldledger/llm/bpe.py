"""Byte-level BPE encoding and decoding over overlapping chunks.

A text of up to `CHUNK` characters is encoded where it lies. A longer one is cut into chunks
that reach `OVERLAP` characters into their successor; the chunks spread over the cluster
and are pre-tokenised on their own. The pattern looks ahead only, so two neighbours that
share one boundary in the overlap agree on all that follows: the text is cut there, behind a
character that is no white space, and the pieces are encoded in parallel. Decoding turns the
ids of each piece into raw bytes and concatenates these, so a character split between ids
comes back whole.

A neighbour without a common boundary in the overlap (one run longer than it) is glued to
its predecessor, as is all that follows in that text, and the glued part is one piece.

Defined results: one row per input row, repeated ids and rows included; a null text is
empty, has no ids and the digests of no bytes; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import map_batches, staged, table, whole_text

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32_768, 1024
# A boundary this close to the end of a chunk may depend on what follows it.
UNSURE = 8


@lru_cache(maxsize=2)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@lru_cache(maxsize=1)
def pretokens() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def encode(text: str, ranks_path: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(encoding(ranks_path).encode_ordinary(text), dtype="<u4").tobytes()


def decode(ids: bytes, ranks_path: str) -> bytes:
    """The raw bytes that the ids stand for."""
    return encoding(ranks_path).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def chunk_texts(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text, numbered, with the place where each begins."""

    def cut(batch):
        rows = []
        for row, doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            for number, start in enumerate(range(0, len(text), chunk)):
                rows.append((row, doc_id, number, start, text[start : start + chunk + overlap]))
        yield pa.record_batch(
            [pa.array(list(column)) for column in zip(*rows, strict=True)],
            names=["row", "doc_id", "number", "start", "chunk"],
        ).cast(
            pa.schema(
                [
                    ("row", pa.int64()),
                    ("doc_id", pa.int64()),
                    ("number", pa.int64()),
                    ("start", pa.int64()),
                    ("chunk", pa.string()),
                ]
            )
        )

    schema = "row long, doc_id long, number long, start long, chunk string"
    return map_batches(docs.select("row", "doc_id", "text"), cut, schema)


def chunk_edges(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Pre-token boundaries of each chunk in the overlaps with its two neighbours."""

    def edges(batch):
        heads, tails = [], []
        starts = batch.column("start").to_pylist()
        for start, text in zip(starts, batch.column("chunk").to_pylist(), strict=True):
            # Only there does nothing in front of a boundary depend on what follows it.
            bounds = [match.start() for match in pretokens().finditer(text)]
            bounds = [b for b in bounds if b and not text[b - 1].isspace()]
            sure = len(text) - UNSURE
            heads.append([start + b for b in bounds if b < overlap])
            tails.append([start + b for b in bounds if chunk < b <= sure])
        ints = pa.list_(pa.int64())
        yield pa.record_batch(
            [batch.column("row"), batch.column("number"), pa.array(heads, ints), pa.array(tails, ints)],
            names=["row", "number", "head", "tail"],
        )

    schema = "row long, number long, head array<long>, tail array<long>"
    return map_batches(chunks.select("row", "number", "start", "chunk"), edges, schema)


def stitch(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces of whole pre-tokens: chunks cut where neighbours agree, else glued."""
    before = edges.select("row", (F.col("number") + 1).alias("number"), "tail")
    common = F.array_min(F.array_intersect("head", "tail"))
    cuts = edges.drop("tail").join(before, ["row", "number"], "left").select(
        "row", "number", F.when(F.col("number") == 0, F.lit(0)).otherwise(common).alias("cut")
    )
    along = Window.partitionBy("row").orderBy("number")
    placed = chunks.drop("chunk").join(cuts, ["row", "number"])
    # Behind a missing cut nothing proves that a chunk is in step.
    glued = F.max(F.col("cut").isNull()).over(along)
    own = placed.withColumn("own", F.when(glued, F.col("start")).otherwise(F.col("cut")))
    own = own.select(
        "row",
        "number",
        "own",
        F.lead("own").over(along).alias("until"),
        F.sum((~glued).cast("int")).over(along).alias("piece"),
    )
    first, last = F.col("own") - F.col("start") + 1, F.col("until") - F.col("own")
    to_end = F.char_length("chunk").cast("bigint")
    segment = F.col("chunk").substr(first.cast("int"), F.coalesce(last, to_end).cast("int"))
    segments = chunks.join(own, ["row", "number"]).select(
        "row", "doc_id", "piece", F.struct("number", segment.alias("text")).alias("segment")
    )
    # One text's own segments, never more than that text.
    pieces = segments.groupBy("row", "doc_id", "piece").agg(
        F.array_sort(F.collect_list("segment")).alias("segments")
    )
    return pieces.select("row", "doc_id", "piece", F.array_join("segments.text", "").alias("text"))


def encode_pieces(pieces: DataFrame, ranks_path: str) -> DataFrame:
    """Ids of each piece, and the bytes that decoding them gives."""

    def work(batch):
        ids = [encode(text, ranks_path) for text in batch.column("text").to_pylist()]
        back = [decode(piece, ranks_path) for piece in ids]
        kept = [batch.column(name) for name in ("row", "doc_id", "piece")]
        yield pa.record_batch(
            [*kept, pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
            names=["row", "doc_id", "piece", "ids", "decoded"],
        )

    schema = "row long, doc_id long, piece long, ids binary, decoded binary"
    return map_batches(pieces, work, schema)


def encode_long(docs: DataFrame, ranks_path: str, chunk: int, overlap: int) -> DataFrame:
    """Whole ids and decoded bytes of each text, as `row`, `doc_id`, `ids`, `decoded`."""
    chunks = chunk_texts(docs.withColumn("row", F.monotonically_increasing_id()), chunk, overlap)
    # Written once: row numbers must not change between the uses below.
    chunks = staged(chunks.repartition("row", "number"), "bpe-chunks")
    edges = staged(chunk_edges(chunks, chunk, overlap), "bpe-edges")
    pieces = stitch(chunks, edges)
    parts = encode_pieces(pieces, ranks_path).groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("parts")
    )

    def joined(name: str):
        hexes = F.transform(F.col("parts"), lambda part: F.hex(part[name]))
        return F.unhex(F.array_join(hexes, "")).alias(name)

    return parts.select("doc_id", joined("ids"), joined("decoded"))


def digest_short(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of texts that are one piece, without a shuffle."""

    def work(batch):
        counts, ids_sha, decoded_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = encode(text, ranks_path)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(decode(ids, ranks_path)).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, work, schema)


def token_digests(
    docs: DataFrame, ranks_path: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes per document."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must lie between 0 and the chunk length")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    long = F.char_length("text") > chunk
    whole = encode_long(texts.where(long), ranks_path, chunk, overlap).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return digest_short(texts.where(~long), ranks_path).unionByName(whole)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
