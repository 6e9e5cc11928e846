"""Near duplicates by SetSketch registers, banding, a joint likelihood and full sets.

A document's set holds its distinct two-word shingles. Its sketch has `REGISTERS` registers;
each holds, on an exponential scale truncated to 16 bits, the smallest of one random value
per shingle, so sketches merge by maximum and equal registers are as likely as shared
shingles. Four registers make a band. Documents that share a band are candidates: at a
similarity of 0.8 a pair shares none of the 32 bands with a probability of 5e-8.

The smallest document of a band is its pivot, and documents meet in the group of a pivot
(or of the pivot's own pivot, which joins the many groups of one family). A group is cut
into chunks. Within a chunk, likelihood over the registers and the sizes estimates each
pair's similarity; pairs above `LEAST_ESTIMATE`, five standard errors below the threshold,
are compared on full sets until they are connected. Groups of several chunks then compare
what the first pass left outside their largest component against all their chunks. Pairs of
one component need no look, so a large group of near copies costs its outsiders times its
members, and only links leave a task.

Equal sets are one node from the start. Components are those of the confirmed links.

Defined results: a document without words has an empty set and is linked with nothing; a
null id is linked with nothing, has a null component and is kept; rows that repeat an id are
judged by their own texts; without rows there is no result. Sets are compared by 64-bit
hashes of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import blocks_of, dealt, free_name, map_batches, on_workers, staged, table, whole_text
from fieldledger.llm.components import components
from fieldledger.llm.shingles import shingle_sets

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
SCALE, RATE, TOP = 1.001, 20.0, 2**16 - 2
PERCENT = 80
LEAST_ESTIMATE = 0.62
CHUNK = 256
SEED = 20_240


def register_factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    odd = draw.integers(0, 2**31, REGISTERS, dtype=np.uint64) * 2 + 1
    return odd.astype(np.uint32), draw.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def sketch(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Registers of a set that is not empty."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(values), 4096):
        part = values[None, start : start + 4096] * factors[0][:, None] + factors[1][:, None]
        np.minimum(least, part.min(axis=1), out=least)
    # The least of n uniform values gives the least of n exponential ones.
    waits = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(waits) / np.log(SCALE)), 0, TOP + 1).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely_jaccard(
    equal: np.ndarray, above: np.ndarray, below: np.ndarray, size: float, sizes: np.ndarray
) -> np.ndarray:
    """Similarity of largest likelihood, from counts of equal, larger and smaller registers."""
    u, v = size / (size + sizes), sizes / (size + sizes)
    step, log = (SCALE - 1) / SCALE, np.log(SCALE)

    def slope(j: np.ndarray) -> np.ndarray:
        room_above, room_below = 1 - step * (u - v * j), 1 - step * (v - u * j)
        p, q = -np.log(room_above) / log, -np.log(room_below) / log
        dp, dq = -step * v / (log * room_above), -step * u / (log * room_below)
        p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
        return above * dp / p + below * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)

    low, high = np.zeros(len(sizes)), np.minimum(u / v, v / u)
    for _ in range(24):
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets overlap enough."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    places = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[places] == a))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def block_links(
    ids: list[int], labels: list[int], left: np.ndarray, registers: np.ndarray, sets: list[np.ndarray]
) -> list[tuple[int, int]]:
    """Links that connect the rows of one task; pairs of one label count as connected.

    `left` marks the rows that are compared with all; other rows are not compared among
    themselves.
    """
    roots: dict[int, int] = {}

    def root(label: int) -> int:
        while (up := roots.get(label, label)) != label:
            roots[label] = label = roots.get(up, up)
        return label

    sizes = np.array([len(s) for s in sets], dtype=float)
    found, pairs = [], []
    for i in np.flatnonzero(left):
        others = np.flatnonzero(~left | (np.arange(len(ids)) > i))
        fits = np.minimum(sizes[others], sizes[i]) * 100 >= PERCENT * np.maximum(sizes[others], sizes[i])
        others = others[fits]
        equal = np.count_nonzero(registers[others] == registers[i], axis=1)
        near = equal >= REGISTERS * (LEAST_ESTIMATE - 0.1)
        others, equal = others[near], equal[near]
        if not len(others):
            continue
        above = np.count_nonzero(registers[i] > registers[others], axis=1)
        estimate = likely_jaccard(equal, above, REGISTERS - equal - above, sizes[i], sizes[others])
        kept = estimate >= LEAST_ESTIMATE
        pairs += zip((-estimate[kept]).tolist(), [int(i)] * int(kept.sum()), others[kept].tolist(), strict=True)
    for _, i, j in sorted(pairs):
        a, b = root(labels[i]), root(labels[j])
        if a != b and similar(sets[i], sets[j]):
            roots[max(a, b)] = min(a, b)
            found.append((ids[i], ids[j]))
    return found


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Size, digest and registers of every document's set; null registers of an empty set."""

    def work(batch):
        factors = register_factors()
        sizes, digests, registers = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            registers.append(sketch(shingles, factors).tobytes() if len(shingles) else None)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(registers, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "digest", "registers"],
        )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, registers binary"
    return staged(map_batches(texts, work, schema), "near-sketches")


def set_classes(sketches: DataFrame) -> DataFrame:
    """One row per distinct set, under its smallest id."""
    return staged(
        sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers")),
        "near-classes",
    )


def pivot_groups(classes: DataFrame) -> DataFrame:
    """`pivot` and `node`: which nodes meet in which group; every sharing of a band is covered."""
    bands = [
        F.xxhash64(F.lit(band), F.substring("registers", 2 * ROWS * band + 1, 2 * ROWS))
        for band in range(BANDS)
    ]
    shared = classes.select("node", F.explode(F.array(*bands)).alias("band"))
    pivots = staged(
        shared.groupBy("band")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
        .where(F.col("pivot") < F.col("last"))
        .select("band", "pivot"),
        "near-pivots",
    )
    direct = staged(shared.join(pivots, "band").select("pivot", "node").distinct(), "near-direct")
    # A pivot's own smallest pivot takes over its group.
    above = staged(
        direct.groupBy("node").agg(F.min("pivot").alias("above")).withColumnRenamed("node", "pivot"),
        "near-above",
    )
    joined = direct.join(above, "pivot").select(F.col("above").alias("pivot"), "node")
    return staged(joined.distinct(), "near-groups")


def full_sets(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """`node`, registers and the full set, of the nodes that meet others."""
    wanted = groups.select("node").distinct().join(classes, "node")

    def work(batch):
        nodes, registers, sets = [], [], []
        for i, shingles in enumerate(shingle_sets(batch.column("text"))):
            data = shingles.tobytes()
            # An id may repeat with another text.
            if hashlib.blake2b(data, digest_size=16).digest() == batch.column("digest")[i].as_py():
                nodes.append(batch.column("node")[i].as_py())
                registers.append(batch.column("registers")[i].as_py())
                sets.append(data)
        yield pa.record_batch(
            [pa.array(nodes, pa.int64()), pa.array(registers, pa.binary()), pa.array(sets, pa.binary())],
            names=["node", "registers", "shingles"],
        )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), whole_text().alias("text"))
    met = texts.join(wanted, "node").select("node", "digest", "registers", "text")
    return staged(map_batches(met, work, "node long, registers binary, shingles binary"), "near-sets")


def links_of_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed links `a`, `b` among the rows of each block.

    `rows` has the keys and `node`, `label`, `left`, `registers`, `shingles`. A block holds two
    chunks at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, keys):
            registers = np.stack([np.frombuffer(r, np.uint16) for r in block["registers"]])
            sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
            links = block_links(block["node"], block["label"], np.array(block["left"]), registers, sets)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select(*keys, "node", "label", "left", "registers", "shingles")
    return on_workers(dealt(rows, *keys)).mapInArrow(work, "a long, b long")


def cut_groups(groups: DataFrame, chunk: int) -> DataFrame:
    """`pivot`, `node`, its `part` and the group's number of `parts`."""
    sizes = staged(
        groups.groupBy("pivot").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "near-sizes"
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return staged(groups.join(sizes, "pivot").withColumn("part", part), "near-parts")


def outsiders(parts: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """Blocks of what lies outside a large group's largest component, against its chunks."""
    large = parts.where("parts > 1").join(labels.withColumnRenamed("component", "label"), "node", "left")
    large = staged(large.withColumn("label", F.coalesce("label", "node")), "near-large")
    counts = large.groupBy("pivot", "label").agg(F.count("*").alias("rows"))
    totals = counts.groupBy("pivot").agg(
        F.max(F.struct("rows", "label")).alias("most"), F.sum("rows").alias("all")
    )
    outside = F.col("all") - F.col("most.rows")
    totals = staged(
        totals.where(outside > 0).select(
            "pivot",
            F.col("most.label").alias("major"),
            F.ceil(outside / chunk).cast("int").alias("blocks"),
        ),
        "near-outside",
    )
    known = large.join(totals, "pivot")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    first = F.lit(0)
    left = known.where(F.col("label") != F.col("major")).select(
        "pivot", block.alias("block"), F.explode(F.sequence(first, F.col("parts") - 1)).alias("part"),
        "node", "label", F.lit(True).alias("left"),
    )
    right = known.select(
        "pivot", F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block"), "part",
        "node", "label", F.lit(False).alias("left"),
    )
    return left.unionByName(right)


def near_links(docs: DataFrame, classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Confirmed links between nodes, enough of them to connect every component."""
    groups = pivot_groups(classes)
    sets = full_sets(docs, classes, groups)
    parts = cut_groups(groups, chunk)
    own = parts.select("pivot", "part", "node", F.col("node").alias("label"), F.lit(True).alias("left"))
    links = staged(links_of_blocks(own.join(sets, "node"), ["pivot", "part"]), "near-links")
    if parts.where("parts > 1").isEmpty():
        return links
    across = outsiders(parts, components(links), chunk)
    more = links_of_blocks(across.join(sets, "node"), ["pivot", "block", "part"])
    return staged(links.unionByName(more), "near-links")


def near_components(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every document with the size of its set, its component and whether it stays."""
    sketches = sketch_documents(docs)
    classes = set_classes(sketches)
    labels = components(near_links(docs, classes, chunk))
    named = classes.join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component")
    )
    # Written, so that a set of very many documents is split like any skewed join key.
    named = staged(named, "near-components")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = sketches.withColumn("digest", F.when(has_set, F.col("digest"))).join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, in its own columns."""
    gone = near_components(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    key = free_name(docs, "_gone")
    gone = gone.withColumnRenamed("_gone", key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
