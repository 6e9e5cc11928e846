"""Near-equal embeddings through an inverted product-quantisation index.

A coarse quantiser deals the unit vectors into lists. Within a list each vector is stored as
codes of its residual, one per subspace, with the length of what the codes miss. Every
vector also asks the `PROBES` lists whose centres are nearest to it. In a list, distances
are sums of table entries, one per subspace; an entry is dropped only if its distance less
its coding error exceeds the threshold, so the codes lose no link, and exact cosines in
double precision decide the rest.

Vectors of each length have an index of their own, as cosines exist among them alone.
Quantisers are fitted on about `SAMPLE` vectors, drawn by hash and shared out among the lengths; every
vector is indexed and asks. Lists and their askers are cut into blocks, so a dense list spreads over many
tasks, and a task returns link counts and the links of a spanning forest, never all pairs.
Equal vectors are one node from the start. A pair both of whose vectors ask for the other's
list is counted once. Only the choice of lists can miss a link; tests measure the recall.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite
component link with nothing, as do rows without an id, whose component is null; vectors of
different lengths never link; rows that repeat an id and a vector count row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import blocks_of, dealt, map_batches, on_workers, staged, table
from fieldledger.llm.components import components

COSINE = 0.9
SAMPLE, ROUNDS = 16_384, 8
PER_LIST, MOST_LISTS, PROBES = 128, 1024, 12
SUBSPACES, CODES = 8, 64
BLOCK = 1024
SEED = 8


def nearest(points: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The nearest centres of each point, nearest first."""
    found = []
    for start in range(0, len(points), 4096):
        part = points[start : start + 4096]
        far = (centres**2).sum(axis=1)[None, :] - 2 * part @ centres.T
        some = np.argpartition(far, count - 1, axis=1)[:, :count]
        order = np.take_along_axis(far, some, axis=1).argsort(axis=1, kind="stable")
        found.append(np.take_along_axis(some, order, axis=1))
    return np.concatenate(found) if found else np.empty((0, count), np.int64)


def means(points: np.ndarray, count: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """Centres of `count` groups of points, by alternating assignment and averaging."""
    centres = points[draw.permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)[:, 0]
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        used = sizes > 0
        centres[used] = sums[used] / sizes[used, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centres, and the residual code book of each subspace."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]

    def split(self, residuals: np.ndarray) -> list[np.ndarray]:
        return np.array_split(residuals, len(self.books), axis=1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the length of what they miss."""
        codes, missed = [], np.zeros(len(residuals))
        for part, book in zip(self.split(residuals), self.books, strict=True):
            code = nearest(part, book)[:, 0]
            codes.append(code.astype(np.uint8))
            missed += ((part - book[code]) ** 2).sum(axis=1)
        return np.stack(codes, axis=1), np.sqrt(missed)

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of every residual to every coded one, by table look-ups."""
        total = np.zeros((len(residuals), len(codes)))
        for i, (part, book) in enumerate(zip(self.split(residuals), self.books, strict=True)):
            entries = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            total += entries[:, codes[:, i]]
        return np.sqrt(total)


def fit_index(sample: np.ndarray, lists: int) -> Index:
    draw = np.random.default_rng(SEED)
    centres = means(sample, min(lists, len(sample)), ROUNDS, draw)
    residuals = sample - centres[nearest(sample, centres)[:, 0]]
    parts = np.array_split(residuals, min(SUBSPACES, sample.shape[1]), axis=1)
    books = tuple(means(part, min(CODES, len(part)), ROUNDS, draw) for part in parts)
    return Index(centres, books)


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares must not overflow
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    """Vectors held as bytes of doubles, as rows."""
    return np.stack([np.frombuffer(value, np.float64) for value in column])


def vector_nodes(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector: smallest id, number of rows, bytes of doubles."""
    numbers = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), numbers.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    nodes = rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    return staged(nodes.withColumn("length", F.size("vector")), "vector-nodes")


@dataclass(frozen=True)
class Indexes:
    """The index of each vector length; its lists are numbered from its first one."""

    by_length: dict[int, tuple[int, Index]]

    def of_list(self, number: int) -> tuple[int, Index]:
        return max((own for own in self.by_length.values() if own[0] <= number), key=lambda own: own[0])


def fit_indexes(nodes: DataFrame) -> Indexes:
    """Fits the indexes on samples in proportion to the lengths, one vector of each at least."""
    lengths = nodes.groupBy("length").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    shares = lengths.withColumn("share", F.ceil(F.least(F.lit(1.0), SAMPLE / total) * F.col("n")))
    drawn = nodes.join(F.broadcast(shares), "length")
    drawn = drawn.where(F.pmod(F.xxhash64("vector"), F.col("n")) < F.col("share"))
    first = Window.partitionBy("length").orderBy("node")
    # Bounded: twice the sample, and two vectors of each length that the hash may have left without any.
    some = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * F.col("share"))
    least = nodes.groupBy("length").agg(F.min_by("vector", "node").alias("vector"))
    samples: dict[int, list] = {row["length"]: [row["vector"]] for row in least.collect()}
    for row in some.select("length", "vector").collect():
        samples[row["length"]].append(row["vector"])
    found, lists = {}, 0
    for row in lengths.orderBy("length").collect():
        sample = units(np.array(samples[row["length"]], dtype=np.float64))
        index = fit_index(sample, int(np.clip(row["n"] // PER_LIST, 1, MOST_LISTS)))
        found[row["length"]] = (lists, index)
        lists += len(index.centres)
    return Indexes(found)


def list_rows(nodes: DataFrame, indexes: Indexes) -> DataFrame:
    """Every node as an entry of its list, and as an asker of the lists it probes."""

    def work(batch):
        lengths = pc.list_value_length(batch.column("vector"))
        for length in pc.unique(lengths).to_pylist():
            yield indexed(batch.filter(pc.equal(lengths, length)), *indexes.by_length[length])

    def indexed(batch, lists, index):
        vectors = np.array(batch.column("vector").to_pylist(), dtype=np.float64)
        points = units(vectors)
        near = nearest(points, index.centres, min(PROBES, len(index.centres)))
        codes, missed = index.encode(points - index.centres[near[:, 0]])
        return pa.record_batch(
            [
                batch.column("node"),
                batch.column("copies"),
                pa.array((lists + near[:, 0]).astype(np.int32)),
                pa.array(list((lists + near).astype(np.int32)), pa.list_(pa.int32())),
                pa.array([row.tobytes() for row in vectors], pa.binary()),
                pa.array([row.tobytes() for row in codes], pa.binary()),
                pa.array(missed),
            ],
            names=["node", "copies", "home", "probes", "vector", "codes", "missed"],
        )

    schema = (
        "node long, copies long, home int, probes array<int>, vector binary, codes binary, missed double"
    )
    return staged(map_batches(nodes.select("node", "copies", "vector"), work, schema), "vector-lists")


def list_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of each list, cut so that a block of askers meets a block of entries."""
    entries = rows.withColumn("list", F.col("home"))
    askers = rows.withColumn("list", F.explode("probes"))

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = staged(parts(entries, "entry_parts").join(parts(askers, "asker_parts"), "list"), "vector-sizes")

    def crossed(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.col(f"{own}_parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))
        sized = side.join(sizes, "list")
        return sized.withColumn(f"{own}_part", part).withColumn(f"{other}_part", every).select(
            "list", "asker_part", "entry_part", F.lit(asks).alias("asks"), *rows.columns
        )

    return crossed(askers, "asker", "entry", True).unionByName(crossed(entries, "entry", "asker", False))


def block_links(block: dict[str, list], indexes: Indexes, cosine: float) -> tuple[dict[int, int], list]:
    """Links per node and a spanning forest of the links in one block."""
    asks = np.array(block["asks"])
    askers, entries = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(askers) or not len(entries):
        return {}, []
    raw = matrix(block["vector"])
    points = units(raw)
    lists, index = indexes.of_list(block["list"][0])
    centre = index.centres[block["list"][0] - lists]
    codes = np.stack([np.frombuffer(block["codes"][e], np.uint8) for e in entries])
    missed = np.array(block["missed"])[entries]
    reach = np.sqrt(2 - 2 * cosine) + 1e-9
    nodes, homes, copies = (np.array(block[name]) for name in ("node", "home", "copies"))
    probes = np.array([block["probes"][e] for e in entries])
    counts: dict[int, int] = {}
    forest, roots = [], {}

    def root(node: int) -> int:
        while (up := roots.get(node, node)) != node:
            roots[node] = node = roots.get(up, up)
        return node

    for start in range(0, len(askers), 256):
        some = askers[start : start + 256]
        near = index.distances(points[some] - centre, codes) <= reach + missed[None, :]
        # If the entry asks for the asker's list too, the pair counts where the smaller one asks.
        both = (probes[None, :, :] == homes[some][:, None, None]).any(axis=2)
        smaller = nodes[some][:, None] < nodes[entries][None, :]
        near &= smaller | (~both & (nodes[some][:, None] != nodes[entries][None, :]))
        i, j = np.nonzero(near)
        exact = np.einsum("ij,ij->i", points[some[i]], points[entries[j]]) >= cosine
        for a, b in zip(some[i[exact]].tolist(), entries[j[exact]].tolist(), strict=True):
            first, second = int(nodes[a]), int(nodes[b])
            counts[first] = counts.get(first, 0) + int(copies[b])
            counts[second] = counts.get(second, 0) + int(copies[a])
            low, high = sorted((root(first), root(second)))
            if low != high:
                roots[high] = low
                forest.append((first, second))
    return counts, forest


def links_of_lists(blocks: DataFrame, indexes: Indexes, cosine: float) -> DataFrame:
    """`a` with its `links` in a block, and links `a`, `b` of the block's forest."""
    keys = ["list", "asker_part", "entry_part"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, keys):
            counts, forest = block_links(block, indexes, cosine)
            if counts:
                a = [*counts, *(first for first, _ in forest)]
                b = [None] * len(counts) + [second for _, second in forest]
                n = [*counts.values(), *([0] * len(forest))]
                yield pa.record_batch(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                    names=["a", "b", "links"],
                )

    return staged(on_workers(dealt(blocks, *keys)).mapInArrow(work, "a long, b long, links long"), "vector-links")


def vector_components(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Every row with its number of links, its component and whether it stays."""
    nodes = vector_nodes(vectors)
    numbers = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), numbers.alias("vector"))
    indexes = fit_indexes(nodes)
    found = links_of_lists(list_blocks(list_rows(nodes, indexes), block), indexes, cosine)
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    named = nodes.join(linked, "node", "left").join(labels, "node", "left")
    # Written, so that a vector of very many rows is split like any skewed join key.
    named = staged(
        named.select(
            F.col("vector").alias("known"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "vector-components",
    )
    joined = rows.join(named, (rows["vector"] == named["known"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))
