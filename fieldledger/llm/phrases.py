"""Collocated phrases, counted with a suffix tree that is partitioned by word prefixes.

Every place of a word begins a suffix of at most `longest` words, cut at the end of its piece.
All suffixes that share a prefix lie in one subtree, and subtrees are built apart from each other:

1. Prefixes are counted, single words first. A prefix with more suffixes than a group should
   take is extended by a word and counted again, until none is left or it is as long as the
   longest phrase. Only such large prefixes are ever held in one place, and there are at most
   `N / hot` of each length, with `hot` = max(2**19, N / 2**22) for N words.
2. The others fall into groups of about `group` suffixes by a hash of the prefix. A scan of the
   texts deals its suffixes to the groups as compressed blocks of word codes with their words.
3. A task builds the subtrees of one group after the other, truncated at `longest` words. Suffixes are
   sorted one word deeper at a time, and what lies below a node of less than `least` leaves is
   cut off. The frequency of a phrase is the leaf total of its node.

Parts of a frequent phrase are frequent too, so cuts are scored by joins of the frequent phrases
alone, in exact decimals.

Defined results: null texts are empty and have no words; texts without words add nothing; a null
language is `und`; repeated rows and ids count each time; texts of any length are read whole, about
4 MB of text at a time; ties go to the smallest phrase in the order of its UTF-8 bytes; other columns
are not read; without rows there are no phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import blocks_of, dealt, map_batches, on_workers, staged, table, whole_text

UNKNOWN = "und"
# Where pieces of a text end; RE2 and Java read it alike.
ENDS = r"[.,;:!?\n-\r]"
SLICE_BYTES = 4 << 20
COUNTS = "lang string, phrase string, words int, a long"
COUNTS_ARROW = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())]
)
BLOCKS = "bin long, lang string, block binary"
BLOCKS_ARROW = pa.schema([("bin", pa.int64()), ("lang", pa.string()), ("block", pa.binary())])


@dataclass(frozen=True)
class Mining:
    """What counts as a phrase, and how many suffixes a group and an unsplit prefix may have."""

    longest: int = 5
    least: int = 100
    covered: int = 100
    top: int = 2000
    group: int = 1 << 21
    hot: int = 1 << 19

    def hot_of(self, words: int) -> int:
        return max(self.hot, words >> 22, self.least)

    def groups_of(self, words: int) -> int:
        return 1 + 2 * words // max(self.group, 4 * self.hot_of(words))


@dataclass(frozen=True)
class Words:
    """Texts of one language as word codes; 0 ends a piece, code k is `words[k - 1]`."""

    lang: str
    codes: np.ndarray
    words: pa.Array

    def ahead(self, steps: int) -> np.ndarray:
        return np.append(self.codes[steps:], np.zeros(min(steps, len(self.codes)), self.codes.dtype))

    def columns(self, longest: int) -> list[np.ndarray]:
        """The first, second and further words of the suffix at each place; 0 behind its end."""
        found = [self.codes]
        for step in range(1, longest):
            found.append(self.ahead(step) * (found[-1] > 0))
        return found

    def places_of(self, wanted: list[str]) -> np.ndarray:
        """The codes of the wanted words, 0 for those that do not occur."""
        found = pc.index_in(pa.array(wanted, pa.string()), value_set=self.words)
        return pc.fill_null(pc.add(found, 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(lang: str, texts: pa.Array) -> Words:
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, " \n ")
    spaced = pc.replace_substring(marked, "\t", " ")
    ended = pc.binary_join_element_wise(spaced, pa.scalar("\n"), " ")
    coded = pc.list_flatten(pc.split_pattern(ended, " ")).dictionary_encode()
    held = coded.dictionary
    kept = pc.and_(pc.not_equal(held, ""), pc.not_equal(held, "\n")).to_numpy(zero_copy_only=False)
    renamed = np.where(kept, np.cumsum(kept), 0).astype(np.int32)
    renamed[pc.equal(held, "").to_numpy(zero_copy_only=False)] = -1
    codes = renamed[coded.indices.to_numpy()]
    return Words(lang, codes[codes >= 0], held.filter(pa.array(kept)))


def slices_of(batch: pa.RecordBatch) -> Iterator[Words]:
    """The rows of a batch by language, a bounded amount of text at a time."""
    for lang in pc.unique(batch.column("lang")).to_pylist():
        texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield words_of(lang, texts.slice(start, stop - start))
            start = stop


def scan(docs: DataFrame, work: Callable[[Words], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in slices_of(batch):
            yield from work(words)

    return map_batches(docs, run, schema)


def counts_batch(lang: str, phrases: pa.Array, words: int, counts: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    columns = [pa.repeat(lang, size), phrases, pa.repeat(pa.scalar(words, pa.int32()), size)]
    return pa.record_batch([*columns, pa.array(counts, pa.int64())], schema=COUNTS_ARROW)


def count_words(docs: DataFrame) -> DataFrame:
    """How often each word occurs in each language."""

    def work(found: Words) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(found.codes, minlength=len(found.words) + 1)[1:]
        yield counts_batch(found.lang, found.words, 1, counts)

    return summed(scan(docs, work, COUNTS))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


class Prefixes:
    """Prefixes of a language that are too large for a group, as a tree of numbered nodes.

    Node 0 is the root. The children of the nodes of depth d are `edges[d]`: parent numbers,
    words, child numbers.
    """

    def __init__(self) -> None:
        self.phrases = [""]
        self.edges: list[tuple[list[int], list[str], list[int]]] = []
        self._numbers = {"": 0}

    def grow(self, phrases: list[str]) -> None:
        """Adds the large prefixes that are one word longer than the last ones."""
        parents, words, children = [], [], []
        for phrase in sorted(phrases):
            front, _, word = phrase.rpartition(" ")
            parents.append(self._numbers[front])
            words.append(word)
            children.append(len(self.phrases))
            self._numbers[phrase] = len(self.phrases)
            self.phrases.append(phrase)
        self.edges.append((parents, words, children))

    def single_words(self) -> list[str]:
        return self.edges[0][1] if self.edges else []

    def walk(self, found: Words, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each place the deepest node its suffix passes, and the depth of that node."""
        node, depth = np.zeros(len(found.codes), np.int32), np.zeros(len(found.codes), np.int8)
        on = np.arange(len(found.codes))
        for level, (parents, words, children) in enumerate(self.edges):
            codes = found.places_of(words)
            present = codes > 0
            keys = (np.array(parents, np.int64) << 32 | codes)[present]
            order = np.argsort(keys)
            keys, into = keys[order], np.array(children, np.int64)[present][order]
            if not len(keys):
                break
            own = node[on].astype(np.int64) << 32 | columns[level][on]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            on, at = on[hit], at[hit]
            node[on], depth[on] = into[at], level + 1
        return node, depth


def extensions(docs: DataFrame, trees: dict[str, Prefixes], length: int) -> DataFrame:
    """Counts of the prefixes of `length` words whose front and last word are large prefixes."""

    def work(found: Words) -> Iterator[pa.RecordBatch]:
        tree = trees.get(found.lang)
        if tree is None:
            return
        columns = found.columns(length)
        node, depth = tree.walk(found, columns)
        large = np.zeros(len(found.words) + 1, bool)
        large[found.places_of(tree.single_words())] = True
        large[0] = False
        on = np.flatnonzero((depth == length - 1) & large[columns[length - 1]])
        ends = node[on].astype(np.int64) << 32 | columns[length - 1][on]
        keys, counts = np.unique(ends, return_counts=True)
        fronts = pa.array([tree.phrases[i] for i in (keys >> 32).tolist()], pa.string())
        lasts = found.words.take(pa.array((keys & 0xFFFFFFFF) - 1))
        yield counts_batch(found.lang, pc.binary_join_element_wise(fronts, lasts, " "), length, counts)

    return summed(scan(docs, work, COUNTS))


def large_prefixes(
    docs: DataFrame, unigrams: DataFrame, limit: int, longest: int
) -> tuple[dict[str, Prefixes], list[tuple]]:
    """All prefixes with more than `limit` suffixes, and the counts of those of several words."""
    trees: dict[str, Prefixes] = {}
    counted: list[tuple] = []
    counts = unigrams
    for length in range(1, longest + 1):
        # Bounded: at most one row for every `limit` words of the corpus.
        rows = counts.where(F.col("a") > limit).collect()
        if not rows:
            break
        counted += [tuple(row) for row in rows if length > 1]
        found: dict[str, list[str]] = {}
        for row in rows:
            found.setdefault(row.lang, []).append(row.phrase)
        for lang in {*trees, *found}:
            trees.setdefault(lang, Prefixes()).grow(found.get(lang, []))
        if length < longest:
            counts = extensions(docs, trees, length + 1)
    return trees, counted


def pack_block(columns: list[np.ndarray], fixed: np.ndarray, words: pa.Array) -> bytes:
    """Suffixes as compressed columns of codes of their own words, and these words."""
    present = np.zeros(len(words) + 1, bool)
    for column in columns:
        present[column] = True
    # Code 0 stays 0, whether or not a suffix of the block ends early.
    present[0] = True
    used = np.flatnonzero(present)
    kind = np.dtype("<u2" if len(used) < 1 << 16 else "<u4")
    renamed = np.zeros(len(present), kind)
    renamed[used] = np.arange(len(used))
    rows = renamed[np.stack(columns)]
    taken = words.take(pa.array(used[1:] - 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), "\n")
    own = joined[0].as_py().encode()
    head = np.array([len(own), rows.shape[1], kind.itemsize], "<i8").tobytes()
    body = head + own + fixed.astype("i1").tobytes() + rows.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_block(block: bytes, longest: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    body = zstandard.ZstdDecompressor().decompress(block)
    size, count, width = np.frombuffer(body, "<i8", 3).tolist()
    own = body[24 : 24 + size].decode().split("\n") if size else []
    fixed = np.frombuffer(body, "i1", count, 24 + size)
    rows = np.frombuffer(body, f"<u{width}", longest * count, 24 + size + count)
    return rows.reshape(longest, count), fixed, own


def deal_suffixes(docs: DataFrame, trees: dict[str, Prefixes], groups: int, longest: int) -> DataFrame:
    """Blocks of suffixes, each with the number of the group that its prefix belongs to.

    What a large prefix of full length begins has been counted already, and so has a suffix
    that ends within a large prefix; single words are counted too.
    """

    def work(found: Words) -> Iterator[pa.RecordBatch]:
        columns = found.columns(longest)
        tree = trees.get(found.lang, Prefixes())
        node, depth = tree.walk(found, columns)
        # The last word of the prefix, which is one word longer than the large prefix in front.
        last = np.select([depth == d for d in range(longest)], columns, 0)
        on = np.flatnonzero((last > 0) & (columns[1] > 0))
        if not len(on):
            return
        hashes = np.append(np.uint64(0), pd.util.hash_array(found.words.to_numpy(zero_copy_only=False)))
        fronts = pd.util.hash_array(np.array([f"{found.lang} {p}" for p in tree.phrases], object))
        prefix = hashes[last[on]] * np.uint64(0x9E3779B97F4A7C15) ^ fronts[node[on]]
        own = ((prefix >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        del hashes, fronts, prefix, last
        order = np.argsort(own << 32 | columns[0][on])
        own, on = own[order], on[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows = []
        for start, end in pairwise([*starts.tolist(), len(on)]):
            part = on[start:end]
            rows.append(pack_block([c[part] for c in columns], depth[part], found.words))
        langs = pa.repeat(found.lang, len(rows))
        yield pa.record_batch([pa.array(own[starts]), langs, pa.array(rows, pa.binary())], schema=BLOCKS_ARROW)

    return scan(docs, work, BLOCKS)


def subtree_counts(
    lang: str, blocks: list[bytes], longest: int, least: int
) -> Iterator[pa.RecordBatch]:
    """Phrases of two or more words with at least `least` leaves in the subtrees of a group."""
    parts, fixed, names = [], [], []
    for block in blocks:
        rows, depth, own = unpack_block(block, longest)
        parts.append(rows)
        fixed.append(depth)
        names.append(own)
    coded = pa.array([w for own in names for w in own], pa.string()).dictionary_encode()
    codes, done = coded.indices.to_numpy().astype(np.int64) + 1, 0
    for i, own in enumerate(names):
        parts[i] = np.append(0, codes[done : done + len(own)])[parts[i]].astype(np.int32)
        done += len(own)
    columns, large = np.concatenate(parts, axis=1), np.concatenate(fixed)
    del parts, fixed, names
    node, on = columns[0].astype(np.int64), np.arange(columns.shape[1])
    for depth in range(2, longest + 1):
        live = columns[depth - 1, on] > 0
        on, node = on[live], node[live]
        keys = node << 32 | columns[depth - 1, on]
        _, first, node, leaves = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        # A node within a large prefix has leaves in other groups; it was counted before.
        whole = large[on[first]] < depth
        told = np.flatnonzero(whole & (leaves >= least))
        at = on[first[told]]
        if len(at):
            path = [coded.dictionary.take(pa.array(columns[d, at] - 1)) for d in range(depth)]
            yield counts_batch(lang, pc.binary_join_element_wise(*path, " "), depth, leaves[told])
        live = (~whole | (leaves >= least))[node]
        on, node = on[live], node[live]


def group_counts(blocks: DataFrame, longest: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, ["bin", "lang"]):
            yield from subtree_counts(held["lang"][0], held["block"], longest, least)

    return on_workers(blocks).mapInArrow(run, COUNTS)


def frequent_phrases(docs: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to `longest` words that occur `least` times in a language; words per language."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text().alias("text")
    )
    unigrams = staged(count_words(texts), "phrase-words")
    totals = unigrams.groupBy("lang").agg(F.sum("a").alias("n"))
    words = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    trees, counted = large_prefixes(texts, unigrams, mining.hot_of(words), mining.longest)
    blocks = dealt(deal_suffixes(texts, trees, mining.groups_of(words), mining.longest), "bin", "lang")
    deeper = group_counts(blocks, mining.longest, mining.least)
    large = docs.sparkSession.createDataFrame(counted, COUNTS)
    whole = unigrams.unionByName(large).where(F.col("a") >= mining.least).unionByName(deeper)
    return staged(whole, "phrase-counts"), totals


def _joined(words: str) -> F.Column:
    return F.array_join(F.expr(words), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase of several words with its weakest cut."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cuts = (
        phrases.where(F.col("words") > 1)
        .withColumn("own", F.split("phrase", " "))
        .withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
        .select(
            "lang", "phrase", "words", "a", "k",
            _joined("slice(own, 1, k)").alias("left"),
            _joined("slice(own, k + 1, words - k)").alias("right"),
        )
    )
    for side, name in (("left", "l"), ("right", "r")):
        own = parts.select("lang", F.col("part").alias(side), F.col("times").alias(name))
        cuts = cuts.join(own, ["lang", side])
    exact = {name: f"cast({name} as decimal(20, 0))" for name in ("a", "n", "l", "r")}
    score = F.expr("1000 * {a} * {n} div ({l} * {r})".format(**exact))
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(weakest)
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(phrases: DataFrame, covered: int) -> DataFrame:
    """Drops a phrase that a longer one contains with at least `covered` percent of its places."""
    inner = (
        phrases.where(F.col("words") > 2)
        .withColumn("own", F.split("phrase", " "))
        .withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
        .withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
        .select("lang", _joined("slice(own, at, size)").alias("phrase"), F.col("a").alias("outer"))
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    held = phrases.join(inner, ["lang", "phrase"], "left")
    loose = F.coalesce(100 * F.col("outer") < covered * F.col("a"), F.lit(True))
    return held.where(loose).drop("outer")


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """The `top` phrases of each language by how much more often they occur than their parts let expect."""
    phrases, totals = frequent_phrases(docs, mining)
    best = uncovered(scored(phrases, totals), mining.covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
    (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest c WHERE NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
