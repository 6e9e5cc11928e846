"""Repair of conversations by Knuth's lightest-derivation agenda.

A conversation is in order when its role initials read `(s?(ua)+)?` and no row is blank or repeated.
An item of the deduction says that the first rows of a conversation, edited, bring a small
automaton into some state. Keeping, rerolling or deleting the next row and inserting an empty row
deduce further items, and each deduction adds its cost and its letter: the pair (cost, audit) never
falls and keeps its order under further edits, since of two audits of one item and one cost
neither begins the other. So the agenda pops every item first with its least pair, and ends with the
first item that covers all rows in an accepting state.

Conversations of more than `rows` rows or `bytes` bytes are cut into blocks. A block's table
holds its least pair from every state to every state; neighbouring tables are deductions of the same
kind and are joined `FAN` at a time, in rounds, so no task gets a long conversation at once. Only its
repaired texts, whose digest has to be taken in order, pass through one task, as a stream.

Defined results: null ids form one conversation, whose id counts as one space in the damage, as do null
turns, roles and texts; null turns come first; differing rows of one turn come in the order of a hash of
role and text; repeated rows are faults of the second and later ones; an empty role fits nowhere;
texts of any length are read whole; a conversation without rows has zeros, no audit and
the digest of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import blocks_of, on_workers, staged, table

SPACES = " \t\n\x0b\x0c\r"
STATES = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = STATES
ACCEPTED = (EMPTY, ASSISTANT)
NEXT = {
    (EMPTY, "s"): SYSTEM,
    (EMPTY, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
CHANGE, DELETE, UNFINISHED = 2, 3, 1
FAN = 64
BATCH_ROWS = 1024

Weight = tuple[int, str]
Edge = tuple[str, int, int, int]


@dataclass(frozen=True)
class Large:
    """Conversations beyond these sizes are cut into blocks of `rows` rows."""

    rows: int = 1024
    bytes: int = 64 << 20


@dataclass(frozen=True)
class Row:
    """What the repair needs to know of a row."""

    initial: str
    lost: bool
    unfinished: bool


def wanted(state: int) -> str:
    """The initial of the row that a reroled or inserted one becomes."""
    return "a" if state == USER else "u"


def lightest(
    start: int, last: int, edges: Callable[[int, int], Iterable[Edge]], goals: Iterable[int], all_goals: bool
) -> dict[int, Weight]:
    """Least pairs of the goal states behind place `last`: of the best goal, or of each that can be reached.

    `edges(place, state)` gives letters, cost, next place and next state of every deduction.
    """
    agenda, closed, found = [(0, "", 0, start)], set(), {}
    left = set(goals)
    while agenda and left:
        cost, audit, place, state = heappop(agenda)
        if (place, state) in closed:
            continue
        closed.add((place, state))
        if place == last and state in left:
            found[state] = (cost, audit)
            if not all_goals:
                break
            left.remove(state)
        for letters, more, then, into in edges(place, state):
            if (then, into) not in closed:
                heappush(agenda, (cost + more, audit + letters, then, into))
    return found


def edits_of(rows: list[Row]) -> Callable[[int, int], Iterator[Edge]]:
    """Deductions by one edit."""

    def edges(place: int, state: int) -> Iterator[Edge]:
        into = NEXT[state, wanted(state)]
        yield "I", CHANGE, place, into
        if place == len(rows):
            return
        row = rows[place]
        yield "D", DELETE, place + 1, state
        if row.lost:
            return
        extra = UNFINISHED if row.unfinished else 0
        yield "R", CHANGE + extra, place + 1, into
        kept = NEXT.get((state, row.initial))
        if kept is not None:
            yield "K", extra, place + 1, kept

    return edges


Table = dict[tuple[int, int], Weight]


def table_of(rows: list[Row]) -> Table:
    """Least pairs of a block from every state to every state."""
    edges, found = edits_of(rows), {}
    for start in STATES:
        for state, weight in lightest(start, len(rows), edges, STATES, True).items():
            found[start, state] = weight
    return found


def joined(tables: list[Table]) -> Table:
    """The table of neighbouring blocks together."""

    def edges(place: int, state: int) -> Iterator[Edge]:
        for into in STATES if place < len(tables) else ():
            if (state, into) in tables[place]:
                cost, audit = tables[place][state, into]
                yield audit, cost, place + 1, into

    found = {}
    for start in STATES:
        for state, weight in lightest(start, len(tables), edges, STATES, True).items():
            found[start, state] = weight
    return found


def best_repair(rows: list[Row]) -> Weight:
    return next(iter(lightest(EMPTY, len(rows), edits_of(rows), ACCEPTED, False).values()))


class Repaired:
    """Applies an audit to the rows of a conversation, given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.put(wanted(self.state), None, "")
            self.at += 1

    def put(self, initial: str, role: str | None, text: str) -> tuple[str, str]:
        self.state = NEXT[self.state, initial]
        return role if role is not None else ROLES[initial], text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            yield self.put(role[:1], role, text)
        elif letter == "R":
            yield self.put(wanted(self.state), None, text)


class Digest:
    """SHA-256 of `role:text` lines that come one by one."""

    def __init__(self) -> None:
        self.hash, self.first = hashlib.sha256(), True

    def add(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False


@dataclass
class Facts:
    """Counts of a run of rows, with what is needed to join it to the next run."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, other: Facts) -> None:
        """Takes in the run that follows; turns never fall."""
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.high is not None and self.high == other.low:
            self.turns -= 1
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    def row(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> Row:
        faults = (blank, duplicate and not blank, truncated and not blank and not duplicate)
        self.add(Facts(1, *faults, 0, int(turn is not None), turn, turn, initial, initial))
        return Row(initial, blank or duplicate, faults[2])

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def told(self) -> tuple[int, ...]:
        return self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal


FACTS = (
    "rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first string, last string"
)
TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "place long, role string, text string"


def in_order(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of equal keys in one task, in the given order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def _space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with seeded faults; dropped ones stay, marked as `gone`, so that no id is lost."""
    seed = F.crc32(F.concat_ws(":", _space("conv_id"), _space("turn")).cast("binary")) % 20
    text, role = _space("text"), _space("role")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(seed == 4, "user").otherwise(role).alias("role"),
        F.when(seed == 1, "").when(seed == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (seed == 0).alias("gone"),
        F.explode(F.when(seed == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def plain(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form of `damaged`."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _space("role").alias("role"), _space("text").alias("text"), F.lit(False).alias("gone"),
        F.lit(0).alias("copy"),
    )


def looked_at(rows: DataFrame) -> DataFrame:
    """Adds what can be told of a row alone."""
    ended = F.rtrim("text", F.lit(SPACES))
    return rows.withColumns(
        {
            "initial": F.substring("role", 1, 1),
            "blank": ended == "",
            "truncated": ~F.substring(ended, -1, 1).isin(".", "!", "?"),
            "tie": F.xxhash64("role", "text"),
        }
    )


def whole_conversations(rows: DataFrame, schema: str, kind: Callable) -> DataFrame:
    """`kind` of each conversation: its id, facts, best repair and rows."""

    def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in blocks_of(batches, ["conv_id"]):
            facts, seen, own, texts = Facts(), set(), [], []
            for i, gone in enumerate(held["gone"]):
                if gone:
                    continue
                text = (held["role"][i], held["text"][i])
                flags = held["blank"][i], text in seen, held["truncated"][i]
                own.append(facts.row(held["turn"][i], held["initial"][i], *flags))
                seen.add(text)
                texts.append(text)
            yield from kind(held["conv_id"][0], facts, *best_repair(own), texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = repairs(batches)
        while rows := list(islice(found, BATCH_ROWS)):
            yield _batch(rows, schema)

    return on_workers(rows.drop("tie", "copy")).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.record_batch(arrays, schema=pa.schema(fields))


SUMMARY = f"conv_id long, {TOLD}, repaired_sha256 string"


def summary(conv_id: int | None, facts: Facts, cost: int, audit: str, texts: list) -> Iterator[tuple]:
    digest, repaired = Digest(), Repaired(audit)
    for text in texts:
        digest.add(repaired.row(*text))
    digest.add(repaired.inserted())
    yield conv_id, *facts.told(), cost, audit, digest.hash.hexdigest()


ROWS = f"conv_id long, {REPAIRED}"


def repaired_rows(conv_id: int | None, facts: Facts, cost: int, audit: str, texts: list) -> Iterator[tuple]:
    repaired = Repaired(audit)
    found = chain(chain.from_iterable(repaired.row(*text) for text in texts), repaired.inserted())
    for place, row in enumerate(found):
        yield conv_id, place, *row


# Long conversations.


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt by ranges of their order, numbered in that order, with duplicates marked."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "tie", "copy", "salt"]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    dealt_rows = salted.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = staged(dealt_rows.withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    digest = F.sha2(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"), 256)
    marked = placed.withColumns({"digest": digest, "block": F.expr(f"at div {size}")})
    seen = marked.where(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min("at").alias("first"))
    own, other = marked.alias("own"), seen.withColumnRenamed("conv_id", "other").alias("seen")
    same = F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("own.digest") == F.col("seen.digest"))
    duplicate = (F.col("first") < F.col("at")).alias("duplicate")
    return staged(marked.alias("own").join(other, same, "left").select("own.*", duplicate), "conversation-marks")


PAIRS = ", ".join(f"cost_{p}{q} long, audit_{p}{q} string" for p in STATES for q in STATES)
BLOCK = f"conv_id long, block long, {FACTS}, {PAIRS}"


def block_row(conv_id: int | None, block: int, facts: Facts, found: Table) -> pa.RecordBatch:
    cells = [cell for p in STATES for q in STATES for cell in found.get((p, q), (None, None))]
    return _batch([(conv_id, block, *vars(facts).values(), *cells)], BLOCK)


def block_tables(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, ["block", "conv_id"]):
            facts, own = Facts(), []
            for i, gone in enumerate(held["gone"]):
                if not gone:
                    flags = held["blank"][i], bool(held["duplicate"][i]), held["truncated"][i]
                    own.append(facts.row(held["turn"][i], held["initial"][i], *flags))
            yield block_row(held["conv_id"][0], held["block"][0], facts, table_of(own))

    columns = marked.select(
        "block", "conv_id", "at", "turn", "gone", "initial", "blank", "duplicate", "truncated"
    )
    return on_workers(in_order(columns, ["block", "conv_id"], "at")).mapInArrow(run, BLOCK)


def join_tables(tables: DataFrame) -> DataFrame:
    """Joins `FAN` neighbouring blocks of a conversation into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, ["conv_id", "block"]):
            facts, parts = Facts(), []
            for i in range(len(held["block"])):
                facts.add(Facts(*(held[f.split()[0]][i] for f in FACTS.split(", "))))
                cells = {(p, q): (held[f"cost_{p}{q}"][i], held[f"audit_{p}{q}"][i]) for p in STATES for q in STATES}
                parts.append({key: cell for key, cell in cells.items() if cell[0] is not None})
            yield block_row(held["conv_id"][0], held["block"][0], facts, joined(parts))

    grouped = tables.withColumn("part", F.col("block")).withColumn("block", F.expr(f"block div {FAN}"))
    return on_workers(in_order(grouped, ["conv_id", "block"], "part")).mapInArrow(run, BLOCK)


def long_repairs(marked: DataFrame) -> DataFrame:
    """Facts and best repair of every long conversation."""
    tables = staged(block_tables(marked), "repair-blocks")
    # Blocks are numbered within their conversation, on narrow rows: one for each block.
    order = Window.partitionBy("conv_id").orderBy("block")
    numbers = tables.select(
        "conv_id", F.col("block").alias("old"), (F.row_number().over(order) - 1).cast("long").alias("number")
    )
    numbers = numbers.withColumnRenamed("conv_id", "other")
    same = F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("block") == F.col("old"))
    tables = tables.join(numbers, same).withColumn("block", F.col("number"))
    tables = staged(tables.select(*(f.split()[0] for f in BLOCK.split(", "))), "repair-blocks")
    while not tables.where(F.col("block") > 0).isEmpty():
        tables = staged(join_tables(tables), "repair-blocks")
    goals = [F.struct(F.col(f"cost_0{q}").alias("cost"), F.col(f"audit_0{q}").alias("audit")) for q in ACCEPTED]
    best = F.array_min(F.filter(F.array(*goals), lambda goal: goal["cost"].isNotNull()))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    told = tables.withColumns({"best": best, "gaps": gaps})
    return told.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"
    )


def long_streams(marked: DataFrame, repairs: DataFrame, out: str, digests: bool) -> DataFrame:
    """Digest or repaired rows of long conversations, each read once in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, repaired, digest, place = None, None, None, 0

        def finished() -> Iterator[pa.RecordBatch]:
            rows = list(repaired.inserted())
            digest.add(rows)
            if digests:
                yield _batch([(owner, digest.hash.hexdigest())], out)
            else:
                yield _batch([(owner, place + i, *row) for i, row in enumerate(rows)], out)

        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text", "gone")]
            for conv_id, audit, role, text, gone in zip(*columns, strict=True):
                if audit is not None:
                    # The audit comes in front of the rows of its conversation.
                    if repaired is not None:
                        if found:
                            yield _batch(found, out)
                            found = []
                        yield from finished()
                    owner, repaired, digest, place = conv_id, Repaired(audit), Digest(), 0
                elif not gone:
                    rows = list(repaired.row(role, text))
                    if digests:
                        digest.add(rows)
                    else:
                        found += [(owner, place + i, *row) for i, row in enumerate(rows)]
                        place += len(rows)
            if found:
                yield _batch(found, out)
        if repaired is not None:
            yield from finished()

    none = F.lit(None).cast("string")
    heads = repairs.select(
        "conv_id", F.lit(-1).cast("long").alias("at"), "audit", none.alias("role"), none.alias("text"),
        F.lit(False).alias("gone"),
    )
    rows = marked.select("conv_id", "at", none.alias("audit"), "role", "text", "gone")
    return on_workers(in_order(heads.unionByName(rows), ["conv_id"], "at")).mapInArrow(run, out)


def _by_size(rows: DataFrame, large: Large) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that one task may hold, and of those that are longer."""
    sizes = rows.groupBy("conv_id").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes")
    )
    long = sizes.where((F.col("rows") > large.rows) | (F.col("bytes") > large.bytes))
    long = staged(long.select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long")), "long-conversations")
    if long.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def _short(rows: DataFrame, schema: str, kind: Callable) -> DataFrame:
    return whole_conversations(in_order(rows, ["conv_id"], "turn", "tie", "copy"), schema, kind)


def repair_summary(rows: DataFrame, large: Large = Large()) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every conversation; rows as by `plain` or `damaged`."""
    short, long = _by_size(looked_at(rows), large)
    found = _short(short, SUMMARY, summary)
    if long is None:
        return found
    marked = in_blocks(long, large.rows)
    repairs = staged(long_repairs(marked), "long-repairs")
    digests = long_streams(marked, repairs, "conv_id long, repaired_sha256 string", True)
    digests = digests.withColumnRenamed("conv_id", "other")
    told = repairs.join(digests, F.col("conv_id").eqNullSafe(F.col("other"))).drop("other")
    return found.unionByName(told)


def repair(rows: DataFrame, large: Large = Large()) -> DataFrame:
    """The repaired rows of every conversation: `conv_id`, `place` from 0, `role`, `text`."""
    short, long = _by_size(looked_at(rows), large)
    found = _short(short, ROWS, repaired_rows)
    if long is None:
        return found
    marked = in_blocks(long, large.rows)
    return found.unionByName(long_streams(marked, staged(long_repairs(marked), "long-repairs"), ROWS, False))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damaged(table(spark, sf_dir, "conversations")))
