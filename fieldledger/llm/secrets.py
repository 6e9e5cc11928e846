"""Secrets, judged by how many owners in the corpus hold the same value.

Every text is scanned once for base spans of three kinds and for further long mixed tokens.
The values' hashes are counted over the whole corpus by distinct repositories and owners,
first per value, repository and owner, so that a value copied into a third of all texts is
summed where it is read. A value that `SHARED_OWNERS` owners or `SHARED_REPOSITORIES`
repositories or more hold is an example that people copy; any other looks live. Base spans always stay in the result; a further
token is added, as kind `owned`, if it looks live.

Defined results: a null text is empty and has no spans; a null owner or repository is one of
its own; repeated rows are scanned row by row and count once in the ownership; a null id
stays null. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import free_name, map_batches, staged, table, whole_text

# The base patterns, and the words without which the first cannot match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "owned")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
LEAST_DIGITS, LEAST_LETTERS, LEAST_BITS = 3, 3, 3.0

SHARED_OWNERS, SHARED_REPOSITORIES = 3, 4
MARK = "[REDACTED]"

FOUND = "array<struct<start: int, kind: int, end: int, value: long>>"
SCAN = (
    "row long, doc_id long, owner string, repository string, n_assign long, n_access long, "
    f"n_hex long, base_sha256 string, text_hash long, found {FOUND}"
)


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, number of the kind, end and value, by start and kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for match in ASSIGN.finditer(text):
            if len(match[2]) >= LEAST_ASSIGN:
                found.append((match.start(), 0, match.end(), match[2]))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if len(match[0]) >= LEAST_ACCESS:
                found.append((match.start(), 1, match.end(), match[0]))
    found += [(match.start(), 2, match.end(), match[0]) for match in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    if digits < LEAST_DIGITS or letters < LEAST_LETTERS:
        return False
    counts = Counter(token).values()
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts) >= LEAST_BITS


def further_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Long mixed tokens that touch no base span."""
    found = []
    for match in MIXED.finditer(text):
        start, end = match.span()
        if looks_random(match[0]) and not any(s < end and start < e for s, _, e, _ in base):
            found.append((start, 3, end, match[0]))
    return found


def span_text(kind: int, start: int, end: int) -> str:
    return f"{KINDS[kind]}:{start}:{end}"


def scan_documents(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document with the spans found and the hashes of their values."""

    def scan(batch):
        counts, digests, found = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            kinds = Counter(kind for _, kind, _, _ in base)
            counts.append([kinds[0], kinds[1], kinds[2]])
            joined = ",".join(span_text(kind, start, end) for start, kind, end, _ in base)
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            spans = base + further_spans(text, base)
            found.append(
                [{"start": s, "kind": k, "end": e, "value": value_hash(v)} for s, k, e, v in spans]
            )
        kept = [batch.column(name) for name in ("row", "doc_id", "owner", "repository")]
        numbers = [pa.array([row[i] for row in counts], pa.int64()) for i in range(3)]
        struct = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])
        yield pa.record_batch(
            [*kept, *numbers, pa.array(digests), batch.column("text_hash"), pa.array(found, pa.list_(struct))],
            names=["row", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex"]
            + ["base_sha256", "text_hash", "found"],
        )

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        whole_text().alias("text"),
        F.xxhash64(whole_text()).alias("text_hash"),
    )
    # Written once: the spans are counted and judged, and row numbers must not change.
    return staged(map_batches(texts, scan, SCAN), "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value."""
    once = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("places"))
    owners = once.groupBy("value", "owner").agg(
        F.count("*").alias("repositories"), F.sum("places").alias("places")
    )
    return owners.groupBy("value").agg(
        F.count("*").alias("owners"),
        F.sum("repositories").alias("repositories"),
        F.sum("places").alias("places"),
    )


def judged_documents(
    scanned: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """`row` and its sorted `spans`, each with whether it looks live."""
    spans = scanned.select("row", "owner", "repository", F.inline("found"))
    # Written, so that a value of very many spans is split like any skewed join key.
    owned = staged(ownership(spans), "secret-owners")
    live = (F.col("owners") < shared_owners) & (F.col("repositories") < shared_repositories)
    base = F.col("kind") < KINDS.index("owned")
    judged = spans.join(owned, "value").where(base | live)
    return judged.groupBy("row").agg(
        # The spans of one text.
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", live.alias("live")))).alias("spans")
    )


def find_secrets(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    shared_owners: int = SHARED_OWNERS,
    shared_repositories: int = SHARED_REPOSITORIES,
) -> DataFrame:
    """Every document with its counts of base spans, their digest, and all its spans."""
    scanned = scan_documents(docs, owner, repository)
    judged = judged_documents(scanned, shared_owners, shared_repositories)
    names = F.array(*[F.lit(kind) for kind in KINDS])
    written = F.transform(
        "spans", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
    )
    live = F.size(F.filter("spans", lambda s: s["live"]))
    rows = scanned.join(judged, "row", "left")
    return rows.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(written, ","), F.lit("")).alias("spans"),
        F.when(F.col("spans").isNull(), 0).otherwise(live).cast("bigint").alias("n_live"),
    )


def redact(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """The documents in their own columns; spans that look live are replaced by `MARK`."""
    scanned = scan_documents(docs, owner, repository)
    spans, key = free_name(docs, "spans"), free_name(docs, "text_hash")
    live = scanned.join(judged_documents(scanned), "row").select(
        F.col("doc_id").alias(f"{key}_id"),
        F.col("text_hash").alias(f"{key}_found"),
        F.filter("spans", lambda s: s["live"]).alias(spans),
    )
    live = live.where(F.size(spans) > 0).dropDuplicates([f"{key}_id", f"{key}_found"])
    rows = docs.withColumn(key, F.xxhash64(whole_text()))
    same = rows["doc_id"].eqNullSafe(live[f"{key}_id"]) & (rows[key] == live[f"{key}_found"])
    joined = rows.join(live, same, "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_without(whole_text(), F.col(spans)))
    done = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        done = done.withColumn("n_chars", chars)
    return done.select(*docs.columns)


def _without(text: Column, spans: Column) -> Column:
    """The text with sorted spans, which may overlap, replaced."""

    def step(done: Column, span: Column) -> Column:
        before = F.concat(done["out"], text.substr(done["at"] + 1, span["start"] - done["at"]), F.lit(MARK))
        return F.struct(
            F.when(span["start"] >= done["at"], before).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, none, step, rest)


def repository_of() -> Column:
    """The test tables name no repository; a source's texts of one language stand for one."""
    return F.concat_ws("/", "source", "lang")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), F.col("source"), repository_of())
