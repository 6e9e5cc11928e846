"""Exact duplicates: 128-bit content hash, then the bytes themselves.

Texts are compared without the white space of `WHITE`. A first grouping keys rows by hash
and bytes, so two texts of one hash never share a group, and every map task sends each
distinct text once, however many copies it holds. Rows get their group by hash and digest.

Defined results: a null text equals an empty one; a null id loses against every id and is
kept only if its group has no other; rows that repeat an id and a text count one by one in
`group_size`, carry the same `kept` in `mark_copies`, and `drop_copies` returns one of them.
Only the named columns are read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import WHITE, free_name, table, whole_text

# Wider than any id, so that a rank orders by length first and by smaller id second.
ID_SPAN, NO_ID = 2**65, 2**63


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole_text(text), f"{WHITE}+", "")


def content_hash(text: Column) -> Column:
    """128 bits over the bytes of the text."""
    return F.unhex(F.md5(text))


def copy_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per distinct text: hash, digest, the id that stays, and the number of rows."""
    text, chars = normalised(F.col("text")), F.char_length(whole_text()).cast("bigint")
    ids = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), _number(NO_ID))
    span = chars.cast("decimal(18,0)") * _number(ID_SPAN)
    rows = docs.select(text.alias("bytes"), chars.alias("chars"), (span - ids).alias("rank"))
    groups = rows.groupBy(hash_of(F.col("bytes")).alias("hash"), "bytes").agg(
        F.max("chars").alias("chars"), F.max("rank").alias("rank"), F.count("*").alias("rows")
    )
    first = F.col("chars").cast("decimal(18,0)") * _number(ID_SPAN) - F.col("rank")
    return groups.select(
        "hash",
        F.sha2(F.col("bytes"), 256).alias("text_sha256"),
        F.when(first != _number(NO_ID), first.cast("bigint")).alias("keep_id"),
        F.col("rows").alias("group_size"),
    )


def mark_copies(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per document with its group, its group's survivor and whether it is that."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("bytes")).select(
        "doc_id", hash_of(F.col("bytes")).alias("hash"), F.sha2(F.col("bytes"), 256).alias("text_sha256")
    )
    return rows.join(copy_groups(docs, hash_of), ["hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """The documents that stay, in their own columns; one row of those that repeat an id."""
    # Plain keys, so that the join's partitions also serve to drop repeated rows.
    key, digest = free_name(docs, "doc_key"), free_name(docs, "text_sha256")
    kept = copy_groups(docs, hash_of).select(
        _key(F.col("keep_id")).alias(key), F.col("text_sha256").alias(digest)
    )
    rows = docs.withColumns({key: _key(F.col("doc_id")), digest: F.sha2(normalised(F.col("text")), 256)})
    found = rows.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest])
    return found.select(*docs.columns)


def _key(doc_id: Column) -> Column:
    """The id as text; a null id is the empty text, which no id is."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bytes
  FROM documents
), ranked AS (
  SELECT doc_id, bytes, count(*) OVER (PARTITION BY bytes) AS group_size,
         first_value(doc_id) OVER (PARTITION BY bytes ORDER BY chars DESC, doc_id) AS keep_id
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bytes) AS text_sha256
FROM ranked
"""
