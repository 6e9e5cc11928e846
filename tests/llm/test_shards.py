import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldledger.llm import shards
from fieldledger.llm.common import table
from fieldledger.llm.shards import Placement, Run, find_placement, op12_sharding, partition, sharded, sized_texts


def needed(sizes, capacity):
    """Shards that a greedy walk over the sizes takes."""
    count, room = 0, 0
    for size in sizes:
        if size > capacity:
            return float("inf")
        if size > room:
            count, room = count + 1, capacity
        room -= size
    return count


def least_capacity(sizes, count):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(sizes, c) <= count)


def splitter(units):
    """`split_runs` over a list of (hash, size)."""

    def split(runs, parts):
        found = defaultdict(list)
        for run_number, run in enumerate(runs):
            step = (run.last - run.first) // parts + 1
            for unit, size in units:
                if run.first <= unit <= run.last:
                    found[run_number, (unit - run.first) // step].append((unit, size))
        return sorted(
            (Run(min(v)[0], max(v)[0], sum(s for _, s in v), len(v)) for v in found.values()), key=lambda r: r.first
        )

    return split


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 60)), min_size=1, max_size=60, unique_by=lambda x: x[0]),
    st.integers(1, 9),
    st.sampled_from([2, 4, 16, 1 << 16]),
)
def test_capacity_is_the_smallest_whatever_the_driver_sees(units, count, most_runs):
    units = sorted(units)
    sizes = [s for _, s in units]
    cuts, capacity = partition(splitter(units), count, most_runs)
    assert capacity == least_capacity(sizes, count)
    assert len(cuts) == count - 1 and cuts == sorted(cuts)
    held = defaultdict(int)
    for unit, size in units:
        held[sum(unit >= cut for cut in cuts)] += size
    assert max(held.values()) <= capacity


def check(rows, docs, count):
    """Contract of the result: rows as (doc_id, size, shard, slot), docs as (id, text)."""
    assert sorted(r[0] for r in rows) == sorted(i for i, _ in docs)
    slots, shard_of, text_of = defaultdict(list), defaultdict(set), dict(docs)
    for doc_id, size, shard, slot in rows:
        text = text_of[doc_id] or ""
        assert size == len(text.encode()) + 16 and 0 <= shard < count
        slots[shard].append(slot)
        shard_of[text].add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    rows = op12_sharding(spark, sf_dir).collect()
    check([(r.doc_id, r.size, r.shard, r.slot) for r in rows], docs, 40)
    texts = dict(docs)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sums, units = defaultdict(int), defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
        units[r.shard, texts[r.doc_id]] += r.size
    largest = max(units.values())
    assert len(sums) == 40 and max(sums.values()) <= max(largest, sum(sums.values()) / 40 + largest)


@pytest.mark.parametrize("most_runs", [4, 1 << 16])
def test_spark_passes_agree_with_brute_force(spark, sf_dir, most_runs):
    whole = sized_texts(table(spark, sf_dir, "documents"), "unit", "bytes")
    units = whole.groupBy("unit").sum("bytes").toDF("unit", "bytes").cache()
    found = find_placement(units, 7, most_runs)
    sizes = [r.bytes for r in units.where(~units.unit.isin([0, *found.giants])).orderBy("unit").collect()]
    giants = [r.bytes for r in units.where(units.unit.isin([0, *found.giants])).collect()]
    assert found.capacity == max([least_capacity(sizes, 7 - len(giants)), *giants])


def test_hot_texts_get_a_shard_of_their_own(make_docs):
    docs = [(i, "copy " * 50) for i in range(40)] + [(100 + i, f"other {i} " * 3) for i in range(80)]
    docs += [(300 + i, "second " * 40) for i in range(30)]
    rows = sharded(sized_texts(make_docs(docs), "unit", "bytes"), "unit", "bytes", 6).collect()
    check([(r.doc_id, r.bytes, r.shard, r.slot) for r in rows], docs, 6)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.bytes
    assert sums[0] == 40 * (250 + 16) and sums[1] == 30 * (280 + 16)
    rest = [sums[i] for i in range(2, 6)]
    assert max(rest) - min(rest) <= 2 * max(len(t) + 16 for i, t in docs if 100 <= i < 300)


def test_nulls_empty_and_repeated_rows_and_clashing_columns(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (5, "é" * 30_000)]
    frame = make_docs(docs).withColumnRenamed("score", "shard").withColumnRenamed("spans", "_at")
    placed = sharded(sized_texts(frame, "unit", "bytes"), "unit", "bytes", 3)
    assert placed.columns.count("shard") == 1 and "_at" in placed.columns
    rows = placed.collect()
    assert sorted((r.doc_id or 0, r.bytes) for r in rows) == [(0, 17), (1, 16), (2, 16), (3, 17), (3, 17), (5, 60016)]
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert by_id[1] == by_id[2] and len(by_id[3]) == 1


def test_fewer_texts_than_shards_and_none(make_docs):
    rows = sharded(sized_texts(make_docs([(1, "a"), (2, "b")]), "unit", "bytes"), "unit", "bytes").collect()
    assert len({r.shard for r in rows}) == 2 and {r.slot for r in rows} == {0}
    none = make_docs([(1, "a")]).where("doc_id < 0")
    assert sharded(sized_texts(none, "unit", "bytes"), "unit", "bytes").collect() == []
    units = sized_texts(none, "unit", "bytes").select("unit", "bytes")
    assert find_placement(units, 5) == Placement((), (), 0)


def test_written_shards_hold_the_texts(spark, make_docs, tmp_path):
    docs = [(i, f"text {i % 7}") for i in range(30)]
    shards.write_shards(make_docs(docs), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    check([(r.doc_id, len(r.text) + 16, r.shard, r.slot) for r in back.collect()], docs, 3)
    assert {"lang", "source", "score"} <= set(back.columns)
