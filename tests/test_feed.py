import pytest

from fieldledger.operators import feed
from fieldledger.plans.queries import _cursor
from fieldledger.schemas import CHANGE_LOG
from fieldledger.streaming import change_feed

SEQS = [3, 4, 9, 20, 21, 40]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(s, _cursor(s), "Bytes", None, "Add", f"p{s}") for s in SEQS]
    return spark.createDataFrame(rows, CHANGE_LOG)


def seqs(df):
    return [r.seq for r in df.collect()]


def test_sync(spark, log):
    assert seqs(feed.sync(log)) == [3]
    assert seqs(feed.sync(log, _cursor(9))) == [20]
    assert seqs(feed.sync(log, _cursor(40))) == []
    assert seqs(feed.sync(log, _cursor(7))) == []
    assert seqs(feed.sync(spark.createDataFrame([], CHANGE_LOG))) == []
    with pytest.raises(ValueError):
        feed.sync(log, "not an id")


def test_draining_one_by_one_gives_the_log(log):
    seen, last = [], None
    while rows := feed.sync(log, last).collect():
        seen.append(rows[0].seq)
        last = rows[0].id
    assert seen == SEQS
    assert sorted(seqs(feed.drain(log))) == SEQS
    assert sorted(seqs(feed.drain(log, _cursor(9)))) == [20, 21, 40]


def test_position_is_read_from_the_scan(spark, log, tmp_path, plan):
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    text = plan(feed.sync(stored, _cursor(9)))
    assert "TakeOrderedAndProject" in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("width", [1, 4, 1 << 20])
def test_consumers(spark, log, limit, width, plan):
    asked = [("new", None), ("new too", None), ("mid", 9), ("mid too", 9), ("last", 40), ("odd", 7)]
    rows = [(name, None if seq is None else _cursor(seq)) for name, seq in asked]
    cursors = spark.createDataFrame(rows, "consumer string, cursor string")
    answers = feed.next_entries(log, cursors, limit=limit, width=width)
    got = {r.consumer: r.seq for r in answers.collect()}
    assert got == {"new": 3, "new too": 3, "mid": 20, "mid too": 20, "last": None, "odd": None}
    assert "NestedLoop" not in plan(answers) and "Cartesian" not in plan(answers)


def test_stream_takes_each_file_once(spark, log, tmp_path):
    paths = [str(tmp_path / name) for name in ("log", "out", "cursor")]

    def follow():
        change_feed.follow(spark, *paths, files_per_trigger=1).awaitTermination()
        return sorted(seqs(spark.read.parquet(paths[1])))

    log.where("seq < 10").repartition(2).write.parquet(paths[0])
    assert follow() == [3, 4, 9]
    assert follow() == [3, 4, 9]
    log.where("seq >= 10").write.mode("append").parquet(paths[0])
    assert follow() == SEQS
