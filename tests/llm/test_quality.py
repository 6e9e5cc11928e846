import math
import zlib

import pytest

from fieldledger.llm import quality
from fieldledger.llm.common import table


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = quality.op9_quality(spark, sf_dir)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    scored = rows.collect()
    assert len(scored) == table(spark, sf_dir, "documents").count()
    for row in scored:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
    held = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.95 * len(held)
    assert sum(p for p, q in held if q) >= 0.98 * sum(q for _, q in held)


LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, 0, "clash") for i, q in rows], LABELS)


@pytest.fixture(scope="module")
def small(make_docs):
    good = "The quiet river runs past old houses, and people walk there every day number {}."
    rows = [(i, good.format(i) * 3 if i % 3 else "BUY!!! $$$ ### " * 9) for i in range(90)]
    extra = [(None, None), (500, ""), (501, None), (3, "repeat of an id"), (502, "word " * 50_000), (503, "\n \t")]
    return make_docs(rows + extra)


def test_nulls_and_contradictory_labels(spark, small):
    rows = [(i, int(i % 3 > 0)) for i in range(90)] + [(1, 0), (None, 1), (4, None), (5, 7)]
    scored = quality.score_documents(small, labelled(spark, rows)).collect()
    assert len(scored) == small.count()
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in scored)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in scored if r.doc_id is not None and 5 < r.doc_id < 90]
    assert all(right)
    kept = quality.accepted(small, labelled(spark, rows))
    assert kept.columns == small.columns
    accepted = sorted(str(r.doc_id) for r in scored if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == accepted


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)], [(0, 0)]])
def test_labels_of_one_kind(spark, small, rows):
    scores = {r.score for r in quality.score_documents(small, labelled(spark, rows)).collect()}
    known = [q for i, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(scores) == 1
    assert scores.pop() == pytest.approx((sum(known) + 1) / (len(known) + 2))


def test_bounded_sample_and_empty_table(spark, small, make_docs):
    rows = [(i, int(i % 3 > 0)) for i in range(90)]
    stats = quality.text_statistics(small)
    model = quality.fit(stats, labelled(spark, rows), train_rows=30)
    assert model.rules
    assert quality.score_documents(make_docs([]), labelled(spark, rows)).count() == 0


def test_rules_are_sparse_columns(spark, small):
    rows = [(i, int(i % 3 > 0)) for i in range(90)]
    model = quality.fit(quality.text_statistics(small), labelled(spark, rows))
    assert 0 < len(model.rules) < quality.TREES * 2 ** (quality.DEPTH + 1)
    assert all(rule.bounds and weight for rule, weight in model.rules)
