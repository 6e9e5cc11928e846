"""Each stage of the pipeline against brute force on the stage's own input."""

import pytest

import corpus_pipeline
import test_near_dedup
import test_packing
import test_secrets
from fieldledger.llm import quality
from fieldledger.llm.common import table
from fieldledger.llm.packing import Limits


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What every stage reads and returns."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        found.append((docs, out))
        docs = out
    return found


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "secret scans", "packing"
    ]
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage_follows_the_score(spark, sf_dir, steps):
    before, after = steps[0]
    scored = quality.score_documents(before, table(spark, sf_dir, "labels")).collect()
    assert set(texts(after)) == {r.doc_id for r in scored if r.predicted}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = {i for i in texts(before) if labels.get(i) == 1}
    assert len(good - set(texts(after))) <= 0.02 * len(good)


def test_exact_stage(steps):
    groups = {}
    for i, text in texts(steps[1][0]).items():
        key = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(text or ""), i))
    assert set(texts(steps[1][1])) == {min(group)[1] for group in groups.values()}


def test_near_stage(steps, monkeypatch):
    monkeypatch.setattr(test_near_dedup, "ROWS", list(texts(steps[2][0]).items()))
    assert set(texts(steps[2][1])) == {i for i, (*_, kept) in test_near_dedup.expected().items() if kept}


def test_secret_stage_changes_nothing_else(steps):
    before, after = map(texts, steps[3])
    assert set(before) == set(after)
    for i, text in before.items():
        if not test_secrets.base(text or ""):
            assert after[i] == text or test_secrets.MARK in after[i]
    hidden = [i for i, text in before.items() if test_secrets.base(text or "")]
    assert all(test_secrets.MARK in after[i] for i in hidden)


def test_packing_stage(steps):
    test_packing.check(steps[4][1].collect(), texts(steps[4][0]), Limits())


def test_run_equals_its_stages(spark, sf_dir, steps):
    rows = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(rows.select("length").toPandas()["length"]) == sum(steps[4][1].toPandas()["length"])
    assert set(rows.select("doc_id").distinct().collect()) == set(steps[4][1].select("doc_id").distinct().collect())
    assert set(columns) <= set(rows.columns)


def test_empty_tables(spark, tmp_path, sf_dir):
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
