"""The registered queries on whole small tables against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import test_bpe
import test_licenses
import test_near_dedup
import test_packing
import test_secrets
import test_vectors
from fieldledger.llm.common import table
from fieldledger.llm.packing import Limits
from fieldledger.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


def result(spark, sf_dir, name):
    return {row[0]: row for row in QUERIES[name](spark, sf_dir).collect()}


def test_byte_bpe(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op2_byte_bpe")
    assert {i: tuple(row)[1:] for i, row in got.items()} == {i: test_bpe.digests(t) for i, t in texts.items()}


def test_packing_covers_every_document(spark, sf_dir, texts):
    test_packing.check(QUERIES["op5_packing"](spark, sf_dir).collect(), texts, Limits())


def test_license_places(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op6_licenses")
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {i: tuple(row[c] for c in columns) for i, row in got.items()} == {
        i: test_licenses.brute(t) for i, t in texts.items()
    }


def test_secret_spans(spark, sf_dir, texts):
    for i, row in result(spark, sf_dir, "op10_secrets").items():
        spans = test_secrets.base(texts[i] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(row.spans.split(",")) or not spans


def test_near_components(spark, sf_dir, texts, monkeypatch):
    monkeypatch.setattr(test_near_dedup, "ROWS", list(texts.items()))
    got = result(spark, sf_dir, "op3_minhash_near_dedup")
    want = test_near_dedup.expected()
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want


def test_vector_links(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    points = test_vectors.vectors.units(np.array([v for _, v in rows], dtype=float))
    links = (points @ points.T >= 0.9).sum(axis=1) - 1
    got = result(spark, sf_dir, "op8_embedding_near_dedup")
    found = [got[i].n_links for i, _ in rows]
    assert all(f <= n for f, n in zip(found, links, strict=True)) and sum(found) >= 0.9 * links.sum()


def test_long_repeats_are_found(spark, sf_dir, texts):
    where = defaultdict(set)
    for i, text in texts.items():
        words = [w for w in "".join(c.lower() if c < "\x7f" else c for c in text or "").split()]
        for at in range(len(words) - 50):
            where[tuple(words[at : at + 51])].add(i)
    shared = {i for ids in where.values() if len(ids) > 1 for i in ids}
    assert shared <= {r.doc_id for r in QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
