import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fieldledger.llm import near_dedup
from fieldledger.llm.shingles import RUN_BYTES, shingle_sets

WORDS = [f"w{i}" for i in range(900)]


def family(draw, n, length, edits):
    base = [draw.choice(WORDS) for _ in range(length)]
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(length)] = draw.choice(WORDS)
        yield " ".join(own)


def make_rows():
    draw = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\tWORDS", "\xa0nbsp stays", "É é", "x y x y x y"]
    texts += [t for _ in range(12) for t in family(draw, 6, 60, 8)]
    texts += list(family(draw, 70, 80, 14)) + [" ".join(draw.choice(WORDS) for _ in range(9000))] * 2
    ids = list(range(1000, 1000 + len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(None, "two words"), (ids[5], "two words")]


ROWS = make_rows()


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return frozenset(zip(words, words[1:], strict=False)) if len(words) != 1 else frozenset([(words[0],)])


def expected():
    sets = {i: shingles(t) for i, t in ROWS if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [256, 8])
def test_components_equal_brute_force(make_docs, chunk):
    got = near_dedup.near_components(make_docs(ROWS), chunk).collect()
    assert len(got) == len(ROWS)
    want = expected()
    assert [r for r in got if r.doc_id is None] == [(None, 1, None, True)]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want


def test_survivors(make_docs):
    docs = make_docs(ROWS)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, _, kept) in expected().items() if kept} | {None}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table(make_docs):
    assert near_dedup.near_components(make_docs([])).count() == 0


def test_sets_across_runs_of_bytes():
    texts = ["a b c", "", "x" * (RUN_BYTES + 5) + " y", "A  B\nc", "tail", "a b c " * 9]
    got = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[0] == got[3]).all() and set(got[0]) < set(got[5])
    assert [len(s) for s in shingle_sets(pa.array(texts)[2:5])] == [1, 2, 1]


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(1)
    factors = near_dedup.register_factors()
    errors = []
    for share in (0.3, 0.6, 0.8, 0.95):
        values = draw.integers(0, 2**64, 1000, dtype=np.uint64)
        both = int(1000 * share)
        a, b = values[: both + (1000 - both) // 2], np.concatenate([values[:both], values[both + (1000 - both) // 2 :]])
        x, y = near_dedup.sketch(a, factors), near_dedup.sketch(b, factors)
        union = near_dedup.sketch(np.union1d(a, b), factors)
        assert (near_dedup.merge_sketches(x, y) == union).all()
        equal, above = np.array([(x == y).sum()]), np.array([(x > y).sum()])
        guess = near_dedup.likely_jaccard(equal, above, 128 - equal - above, len(a), np.array([float(len(b))]))
        errors.append(abs(guess[0] - share))
    assert max(errors) < 0.15
