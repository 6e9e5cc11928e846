import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fieldledger.llm import bpe, word_ids

RANKS = public_tokenizers.path(bpe.RANKS)
PARTS = [" ", "  ", "\n", "\t", "a", "word", "'s", "'", "12", "!!", "é", "　", "\xa0", "漢字", "😀", "'ll", "don't"]


def noise(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice(PARTS) for _ in range(n))


TEXTS = [None, "", " ", "one", "don't  stop\n\n now", "x" * 700, " " * 500, "=" * 900 + " tail of words " * 40]
TEXTS += [noise(seed, 400) for seed in range(12)] + ["plain words here " * 200]


def digests(text):
    ids = bpe.encoding(RANKS).encode_ordinary(text or "")
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(8192, 512), (64, 24), (100, 60), (150, 40)])
def test_ids_and_round_trip(make_docs, chunk, overlap):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "one"), (7, TEXTS[-1])]
    got = bpe.token_digests(make_docs(rows), RANKS, chunk, overlap).collect()
    want = sorted((str(i), *digests(text)) for i, text in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_chunks_are_cut_and_glued(make_docs):
    docs = make_docs([(1, "plain words here " * 200), (2, "=" * 900)]).select("doc_id", "text")
    from pyspark.sql import functions as F

    chunks = bpe.chunk_texts(docs.withColumn("row", F.col("doc_id")), 64, 24)
    pieces = bpe.stitch(chunks, bpe.chunk_edges(chunks, 64, 24)).collect()
    assert sum(p.doc_id == 1 for p in pieces) > 40 and sum(p.doc_id == 2 for p in pieces) == 1


def test_overlap_must_fit(make_docs):
    with pytest.raises(ValueError):
        bpe.token_digests(make_docs([(1, "a")]), RANKS, 64, 64)


def test_empty_table(make_docs):
    assert bpe.token_digests(make_docs([]), RANKS).count() == 0


@pytest.mark.parametrize("slice_bytes", [1, 500, 8 << 20])
def test_word_ids_equal_the_tokenizer(monkeypatch, slice_bytes):
    monkeypatch.setattr(word_ids, "SLICE_BYTES", slice_bytes)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [text or "" for text in TEXTS] + ["<|endoftext|> as text"]
    want = [found.ids for found in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in word_ids.all_ids(pa.array(texts), RANKS)] == want
