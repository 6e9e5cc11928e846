import re
from collections import Counter

import pytest

from fieldledger.llm.common import table
from fieldledger.llm.phrases import Mining, collocations, frequent_phrases

SMALL = Mining(least=4, top=50, group=64, hot=8)


def frequencies(rows, longest):
    """Counts of all phrases by language, one place at a time."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for at in range(len(words)):
                for size in range(1, min(longest, len(words) - at) + 1):
                    counts[lang, tuple(words[at : at + size])] += 1
    return counts, totals


def brute(rows, mining):
    counts, totals = frequencies(rows, mining.longest)
    found = {key: a for key, a in counts.items() if a >= mining.least}
    best = {}
    for (lang, phrase), a in found.items():
        if len(phrase) < 2:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = found[lang, phrase[:k]], found[lang, phrase[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        best[lang, phrase] = (a, *min(cuts))
    lost = set()
    for (lang, phrase), (a, *_) in best.items():
        for size in range(2, len(phrase)):
            for at in range(len(phrase) - size + 1):
                inner = (lang, phrase[at : at + size])
                if 100 * a >= mining.covered * best[inner][0]:
                    lost.add(inner)
    out = []
    for lang in totals:
        own = [(p, v) for (g, p), v in best.items() if g == lang and (g, p) not in lost]
        own.sort(key=lambda x: (-x[1][1], -x[1][0], " ".join(x[0]).encode()))
        for rank, (phrase, (a, score, _, l, r)) in enumerate(own[: mining.top], 1):
            out.append((lang, rank, " ".join(phrase), a, l, r, totals[lang], score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "mining", [SMALL, Mining(least=4, top=50), Mining(longest=3, least=2, covered=80, top=5, group=16, hot=3)]
)
def test_equals_brute_force_on_a_whole_table(spark, sf_dir, mining):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(collocations(docs, mining)) == brute(rows, mining)


SCHEMA = "doc_id long, text string, lang string, phrase string, a long, words string, bin long, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, "y", 2, "z") for i, (g, t) in enumerate(rows)], SCHEMA)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (None, "A b. a B! a b"),
        ("und", "a b"),
        ("en", None),
        ("en", ""),
        ("en", " \t.,;:!?\r\n"),
        ("en", "x y, x y; x y: x y"),
        ("en", "u v\x0bu v\x0cu v\ru v"),
        ("de", "É é é é é"),
        ("de", "it's a b it's a b it's a b it's a b \x00 \x00 \x00 \x00 \x00"),
    ] + [("fr", "the same words again and again")] * 6
    mining = Mining(least=3, top=10, group=4, hot=3)
    assert rows_of(collocations(frame(spark, rows), mining)) == brute(rows, mining)


def test_hot_prefixes_of_full_length_are_counted_once(spark):
    rows = [("en", "a a a a a a a a a")] * 40 + [("en", "b a a a a c")] * 5
    mining = Mining(least=3, top=10, group=8, hot=6)
    assert rows_of(collocations(frame(spark, rows), mining)) == brute(rows, mining)


def test_long_text_is_read_whole(spark):
    rows = [("en", "p q r. " * 60_000 + "tail end"), ("en", "tail end")]
    mining = Mining(least=2, top=10, hot=1000)
    assert rows_of(collocations(frame(spark, rows), mining)) == brute(rows, mining)


def test_empty_table(spark):
    assert collocations(frame(spark, []).where("doc_id < 0")).collect() == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits: the score of counts near 10**13."""
    from fieldledger.llm.phrases import COUNTS, scored

    big = 9_000_000_000_001
    rows = [("en", "a", 1, big + 6), ("en", "b", 1, big + 2), ("en", "a b", 2, big)]
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, n long")
    got = scored(spark.createDataFrame(rows, COUNTS), totals).first()
    assert got.score == 1000 * big * 7 * big // ((big + 6) * (big + 2))


def test_frequencies_of_all_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    counts, totals = frequencies(rows, 5)
    phrases, words = frequent_phrases(docs, SMALL)
    want = {(g, " ".join(p)): a for (g, p), a in counts.items() if a >= SMALL.least}
    assert {(r.lang, r.phrase): r.a for r in phrases.collect()} == want
    assert phrases.count() == len(want)
    assert {r.lang: r.n for r in words.collect()} == dict(totals)
