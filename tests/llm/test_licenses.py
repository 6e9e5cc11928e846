import re

import pytest

from fieldledger.llm.licenses import BASE, compile_template, scan_licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
)
TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "x under, the\nMIT license under the mit license ÜBER",
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0",
    "under the MITlicense; apache licence version 2; cc-by-nc",
    MIT,
    MIT.replace("without restriction", "with restriction"),
    "licensed under cc by-sa 4.0",
    "This work is licensed under the GNU General Public License, version 3",
    "word " * 30_000 + "cc by nc",
]


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places, labels = [], set()
    for phrase, label in BASE:
        own = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(own)] == own:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(make_docs):
    rows = [*enumerate(TEXTS), (None, TEXTS[2]), (2, TEXTS[2])]
    got = scan_licenses(make_docs(rows)).collect()
    want = sorted((str(i), *map(str, brute(t))) for i, t in rows)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((str(r.doc_id), *(str(r[c]) for c in columns)) for r in got) == want
    for row in got:
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)


def test_templates_need_their_mandatory_words(make_docs):
    found = {r.doc_id: r.labels for r in scan_licenses(make_docs(list(enumerate(TEXTS)))).collect()}
    assert found[6] == "mit" and found[7] == "" and found[8] == "cc-by-sa" and found[9] == "gpl-3"
    assert found[4] == "apache-2,cc-by-nc"


def test_optional_and_replaceable_regions():
    automaton = compile_template("x", "a [[b c]] {{1-2}} d")
    accept = lambda text: automaton.accept(text.encode().split(), 0)
    assert accept("a x d") == 2 and accept("a x y d") == 2 and accept("a b c x d") == 4
    assert accept("a d") == 0 and accept("a x y z d") == 0


def test_faulty_templates_are_refused():
    for template in ("a [[b", "[[a]]", "{{1-2}} a"):
        with pytest.raises(ValueError):
            compile_template("x", template)


def test_empty_table(make_docs):
    assert scan_licenses(make_docs([])).count() == 0
