"""License wording found by token automata compiled from marked-up templates.

A template is license wording with markup: `[[words]]` may be missing, and `{{low-high}}`
stands for any words of that number, such as a name. It is compiled into an automaton over
words that accepts a stretch of text exactly if the mandatory wording stands there word for
word. Base phrases are templates without markup. Texts are lower-cased in A-Z, and words are
runs of letters, digits and characters beyond ASCII, so punctuation and line breaks in
between do not matter.

Defined results: a null text is empty and has no words; without a label the score is 0;
repeated rows are scanned row by row; a null id stays null. The score of a text is m / (m +
4) for the m words that its longest match has word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import map_batches, table, whole_text

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARKUP = re.compile(r"(\[\[|\]\]|\{\{\d+-\d+\}\})")
HALF_SURE = 4

# Phrases whose places are counted, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licenses and of notices that name them.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files [[the {{1-4}}]] to deal in the {{1-3}} without restriction "
        "including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the {{1-3}} and to permit persons to whom the {{1-3}} is "
        "furnished to do so",
    ),
    ("mit", "[[released]] [[distributed]] [[licensed]] [[available]] under the [[terms of the]] mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "[[licensed under the]] apache license [[the license]] version 2 [[0]]"),
    ("apache-2", "spdx license identifier apache 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("bsd", "spdx license identifier bsd {{1-1}} clause"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-3", "spdx license identifier gpl 3 0 {{1-3}}"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation either]] version 2"),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[{{1-1}} 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[{{1-1}} 0]] [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa [[{{1-1}} 0]]"),
    ("cc-by", "creative commons attribution [[{{1-1}} 0]] [[international]] license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
    ),
)


@dataclass(frozen=True)
class Automaton:
    """States are places in the template; `skips` need no word, `words` read one."""

    label: str
    words: tuple[dict[bytes | None, int], ...]
    skips: tuple[tuple[int, ...], ...]
    first: frozenset[bytes]
    needed: frozenset[bytes]

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """Adds what is reached without a word; keeps the most matched words."""
        todo = list(states)
        while todo:
            state = todo.pop()
            for skip in self.skips[state]:
                if states.get(skip, -1) < states[state]:
                    states[skip] = states[state]
                    todo.append(skip)
        return states

    def accept(self, text: list[bytes], start: int) -> int:
        """Words matched by the longest wording that begins at `start`; 0 if none does."""
        states, final, best = self.closure({0: 0}), len(self.words), 0
        for at in range(start, len(text)):
            word = text[at]
            after: dict[int, int] = {}
            for state, seen in states.items():
                if state == final:
                    continue
                for key, gain in ((word, 1), (None, 0)):
                    target = self.words[state].get(key)
                    if target is not None:
                        after[target] = max(after.get(target, 0), seen + gain)
            states = self.closure(after)
            best = max(best, states.get(final, 0))
            if not states or set(states) == {final}:
                break
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Optional regions become skips, replaceable ones words of any kind."""
    words: list[dict[bytes | None, int]] = []
    skips: dict[int, list[int]] = {}
    opened, needed = [], set()
    for part in MARKUP.split(template):
        if part == "[[":
            opened.append(len(words))
        elif part == "]]":
            skips.setdefault(opened.pop(), []).append(len(words))
        elif part.startswith("{{"):
            low, high = map(int, part[2:-2].split("-"))
            first = len(words)
            words += [{None: first + i + 1} for i in range(high)]
            for i in range(low, high):
                skips.setdefault(first + i, []).append(first + high)
        else:
            for word in part.encode().split():
                words.append({word: len(words) + 1})
                if not opened:
                    needed.add(word)
    if opened:
        raise ValueError(f"open region in the template of {label}")
    over = tuple(tuple(skips.get(i, ())) for i in range(len(words) + 1))
    automaton = Automaton(label, tuple(words), over, frozenset(), frozenset(needed))
    reached = automaton.closure({0: 0})
    if len(words) in reached or any(None in words[state] for state in reached):
        raise ValueError(f"the template of {label} must begin with a word")
    return replace(automaton, first=frozenset(word for state in reached for word in words[state]))


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(compile_template(label, template) for label, template in templates)


def count_words(text: bytes) -> int:
    """Beginnings of runs of word bytes in a lower-cased text."""
    codes = np.frombuffer(text, dtype=np.uint8)
    inside = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    return int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1]))


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    places, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return places
        if words[at : at + len(phrase)] == phrase:
            places.append(at)


def scan_text(text: bytes, templates: tuple[tuple[str, str], ...]) -> tuple:
    """Places of base phrases, their labels, all labels, and the longest match's words."""
    base = [(phrase.encode().split(), label) for phrase, label in BASE]
    automata = [a for a in compiled(templates) if all(word in text for word in a.needed)]
    base = [(phrase, label) for phrase, label in base if all(word in text for word in phrase)]
    if not automata and not base:
        return [], (), (), 0
    words = WORD.findall(text)
    places, base_labels, labels, best = [], set(), set(), 0
    for phrase, label in base:
        if found := phrase_places(words, phrase):
            places += found
            base_labels.add(label)
            best = max(best, len(phrase))
    for automaton in automata:
        for start, word in enumerate(words):
            if word in automaton.first and (matched := automaton.accept(words, start)):
                labels.add(automaton.label)
                best = max(best, matched)
    return places, tuple(sorted(base_labels)), tuple(sorted(base_labels | labels)), best


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every document with its license wording, in one pass over the texts."""
    compiled(templates)  # a faulty template fails here and not on an executor

    def scan(batch):
        rows = []
        for text in batch.column("text").to_pylist():
            lowered = text.encode().lower()  # bytes: only A-Z change
            places, base_labels, labels, best = scan_text(lowered, templates)
            first, last = (min(places), max(places)) if places else (None, None)
            rows.append(
                (count_words(lowered), len(places), first, last)
                + (",".join(base_labels), ",".join(labels), best / (best + HALF_SURE))
            )
        columns = [list(column) for column in zip(*rows, strict=True)]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.record_batch(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return map_batches(
        texts,
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
