import hashlib
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldledger.llm.common import table
from fieldledger.llm.repair import (
    ACCEPTED,
    EMPTY,
    Large,
    Row,
    best_repair,
    damaged,
    joined,
    op13_conversation_repair,
    plain,
    repair,
    repair_summary,
    table_of,
)

WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def by_enumeration(rows):
    """The least (cost, audit) among all ways with at most two inserted rows in a gap."""
    fills = ["", "u", "a", "ua", "au"]
    best = None
    for choice in product("DKua", repeat=len(rows)):
        if any(r.lost and c != "D" for r, c in zip(rows, choice, strict=True)):
            continue
        for gaps in product(fills, repeat=len(rows) + 1):
            text, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for row, c, gap in zip(rows, choice, gaps[1:], strict=True):
                text += {"D": "", "K": row.initial}.get(c, c) + gap
                audit += {"u": "R", "a": "R"}.get(c, c) + "I" * len(gap)
                cost += 3 if c == "D" else (0 if c == "K" else 2) + row.unfinished
            if GOOD.fullmatch(text) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


row = st.builds(Row, st.sampled_from("suat"), st.booleans(), st.booleans())


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=3))
def test_agenda_finds_the_least_of_all_repairs(rows):
    assert best_repair(rows) == by_enumeration(rows)


def layered(rows):
    """Least pairs by plain relaxation, row by row."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "")}

    def relax(into, state, weight):
        if state not in into or weight < into[state]:
            into[state] = weight

    def insert(states):
        for _ in range(4):
            for state, (cost, audit) in list(states.items()):
                relax(states, follow[state, "a" if state == 2 else "u"], (cost + 2, audit + "I"))
        return states

    for r in rows:
        new = {}
        for state, (cost, audit) in insert(best).items():
            relax(new, state, (cost + 3, audit + "D"))
            if r.lost:
                continue
            relax(new, follow[state, "a" if state == 2 else "u"], (cost + 2 + r.unfinished, audit + "R"))
            if (state, r.initial) in follow:
                relax(new, follow[state, r.initial], (cost + r.unfinished, audit + "K"))
        best = new
    return min(w for s, w in insert(best).items() if s in (0, 3))


@settings(max_examples=100, deadline=None)
@given(st.lists(row, max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_blocks_join_to_the_same_repair(rows, cuts):
    assert best_repair(rows) == layered(rows)
    cuts = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    parts = [table_of(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] or [table_of(rows)]
    whole = joined(parts)
    assert min(whole[EMPTY, q] for q in ACCEPTED if (EMPTY, q) in whole) == layered(rows)


def expected(rows, damage):
    """One conversation after the other; rows are (conv_id, turn, role, text)."""
    groups = {}
    for conv_id, turn, role, text in rows:
        own = groups.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        counts, items, seen = [0, 0, 0], [], set()
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            items.append(Row(role[:1], fault < 2, fault == 2))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(items, items[1:], strict=False))
        cost, audit = layered(items)
        texts, at = [], 0
        for letter in audit:
            system = bool(texts) and texts[0][0][:1] == "s"
            turn_of = ("user", "assistant")[(len(texts) - system) % 2]
            if letter == "I":
                texts.append((turn_of, ""))
                continue
            if letter != "D":
                texts.append((own[at][1] if letter == "K" else turn_of, own[at][2]))
            at += 1
        told = "\n".join(f"{r}:{t}" for r, t in texts)
        digest = hashlib.sha256(told.encode()).hexdigest()
        out[conv_id] = ((gaps, *counts, illegal, cost, audit, digest), texts)
    return out


def check(frame, large, rows, damage):
    want = expected(rows, damage)
    got = repair_summary(frame, large).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {i: w[0] for i, w in want.items()}
    texts = {}
    for r in sorted(repair(frame, large).collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert texts == {i: [(n, *t) for n, t in enumerate(w[1])] for i, w in want.items() if w[1]}


@pytest.mark.parametrize("large", [Large(), Large(rows=3), Large(bytes=2000)])
def test_whole_table(spark, sf_dir, large):
    frame = table(spark, sf_dir, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    check(damaged(frame), large, rows, True)


def test_registered_query(spark, sf_dir):
    frame = table(spark, sf_dir, "conversations")
    want = expected([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()], True)
    got = op13_conversation_repair(spark, sf_dir)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {i: w[0] for i, w in want.items()}


SCHEMA = "text string, conv_id long, gaps string, turn long, audit string, role string, block long"


def frame_of(spark, rows):
    return spark.createDataFrame([(t, c, "x", n, "y", r, 1) for c, n, r, t in rows], SCHEMA)


ODD = [
    (None, None, None, None),
    (None, 3, "user", "Hi."),
    (None, 4, "assistant", "So?"),
    (1, None, "user", "First!"),
    (1, None, "user", "First!"),
    (1, 2, "assistant", "Second"),
    (1, 9, "user", " \t\n\x0b\x0c\r"),
    (1, 11, "", "odd role."),
    (2, 5, "system", "Only."),
    (3, 1, "user", "Long " * 50_000 + "."),
    (3, 2, "assistant", "é. "),
    (4, 0, "assistant", "A."),
    (4, 1, "user", "A."),
    (4, -7, "tool", "x."),
]


@pytest.mark.parametrize("large", [Large(), Large(rows=1)])
@pytest.mark.parametrize("form, damage", [(plain, False), (damaged, True)])
def test_nulls_empty_long_and_odd_rows(spark, large, form, damage):
    check(form(frame_of(spark, ODD)), large, ODD, damage)


def test_a_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, turn, "user", "Gone."), (8, turn + 1, "user", "Hi.")]
    check(damaged(frame_of(spark, rows)), Large(), rows, True)
    check(damaged(frame_of(spark, rows * 3)), Large(rows=1), rows * 3, True)


def test_hot_conversation_in_many_blocks(spark):
    roles = ["user", "assistant", "user", "user", "system", "assistant"]
    rows = [(1, t // 2 if t % 11 else None, roles[t * 7 % 6], f"text {t % 90}" + "." * (t % 3 > 0)) for t in range(500)]
    rows = [r for i, r in enumerate(rows) if r[1] is None or (i % 2 == 0)]
    unique = {(r[0], r[1]) for r in rows}
    rows = [r for i, r in enumerate(rows) if r[1] is not None] + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Yo.")]
    assert len(unique) > 200
    check(plain(frame_of(spark, rows)), Large(rows=2), rows, False)


def test_empty_table(spark):
    none = frame_of(spark, ODD).where("conv_id > 99")
    assert repair_summary(damaged(none)).collect() == [] and repair(damaged(none)).collect() == []
