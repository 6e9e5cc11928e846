"""A store with archived versions and a log, taken into a ledger with its history."""

import hashlib
import json
import os

import pytest

from fieldledger.sources import record_store, store_history
from fieldledger.sources.ledger import Ledger

T1, B1, B2 = (f"{n}1111111-2222-4333-8444-555555555555" for n in "abc")
# Names whose order is not that of writing.
LATE, EARLY, GONE, AGAIN = (f"{n}0000000-2222-4333-8444-555555555555" for n in "1f5e")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def template(year):
    return json.dumps({"fields": [{"data_type": "Number", "name": "a"}], "name": "m", "year": year})


def form(id, team):
    return json.dumps({"fields": {"a": {"Number": 1}}, "scouter": "s", "team": team, "match_number": 1,
                       "event_key": "e", "id": id})


def blob(key, payload):
    return len(key).to_bytes(8, "big") + key + payload


@pytest.fixture
def store(tmp_path):
    root, clock = tmp_path / "store", [1_700_000_000]

    def put(path, data):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())
        clock[0] += 1
        os.utime(target, (clock[0], clock[0]))

    m, old, new = sha("m"), f"forms/{sha('m')}.{T1}", f"forms/{sha('m')}.current"
    f1, f2, b, e = sha("f1"), sha("f2"), sha("b"), sha("e")
    put(f"templates/{m}.{T1}", template(2023))
    put(f"{old}/{f1}.{EARLY}", form("f1", 1))
    put(f"{old}/{f1}.{LATE}", form("f1", 2))
    put(f"{old}/{f1}.current", form("f1", 3))
    put(f"{old}/{f2}.{GONE}", form("f2", 4))
    put(f"{old}/{f2}.current", form("f2", 5))
    put(f"templates/{m}.current", template(2024))
    put(f"{new}/{f1}.{AGAIN}", form("f1", 6))
    put(f"{new}/{f1}.current", form("f1", 7))
    put(f"bytes/{b}.{B1}", blob(b"b", b"one"))
    put(f"bytes/{b}.{B2}", blob(b"b", b"two"))
    put(f"schedules/{e}.current", json.dumps({"event": "e", "shifts": []}))
    entries = [
        ("Template", "Add", f"{m}.current"),
        ({"Form": "m"}, "Add", f"{f1}.current"),
        ({"Form": "m"}, "Add", f"{f2}.current"),
        ({"Form": "m"}, "Edit", f"{f1}.current"),
        ({"Form": "m"}, "Delete", f"{f2}.current"),
        ({"Form": "m"}, "Edit", f"{f1}.current"),
        ({"Form": "m"}, "Add", f"{f2}.current"),
        ("Template", "Edit", f"{m}.{T1}"),
        ({"Form": "m"}, "Add", f"{f1}.current"),
        ("Bytes", "Add", f"{b}.current"),
        ({"Form": "m"}, "Edit", f"{f1}.current"),
        ("Bytes", "Edit", f"{b}.{B1}"),
        ("Bytes", "Delete", f"{b}.{B2}"),
        ("Schedule", "Add", f"{e}.current"),
        ("Schedule", "Add", f"{sha('lost')}.current"),
    ]
    lines = [json.dumps({"id": f"00000000-0000-4000-8000-{i:012d}", "data_type": kind, "action": action,
                         "new_path": path}) for i, (kind, action, path) in enumerate(entries)]
    (root / "log.jsonl").write_text("\n".join(lines) + "\n")
    return str(root), entries


def test_versions_generations_and_log_come_back(spark, store, tmp_path):
    root, entries = store
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = store_history.history_mutations(spark, root, f"{root}/log.jsonl")
    assert ledger.commit("history", rows, new_ids=False, assign_seq=True)
    versions = {r.seq: r for r in ledger.versions().collect()}
    assert sorted(versions) == list(range(14))
    assert [(r.key, r.reject_reason) for r in ledger.rejects().collect()] == [("", "not_json")]
    teams = {s: (r.key, r.generation, r.form.team) for s, r in versions.items() if r.form is not None}
    assert teams == {1: ("f1", 0, 1), 2: ("f2", 0, 4), 3: ("f1", 0, 2), 5: ("f1", 0, 3), 6: ("f2", 0, 5),
                     8: ("f1", 7, 6), 10: ("f1", 7, 7)}
    assert (versions[4].key, versions[4].action, versions[4].generation) == ("f2", "Delete", 0)
    assert [versions[s].template_record.year for s in (0, 7)] == [2023, 2024]
    assert [bytes(versions[s].payload) for s in (9, 11)] == [b"one", b"two"]
    assert versions[3].committed_at.timestamp() - versions[1].committed_at.timestamp() == 1
    log = ledger.change_log().orderBy("seq").collect()
    assert [(r.id, r.action, r.new_path) for r in log] == [
        (f"00000000-0000-4000-8000-{i:012d}", action, path) for i, (_, action, path) in enumerate(entries[:14])]
    assert [(r.id, r.team) for r in ledger.forms().collect()] == [("f1", 7)]
    assert ledger.blobs().collect() == [] and [r.event for r in ledger.schedules().collect()] == ["e"]
    # A client goes on from the entry it knew.
    assert [r.seq for r in ledger.feed().sync("00000000-0000-4000-8000-000000000003").collect()] == [4]


def test_a_store_goes_behind_what_a_ledger_holds(spark, store, tmp_path):
    root, _ = store
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    live = record_store.store_mutations(spark, root)
    assert sorted(r.seq for r in live.collect()) == list(range(live.count()))
    assert ledger.commit("live", live, new_ids=False, assign_seq=True)
    held = ledger.view().last_seq
    rows = store_history.history_mutations(spark, root, f"{root}/log.jsonl")
    assert ledger.commit("history", rows.where("kind = 'Bytes'"), new_ids=False, assign_seq=True)
    got = [(r.seq - held - 1, r.key, r.accepted) for r in ledger.outcomes().where("batch = 'history'").collect()]
    assert sorted(got) == [(0, "b", True), (2, "b", True), (3, "b", True)]
    assert [(r.id, r.team) for r in ledger.forms().collect()] == [("f1", 7)]


def test_exported_history_can_be_read_as_a_store(spark, store, tmp_path):
    root, _ = store
    ledger, out = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    rows = store_history.history_mutations(spark, root, f"{root}/log.jsonl")
    ledger.commit("history", rows, new_ids=False, assign_seq=True)
    totals = store_history.export_history(ledger, out)
    assert {kind: t["files"] for kind, t in totals.items()} == {"Template": 2, "Schedule": 1, "Bytes": 2, "Form": 7}
    for folder in ("templates", "schedules", "bytes"):
        assert sorted(os.listdir(f"{out}/{folder}")) == sorted(os.listdir(f"{root}/{folder}"))
        for name in os.listdir(f"{out}/{folder}"):
            assert os.path.getmtime(f"{out}/{folder}/{name}") == os.path.getmtime(f"{root}/{folder}/{name}")
    assert sorted(os.listdir(f"{out}/forms")) == sorted(os.listdir(f"{root}/forms"))
    tables = record_store.import_store(spark, out, f"{out}/log", live_only=False)
    assert {(r.id, r.team, r.generation) for r in tables["forms"].collect()} == {
        ("f1", 1, 0), ("f1", 2, 0), ("f1", 3, 0), ("f2", 4, 0), ("f2", 5, 0), ("f1", 6, 7), ("f1", 7, 7)}


def test_an_empty_store_has_no_history(spark, tmp_path):
    (tmp_path / "log").write_text("")
    assert store_history.history_mutations(spark, str(tmp_path / "none"), str(tmp_path / "log")).collect() == []
