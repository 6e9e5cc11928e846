import json

import pytest

from fieldledger.functions.documents import with_decoded

HEAD = '"scouter":"s","team":1,"match_number":2,"event_key":"e"'
LOG_ID = '"id":"6b1f8a40-0000-4000-8000-000000000000"'


def reasons(spark, kind, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "n int, doc string")
    out = with_decoded(rows, kind, "doc").orderBy("n").collect()
    for row in out:
        assert (row.record is None) == (row.reject_reason is not None)
    return [row.reject_reason for row in out]


def test_field_values(spark):
    good = [
        '{"CheckBox":true}', '{"Rating":-3}', '{"Number":9223372036854775807}',
        '{"ShortText":""}', '{"LongText":"é"}',
    ]
    bad = [
        '{"Number":1.5}', '{"Number":3.0}', '{"Number":1e3}', '{"Number":9223372036854775808}',
        '{"Number":"7"}', '{"CheckBox":null}', '{"CheckBox":1}', '{"ShortText":7}', '{"LongText":{}}',
        '{"Number":1,"Rating":2}', '{"Bogus":1}', '{}', "7", "null", "[]", '"Number"',
    ]
    docs = ['{"fields":{"a":%s},%s}' % (value, HEAD) for value in good + bad]
    assert reasons(spark, "Form", docs) == [None] * len(good) + ["bad_fields"] * len(bad)


def test_decoded_form(spark):
    doc = '{"fields":{"a":{"Rating":3},"b":{"ShortText":"x"}},%s,"id":"q","more":[1]}' % HEAD
    rows = spark.createDataFrame([(doc,)], "doc string")
    record = with_decoded(rows, "Form", "doc").first().record
    assert (record.id, record.scouter, record.team, record.match_number, record.event_key) == (
        "q", "s", 1, 2, "e",
    )
    assert record.fields["a"].asDict() == {
        "CheckBox": None, "Rating": 3, "Number": None, "ShortText": None, "LongText": None,
    }
    assert record.fields["b"].ShortText == "x"


def test_form_members(spark):
    whole = {
        "fields": {}, "scouter": "s", "team": 1, "match_number": 2, "event_key": "e", "id": None,
    }
    docs = [json.dumps(whole), json.dumps({k: v for k, v in whole.items() if k != "id"})]
    expected = [None, None]
    for name in ("fields", "scouter", "team", "match_number", "event_key"):
        docs.append(json.dumps({k: v for k, v in whole.items() if k != name}))
        docs.append(json.dumps({**whole, name: None}))
        expected += [f"bad_{name}"] * 2
    docs += [json.dumps({**whole, "team": "1"}), json.dumps({**whole, "id": 5})]
    expected += ["bad_team", "bad_id"]
    assert reasons(spark, "Form", docs) == expected


def test_one_value_and_nothing_else(spark):
    doc = '{"fields":{},%s}' % HEAD
    texts = [f"  {doc}\n", doc + " x", doc + "," + doc, doc + "] }", doc + "}", doc[:-1], "", "nope",
             doc + "}, {", None, "[]", "1", "null"]
    assert reasons(spark, "Form", texts) == (
        [None] + ["not_json"] * 9 + ["not_an_object", "not_an_object", "not_an_object"]
    )


def test_templates(spark):
    def doc(data_type):
        return '{"fields":[{"data_type":%s,"name":"a"}],"name":"m","year":2024}' % data_type

    good = ['"Title"', '"CheckBox"', '{"Rating":{"min":0,"max":5}}', '{"Number":null}']
    bad = ['"Rating"', '"Bogus"', '{"Rating":{"min":0}}', '{"Rating":{"min":0,"max":1.5}}',
           '{"Rating":{"min":0,"max":5},"Number":null}', '{"Number":1}', "null", "{}"]
    docs = [doc(value) for value in good + bad]
    assert reasons(spark, "Template", docs) == [None] * len(good) + ["bad_fields"] * len(bad)
    rest = ['{"fields":[],"name":"m","year":1}', '{"fields":[],"name":"m"}', '{"fields":[],"year":1}']
    assert reasons(spark, "Template", rest) == [None, "bad_year", "bad_name"]
    row = with_decoded(spark.createDataFrame([(docs[2],)], "doc string"), "Template", "doc").first()
    assert [tuple(f) for f in row.record.fields] == [("a", "Rating", 0, 5)]


@pytest.mark.parametrize(
    "station,start,ok",
    [(0, 1, True), (255, 1, True), (-1, 1, False), (256, 1, False), (1, 2**32 - 1, True),
     (1, 2**32, False), (1, 99, True)],
)
def test_shifts(spark, station, start, ok):
    shift = {"scouter": "s", "station": station, "match_start": start, "match_end": 10}
    doc = json.dumps({"event": "e", "shifts": [shift]})
    assert reasons(spark, "Schedule", [doc]) == [None if ok else "bad_shifts"]


def test_log_entries(spark):
    cases = [
        ('"Bytes"', "Add", None), ('{"Form":"m"}', "Edit", None), ('{"Template":null}', "Delete", None),
        ('"Form"', "Add", "bad_data_type"), ('{"Form":7}', "Add", "bad_data_type"),
        ('"Bytes"', "Zap", "bad_action"),
    ]
    docs = ['{%s,"data_type":%s,"action":"%s","new_path":"p"}' % (LOG_ID, t, a) for t, a, _ in cases]
    docs.append('{"id":"7","data_type":"Bytes","action":"Add","new_path":"p"}')
    assert reasons(spark, "Log", docs) == [c[2] for c in cases] + ["bad_id"]
