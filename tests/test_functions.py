import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldledger.functions.age import age, age_days
from fieldledger.functions.codecs import decode_blob, derived_id, encode_blob, sha256_hex
from fieldledger.functions.documents import UUID_PATTERN
from fieldledger.functions.fields import (
    field_value, follows_template, put_field, tag_of, template_field, violations,
)
from fieldledger.functions.locations import location
from fieldledger.plans.queries import _cursor

QUIET = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


@QUIET
@given(st.lists(st.tuples(st.text(max_size=20), st.binary(max_size=40)), min_size=1, max_size=20))
def test_blob_frames_round_trip(spark, blobs):
    blobs = [(k.encode("utf-8", "ignore").decode(), v) for k, v in blobs]
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs], "key string, payload binary")
    framed = rows.select("key", "payload", encode_blob(F.col("key"), F.col("payload")).alias("c"))
    for row in framed.select("*", decode_blob(F.col("c")).alias("b")).collect():
        raw = row.key.encode()
        assert bytes(row.c) == len(raw).to_bytes(8, "big") + raw + bytes(row.payload)
        assert row.b.key == row.key and bytes(row.b.payload) == bytes(row.payload)


def test_broken_blob_frames(spark):
    frames = [b"", b"\0" * 7, (5).to_bytes(8, "big") + b"abc", b"\xff" * 8 + b"abc",
              (2).to_bytes(8, "big") + b"\xff\xfeX", (0).to_bytes(8, "big")]
    rows = spark.createDataFrame([(bytearray(f),) for f in frames], "c binary")
    out = [r.b for r in rows.select(decode_blob(F.col("c")).alias("b")).collect()]
    assert out[:4] == [None] * 4
    assert out[4].key == "��" and bytes(out[4].payload) == b"X"
    assert out[5].key == "" and bytes(out[5].payload) == b""


def test_hash_and_ids(spark):
    row = spark.range(1).select(
        sha256_hex(F.lit("naïve ✓")).alias("h"), derived_id("log", F.lit(5)).alias("a"),
        derived_id("log", F.lit(6)).alias("b"), derived_id("version", F.lit(5)).alias("c"),
    ).first()
    assert row.h == hashlib.sha256("naïve ✓".encode()).hexdigest()
    assert re.match(UUID_PATTERN, row.a) and row.a == _cursor(5)
    assert len({row.a, row.b, row.c}) == 3


def test_age_truncates_toward_zero(spark):
    offsets = {0: 0, 86_399: 0, 86_400: 1, -5_000: 0, -100_000: -1}
    rows = spark.createDataFrame([(s,) for s in offsets], "s bigint").select(
        "s", F.timestamp_seconds(F.lit(1_700_000_000)).alias("made"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("now"),
    )
    for row in rows.withColumn("d", age_days(F.col("made"), F.col("now"))).collect():
        assert row.d == offsets[row.s]
    fraction = F.timestamp_millis(F.lit(1_700_000_000_900))
    row = spark.range(1).select(age(fraction, fraction, "timestamp").alias("t")).first()
    assert row.t == 1_700_000_000


def test_locations(spark):
    def path(*arguments, **named):
        return spark.range(1).select(location(*arguments, **named).alias("p")).first().p

    k, t = hashlib.sha256(b"k").hexdigest(), hashlib.sha256(b"t").hexdigest()
    assert path(F.lit("Bytes"), F.lit("k")) == f"bytes/{k}.current"
    assert path(F.lit("Schedule"), F.lit("k"), F.lit("v")) == f"schedules/{k}.v"
    assert path(F.lit("Template"), F.lit("k"), F.lit(None)) == f"templates/{k}.current"
    form = path(F.lit("Form"), F.lit("k"), F.lit("v"), F.lit("t"), F.lit("w"))
    assert form == f"forms/{t}.w/{k}.v"


def _checked(spark, template, fields):
    entries = [x for name, value in fields.items() for x in (F.lit(name), value)]
    row = spark.range(1).select(
        F.array(*template).alias("t"),
        (F.create_map(*entries) if entries else F.expr("cast(map() as map<string,struct<CheckBox:boolean,Rating:bigint,Number:bigint,ShortText:string,LongText:string>>)")).alias("f"),
    ).select(
        follows_template(F.col("t"), F.col("f")).alias("ok"),
        violations(F.col("t"), F.col("f")).alias("broken"),
    ).first()
    return row.ok, [(b.field, b.expected, b.found, b.reason) for b in row.broken]


def test_template_rules(spark):
    template = [template_field("head", "Title"), template_field("n", "Number"),
                template_field("r", "Rating", 0, 5)]
    number, rating = field_value("Number", F.lit(1)), field_value("Rating", F.lit(99))
    assert _checked(spark, template, {"n": number, "r": rating}) == (True, [])
    extra = {"n": number, "r": rating, "more": number}
    assert _checked(spark, template, extra) == (True, [])
    assert _checked(spark, template, {"n": number}) == (False, [("r", "Rating", None, "missing")])
    assert _checked(spark, template, {"n": rating, "r": rating}) == (
        False, [("n", "Number", "Rating", "type_mismatch")])
    assert _checked(spark, [template_field("head", "Title")], {}) == (True, [])


def test_put_field_adds_and_overwrites(spark):
    start = F.create_map(F.lit("a"), field_value("Number", F.lit(1)))
    changed = put_field(put_field(start, "a", field_value("CheckBox", F.lit(False))), "b",
                        field_value("LongText", F.lit("x")))
    row = spark.range(1).select(changed.alias("m")).select(
        F.size("m").alias("n"), tag_of(F.col("m")["a"]).alias("a"), tag_of(F.col("m")["b"]).alias("b"),
        tag_of(F.try_element_at("m", F.lit("c"))).alias("c"),
    ).first()
    assert tuple(row) == (2, "CheckBox", "LongText", None)
