import pytest
from pyspark.sql import functions as F

from fieldledger.functions.fields import field_value, template_field
from fieldledger.operators import lookup, query, validate
from fieldledger.operators.joins import join_small
from fieldledger.sources import sample_views as views


@pytest.fixture(scope="module")
def stored_forms(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("forms") / "snapshot")
    views.forms(spark, sf_dir).write.partitionBy("template").parquet(path)
    return spark.read.parquet(path)


def test_filters(stored_forms):
    everything = query.filter_forms(stored_forms, "view")
    assert everything.count() == stored_forms.where("template = 'view'").count() > 0
    assert query.filter_forms(stored_forms, "unknown").count() == 0
    row = everything.first()
    exact = query.filter_forms(
        stored_forms, "view", event=row.event_key, scouter=row.scouter,
        match_number=row.match_number, team=row.team,
    )
    assert row.id in {r.id for r in exact.collect()}
    assert query.filter_forms(stored_forms, "view", scouter=row.scouter.upper()).count() == 0
    assert query.filter_forms(stored_forms, "view", team=-1).count() == 0


def test_filter_reaches_the_scan(stored_forms, plan):
    text = plan(query.filter_forms(stored_forms, "view", team=3, event="20240105").select("id"))
    assert "PartitionFilters: [isnotnull(template" in text
    assert "EqualTo(team,3)" in text and "EqualTo(event_key,20240105)" in text
    listed = plan(query.list_forms(stored_forms, "view"))
    assert "ReadSchema: struct<id:string>" in listed


def test_blob_listing_leaves_payloads_alone(spark, sf_dir, tmp_path, plan):
    views.blobs(spark, sf_dir).write.parquet(str(tmp_path / "blobs"))
    blobs = spark.read.parquet(str(tmp_path / "blobs"))
    assert "ReadSchema: struct<key:string>" in plan(query.list_blobs(blobs))
    text = plan(lookup.get_record(blobs, key="x").select("payload"))
    assert "EqualTo(key,x)" in text


def test_lists_skip_nulls(spark):
    rows = spark.createDataFrame([("a",), (None,)], "event string")
    assert [r.event for r in query.list_schedules(rows).collect()] == ["a"]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lookup_answers_every_wanted_key_once(spark, limit):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "key string")
    got = lookup.get_records(current, wanted, ["key"], limit=limit).collect()
    assert {(r.key, r.found, r.n) for r in got} == {("a", True, 1), ("z", False, None)}
    assert len(got) == 2


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_validation_paths_agree(spark, sf_dir, limit, plan):
    forms = views.forms(spark, sf_dir)
    templates = views.templates(spark, sf_dir).where("name <> 'error'").withColumnRenamed(
        "name", "template")
    checked = validate.validate_forms(forms, templates, limit=limit)
    assert ("_part" in plan(checked)) == (limit == 0)
    broken = validate.form_violations(forms, templates, limit=limit)
    invalid = checked.where("NOT valid").select("template", "id")
    assert invalid.exceptAll(broken.select("template", "id").distinct()).count() == 0
    assert broken.select("template", "id").distinct().exceptAll(invalid).count() == 0
    assert checked.count() == forms.count()
    accepted, rejected = validate.accept_forms(forms, templates, limit=limit)
    assert accepted.count() + rejected.count() == forms.count()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_keys_are_cut_into_parts(spark, how):
    rows = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE 'k' || id % 50 END AS k")
    small = spark.createDataFrame([("hot", 1), ("k2", 2), ("unused", 3)], "k string, n int")
    whole = join_small(rows, small, ["k"], how, spread=F.col("id"))
    parted = join_small(rows, small, ["k"], how, spread=F.col("id"), limit=0, hot_rows=50)
    assert whole.count() == parted.count() and whole.exceptAll(parted).count() == 0


def test_named_table_is_made_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert query.named_table(spark, "named_once", make).count() == 3
    assert made == [1]


def test_unknown_tag_is_refused():
    with pytest.raises(ValueError):
        field_value("Bogus", None)


def test_template_field_columns(spark):
    row = spark.range(1).select(template_field("r", "Rating", 0, 5).alias("f")).first()
    assert tuple(row.f) == ("r", "Rating", 0, 5)

