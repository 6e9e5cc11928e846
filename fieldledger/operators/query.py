"""The form filter, listings and named tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def form_predicate(
    event: str | None = None,
    scouter: str | None = None,
    match_number: int | None = None,
    team: int | None = None,
) -> Column:
    """Conjunction of the given equalities; an unset one restricts nothing."""
    wanted = {"event_key": event, "scouter": scouter, "match_number": match_number, "team": team}
    tests = [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]
    return reduce(lambda a, b: a & b, tests, F.col("fields").isNotNull())


def filter_forms(forms: DataFrame, template: str, **wanted) -> DataFrame:
    """Current forms of a template that meet every given equality.

    `template` is the partition column of the forms table. `wanted` takes `event`,
    `scouter`, `match_number` and `team`.
    """
    return forms.where((F.col("template") == F.lit(template)) & form_predicate(**wanted))


def list_present(records: DataFrame, column: str) -> DataFrame:
    """One column of the records, without its nulls."""
    return records.select(column).where(F.col(column).isNotNull())


def list_forms(forms: DataFrame, template: str) -> DataFrame:
    return list_present(forms.where(F.col("template") == F.lit(template)), "id")


def list_schedules(schedules: DataFrame) -> DataFrame:
    return list_present(schedules, "event")


def list_templates(templates: DataFrame) -> DataFrame:
    return list_present(templates, "name")


def list_blobs(blobs: DataFrame) -> DataFrame:
    return list_present(blobs, "key")


def named_table(spark: SparkSession, name: str, make) -> DataFrame:
    """The view `name`; it is made and registered the first time it is asked for."""
    if not spark.catalog.tableExists(name):
        make().createOrReplaceTempView(name)
    return spark.table(name)
