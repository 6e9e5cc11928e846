"""Storage locations derived from natural keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.codecs import sha256_hex

# The folder of each record kind and the suffix of live files.
FOLDERS = {"Bytes": "bytes", "Template": "templates", "Schedule": "schedules", "Form": "forms"}
LIVE = "current"


def file_name(key: Column, version: Column | None = None) -> Column:
    """`<hash>.current`, or `<hash>.<version>` for an archived version."""
    suffix = F.lit(LIVE) if version is None else F.coalesce(version, F.lit(LIVE))
    return F.concat_ws(".", sha256_hex(key), suffix)


def location(
    kind: Column,
    key: Column,
    version: Column | None = None,
    template: Column | None = None,
    template_version: Column | None = None,
) -> Column:
    """Path of a record below the store root; forms sit in a folder per template version."""
    folder = F.coalesce(*[F.when(kind == k, F.lit(path)) for k, path in FOLDERS.items()])
    name = file_name(key, version)
    plain = F.concat_ws("/", folder, name)
    if template is None:
        return plain
    nested = F.concat_ws("/", folder, file_name(template, template_version), name)
    return F.when(kind == "Form", nested).otherwise(plain)
