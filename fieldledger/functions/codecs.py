"""Hashes, ids, blob framing and record-to-JSON encoders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(value: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of a string."""
    return F.sha2(value.cast("binary"), 256)


def derived_id(namespace: Column | str, seq: Column) -> Column:
    """A UUID-shaped id that is the same on every retry of the same row."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    digest = F.sha2(F.concat_ws(":", space, seq.cast("string")), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("8"), F.substring(digest, 14, 3)),
        F.concat(F.lit("a"), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def encode_blob(key: Column, payload: Column) -> Column:
    """Eight-byte big-endian key length, the key bytes, the payload."""
    length = F.lpad(F.hex(F.octet_length(key).cast("bigint")), 16, "0")
    return F.concat(F.unhex(length), key.cast("binary"), payload)


def decode_blob(content: Column) -> Column:
    """`STRUCT<key, payload>` of a framed blob, null when the frame is broken.

    Bytes of the key that are not UTF-8 become replacement characters.
    """
    declared = F.conv(F.hex(F.substring(content, 1, 8)), 16, 10).try_cast("bigint")
    length = F.octet_length(content)
    key_bytes = content.substr(F.lit(9), declared.cast("int"))
    payload = content.substr(declared.cast("int") + 9, length)
    whole = (length >= 8) & (declared <= length - 8)
    return F.when(
        whole,
        F.struct(
            F.make_valid_utf8(key_bytes.cast("string")).alias("key"),
            payload.alias("payload"),
        ),
    )


def form_json(
    fields: Column,
    scouter: Column,
    team: Column,
    match_number: Column,
    event_key: Column,
    id: Column,
) -> Column:
    """JSON document of a form; each field value keeps only its one tag."""
    return F.to_json(
        F.struct(
            fields.alias("fields"),
            scouter.alias("scouter"),
            team.alias("team"),
            match_number.alias("match_number"),
            event_key.alias("event_key"),
            id.alias("id"),
        )
    )


def template_json(name: Column, year: Column, fields: Column) -> Column:
    """JSON document of a template; a rating is an object, other kinds a name."""

    def one(field: Column) -> Column:
        rating = F.to_variant_object(
            F.struct(F.struct(field["min"].alias("min"), field["max"].alias("max")).alias("Rating"))
        )
        data_type = F.when(field["kind"] == "Rating", rating).otherwise(
            field["kind"].cast("variant")
        )
        return F.struct(data_type.alias("data_type"), field["name"].alias("name"))

    return F.to_json(
        F.struct(F.transform(fields, one).alias("fields"), name.alias("name"), year.alias("year"))
    )


def schedule_json(event: Column, shifts: Column) -> Column:
    return F.to_json(F.struct(event.alias("event"), shifts.alias("shifts")))


def log_json(id: Column, kind: Column, template: Column, action: Column, new_path: Column) -> Column:
    """JSON line of a change-log entry; only form entries name a template."""
    form = F.to_variant_object(F.struct(template.alias("Form")))
    data_type = F.when(kind == "Form", form).otherwise(kind.cast("variant"))
    return F.to_json(
        F.struct(
            id.alias("id"),
            data_type.alias("data_type"),
            action.alias("action"),
            new_path.alias("new_path"),
        )
    )


def row_json(*columns: Column) -> Column:
    """One JSON object per row, null members left out."""
    return F.to_json(F.struct(*columns))
