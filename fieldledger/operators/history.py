"""Ordered mutations of keyed records: accept rule, current state, versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.codecs import derived_id
from fieldledger.operators.joins import BROADCAST_BYTES, fits_broadcast
from fieldledger.operators.ordered import RANGE_WIDTH, carry

# Keys that were live before, as a table, or found for the keys that are asked for.
LiveKeys = DataFrame | Callable[[DataFrame], DataFrame | None] | None

LOG_IDS = "log"
VERSION_IDS = "version"
RECORD_IDS = "record"


def accept_mutations(
    mutations: DataFrame,
    keys: Sequence[str],
    *,
    live_keys: LiveKeys = None,
    limit: int = BROADCAST_BYTES,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Adds `live_before` and `accepted` to mutations ordered by `seq`.

    An Add needs an absent record, an Edit or Delete a live one. A refused row
    leaves the state as it was, and so does an accepted Edit, hence the state in
    front of a row follows from the nearest earlier Add or Delete alone.
    `live_keys` are the keys live before the first row; only those that the
    mutations name are looked at.
    """
    action = F.col("action")
    live_after = F.when(action == "Add", F.lit(True)).when(action == "Delete", F.lit(False))
    initial = None
    asked = mutations.select(*keys).distinct()
    known = live_keys(asked) if callable(live_keys) else live_keys
    if known is not None:
        known = known.select(*keys).distinct()
        # A function has looked for the asked keys alone.
        if not callable(live_keys) and fits_broadcast(asked, limit):
            # Narrowed where the earlier state is scanned, before it is shuffled.
            known = known.join(F.broadcast(asked), list(keys), "left_semi")
        initial = known.withColumn("live_before", F.lit(True))
    stated = carry(
        mutations, keys, "seq", live_after, "live_before", initial=initial, width=width
    )
    live = F.coalesce("live_before", F.lit(False))
    allowed = F.when(action == "Add", ~F.col("live_before")).when(
        action.isin("Edit", "Delete"), F.col("live_before")
    )
    return stated.withColumn("live_before", live).withColumn(
        "accepted", F.coalesce(allowed, F.lit(False))
    )


def decide(
    checked: DataFrame,
    keys: Sequence[str],
    *,
    live_keys: LiveKeys = None,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """`accept_mutations` for wide rows some of which already have a `reject_reason`.

    Those rows are kept and never count for the state of their record. The other
    refused rows get the reason `exists` or `absent`. The order is worked out on
    keys and actions alone; content meets the decision by `seq`, which is unique
    and so spreads evenly, and is never held by a window.
    """
    action = F.col("action")
    narrow = checked.select(
        *keys, "seq", F.when(F.col("reject_reason").isNull(), action).alias("action")
    )
    decisions = accept_mutations(narrow, keys, live_keys=live_keys, width=width)
    decided = checked.join(decisions.select("seq", "live_before", "accepted"), "seq", "left")
    refused = F.when(action == "Add", F.lit("exists")).otherwise(F.lit("absent"))
    accepted = F.coalesce("accepted", F.lit(False))
    return decided.withColumn("accepted", accepted).withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(~F.col("accepted"), refused))
    )


def current_state(accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The live version of each key; accepted mutations come in, deleted keys go.

    The newest row is picked before deletes are dropped; the other way round
    deleted records would come back.
    """
    rest = [name for name in accepted.columns if name not in keys]
    newest = accepted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_newest"))
    return newest.select(*keys, "_newest.*").where(F.col("action") != "Delete")


def current_state_stored(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for a stored table with wide rows.

    Only the key, `seq` and `action` are aggregated; payloads are then picked by
    `seq`, which is unique and so spreads evenly.
    """
    newest = versions.groupBy(*keys).agg(
        F.max("seq").alias("seq"), F.max_by(F.col("action") == "Delete", "seq").alias("_gone")
    )
    return versions.join(newest.where(~F.col("_gone")).select("seq"), "seq", "left_semi")


def version_history(
    accepted: DataFrame, keys: Sequence[str], *, width: int | None = RANGE_WIDTH
) -> DataFrame:
    """All versions ever live, with the `seq` that replaced each.

    `version_id` is null for the live version, else the suffix it was archived under.
    """
    followed = carry(
        accepted, keys, "seq", F.col("seq"), "superseded_by", backward=True, width=width
    )
    version_id = F.when(
        F.col("superseded_by").isNotNull(), derived_id(VERSION_IDS, F.col("superseded_by"))
    )
    return followed.where(F.col("action") != "Delete").withColumn("version_id", version_id)


def assign_record_ids(adds: DataFrame, id_column: str = "key") -> DataFrame:
    """Gives every Add a new id; an id the client sent is overwritten."""
    fresh = derived_id(RECORD_IDS, F.col("seq"))
    return adds.withColumn(
        id_column, F.when(F.col("action") == "Add", fresh).otherwise(F.col(id_column))
    )
