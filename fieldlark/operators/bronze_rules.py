"""Checks of bronze rows by their class: fields, prices, times, and why a row needs review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: By class the fields that must be filled, its price and its time; fixed values.
FIELDS = {
    "fixture_result": (("fixture_id", "home_team", "away_team", "result_status"), None, "kickoff_utc"),
    "odds_snapshot": (("fixture_id", "provider_id", "bookmaker_id", "market_key", "selection_key"), "price_decimal", "snapshot_utc"),
    "lineup_event_context": (("fixture_id", "provider_id", "entity_id", "event_type"), None, "observed_at_utc"),
}
#: A decimal number, and the least length of a time in UTC; fixed values.
NUMBER, TIME_LENGTH = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", 20


def _of(values: Column, field: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at(values, F.lit(field)), F.lit("")))


def price_fault(text: Column) -> Column:
    """Whether a text is no decimal price between 1 and 1000, both excluded."""
    price = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return ~F.coalesce((price > 1) & (price < 1000), F.lit(False))


def time_fault(text: Column) -> Column:
    """Whether a text has not the shape of a time in UTC."""
    return ~((F.octet_length(text) >= TIME_LENGTH) & F.contains(text, F.lit("T")) & F.endswith(text, F.lit("Z")))


def plain_reason(text: Column) -> Column:
    """ASCII letters and digits in lower case with single underscores between."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, "[^a-z0-9]+", "_"), "^_|_$", "")


def value_reasons(row_class: Column, values: Column, status: Column, missing: Column, review: Column) -> Column:
    """Why a row needs review, sorted, each reason once; an empty array if nothing does.

    ``values`` is a map of texts (null: no payload), ``status`` of the row's fields, with those ``missing`` (an array) and the ``review`` reason.
    """
    named = lambda name, field, bad: F.when(bad, F.lit(f"{name}:{field}"))
    shape = ~F.coalesce(status == "schema_ok", F.lit(False))
    found = [
        F.when(shape, "schema_not_ok"),
        F.when(shape & (F.size(F.coalesce(missing, F.array().cast("array<string>"))) > 0), F.concat(F.lit("missing_fields:"), F.array_join(missing, ","))),
        F.when(shape & review.isNotNull(), F.concat(F.lit("schema_review:"), plain_reason(review))),
        F.when(values.isNull(), "missing_value_payload"),
        F.when(values.isNotNull() & ~F.coalesce(row_class.isin(*FIELDS), F.lit(False)), F.concat(F.lit("unsupported_row_class:"), F.coalesce(row_class, F.lit("")))),
    ]
    for name, (filled, price, time) in FIELDS.items():
        own = (row_class == name) & values.isNotNull()
        found += [named("empty_or_missing", f, own & (_of(values, f) == "")) for f in filled]
        found.append(named("invalid_timestamp_shape", time, own & time_fault(_of(values, time))))
        if price:
            found.append(named("invalid_decimal_price", price, own & price_fault(_of(values, price))))
    return F.sort_array(F.array_except(F.array(*found), F.array(F.lit(None).cast("string"))))  # no lambda: the checks stay compiled


def validated(rows: DataFrame) -> DataFrame:
    """(row_id, row_class, value_status, review_reasons, quarantine_only) of preview rows (row_id, row_class, schema_status, missing_fields, review_reason, values)."""
    reasons = value_reasons(c("row_class"), c("values"), c("schema_status"), c("missing_fields"), c("review_reason"))
    made = rows.select("row_id", "row_class", reasons.alias("review_reasons"))
    return made.select("row_id", "row_class", F.when(F.size("review_reasons") == 0, "value_ok").otherwise("review_required").alias("value_status"), "review_reasons", F.lit(True).alias("quarantine_only"))


def _by_reasons(checked: DataFrame) -> DataFrame:
    """Rows by what is wrong with them, all in one pass; there are few such sets."""
    return checked.groupBy("value_status", "review_reasons").agg(F.count("*").alias("n"))


def reason_counts(checked: DataFrame) -> DataFrame:
    """(reason, rows) over all rows; a reason that no row has is absent."""
    each = _by_reasons(checked).select("n", F.explode_outer("review_reasons").alias("reason")).where("reason IS NOT NULL")  # a plain explode has its rows filtered first, and all checks made for that again
    return each.groupBy("reason").agg(F.sum("n").alias("rows"))


def readiness(checked: DataFrame) -> DataFrame:
    """One row: rows, those that are fine, those that are not, and what blocks the batch, in order of reason. Nothing is ever ready by itself."""
    fine = c("value_status") == "value_ok"
    marks = F.array(F.struct(F.when(fine, "ok").otherwise("blocked").alias("kind"), F.lit("").alias("reason")))
    why = F.transform("review_reasons", lambda r: F.struct(F.lit("why").alias("kind"), r.alias("reason")))
    each = _by_reasons(checked).select("n", F.inline(F.concat(marks, why))).groupBy("kind", "reason").agg(F.sum("n").alias("n"))
    of = lambda kind: F.coalesce(F.sum(F.when(c("kind") == kind, c("n"))), F.lit(0))
    told = F.sort_array(F.collect_list(F.when(c("kind") == "why", F.concat_ws(":", "reason", "n"))))  # as many as there are checks
    totals = each.agg((of("ok") + of("blocked")).alias("total_rows"), of("ok").alias("value_ok_rows"), of("blocked").alias("blocked_rows"), told.alias("_why"))
    blocked = F.when(c("blocked_rows") > 0, F.array(F.concat(F.lit("review_required_rows:"), "blocked_rows"))).otherwise(F.array().cast("array<string>"))
    ready = [F.lit(False).alias(f"ready_for_{x}") for x in ("bronze_write", "silver_promotion", "evaluation", "training")]
    return totals.select("total_rows", "value_ok_rows", "blocked_rows", F.concat(blocked, "_why").alias("blockers"), *ready)
