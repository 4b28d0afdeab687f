"""Checks of imported tables against each other: settlements beside prices, labels beside kick-offs, packs and payloads by shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import bronze_rules

c = F.col
KEYS = ["fixture_id", "market_family", "selection_id"]
#: Results of a settlement; fixed values.
RESULTS = ("win", "loss", "push", "void")


def settlement_faults(settlements: DataFrame, odds: DataFrame, fixtures: DataFrame, order: list[str]) -> DataFrame:
    """(KEYS, fault), a row for each fault of a settlement: no fixture, no price, no known result, a label before the first price was taken.

    The first price of a selection is the first in ``order``; prices are reduced to it before they meet the settlements.
    """
    first = odds.groupBy(*KEYS).agg(F.min_by("captured_at", F.struct(*order)).alias("_captured"), F.lit(True).alias("_priced"))
    known = fixtures.select("fixture_id").distinct().withColumn("_fixture", F.lit(True))
    both = settlements.join(first, KEYS, "left").join(known, "fixture_id", "left")
    bad = {
        "settlement_missing_fixture": c("_fixture").isNull(), "settlement_missing_odds": c("_priced").isNull(),
        "invalid_settlement_result": ~F.coalesce(c("result").isin(*RESULTS), F.lit(False)), "label_before_prediction_time": c("label_time") < c("_captured"),
    }
    found = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in bad.items())))
    return both.select(*KEYS, F.explode(found).alias("fault"))


def priced_before_settlement(odds: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``odds`` with its fixture's settled_at and ``fault``: missing_fixture, price_not_above_one, captured_after_settlement, or null. Fixtures have one row an id."""
    joined = odds.join(fixtures.select("fixture_id", "settled_at", F.lit(True).alias("_there")), "fixture_id", "left")
    fine = lambda price: F.coalesce(c(price) > 1, F.lit(False))
    fault = F.when(~(fine("price") & fine("closing_price")), "price_not_above_one").when(c("_there").isNull(), "missing_fixture").when(F.coalesce(c("captured_at") >= c("settled_at"), F.lit(True)), "captured_after_settlement")
    return joined.withColumn("fault", fault).drop("_there")


def result_candidates(settlements: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Settled rows beside their fixture, with ``fault`` (missing_required_fields, label_not_after_kickoff, or null) and the status of the fine ones.

    Rows that are not settled are left out; a settlement's own names come before the fixture's. Nothing of it trains.
    """
    known = fixtures.select("fixture_id", "competition_id", "kickoff", c("home_name").alias("_home"), c("away_name").alias("_away"))
    rows = settlements.where("status = 'settled'").join(known, "fixture_id", "left")
    lacking = c("home_score").isNull() | c("away_score").isNull() | c("label_time").isNull()
    fault = F.when(lacking, "missing_required_fields").when(c("label_time") <= c("kickoff"), "label_not_after_kickoff")
    name = lambda own, other: F.coalesce(F.nullif(c(own), F.lit("")), c(other)).alias(own)
    return rows.select("fixture_id", "competition_id", name("home_name", "_home"), name("away_name", "_away"), "kickoff", "home_score", "away_score", "label_time", fault.alias("fault"), F.when(fault.isNull(), "ready_for_evaluation_preview_not_training").alias("candidate_status"))


def staged(timeline: DataFrame, truths: list[str], kind: str = "timeline_type") -> DataFrame:
    """Match states and events with the stage they belong to; ``truths`` are shown to the stage after the event alone. Rows of other kinds are left out."""
    after = c(kind) == "match_state"
    rows = timeline.where(c(kind).isin("match_state", "match_event"))
    made = {"snapshot_stage": F.when(after, "post_event_truth").otherwise("event_observation"), "final_truth_allowed": after.cast("int")}
    return rows.withColumns(made | {t: F.when(after, c(t)) for t in truths})


#: Fields that rows of a normalised pack fill; fixed values.
PACK = {
    "fixtures": ("source_id", "fixture_id", "kickoff_utc", "home_name", "away_name"),
    "results": ("source_id", "fixture_id", "result_label", "label_available_after_utc"),
    "events": ("source_id", "fixture_id", "event_type", "team_name"),
}


def pack_faults(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, fault, rows): tables of PACK that must have rows and have none (fixtures, results), and rows with an empty field."""
    out = None
    for name, fields in PACK.items():
        if name not in tables:
            continue
        empty = F.lit(False)
        for f in fields:
            empty |= F.coalesce(c(f).cast("string"), F.lit("")) == ""
        counts = tables[name].agg(F.when((F.count("*") == 0) & F.lit(name != "events"), 1).otherwise(0).cast("long").alias("no_rows"), F.count_if(empty).alias("missing_fields"))
        part = counts.unpivot([], ["no_rows", "missing_fields"], "fault", "rows").select(F.lit(name).alias("table_name"), "fault", "rows")
        out = part if out is None else out.unionByName(part)
    return out.where("rows > 0")


_OUTCOME = "struct<name:variant,price:variant>"
ODDS_SHAPE = f"array<struct<id:variant,sport_key:variant,commence_time:variant,home_team:variant,away_team:variant,bookmakers:array<struct<key:variant,last_update:variant,markets:array<struct<key:variant,outcomes:array<{_OUTCOME}>>>>>>>"
_SIDE = "struct<id:variant>"
STATE_SHAPE = (
    f"struct<response:array<struct<fixture:struct<id:variant,date:variant>,teams:struct<home:{_SIDE},away:{_SIDE}>,goals:struct<home:variant,away:variant>,"
    "events:array<struct<time:struct<elapsed:variant>,team:struct<id:variant>,type:variant,player:struct<id:variant>>>>>>"
)


def _text(v: Column) -> Column:
    """A variant's text, null if it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT)$"), F.try_variant_get(v, "$", "double"))


def _lacks(kind: str, label: str, v: Column) -> Column:
    """What is to say of a field that is not as it must be: a text, a number, a time, or a price."""
    if kind == "string":
        return F.when(F.trim(F.coalesce(_text(v), F.lit(""))) == "", f"missing string field: {label}")
    if kind == "number":
        return F.when(_number(v).isNull(), f"missing number field: {label}")
    if kind == "timestamp":
        return F.when(bronze_rules.time_fault(F.coalesce(_text(v), F.lit(""))), f"invalid timestamp field: {label}")
    return F.when(~F.coalesce((_number(v) > 1) & (_number(v) < 1000), F.lit(False)), f"invalid decimal field: {label}")


def _all(kinds: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(F.array(*(_lacks(*k) for k in kinds)))


def _of_each(items: Column, label: str, faults, empty: str | None = None) -> Column:
    """Faults of an array: that it is none, that it is empty, and those of its elements."""
    none = F.array().cast("array<string>")
    whole = F.when(items.isNull(), F.array(F.lit(f"{label} must be an array")))
    if empty:
        whole = whole.when(F.size(items) == 0, F.array(F.lit(f"{empty} must not be empty")))
    return whole.otherwise(F.coalesce(F.flatten(F.transform(items, faults)), none))


def odds_faults(payload: Column) -> Column:
    """What is wrong with the shape of a price payload, each fault as often as it is there."""
    outcome = lambda o: _all([("string", "bookmakers.markets.outcomes.name", o["name"]), ("decimal", "bookmakers.markets.outcomes.price", o["price"])])
    market = lambda m: F.concat(_all([("string", "bookmakers.markets.key", m["key"])]), _of_each(m["outcomes"], "bookmakers.markets.outcomes", outcome))
    book = lambda b: F.concat(_all([("string", "bookmakers.key", b["key"]), ("timestamp", "bookmakers.last_update", b["last_update"])]), _of_each(b["markets"], "bookmakers.markets", market))
    fields = [("string", "id"), ("string", "sport_key"), ("timestamp", "commence_time"), ("string", "home_team"), ("string", "away_team")]
    item = lambda x: F.concat(_all([(k, f, x[f]) for k, f in fields]), _of_each(x["bookmakers"], "bookmakers", book, "bookmakers"))
    return _of_each(F.from_json(payload, ODDS_SHAPE), "odds fixture", item, "odds fixture")


def state_faults(payload: Column) -> Column:
    """What is wrong with the shape of a match state payload, each fault as often as it is there."""
    at = "response.events"
    event = lambda e: _all([("number", f"{at}.time.elapsed", e["time"]["elapsed"]), ("number", f"{at}.team.id", e["team"]["id"]), ("string", f"{at}.type", e["type"]), ("number", f"{at}.player.id", e["player"]["id"])])

    def item(x: Column) -> Column:
        own = [("number", "fixture.id", x["fixture"]["id"]), ("timestamp", "fixture.date", x["fixture"]["date"]), ("number", "teams.home.id", x["teams"]["home"]["id"]), ("number", "teams.away.id", x["teams"]["away"]["id"]), ("number", "goals.home", x["goals"]["home"]), ("number", "goals.away", x["goals"]["away"])]
        return F.concat(_all([(k, f"response.{f}", v) for k, f, v in own]), _of_each(x["events"], at, event))

    return _of_each(F.from_json(payload, STATE_SHAPE)["response"], "response", item, "response")


#: The shape checks by provider payload.
SHAPES = {"odds": odds_faults, "match_state": state_faults}


def payload_health(payloads: DataFrame) -> DataFrame:
    """(payload_id, kind, contract_ok, blockers) of payloads (payload_id, kind, payload): the different faults of each, sorted; a kind without a check is one."""
    found = F.array(F.concat(F.lit("unsupported provider fixture validation: "), F.coalesce("kind", F.lit(""))))
    for kind, faults in SHAPES.items():
        found = F.when(c("kind") == kind, faults(c("payload"))).otherwise(found)
    return payloads.select("payload_id", "kind", F.array_sort(F.array_distinct(found)).alias("blockers")).withColumn("contract_ok", F.size("blockers") == 0)
