"""The provider chain: linked timelines, feature snapshots by stage, grading, leak checks, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.odds import brier, log_loss
from fieldlark.functions.settle import total
from fieldlark.operators.joins import stacked
from fieldlark.operators.models import blended

PRE, POST = "pre_event_market", "post_event_evaluation"


def timeline(links: DataFrame, matches: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Everything known of each linked event in one table, tagged by where it comes from."""
    ids = links.select("canonical_event_id", "match_id", "provider_event_id")
    fields = lambda df, at, detail: df.select("canonical_event_id", at.cast("string").alias("at"), F.to_json(F.struct(*detail)).alias("detail"))
    by_match = ids.where("match_id IS NOT NULL").select("canonical_event_id", "match_id").distinct()
    by_event = ids.where("provider_event_id IS NOT NULL").select("canonical_event_id", F.col("provider_event_id").alias("event_id")).distinct()
    return stacked(
        match=fields(by_match.join(matches, "match_id"), F.col("kickoff"), ["home_team", "away_team", "home_goals", "away_goals"]),
        event=fields(by_match.join(events, "match_id"), F.col("minute"), ["type", "team_id", "player_id"]),
        market=fields(by_event.join(snapshots, "event_id"), F.col("observed_at"), ["bookmaker", "market_key", "selection", "price", "line"]),
    )


def market_snapshots(markets: DataFrame, graded: DataFrame) -> DataFrame:
    """Each market row before the event, without truth, and after it with its settlement; eligible if mapped and sure."""
    eligible = F.coalesce((F.col("mapped_market_id") != "") & (F.coalesce("needs_mapping", F.lit(0)) == 0), F.lit(False))
    rows = markets.withColumn("model_eligible", eligible)
    before = rows.withColumns({"snapshot_stage": F.lit(PRE), "settlement_result": F.lit(None).cast("string"), "settlement_status": F.lit(None).cast("string")})
    after = rows.join(graded.select("canonical_event_id", "source_ref", "settlement_result", "settlement_status"), ["canonical_event_id", "source_ref"], "left").withColumn("snapshot_stage", F.lit(POST))
    return before.unionByName(after)


def first_pass(snapshots: DataFrame) -> DataFrame:
    """Eligible prices before the event beside their settled rows after it: blended probability, label, losses. Pushes drop out."""
    pre = snapshots.where((F.col("snapshot_stage") == PRE) & F.col("model_eligible")).select("canonical_event_id", "source_ref", "mapped_market_id", "decimal_odds")
    post = snapshots.where((F.col("snapshot_stage") == POST) & (F.col("settlement_status") == "settled")).select("canonical_event_id", "source_ref", "settlement_result")
    label = F.when(F.col("settlement_result") == "win", 1.0).when(F.col("settlement_result") == "loss", 0.0)
    ways = F.when(F.col("mapped_market_id") == "football_1x2_regulation", 3.0).otherwise(2.0)
    rows = pre.join(post, ["canonical_event_id", "source_ref"]).withColumn("label", label).where("label IS NOT NULL")
    p = blended(1 / F.coalesce("decimal_odds", F.lit(2.0)), ways)
    return rows.withColumn("p", p).withColumns({"brier": brier(F.col("p"), F.col("label")), "log_loss": log_loss(F.col("p"), F.col("label"))})


def player_lines(markets: DataFrame, truth: DataFrame) -> DataFrame:
    """Player lines graded by what the player did; without a truth they are unsupported."""
    out = markets.join(truth, ["canonical_event_id", "player_id", "stat"], "left")
    result = F.when(F.col("value").isNull(), "unsettled").otherwise(total(F.col("value"), F.col("line"), F.col("selection")))
    return out.withColumns({"settlement_result": result, "settlement_status": F.when(result == "unsettled", "unsupported").otherwise("settled")})


def results_into_fixtures(fixtures: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixtures with their result, results that are in error: no fixture, or a label not after kick-off)."""
    both = results.join(fixtures.select("fixture_id", "kickoff"), "fixture_id", "left")
    bad = F.when(F.col("kickoff").isNull(), "orphan").when(F.col("label_time") <= F.col("kickoff"), "label_before_kickoff")
    checked = both.withColumn("error", bad)
    good = checked.where("error IS NULL").drop("error", "kickoff")
    return fixtures.join(good, "fixture_id", "left"), checked.where("error IS NOT NULL")


def import_report(rows: DataFrame, key: str, reasons: Column) -> DataFrame:
    """One row: rows read, accepted, and refused by reason, repeated keys last; the first row of a key is kept."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy(key, F.col("_reason").isNull()).orderBy("position")) > 1
    checked = rows.withColumn("_reason", reasons).withColumn("_reason", F.coalesce("_reason", F.when(again, "duplicate")))
    return checked.agg(F.count("*").alias("input_rows"), F.count_if(F.col("_reason").isNull()).alias("accepted")).crossJoin(F.broadcast(checked.where("_reason IS NOT NULL").groupBy("_reason").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_reason", "count")))).alias("refused"))))
