"""Bronze, silver and gold tables of historical packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.text import identifier
from fieldlark.operators.dedupe import keep_last
from fieldlark.operators.joins import last_wins, small


def bronze_odds(odds: DataFrame) -> DataFrame:
    return odds.select("fixture_id", "source_id", "market_family", "selection_id", "bookmaker", "captured_at_utc", "decimal_odds", "is_closing_snapshot")


def silver_fixtures(fixtures: DataFrame, identity: DataFrame) -> DataFrame:
    """Fixtures with canonical team ids and names: from the identity map by raw name (its last row), else their own."""
    names = small(keep_last(identity, ["raw_name"], ["source_id", "entity_type"]))
    out = fixtures
    for side in ("home", "away"):
        known = names.select(F.col("raw_name").alias(f"{side}_team_raw"), F.col("canonical_id").alias(f"_{side}_id"), F.col("canonical_name").alias(f"_{side}_name"))
        out = out.join(known, f"{side}_team_raw", "left")
        out = out.withColumns({f"{side}_id": F.coalesce(f"_{side}_id", f"{side}_team_canonical_id"), f"{side}_name": F.coalesce(f"_{side}_name", f"{side}_team_raw")}).drop(f"_{side}_id", f"_{side}_name")
    return out


def silver_odds(odds: DataFrame) -> DataFrame:
    """Odds with the key of the group that their margin is taken out of, and the group's no-vig shares."""
    from fieldlark.operators.bets import implied_share

    keyed = bronze_odds(odds).withColumn("no_vig_group", identifier(*(F.col(c) for c in ("fixture_id", "bookmaker", "market_family", "captured_at_utc"))))
    return implied_share(keyed, "decimal_odds", ["no_vig_group"])


def gold_candidates(odds: DataFrame, settlements: DataFrame, compat: bool = False) -> DataFrame:
    """Odds beside their settlement (the last one of a key) with ``leakage_safe``; ids name family and bookmaker unless ``compat``."""
    keys = ["fixture_id", "market_family", "selection_id"]
    out = last_wins(odds, settlements, keys, ["settled_at_utc"])
    parts = ["fixture_id", "selection_id", "captured_at_utc"] if compat else ["fixture_id", "market_family", "selection_id", "bookmaker", "captured_at_utc"]
    return out.withColumns({"candidate_id": identifier(*(F.col(c) for c in parts)), "leakage_safe": F.col("label_available_after_utc") >= F.col("captured_at_utc")})


def silver_facts(ready: bool, **parts: DataFrame) -> DataFrame:
    """All fact rows with their kind; refused unless the promotion gate is open."""
    if not ready:
        raise ValueError("identities or markets are still under review")
    out = None
    for kind, df in parts.items():
        rows = df.withColumn("fact_kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
