"""Coverage of players and prices, counts of settlements, the ledger's summary, and the resolver's review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.scalars import rate

c = F.col
#: What a closing book's name holds, and one that is named as a whole; fixed values.
CLOSING, CLOSING_BOOK = ("pinnacle", "closing"), "Pinnacle/PS"
#: What a review row is told apart by; fixed values.
QUEUE = ["entity_type", "raw_value", "normalized_raw_value", "provider_id", "context", "canonical_id", "display_name", "strategy", "confidence", "reason"]


def is_closing(bookmaker: Column) -> Column:
    """Whether a book's prices are closing ones."""
    name = F.lower(F.coalesce(bookmaker, F.lit("")))
    found = F.coalesce(bookmaker == CLOSING_BOOK, F.lit(False))
    for part in CLOSING:
        found |= F.contains(name, F.lit(part))
    return found


def player_coverage(matches: DataFrame, players: DataFrame, lineups: DataFrame) -> DataFrame:
    """One row: matches, players, line-up rows, matches with a line-up and their share, starters, rows with minutes."""
    total = matches.agg(F.count("*").alias("_matches"))
    known = players.agg(F.count("*").alias("players_total"))
    rows = lineups.agg(F.count("*").alias("lineup_rows"), F.countDistinct("match_id").alias("matches_with_lineups"), F.count_if(c("started") == 1).alias("starter_rows"), F.count("minutes_played").alias("minutes_known_rows"))
    both = total.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(rows))  # one row each
    return both.select("players_total", "lineup_rows", "matches_with_lineups", rate(c("matches_with_lineups"), c("_matches")).alias("lineup_match_coverage"), "starter_rows", "minutes_known_rows")


def odds_coverage(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """One row: prices, matches that have some and their share, and the same of closing books."""
    closing = is_closing(c("bookmaker"))
    total = matches.agg(F.count("*").alias("_matches"))
    rows = odds.agg(F.count("*").alias("odds_rows"), F.countDistinct("match_id").alias("matches_with_odds"), F.count_if(closing).alias("closing_odds_rows"), F.countDistinct(F.when(closing, c("match_id"))).alias("matches_with_closing_odds"))
    both = total.crossJoin(F.broadcast(rows))  # one row each
    share = lambda n: rate(c(n), c("_matches"))
    return both.select(*rows.columns, share("matches_with_odds").alias("odds_match_coverage"), share("matches_with_closing_odds").alias("closing_odds_match_coverage"))


def mapped_by(outcomes: DataFrame, keys: list[str], canonical: str) -> DataFrame:
    """Outcomes by ``keys`` that have a canonical id, and those that have none (null or empty)."""
    there = F.coalesce(c(canonical).cast("string"), F.lit("")) != ""
    return outcomes.groupBy(*keys).agg(F.count_if(there).alias("mapped"), F.count_if(~there).alias("unknown"))


def settlement_counts(settled: DataFrame) -> DataFrame:
    """(market, status, result, rows, units) of settled rows, units to six places."""
    return settled.groupBy("market", "status", "result").agg(F.count("*").alias("rows"), F.round(F.sum("unit_result"), 6).alias("units"))


def ledger_summary(bets: DataFrame) -> DataFrame:
    """One row: bets, those settled, won, lost and open, stake, profit, return on stake, mean closing value."""
    result = c("result")
    return bets.agg(
        F.count("*").alias("bets"), F.count_if(result.isNotNull()).alias("settled"), F.count_if(result == "win").alias("won"), F.count_if(result == "loss").alias("lost"), F.count_if(result.isNull()).alias("open"),
        F.round(F.sum("stake"), 6).alias("stake"), F.round(F.sum("profit"), 6).alias("profit"), rate(F.sum(F.when(result.isNotNull(), c("profit"))), F.sum(F.when(result.isNotNull(), c("stake")))).alias("roi"), F.round(F.avg("clv"), 6).alias("mean_clv"),
    )


def review_queue(candidates: DataFrame, least: float = 0.95) -> DataFrame:
    """Candidates that nobody may map by themselves, by QUEUE: how many, when first and last seen.

    These are not allowed to map, of a confidence under ``least``, or without a canonical id (null or empty). A null permission is one that was not given; a
    null confidence alone sends no row to review.
    """
    open_ = ~F.coalesce(c("auto"), F.lit(False)) | F.coalesce(c("confidence") < least, F.lit(False)) | (F.coalesce(c("canonical_id").cast("string"), F.lit("")) == "")
    return candidates.where(open_).groupBy(*QUEUE).agg(F.count("*").alias("candidates"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
