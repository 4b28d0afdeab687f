"""The registry of markets, and how a provider's markets resolve to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.operators import resolve
from fieldlark.operators.joins import small

#: market | family | selections | what it needs | availability | correlation tags | settlement scope; fixed values.
MARKETS = """
football.1x2 | core | home,draw,away | | supported | result | regulation_time
football.double_chance | core | 1X,12,X2 | | supported | result | regulation_time
football.draw_no_bet | core | home,away | | prototype | result | regulation_time
football.correct_score | core | 0-0,1-0,1-1,2-1,2-0 | | prototype | scoreline,result,goals | regulation_time
football.after_extra_time_winner | knockout | home,away | | future | result,extra_time | after_extra_time
football.to_qualify | knockout | home,away | | future | result,qualification | qualification
football.penalty_shootout_winner | knockout | home,away | | future | penalties,qualification | penalty_shootout
football.extra_time_result | extra_time | home,draw,away | | future | extra_time,result | extra_time_only
football.extra_time_total_goals | extra_time | over,under | line | future | extra_time,goals | extra_time_only
football.extra_time_goal_interval | extra_time | yes,no | minute | future | extra_time,goal_timing,goals | extra_time_only
football.total_goals | goals | over,under | line | supported | goals | regulation_time
football.team_goals | goals | over,under | team,line | prototype | team_attacking,goals | regulation_time
football.btts | goals | yes,no | | supported | goals,both_teams_score | regulation_time
football.goal_interval | goal_timing | yes,no | minute | future | goal_timing,goals | regulation_time
football.first_goal_time | goal_timing | before,after,no_goal | minute | future | goal_timing,goals | regulation_time
football.team_to_score_first | goal_timing | home,away,no_goal | | future | goal_timing,team_attacking | regulation_time
football.anytime_goalscorer | player_goals | yes,no | player | future | player_attacking,goals | regulation_time
football.first_goalscorer | player_goals | yes,no | player | future | player_attacking,goal_timing | regulation_time
football.total_corners | corners | over,under | line | prototype | corners,tempo | regulation_time
football.team_corners | corners | over,under | team,line | future | corners,team_attacking | regulation_time
football.first_corner | corners | home,away | | future | corners,tempo | regulation_time
football.total_cards | discipline | over,under | line | prototype | cards,physicality | regulation_time
football.team_cards | discipline | over,under | team,line | future | cards,team_discipline | regulation_time
football.player_card | discipline | yes,no | player | future | cards,player_discipline | regulation_time
football.red_card | discipline | yes,no | | future | cards,chaos | regulation_time
football.player_shots | player_stats | over,under | player,line | future | player_attacking,shots,tempo | regulation_time
football.player_shots_on_target | player_stats | over,under | player,line | future | player_attacking,shots,goals | regulation_time
football.player_assist | player_stats | yes,no | player | future | player_creativity,team_attacking | regulation_time
football.total_offsides | offsides | over,under | line | future | offsides,tempo | regulation_time
football.penalty_awarded | penalties | yes,no | | future | penalties,chaos,goals | regulation_time
football.halftime_result | halves | home,draw,away | | future | first_half,result | first_half
football.ht_ft | halves | HH,HD,HA,DH,DD,DA,AH,AD,AA | | future | first_half,result | regulation_time
nba.moneyline | core | home,away | | future | result | game_including_overtime
nba.spread | spread | home,away | line | future | spread,result | game_including_overtime
nba.total_points | totals | over,under | line | future | totals,pace | game_including_overtime
nba.player_points | player_props | over,under | player,line | future | player_usage,totals | game_including_overtime
"""
#: The phases whose play settles a market of each scope; fixed values.
REGULATION = "regulation_first_half,regulation_second_half,regulation_stoppage"
EXTRA_TIME = "extra_time_first_half,extra_time_first_half_stoppage,extra_time_second_half,extra_time_second_half_stoppage"
PHASES = {
    "regulation_time": REGULATION,
    "first_half": "regulation_first_half",
    "after_extra_time": f"{REGULATION},{EXTRA_TIME}",
    "extra_time_only": EXTRA_TIME,
    "penalty_shootout": "penalty_shootout",
    "qualification": f"{REGULATION},{EXTRA_TIME},penalty_shootout",
    "game_including_overtime": "",
}
NEEDS = ("team", "player", "line", "minute")
#: Sources by what their rows are; fixed values.
ROW_CLASSES = {"fixtures_results": "fixture_result", "odds": "odds_snapshot", "lineups_events": "lineup_event_context"}


def registry(spark: SparkSession, sport: str | None = None, availability: str | None = None) -> DataFrame:
    """The registry's markets, lists as arrays, of one sport or availability if named."""
    rows = [[x.strip() for x in line.split("|")] for line in MARKETS.strip().splitlines()]
    names = ["market_id", "family", "selections", "_needs", "availability", "correlation_tags", "settlement_scope"]
    df = spark.createDataFrame([(*r, PHASES[r[-1]]) for r in rows], ", ".join(f"{n} string" for n in [*names, "phase_scope"]))
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    df = df.withColumns({c: split(c) for c in ("selections", "_needs", "correlation_tags", "phase_scope")} | {"sport": F.substring_index("market_id", ".", 1)})
    df = df.withColumns({f"requires_{n}": F.array_contains("_needs", n) for n in NEEDS}).drop("_needs")
    for column, wanted in (("sport", sport), ("availability", availability)):
        df = df.where(F.col(column) == wanted) if wanted else df
    return df


def exported(markets: DataFrame) -> DataFrame:
    """The registry as flat text, lists joined by a bar."""
    return markets.withColumns({f.name: F.concat_ws("|", f.name) for f in markets.schema if f.dataType.typeName() == "array"})


def resolved(rows: DataFrame, aliases: DataFrame, markets: DataFrame) -> DataFrame:
    """Rows (provider, market_key, ...) with the registry's market, its family, scope and needs, or a review reason.

    ``aliases``: provider, market_key, market_id; of several for one key the smallest market counts. An alias
    to a market that the registry lacks resolves nothing.
    """
    known = aliases.groupBy("provider", "market_key").agg(F.min("market_id").alias("market_id"))
    fields = ["family", "settlement_scope", "requires_line", "requires_player"]
    named = known.join(markets.select("market_id", *fields), "market_id")
    out = rows.join(small(named), ["provider", "market_key"], "left")
    return out.withColumns({"status": F.when(F.col("market_id").isNotNull(), "resolved").otherwise("needs_review"), "reason": F.when(F.col("market_id").isNull(), "unmapped_provider_market")})


def mapping_preview(outcomes: DataFrame, aliases: DataFrame, markets: DataFrame) -> DataFrame:
    """Provider markets with their events, books and outcomes, and whether each is mapped."""
    return resolved(resolve.market_groups(outcomes), aliases, markets).select("provider", "market_key", "events", "books", "outcomes", "market_id", "status")


def classified(rows: DataFrame, kind: str = "source_kind") -> DataFrame:
    """Rows with their class by source kind; other kinds are unknown and to be reviewed. Nothing is promoted."""
    of = F.coalesce(*(F.when(F.col(kind) == k, F.lit(name)) for k, name in ROW_CLASSES.items()))
    unknown = of.isNull()
    return rows.withColumns({"row_class": F.coalesce(of, F.lit("unknown")), "classification_status": F.when(unknown, "review_required").otherwise("classified"), "review_reason": F.when(unknown, F.concat(F.lit("unknown source kind: "), F.coalesce(kind, F.lit(""))))})


#: Scopes of competitions whose rows are trained on; fixed values.
TRAINED_SCOPES, REFERENCE_SCOPE = ("core_train", "expanded_train"), "reference_only"


def league_universe(leagues: DataFrame, scope: str = "default_scope") -> DataFrame:
    """Competitions with what their scope allows: an own model and calibration, or reference only."""
    trained = F.coalesce(F.col(scope).isin(*TRAINED_SCOPES), F.lit(False))
    return leagues.withColumns({"train_separately": trained, "calibrate_separately": trained, "reference_only": F.coalesce(F.col(scope) == REFERENCE_SCOPE, F.lit(False))})


def universe_counts(leagues: DataFrame, group: str = "region_group", scope: str = "default_scope") -> DataFrame:
    """Competitions by group: all, core, trained and the rest."""
    trained = F.coalesce(F.col(scope).isin(*TRAINED_SCOPES), F.lit(False))
    return leagues.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col(scope) == TRAINED_SCOPES[0]).alias("core_train"), F.count_if(trained).alias("trainable"), F.count_if(~trained).alias("other"))


#: Names that imported rows give a column, the first that is filled counts; fixed values.
ROW_ALIASES = {
    "source_id": ("source_id", "source"),
    "competition_id": ("competition_id", "competition", "league"),
    "season": ("season", "year"),
    "source_event_id": ("source_event_id", "event_id", "id"),
    "kickoff_utc": ("kickoff_utc", "date", "kickoff"),
    "home_name": ("home_name", "home", "home_team"),
    "away_name": ("away_name", "away", "away_team"),
    "home_score": ("home_score", "home_goals"),
    "away_score": ("away_score", "away_goals"),
}


def imported(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ROW_ALIASES) -> DataFrame:
    """Rows with the columns of ``aliases``, each from the first of its names that is there and not empty; other columns are left out.

    Scores and seasons are numbers, null where they are none; other columns are strings, empty where unknown.
    """
    have = {c.lower(): c for c in rows.columns}

    def first(names: tuple[str, ...]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`").cast("string")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = lambda name: name == "season" or name.endswith("_score")
    return rows.select(*((first(names).try_cast("double") if number(k) else F.coalesce(first(names), F.lit(""))).alias(k) for k, names in aliases.items()))


def only(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal what is wanted; ``all`` and None want anything."""
    for column, value in wanted.items():
        if value not in (None, "all"):
            rows = rows.where(F.col(column) == value)
    return rows
