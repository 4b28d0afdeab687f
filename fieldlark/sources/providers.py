"""Provider payloads of matches, line-ups, statistics and competitions, as one typed frame each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.functions.scalars import outcome, period_of_minute
from fieldlark.functions.text import percent

_NAMED = "struct<id:long,name:string>"
_SIDES = f"struct<home:{_NAMED},away:{_NAMED}>"
_PAIR = "struct<home:int,away:int>"
_PLAYER = "struct<player:struct<id:long,name:string,number:int,pos:string>>"
STATE = (
    f"response array<struct<fixture:struct<id:long,date:string,status:struct<short:string,elapsed:int>>,league:struct<id:long,name:string,season:int>,teams:{_SIDES},goals:{_PAIR},"
    f"score:struct<halftime:{_PAIR},fulltime:{_PAIR}>,events:array<struct<time:struct<elapsed:int,extra:int>,team:{_NAMED},player:{_NAMED},type:string,detail:string>>,"
    f"lineups:array<struct<team:{_NAMED},startXI:array<{_PLAYER}>,substitutes:array<{_PLAYER}>>>,statistics:array<struct<team:{_NAMED},statistics:array<struct<type:string,value:string>>>>>>"
)


def match_state(spark: SparkSession, path: str) -> DataFrame:
    """One row a match of a state payload, with its nested parts."""
    return spark.read.schema(STATE).json(path, multiLine=True).select(F.explode("response").alias("m")).select("m.*")


def matches(state: DataFrame) -> DataFrame:
    c = F.col
    goals = outcome(c("goals.home"), c("goals.away"))
    return state.select(
        c("fixture.id").alias("match_id"), c("league.id").alias("competition_id"), c("league.season").alias("season"), c("fixture.date").alias("kickoff"), c("fixture.status.short").alias("status"), c("teams.home.id").alias("home_id"),
        c("teams.home.name").alias("home_team"), c("teams.away.id").alias("away_id"), c("teams.away.name").alias("away_team"), c("goals.home").alias("home_goals"), c("goals.away").alias("away_goals"),
        c("score.halftime.home").alias("home_half"), c("score.halftime.away").alias("away_half"), goals.alias("outcome"),
    )


def teams(state: DataFrame) -> DataFrame:
    return state.select(F.inline(F.array("teams.home", "teams.away"))).distinct()


def events(state: DataFrame) -> DataFrame:
    e = state.select(F.col("fixture.id").alias("match_id"), F.posexplode("events").alias("position", "e"))
    return e.select(
        "match_id", "position", F.col("e.time.elapsed").alias("minute"), F.col("e.time.extra").alias("extra"), period_of_minute(F.col("e.time.elapsed")).alias("period"), F.col("e.team.id").alias("team_id"),
        F.col("e.player.id").alias("player_id"), F.lower("e.type").alias("type"), F.col("e.detail").alias("detail"),
    )


def lineups(state: DataFrame) -> DataFrame:
    team = state.select(F.col("fixture.id").alias("match_id"), F.explode("lineups").alias("l"))
    part = lambda name, starts: F.transform(F.coalesce(f"l.{name}", F.array()), lambda x: F.struct(F.lit(starts).alias("starts"), x["player"].alias("p")))
    rows = team.select("match_id", F.col("l.team.id").alias("team_id"), F.inline(F.concat(part("startXI", True), part("substitutes", False))))
    return rows.select("match_id", "team_id", "starts", F.col("p.id").alias("player_id"), F.col("p.name").alias("player"), F.col("p.number").alias("number"), F.col("p.pos").alias("position"))


def statistics(state: DataFrame) -> DataFrame:
    """(match_id, team_id, type, value): numbers, a percent sign dropped."""
    team = state.select(F.col("fixture.id").alias("match_id"), F.explode("statistics").alias("s"))
    return team.select("match_id", F.col("s.team.id").alias("team_id"), F.inline("s.statistics")).select("match_id", "team_id", "type", percent(F.col("value")).alias("value"))


def truths(matches: DataFrame, stats: DataFrame, events: DataFrame) -> DataFrame:
    """One row a truth of each match: scores, margin, totals, corners, shots on target, cards, as (match_id, truth, value)."""
    of = lambda name: F.sum(F.when(F.lower("type") == name, F.col("value")))
    both = stats.groupBy("match_id").agg(of("corner kicks").alias("total_corners"), of("shots on goal").alias("total_shots_on_target"))
    cards = events.groupBy("match_id").agg(F.count_if((F.col("type") == "card") & F.lower("detail").contains("yellow")).alias("yellow_cards"), F.count_if((F.col("type") == "card") & F.lower("detail").contains("red")).alias("red_cards"))
    h, a = F.col("home_goals"), F.col("away_goals")
    wide = matches.join(both, "match_id", "left").join(cards, "match_id", "left").withColumns({"score_margin_home": h - a, "total_goals": h + a})
    names = ["home_goals", "away_goals", "score_margin_home", "total_goals", "total_corners", "total_shots_on_target", "yellow_cards", "red_cards"]
    return wide.select("match_id", *(F.col(n).cast("double").alias(n) for n in names)).unpivot("match_id", names, "truth", "value").where("value IS NOT NULL")


COMPETITION = "competition_id long, season_id long, competition_name string, season_name string, country_name string"
MATCH = "match_id long, match_date string, kick_off string, home_score int, away_score int, home_team struct<home_team_id:long,home_team_name:string>, away_team struct<away_team_id:long,away_team_name:string>, competition struct<competition_id:long>, season struct<season_id:long>"


def competitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPETITION).json(path, multiLine=True).where("competition_id IS NOT NULL")


def open_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of a folder of one file a competition and season; files that do not parse are left out."""
    df = spark.read.schema(MATCH).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).json(folder, multiLine=True).where("match_id IS NOT NULL")
    c = F.col
    return df.select("match_id", "match_date", c("competition.competition_id").alias("competition_id"), c("season.season_id").alias("season_id"), c("home_team.home_team_name").alias("home_team"), c("away_team.away_team_name").alias("away_team"), c("home_score").alias("home_goals"), c("away_score").alias("away_goals"))
