"""Readers of match, price and event files, as typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.functions.scalars import absolute_minute, blank_to_null, first_filled, number, whole
from fieldlark.functions.text import iso_date

#: Prefixes of the match-result prices, and of the over and under 2.5 prices, in season files; fixed values.
RESULT_BOOKS = ("B365", "BW", "IW", "PS", "WH", "VC", "Max", "Avg", "B365C", "BWC", "IWC", "PSC", "WHC", "VCC", "MaxC", "AvgC")
TOTAL_BOOKS = ("B365", "P", "Max", "Avg", "B365C", "PC", "MaxC", "AvgC")


def csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, all columns text: quotes doubled, cells trimmed, rows without any cell left out.

    With ``multi_line``, cells may hold line breaks; such a file is read by one task.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "encoding": "UTF-8"}
    df = spark.read.options(**options).csv(path)
    clean = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    return clean.where(F.coalesce(*(blank_to_null(F.col(f"`{c}`")) for c in clean.columns)).isNotNull())


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has the columns (in any case)."""
    there = {c.lower() for c in df.columns}
    if lacking := [c for c in columns if c.lower() not in there]:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(market_id, selection, odds, bookmaker) of a price file: rows with fewer cells are left out, a malformed price is an error."""
    names = ["market_id", "selection", "odds", "bookmaker", "_wrong"]  # the last holds a line whose cells are not four
    options = {"header": True, "columnNameOfCorruptRecord": "_wrong", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    cells = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).options(**options).csv(path)
    whole = cells.where(F.col("_wrong").isNull() | F.col("bookmaker").isNotNull())
    bad = F.raise_error(F.concat(F.lit("malformed price: "), F.coalesce("odds", F.lit("")))).cast("double")
    return whole.select("market_id", "selection", F.coalesce(F.col("odds").try_cast("double"), bad).alias("odds"), F.coalesce("bookmaker", F.lit("")).alias("bookmaker"))


def optional(df: DataFrame, *names: str) -> Column:
    """The first filled of the columns that ``df`` has."""
    there = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{there[n.lower()]}`") for n in names if n.lower() in there]
    return first_filled(*found) if found else F.lit(None).cast("string")


def season(spark: SparkSession, path: str, competition: str, season_id: str, pivot: int | None = 70) -> DataFrame:
    """Matches of a season file: ids, date, teams, goals, result, and the file's own columns."""
    df = require(csv(spark, path), ["Date", "HomeTeam", "AwayTeam"])
    date, home, away = iso_date(optional(df, "Date"), pivot), optional(df, "HomeTeam", "Home"), optional(df, "AwayTeam", "Away")
    return df.withColumns(
        {
            "match_id": F.concat_ws(":", F.lit(competition), F.lit(season_id), date, home, away),
            "match_date": date,
            "home_team": home,
            "away_team": away,
            "home_goals": whole(optional(df, "FTHG", "HG")),
            "away_goals": whole(optional(df, "FTAG", "AG")),
        }
    )


def season_prices(matches: DataFrame) -> DataFrame:
    """(match_id, market, bookmaker, selection, odds, valid) rows from a season file's price columns."""
    there = set(matches.columns)
    cells = [(f"{b}{s}", "1x2", b, n) for b in RESULT_BOOKS for s, n in (("H", "home"), ("D", "draw"), ("A", "away"))] + [(f"{b}{s}2.5", "total_goals_2.5", b, n) for b in TOTAL_BOOKS for s, n in ((">", "over"), ("<", "under"))]
    each = [F.struct(F.lit(m).alias("market"), F.lit(b).alias("bookmaker"), F.lit(s).alias("selection"), blank_to_null(F.col(f"`{c}`")).alias("raw")) for c, m, b, s in cells if c in there]
    if not each:
        return matches.select("match_id").limit(0).select("match_id", *(F.lit("").alias(c) for c in ("market", "bookmaker", "selection")), F.lit(0.0).alias("odds"), F.lit(False).alias("valid"))
    long = matches.select("match_id", F.inline(F.array(*each))).where("raw IS NOT NULL").withColumn("odds", number(F.col("raw")))
    return long.drop("raw").withColumn("valid", F.coalesce(F.col("odds") > 1, F.lit(False)))


MATCH_LIST = "name string, matches array<struct<round:string,date:string,team1:string,team2:string,score:struct<ft:array<int>,ht:array<int>>>>"


def match_list(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a JSON document {name, matches: [{round, date, team1, team2, score: {ft, ht}}]}."""
    df = spark.read.schema(MATCH_LIST).json(path, multiLine=True)
    m = df.select(F.col("name").alias("competition"), F.explode("matches").alias("m"))
    score = lambda k, i: F.get(F.col(f"m.score.{k}"), F.lit(i))
    return m.select("competition", F.col("m.round").alias("round"), F.col("m.date").alias("match_date"), F.col("m.team1").alias("home_team"), F.col("m.team2").alias("away_team"), score("ft", 0).alias("home_goals"), score("ft", 1).alias("away_goals"), score("ht", 0).alias("home_half"), score("ht", 1).alias("away_half"))


EVENT = "id string, minute int, second int, period int, type struct<name:string>, team struct<name:string>, player struct<id:long,name:string>, location array<double>, shot struct<statsbomb_xg:double,outcome:struct<name:string>>"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON files, one a match; files that do not parse are left out."""
    df = spark.read.schema(EVENT).option("ignoreCorruptFiles", True).json(folder, multiLine=True)
    match = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json", 1)
    return df.where("id IS NOT NULL").select(match.alias("match_id"), "id", "minute", "second", F.col("period").cast("string").alias("period"), F.col("type.name").alias("type"), F.col("team.name").alias("team"), F.col("player.id").alias("player_id"), F.get("location", F.lit(0)).alias("x"), F.get("location", F.lit(1)).alias("y"), F.col("shot.statsbomb_xg").alias("xg"), F.col("shot.outcome.name").alias("outcome"))


PERIOD_EVENT = "id long, matchId long, eventName string, subEventName string, matchPeriod string, eventSec double, teamId long, playerId long, positions array<struct<x:double,y:double>>, tags array<struct<id:int>>"
GOAL_TAG = 101


def period_events(spark: SparkSession, path: str) -> DataFrame:
    """Events that give seconds into a period, with the minute of the match."""
    df = spark.read.schema(PERIOD_EVENT).json(path, multiLine=True)
    return df.select(F.col("matchId").alias("match_id"), F.col("id").alias("event_id"), F.col("eventName").alias("type"), F.col("matchPeriod").alias("period"), absolute_minute(F.col("eventSec"), F.col("matchPeriod")).alias("minute"), (F.col("eventSec") % 60).cast("int").alias("second"), F.col("teamId").alias("team_id"), F.col("playerId").alias("player_id"), F.exists("tags", lambda t: t["id"] == GOAL_TAG).alias("goal"))


ODDS = "id string, sport_key string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string,title:string,last_update:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double,point:double,description:string>>>>>>"


def odds_payload(spark: SparkSession, path: str) -> DataFrame:
    """One row an outcome of event, bookmaker and market; an event without any keeps a row of nulls."""
    df = spark.read.schema(ODDS).json(path, multiLine=True)
    book = df.select(F.col("id").alias("event_id"), "sport_key", "commence_time", "home_team", "away_team", F.explode_outer("bookmakers").alias("b"))
    market = book.select("*", F.explode_outer("b.markets").alias("m"))
    return market.select("event_id", "sport_key", "commence_time", "home_team", "away_team", F.col("b.key").alias("bookmaker"), F.col("m.key").alias("market_key"), F.coalesce("m.last_update", "b.last_update").alias("observed_at"), F.posexplode_outer("m.outcomes").alias("position", "o")).select("*", F.col("o.name").alias("selection"), F.col("o.price").alias("price"), F.col("o.point").alias("line"), F.col("o.description").alias("description")).drop("o")


def discovered_markets(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("market_key").agg(F.count("selection").alias("outcomes"), F.max(F.col("line").isNotNull()).alias("has_line"))


def items(df: DataFrame, *names: str) -> DataFrame:
    """One row an element of the first filled array field of a payload."""
    there = [c for c in names if c in df.columns]
    return df.select(F.explode(F.coalesce(*there)).alias("item")).select("item.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines, compressed or not; blank lines are left out. ``strict``: a bad line is an error, else it is in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def envelope(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The rows of {"rows": [...]} documents; ``row`` is the DDL of one."""
    return spark.read.schema(f"rows array<struct<{row}>>").json(path, multiLine=True).select(F.inline("rows"))


def file_rows(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Lines that are not blank, by file of a folder."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    return lines.where(F.trim("value") != "").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def union_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)
