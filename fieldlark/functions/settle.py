"""Settlement: grading of totals, handicaps, results and player lines, as (result, status) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side(selection: Column) -> Column:
    """over, under, or the selection in lower case."""
    name = F.lower(F.coalesce(selection, F.lit("")))
    return F.when(F.contains(name, F.lit("over")), "over").when(F.contains(name, F.lit("under")), "under").otherwise(F.trim(name))


def total(value: Column, line: Column, selection: Column) -> Column:
    """win, loss, push; unsettled without a line or a side."""
    s = side(selection)
    beats = F.when(s == "over", value > line).when(s == "under", value < line)
    return F.when(line.isNull(), "unsettled").when(value == line, "push").when(beats.isNull(), "unsettled").when(beats, "win").otherwise("loss")


def handicap(margin_home: Column, line: Column, selection: Column, home: Column, away: Column) -> Column:
    adjusted = F.when(selection == home, margin_home + line).when(selection == away, line - margin_home)
    return F.when(adjusted > 0, "win").when(adjusted < 0, "loss").when(adjusted == 0, "push").otherwise("unsettled")


def result(selection: Column, winner: Column) -> Column:
    return F.when(selection == winner, "win").otherwise("loss")


def draw_no_bet(selection: Column, winner: Column) -> Column:
    return F.when(winner == "draw", "push").when(selection == winner, "win").otherwise("loss")


def double_chance(selection: Column, winner: Column) -> Column:
    """``selection``: home_or_draw, away_or_draw or home_or_away."""
    return F.when(F.contains(selection, winner), "win").otherwise("loss")


#: market -> how it is graded, and by which truth; fixed values.
MARKETS = {
    "football_1x2_regulation": ("result", "winner_name"),
    "football_total_goals_regulation": ("total", "total_goals"),
    "football_corners_total_regulation": ("total", "total_corners"),
    "football_shots_on_target_total_regulation": ("total", "total_shots_on_target"),
    "football_asian_handicap_regulation": ("handicap", "score_margin_home"),
}


def grade(market: Column, selection: Column, line: Column, truth: dict[str, Column]) -> Column:
    """Struct (settlement_result, settlement_status) of a market row beside its event's truths."""
    out = F.when(F.coalesce(market, F.lit("")) == "", F.lit("unsettled"))
    for name, (kind, key) in MARKETS.items():
        graded = {"result": lambda k=key: result(selection, truth[k]), "total": lambda k=key: total(truth[k], line, selection), "handicap": lambda k=key: handicap(truth[k], line, selection, truth["home_team_name"], truth["away_team_name"])}[kind]()
        out = out.when(market == name, graded)
    out = out.otherwise("unsettled")
    status = F.when(F.coalesce(market, F.lit("")) == "", "unmapped").when(out == "unsettled", "unsupported").otherwise("settled")
    return F.struct(out.alias("settlement_result"), status.alias("settlement_status"))


def ladder(home: Column, away: Column, yellow: Column, red: Column, corners: Column, half_winner: Column) -> Column:
    """The expanded families of one match: array of (family, selection, line, result, status)."""
    winner = F.when(home > away, "home").when(home < away, "away").otherwise("draw")
    both = F.when((home > 0) & (away > 0), "Yes").otherwise("No")
    row = lambda family, selection, line, graded, status="settled": F.struct(F.lit(family).alias("family"), F.lit(selection).alias("selection"), F.lit(line).cast("double").alias("line"), graded.alias("result"), F.lit(status).alias("status"))
    ou = lambda value, s, line: total(value.cast("double"), F.lit(line), F.lit(s))
    return F.array(
        *(row("both_teams_to_score", s, None, result(F.lit(s), both)) for s in ("Yes", "No")),
        *(row("double_chance", s, None, double_chance(F.lit(s), winner)) for s in ("home_or_draw", "away_or_draw")),
        *(row("draw_no_bet", s, None, draw_no_bet(F.lit(s), winner)) for s in ("home", "away")),
        row("team_total_goals", "home over", 1.5, ou(home, "over", 1.5)),
        row("team_total_goals", "away under", 1.5, ou(away, "under", 1.5)),
        *(row("total_yellow_cards", s, 0.5, ou(yellow, s, 0.5)) for s in ("over", "under")),
        row("total_red_cards", "under", 0.5, ou(red, "under", 0.5)),
        row("total_corners_alt_line", "over", 10.5, ou(corners, "over", 10.5)),
        row("first_half_1x2", "home", None, result(F.lit("home"), half_winner)),
        row("to_qualify", "home", None, F.lit("unsettled"), "unsupported"),
    )
