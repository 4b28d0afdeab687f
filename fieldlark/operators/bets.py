"""Value selections, tickets, paper bets and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.odds import clv, decision, fair_odds, kelly, no_vig, quarter_kelly, ticket_decision, unit_result
from fieldlark.functions.scalars import clamp
from fieldlark.operators import history
from fieldlark.operators.dedupe import keep_last, top_in_group
from fieldlark.operators.joins import books, small

#: The fixed tickets: name -> (risk, legs as market:selection); fixed values.
TICKETS = {
    "Safe Builder": (0.08, ("football.double_chance:1X", "football.total_goals:under_3.5")),
    "Balanced Builder": (0.22, ("football.1x2:home", "football.total_goals:over_2.5")),
    "Aggressive Builder": (0.38, ("football.1x2:home", "football.total_goals:over_2.5", "football.btts:yes")),
}


def market_probabilities(home: Column, draw: Column, away: Column, over: Column, btts: Column, rate_home: Column) -> Column:
    """Array of (market, selection, p) that a prediction gives, some by conservative approximation."""
    scoreless = F.exp(-rate_home)
    p = {
        "football.1x2": {"home": home, "draw": draw, "away": away},
        "football.double_chance": {"1X": home + draw, "12": home + away, "X2": draw + away},
        "football.total_goals": {"over_2.5": over, "under_2.5": 1 - over, "over_1.5": clamp(over + 0.20, 0.0, 0.98), "under_3.5": clamp(1.18 - over, 0.0, 0.98)},
        "football.btts": {"yes": btts, "no": 1 - btts},
        "football.team_goals": {"home_over_0.5": 1 - scoreless, "home_over_1.5": 1 - scoreless * (1 + rate_home)},
    }
    return F.array(*(F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), clamp(x, 0.0, 1.0).alias("p")) for m, each in p.items() for s, x in each.items()))


def value_selections(prices: DataFrame, probabilities: DataFrame, trust: float, keys: list[str] = ["market", "selection"]) -> DataFrame:  # noqa: B006
    """Prices beside the model's probability: fair odds, edge, Kelly share, decision; markets without one drop out.

    A few probabilities go to the prices: by their keys, all prices would meet in as many tasks as there are selections.
    """
    out = prices.join(small(probabilities), keys)
    p, odds = F.col("p"), F.col("odds")
    out = out.withColumns({"fair_odds": fair_odds(p), "edge": p * odds - 1, "kelly": F.coalesce(kelly(p, odds), F.lit(0.0)), "quarter_kelly": F.coalesce(quarter_kelly(p, odds), F.lit(0.0))})
    return out.withColumn("decision", decision(F.col("edge"), F.col("kelly"), F.lit(trust)))


def tickets(selections: DataFrame, match: str, trust: float) -> DataFrame:
    """The fixed tickets of each match whose legs are all priced: combined odds, adjusted probability, edge, decision.

    Of several rows for one leg the likeliest counts, then the one with the best price.
    """
    leg = F.concat_ws(":", "market", "selection")
    wanted = sorted({x for _, legs in TICKETS.values() for x in legs})
    at = selections.withColumn("_leg", leg).where(F.col("_leg").isin(*wanted)).groupBy(match).agg(*(F.max(F.when(F.col("_leg") == x, F.struct("p", "odds"))).alias(f"_{i}") for i, x in enumerate(wanted)))
    rows = []
    for name, (risk, legs) in TICKETS.items():
        each = [F.col(f"_{wanted.index(x)}") for x in legs]
        p, odds = each[0]["p"], each[0]["odds"]
        for x in each[1:]:
            p, odds = p * x["p"], odds * x["odds"]
        rows.append(F.struct(F.lit(name).alias("ticket"), F.lit(risk).alias("risk"), p.alias("p"), odds.alias("odds")))
    out = at.select(match, F.inline(F.array(*rows))).where("p IS NOT NULL AND odds IS NOT NULL")
    adjusted = clamp(F.col("p") * (1 - F.col("risk")), 1e-6, 1 - 1e-6)
    out = out.withColumns({"adjusted": adjusted, "fair_odds": fair_odds(adjusted), "edge": adjusted * F.col("odds") - 1, "quarter_kelly": F.coalesce(quarter_kelly(adjusted, F.col("odds")), F.lit(0.0))})
    return out.withColumn("decision", ticket_decision(F.col("edge"), F.col("quarter_kelly"), F.col("risk"), F.lit(trust)))


#: The tags of each derived leg, and its category; fixed values.
LEG_TAGS = {
    "football.1x2:home": ("core", "result,home_strength"),
    "football.1x2:draw": ("core", "result,draw"),
    "football.1x2:away": ("core", "result,away_strength"),
    "football.double_chance:1X": ("core", "result,safer"),
    "football.double_chance:12": ("core", "result"),
    "football.double_chance:X2": ("core", "result,safer"),
    "football.total_goals:over_1.5": ("goals", "goals,tempo"),
    "football.total_goals:over_2.5": ("goals", "goals,tempo"),
    "football.total_goals:under_2.5": ("goals", "goals,defensive"),
    "football.total_goals:over_3.5": ("goals", "goals,chaos"),
    "football.total_goals:under_3.5": ("goals", "goals,safer"),
    "football.btts:yes": ("goals", "goals,both_teams_score"),
    "football.btts:no": ("goals", "goals,defensive"),
    "football.team_goals:home_over_0.5": ("team_goals", "team_attacking,goals"),
    "football.team_goals:away_over_0.5": ("team_goals", "team_attacking,goals"),
    "football.team_goals:home_over_1.5": ("team_goals", "team_attacking,goals"),
    "football.team_goals:away_over_1.5": ("team_goals", "team_attacking,goals"),
    "football.total_corners:over_8.5": ("corners", "corners,tempo"),
    "football.total_cards:over_3.5": ("cards", "cards,physicality"),
}


def derived_legs(home: Column, draw: Column, away: Column, over25: Column, btts: Column) -> Column:
    """Array of (leg, market, selection, p, category, tags): nineteen legs from the five probabilities.

    The shares, floors and ceilings of the legs that no probability gives are fixed values.
    """
    over15, over35 = F.least(over25 + 0.18, F.lit(0.96)), F.greatest(over25 - 0.22, F.lit(0.04))
    p = {
        "football.1x2": {"home": home, "draw": draw, "away": away},
        "football.double_chance": {"1X": home + draw, "12": home + away, "X2": draw + away},
        "football.total_goals": {"over_1.5": over15, "over_2.5": over25, "under_2.5": 1 - over25, "over_3.5": over35, "under_3.5": 1 - over35},
        "football.btts": {"yes": btts, "no": 1 - btts},
        "football.team_goals": {
            "home_over_0.5": F.least(0.55 * home + 0.55 * over15, F.lit(0.95)),
            "away_over_0.5": F.least(0.55 * away + 0.45 * over15, F.lit(0.95)),
            "home_over_1.5": F.greatest(0.45 * home + 0.35 * over25, F.lit(0.05)),
            "away_over_1.5": F.greatest(0.45 * away + 0.25 * over25, F.lit(0.04)),
        },
        "football.total_corners": {"over_8.5": 0.5 + clamp((over25 - 0.5) * 0.40, -0.16, 0.16)},
        "football.total_cards": {"over_3.5": F.lit(0.50)},
    }
    known = {f"{market}:{selection}": x for market, each in p.items() for selection, x in each.items()}

    def leg(i: int, name: str) -> Column:
        market, selection = name.split(":")
        kind, tags = LEG_TAGS[name]
        return F.struct(F.lit(i).alias("leg"), F.lit(market).alias("market"), F.lit(selection).alias("selection"), known[name].cast("double").alias("p"), F.lit(kind).alias("category"), F.split(F.lit(tags), ",").alias("tags"))

    return F.array(*(leg(i, name) for i, name in enumerate(LEG_TAGS)))


def pair_risk(a: Column, b: Column) -> Column:
    """How two legs of one match hang together, 0 to 4; the order of the two matters."""
    has = lambda leg, tag: F.array_contains(leg["tags"], tag)
    return (
        F.when((a["market"] == b["market"]) & (a["selection"] != b["selection"]), 4)
        .when(has(a, "goals") & has(b, "goals"), 2)
        .when((has(a, "result") & has(b, "team_attacking")) | (has(a, "team_attacking") & has(b, "result")), 2)
        .when((has(a, "corners") & has(b, "goals")) | (has(a, "goals") & has(b, "corners")), 1)
        .when((has(a, "cards") | has(a, "defensive")) & has(b, "chaos"), 3)
        .otherwise(0)
    )


def best_ticket(combos: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The best combination of ``n`` legs (columns leg_1..leg_n with odds): by edge, probability and risk, the first of equals."""
    legs = [F.col(f"leg_{k}") for k in range(1, n + 1)]
    raw, odds, risk = legs[0]["p"], legs[0]["odds"], F.lit(0)
    for i, x in enumerate(legs):
        if i:
            raw, odds = raw * x["p"], odds * x["odds"]
        for y in legs[i + 1 :]:
            risk = risk + pair_risk(x, y)
    rows = combos.withColumns({"raw": raw, "odds": odds, "risk": risk}).withColumn("adjusted", F.col("raw") * F.pow(F.lit(0.93), F.col("risk"))).withColumn("edge", F.col("adjusted") * F.col("odds") - 1)
    score = F.coalesce(F.col("edge"), F.lit(0.0)) + 0.15 * F.col("adjusted") - 0.02 * F.col("risk")
    place = F.struct(*(x["leg"] for x in legs))
    families = F.array_distinct(F.array(*(F.concat_ws(":", x["market"], F.substring_index(x["selection"], "_", 1)) for x in legs)))
    return top_in_group(rows.where(F.size(families) == n).withColumn("score", score), keys, [F.desc("score"), place], 1)


def paper_bets(rows: DataFrame, match: str, min_edge: float = 0.03, per_match: int = 1, stake: float = 1.0) -> DataFrame:
    """Bets of (match, selection, p, placed_odds, closing_odds, result_selection): edge, stake, profit and closing value."""
    edge = rows.withColumn("edge", F.col("p") * F.col("placed_odds") - 1).where(F.col("edge") >= min_edge)
    chosen = top_in_group(edge, [match], [F.desc("edge"), F.desc("selection")], per_match)
    won = F.col("selection") == F.col("result_selection")
    return chosen.withColumns({"stake": F.lit(stake), "profit": F.when(won, F.round(stake * (F.col("placed_odds") - 1), 6)).otherwise(-stake), "clv": clv(F.col("placed_odds"), F.col("closing_odds"))})


def ledger(selections: DataFrame, closing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Selections with an edge beside their last closing price, with the closing value in percent."""
    last = keep_last(closing, keys, [order]).select(*keys, "closing_odds")
    return selections.where("edge > 0").join(last, keys).withColumn("clv_percent", F.round(100 * clv(F.col("odds"), F.col("closing_odds")), 6))


def offline_evaluation(rows: DataFrame) -> DataFrame:
    """Settled rows with their unit result, the rest with why they are skipped."""
    skip = F.when(~F.coalesce(F.col("settlement_status") == "settled", F.lit(False)), F.concat(F.lit("status:"), F.coalesce("settlement_status", F.lit("missing")))).when(F.col("odds").isNull() | (F.col("odds") <= 1), "bad_price")
    return rows.withColumn("skip_reason", skip).withColumn("unit_result", F.when(F.col("skip_reason").isNull(), unit_result(F.col("settlement_result"), F.col("odds"))))


def implied_share(df: DataFrame, odds: str, group: list[str]) -> DataFrame:
    """Add the no-vig probability of each leg in its group."""
    each = F.when(F.col(odds) > 1, 1 / F.col(odds))
    return df.withColumn("no_vig", each / F.sum(each).over(Window.partitionBy(*group)))


def walk_forward_bets(matches: DataFrame, odds: DataFrame, key: str, day: str, order: list[str], classes: list[str], placed: str, closing: str, min_train: int = 60, min_edge: float = 0.03, per_match: int = 1) -> DataFrame:
    """Paper bets on a running prior: its probability beside the no-vig share of the placed prices, settled, with the closing value.

    matches: ``key``, ``day`` and label; odds: ``key``, selection, book, price. The prior of a match is the
    Laplace-smoothed shares of the labels before it; matches with fewer than ``min_train`` before them only train.
    """
    numbered = history.row_number_in(history.global_prior(matches, day, order, "label", classes), day, order)
    prior = numbered.where(F.col("row_index") >= min_train).select(key, F.col("label").alias("result_selection"), F.inline(F.array(*(F.struct(F.lit(k).alias("selection"), F.col(f"p_{k}").alias("p")) for k in classes))))
    priced = books(odds, [key], "selection", "book", "price", placed, closing)
    fair = priced.withColumn("implied_probability", no_vig(F.col("placed_odds"), key))
    return paper_bets(prior.join(fair, [key, "selection"]), key, min_edge, per_match)


def value_report(prices: DataFrame, probabilities: DataFrame, match: str, trust: float) -> DataFrame:
    """Selections and tickets of each match in one table: (match, kind, name, p, odds, edge, decision)."""
    found = value_selections(prices, probabilities, trust, [match, "market", "selection"])
    columns = [match, "kind", "name", "p", "odds", "edge", "decision"]
    single = found.withColumns({"kind": F.lit("selection"), "name": F.concat_ws(":", "market", "selection")}).select(columns)
    built = tickets(found, match, trust).withColumns({"kind": F.lit("ticket"), "name": F.col("ticket"), "p": F.col("adjusted")}).select(columns)
    return single.unionByName(built)
