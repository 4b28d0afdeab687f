"""Features of the hybrid model: rolling means of both sides, a score grid from them, ranks, and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import history, joins, models
from fieldlark.operators.lineage import dealt, tasks

c = F.col
#: Statistics of a match that may be there, as home_ and away_ columns; means that have no side against among the features.
STATISTICS = ("shots", "sot", "corners", "fouls")
#: Goals of a side where no match is known, the least overall mean, points of an unknown team, the least rate, an unknown rank; fixed values.
UNKNOWN_GOALS, LEAST_GOALS, UNKNOWN_POINTS, LEAST_RATE, UNKNOWN_RANK = 1.25, 1.0, 1.0, 0.15, 70
#: The model's features, in order; fixed values.
FEATURES = [
    "lambda_home", "lambda_away", "p_home", "p_draw", "p_away", "p_over25", "p_btts", "rank_home", "rank_away", "rank_diff", "games_home", "games_away",
    "gf_diff", "ga_diff", "shots_for_diff", "shots_against_diff", "sot_for_diff", "corners_for_diff", "corners_against_diff", "fouls_for_diff", "form_points_diff", "rest_days_diff",
]
#: Those of FEATURES that come from the score grid.
GRID = ("p_home", "p_draw", "p_away", "p_over25", "p_btts")


def features(matches: DataFrame, day: str, order: list[str], last: int = 10, ranks: DataFrame | None = None, grid: bool = True) -> DataFrame:
    """``matches`` with FEATURES and the targets outcome (H, D, A), over25 and btts, null for a match without both scores.

    ``matches``: home, away, home_goals, away_goals, the columns of ``order`` (the match's key), and home_ and away_
    columns of STATISTICS where there are any. A feature sees matches with both scores before the row's own, in (day,
    order): a team's ``last`` ones, and for a team without any the mean goals of all matches so far. ``ranks``: (team, rank).
    Without ``grid``, those of GRID are left out and no score grid is made. Statistics that nobody has are null. A team without a match has no rest. Rows with a null team are nobody's history, and get the features of an unknown team.
    """
    there = [s for s in STATISTICS if f"home_{s}" in matches.columns and f"away_{s}" in matches.columns]
    points = lambda own, other: F.when(own > other, 3).when(own == other, 1).when(own < other, 0)
    names = ["team", "gf", "ga", "points", *(f"{s}_{k}" for s in there for k in ("for", "against"))]

    def view(own: str, other: str) -> list:
        g, h = c(f"{own}_goals"), c(f"{other}_goals")
        return [c(own), g, h, points(g, h), *(c(f"{side}_{s}").cast("double") for s in there for side in (own, other))]

    n = max(2 * tasks(matches), matches.sparkSession.sparkContext.defaultParallelism)
    long = dealt(history.team_long(matches, view("home", "away"), view("away", "home"), names, [*order, day]), ["team"], n)
    inside, by = c("points").isNotNull() & c("team").isNotNull(), [day, *order]
    values = names[1:]
    rolled = history.rolling_filtered(long, ["team"], by, inside, values, last, (day,))
    seen = rolled.withColumn("rest", F.datediff(day, f"{day}_last"))
    kept = ["games", "rest", *(f"{v}_avg" for v in values)]
    # both sides of a match come from tasks of their own: they meet before they are put into a row, as nothing is put together before
    sides = dealt(seen.select(*order, "side", *kept), order, n).groupBy(*order).agg(*(F.max(F.when(c("side") == s, c(k))).alias(f"_{s}_{k}") for s in ("home", "away") for k in kept))

    scored = F.when(c("home_goals").isNotNull() & c("away_goals").isNotNull(), c("home_goals") + c("away_goals"))
    so_far = history.running_totals(matches, day, order, {"_goals": scored, "_played": F.when(scored.isNotNull(), 2)})
    rows = dealt(so_far, order, n).join(sides, order)
    if ranks is None:
        rows = rows.withColumns({"rank_home": F.lit(UNKNOWN_RANK), "rank_away": F.lit(UNKNOWN_RANK)})
    else:
        for s in ("home", "away"):
            rows = rows.join(joins.small(ranks.select(c("team").alias(s), c("rank").alias(f"rank_{s}"))), s, "left").withColumn(f"rank_{s}", F.coalesce(f"rank_{s}", F.lit(UNKNOWN_RANK)))
    mean = F.when(c("_played") > 0, F.greatest(c("_goals") / c("_played"), F.lit(LEAST_GOALS))).otherwise(UNKNOWN_GOALS)
    goals = lambda s, k: F.coalesce(c(f"_{s}_{k}_avg"), mean)
    rate = lambda own, other: F.greatest((goals(own, "gf") + goals(other, "ga")) / 2, F.lit(LEAST_RATE))
    apart = lambda x: c(f"_home_{x}") - c(f"_away_{x}")
    made = {
        "lambda_home": rate("home", "away"), "lambda_away": rate("away", "home"), "rank_diff": c("rank_away") - c("rank_home"), "games_home": c("_home_games"), "games_away": c("_away_games"),
        "gf_diff": goals("home", "gf") - goals("away", "gf"), "ga_diff": goals("home", "ga") - goals("away", "ga"), "rest_days_diff": apart("rest"),
        "form_points_diff": F.coalesce("_home_points_avg", F.lit(UNKNOWN_POINTS)) - F.coalesce("_away_points_avg", F.lit(UNKNOWN_POINTS)),
    }
    for name in FEATURES:
        value = name.removesuffix("_diff")
        if name not in made and name.endswith(("_for_diff", "_against_diff")):
            made[name] = apart(f"{value}_avg") if value.rsplit("_", 1)[0] in there else F.lit(None).cast("double")
    total = c("home_goals") + c("away_goals")
    outcome = F.when(c("home_goals") > c("away_goals"), "H").when(c("home_goals") < c("away_goals"), "A").when(total.isNotNull(), "D")
    targets = {"outcome": outcome, "over25": (total >= 3).cast("int"), "btts": F.when(total.isNotNull(), (c("home_goals") > 0) & (c("away_goals") > 0)).cast("int")}
    whole = rows.withColumns(made | targets)
    if grid:
        whole = models.grid_probabilities(whole, "lambda_home", "lambda_away")
    return whole.select(*matches.columns, *(f for f in FEATURES if grid or f not in GRID), *targets)
