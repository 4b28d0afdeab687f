"""Walk-forward evaluation: refits at fixed steps, team-aggregate Poisson models, form features beside ratings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators import history, metrics, models
from fieldlark.operators.lineage import dealt, tasks


#: Folds whose sums one task carries on at most.
WIDTH = 4096


def played(matches: DataFrame) -> DataFrame:
    """Matches with both scores: the others neither train nor test a model."""
    return matches.where("home_goals IS NOT NULL AND away_goals IS NOT NULL")


def folds(matches: DataFrame, day: str, order: list[str], min_train: int, every: int) -> DataFrame:
    """Played matches with row_index and ``fold``: which refit a match is scored by; -1 for the first ``min_train``, which only train."""
    rows = history.row_number_in(played(matches), day, order)
    return rows.withColumn("fold", F.coalesce(history.refit_fold(F.col("row_index"), min_train, every), F.lit(-1)))


def trained(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, fold, ``sums``) of all rows of earlier folds: what a model fitted before the fold knows.

    A model of sums needs no pass a fold: sums by key and fold get running totals. These have two levels, sums of WIDTH
    folds and those within, so that neither a key of very many folds nor the whole table is one task. Null keys have rows too.
    """
    each = rows.groupBy(*keys, "fold").agg(*(F.sum(c).alias(n) for n, c in sums.items())).withColumn("_block", F.floor(F.col("fold") / WIDTH))
    blocks = each.groupBy(*keys, "_block").agg(*(F.sum(n).alias(n) for n in sums))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = blocks.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_k"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums))
    same = F.col("_block") == F.col("_k")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    past = Window.partitionBy(*keys, "_block").orderBy("fold").rangeBetween(Window.unboundedPreceding, -1)
    own = each.withColumns({n: F.coalesce(F.sum(n).over(past), F.lit(0)) for n in sums})
    return own.join(so_far, same).select(*keys, "fold", *((F.col(n) + F.col(f"_{n}_before")).alias(n) for n in sums))


def _known(matches: DataFrame, day: str, order: list[str], min_train: int, every: int) -> tuple[DataFrame, Column, tuple[Column, ...], tuple[Column, ...]]:
    """(tested rows beside what is known before their fold, mean goals of a side, (matches, for, against) of home and of away).

    The mean is 1.25 goals where nothing is known, and 0.5 at least.
    """
    rows = folds(matches, day, order, min_train, every)
    c = F.col
    long = history.team_long(rows, [c("home"), c("home_goals"), c("away_goals")], [c("away"), c("away_goals"), c("home_goals")], ["team", "gf", "ga"], ["fold"])
    teams = trained(long, ["team"], {"n": F.lit(1), "gf": c("gf"), "ga": c("ga")})
    side = lambda s: teams.select(c("team").alias(s), "fold", *(c(x).alias(f"_{s}_{x}") for x in ("n", "gf", "ga")))
    overall = trained(rows, [], {"_goals": c("home_goals") + c("away_goals"), "_n": F.lit(2)})
    tested = rows.where("fold >= 0").join(side("home"), ["home", "fold"], "left").join(side("away"), ["away", "fold"], "left").join(overall, "fold", "left")
    mean = F.when(c("_n") > 0, F.greatest(c("_goals") / c("_n"), F.lit(0.5))).otherwise(F.lit(1.25))
    of = lambda s: tuple(c(f"_{s}_{x}").cast("double") for x in ("n", "gf", "ga"))
    return tested, mean, of("home"), of("away")


def poisson_rates(matches: DataFrame, day: str, order: list[str], min_train: int, every: int = 1) -> DataFrame:
    """Score rates of each played match after the first ``min_train``, attack times the root of the other's defence, from the team sums of earlier folds.

    ``matches``: home, away, home_goals, away_goals and the columns of ``order``, which must be the match's key.
    """
    rated = models.multiplicative_rates(*_known(matches, day, order, min_train, every))
    return rated.select(*matches.columns, "row_index", "fold", "lambda_home", "lambda_away")


def average_rates(matches: DataFrame, day: str, order: list[str], min_train: int, every: int = 1) -> DataFrame:
    """As ``poisson_rates``, each rate being halfway between the own mean for and the other's mean against; a team without a match has the overall mean.

    With ``every`` 1, each match is scored by all played ones before it.
    """
    rated = models.average_rates(*_known(matches, day, order, min_train, every))
    return rated.select(*matches.columns, "row_index", "fold", "lambda_home", "lambda_away")


def poisson(matches: DataFrame, day: str, order: list[str], min_train: int, every: int = 1) -> DataFrame:
    """``poisson_rates`` with the probabilities of their score grid."""
    return models.grid_probabilities(poisson_rates(matches, day, order, min_train, every), "lambda_home", "lambda_away")


def team_averages(matches: DataFrame, day: str, order: list[str], min_train: int, every: int = 1) -> DataFrame:
    """``average_rates`` with the probabilities of their score grid; ``scored`` breaks its ties by AVERAGES."""
    return models.grid_probabilities(average_rates(matches, day, order, min_train, every), "lambda_home", "lambda_away")


#: The order in which ties of the team averages are broken; a fixed value.
AVERAGES = ("home", "away", "draw")


def outcome(home_goals: Column, away_goals: Column) -> Column:
    """home, away or draw; null for a match without both scores."""
    return F.when(home_goals > away_goals, "home").when(home_goals < away_goals, "away").when(home_goals == away_goals, "draw")


def scored(predicted: DataFrame, keys: list[str], ties: tuple[str, ...] = ("home", "draw", "away")) -> DataFrame:
    """Rows, accuracy, log loss and Brier score of result probabilities, and accuracy on 2.5 goals and on both scoring, by ``keys``.

    Matches without both scores do not count.
    """
    c = F.col
    goals = c("home_goals") + c("away_goals")
    p = {"home": c("p_home"), "draw": c("p_draw"), "away": c("p_away")}
    rows = played(predicted).withColumns({"_actual": outcome(c("home_goals"), c("away_goals")), "_over": (c("p_over25") >= 0.5) == (goals >= 3), "_both": (c("p_btts") >= 0.5) == ((c("home_goals") > 0) & (c("away_goals") > 0))})
    right = lambda x: F.round(F.avg(c(x).cast("double")), 6)
    return metrics.multiclass(rows, p, c("_actual"), keys, ties=ties, more=(right("_over").alias("over25_accuracy"), right("_both").alias("btts_accuracy")))


def form(matches: DataFrame, keys: list[str], day: str, order: list[str], last: int = 5, role: int = 8, rest: int = 7, tired: int = 3) -> DataFrame:
    """Differences between home and away before each match: form, home and away strength, rest, congestion.

    Form is the share of wins in a team's ``last`` played matches, strength that in its ``role`` last ones at home or
    away, half where there are none; rest is the days since the last played match, ``rest`` where there is none. Matches without
    both scores get features and are nobody's history.
    """
    c = F.col
    won = lambda a, b: (c(a) > c(b)).cast("int")
    long = history.team_long(matches, [c("home"), won("home_goals", "away_goals")], [c("away"), won("away_goals", "home_goals")], ["team", "won"], [*keys, *order, day])
    long = dealt(long, [*keys, "team"], n := 2 * tasks(matches))
    teams, by, inside = [*keys, "team"], [day, *order], c("won").isNotNull()
    share = lambda df, by_, n, name: history.rolling_filtered(df, by_, by, inside, ["won"], n).withColumn(name, F.coalesce("won_avg", F.lit(0.5))).drop("games", "won_avg")
    before = F.last(F.when(inside, c(day)), ignorenulls=True).over(history.before(teams, by))
    seen = share(share(long, teams, last, "form"), [*teams, "side"], role, "strength").withColumn("rest", F.coalesce(F.datediff(day, before), F.lit(rest)))
    seen = dealt(seen.select(*keys, *order, "side", "form", "strength", "rest"), [*keys, *order], n)
    both = seen.groupBy(*keys, *order).agg(*(F.max(F.when(c("side") == s, c(x))).alias(f"{s}_{x}") for s in ("home", "away") for x in ("form", "strength", "rest")))
    apart = lambda x: c(f"home_{x}") - c(f"away_{x}")
    tired_ = lambda s: (c(f"{s}_rest") <= tired).cast("int")
    return both.select(*keys, *order, F.round(apart("form"), 6).alias("form_diff"), F.round(apart("strength"), 6).alias("strength_diff"), F.round(apart("rest") / rest, 6).alias("rest_diff"), (tired_("away") - tired_("home")).alias("congestion_diff"))


def compared(baseline: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Two evaluations side by side, with the loss of log loss and whether they tested as many rows."""
    measures = ("rows", "accuracy", "log_loss", "brier")
    side = lambda df, s: df.select(*keys, *(F.col(m).alias(f"{s}_{m}") for m in measures))
    both = side(baseline, "baseline").join(side(other, "other"), keys, "full")
    return both.withColumns({"log_loss_delta": F.round(F.col("other_log_loss") - F.col("baseline_log_loss"), 6), "aligned": F.coalesce(F.col("baseline_rows") == F.col("other_rows"), F.lit(False))})


def baseline_report(rows: DataFrame, keys: list[str], p: dict[str, Column], label: Column, min_train: int = 200, min_eval: int = 50, ties: tuple[str, ...] = metrics.CLASSES) -> DataFrame:
    """Metrics of the rows whose part is eval by ``keys``, or a blocked status where there are too few rows in all."""
    part = F.col("part")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("all_rows"), F.count_if(part == "train").alias("train_rows"))
    found = metrics.multiclass(rows.where(part == "eval"), p, label, keys, ties=ties)
    status = F.when(F.col("all_rows") < min_train + min_eval, "blocked_too_few_rows").when(F.col("rows").isNull(), "blocked_no_eval_rows").otherwise("evaluated")
    return counts.join(found, keys, "left").withColumn("status", status)


def top_factors(factors: dict[str, tuple[Column, float]], n: int = 3) -> Column:
    """Array of (name, value, impact): the ``n`` factors whose weighted value is largest, earlier ones first among equals."""
    each = [F.struct((-F.round(F.abs(w * x), 6)).alias("_at"), F.lit(i).alias("_i"), F.lit(name).alias("name"), F.round(x, 6).alias("value")) for i, (name, (x, w)) in enumerate(factors.items())]
    return F.transform(F.slice(F.array_sort(F.array(*each)), 1, n), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"), F.abs(s["_at"]).alias("impact")))


def by_model(rows: DataFrame, models_: list[str]) -> DataFrame:
    """Each row once a model."""
    return rows.withColumn("model", F.explode(F.array(*map(F.lit, models_))))


def base_rates(train: DataFrame, rows: DataFrame, keys: list[str], label: Column, name: str = "base") -> DataFrame:
    """``rows`` with the share of ``label`` among the training rows of the same ``keys``, else among all of them; null if nothing trains."""
    hit = F.avg(label.cast("double"))
    by = train.groupBy(*keys).agg(hit.alias("_own"))
    all_ = train.agg(hit.alias("_all"))
    return rows.join(by, keys, "left").crossJoin(F.broadcast(all_)).select(*rows.columns, F.coalesce("_own", "_all").alias(name))  # one row


#: Shares of the base rates that are tried, the share where rows are too few, and the least rows to choose on; fixed values.
SHARES, USUAL_SHARE, LEAST_CHOICE = tuple(k / 20 for k in range(11)), 0.2, 25


def shrunk(p: Column, base: Column, share: float) -> Column:
    """A probability drawn towards the base rate."""
    return (1 - share) * p + share * base


def share_losses(rows: DataFrame, keys: list[str], p: dict[str, Column], base: dict[str, Column], label: Column) -> DataFrame:
    """(keys, share, rows, log_loss) for each of SHARES, of classes with probabilities ``p`` and base rates ``base``.

    All shares are one aggregate: no pass over the rows is repeated. Rows whose label is no class do not count.
    """
    hit, prior = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k in p:
        hit, prior = F.when(label == k, p[k]).otherwise(hit), F.when(label == k, base[k]).otherwise(prior)
    known = rows.select(*keys, hit.alias("_p"), prior.alias("_b")).where("_p IS NOT NULL")
    loss = lambda share: F.avg(-F.ln(F.greatest(shrunk(F.col("_p"), F.col("_b"), share), F.lit(1e-12))))
    each = known.groupBy(*keys).agg(F.count("*").alias("rows"), F.array(*(F.struct(F.lit(s).alias("share"), loss(s).alias("log_loss")) for s in SHARES)).alias("_s"))
    return each.select(*keys, "rows", F.inline("_s"))


def chosen_share(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the share with the least loss, the smallest of equal ones; USUAL_SHARE where rows are too few."""
    best = losses.groupBy(*keys).agg(F.first("rows").alias("rows"), F.min(F.struct("log_loss", "share")).alias("_m"))
    return best.select(*keys, "rows", F.when(F.col("rows") >= LEAST_CHOICE, F.col("_m.share")).otherwise(USUAL_SHARE).alias("share"), F.col("_m.log_loss").alias("log_loss"))
