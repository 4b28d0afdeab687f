"""Score models: Poisson grids, heuristics, linear artifacts, and their fitting."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.scalars import clamp, sigmoid, softmax

GOALS = 8


def _pmf(rate: Column, k: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k)


def score_grid(home: Column, away: Column, rho: Column | None = None, goals: int = GOALS) -> Column:
    """Array of (h, a, p) over 0..goals each, in row order; with ``rho`` the low scores are corrected. Not normalised."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(goals)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(goals)), lambda a: F.struct(h.alias("h"), a.alias("a")))))

    def p(c: Column) -> Column:
        h, a = c["h"], c["a"]
        base = _pmf(home, h) * _pmf(away, a)
        if rho is None:
            return base
        tau = F.when((h == 0) & (a == 0), 1 - home * away * rho).when((h == 0) & (a == 1), 1 + home * rho).when((h == 1) & (a == 0), 1 + away * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))
        return base * F.greatest(tau, F.lit(0.0))

    return F.transform(cells, lambda c: F.struct(c["h"].alias("h"), c["a"].alias("a"), p(c).alias("p")))


def grid_probabilities(df: DataFrame, home: str, away: str, rho: str | None = None, goals: int = GOALS, normalised: bool = True) -> DataFrame:
    """Add p_home, p_draw, p_away, p_over25, p_btts and the likeliest score (the first in row order), from a grid whose sum is 1 if ``normalised``.

    Shares of goals are arrays in the row, and cells are their products in plain expressions, added in row order: no join, no shuffle and no
    lambda, so that all of it is compiled.
    """
    at = range(goals + 1)
    x, y = F.col(home), F.col(away)
    tau = {(0, 0): 1 - x * y * F.col(rho), (0, 1): 1 + x * F.col(rho), (1, 0): 1 + y * F.col(rho), (1, 1): 1 - F.lit(1.0) * F.col(rho)} if rho else {}
    pmf = lambda rate: F.array(*(_pmf(rate, F.lit(k)) for k in at))
    made = df.select(*df.columns, F.explode(F.array(F.struct(pmf(x).alias("h"), pmf(y).alias("a")))).alias("_g"))
    cells = {(h, a): c * F.greatest(tau[h, a], F.lit(0.0)) if (h, a) in tau else c for h in at for a in at for c in [F.col("_g.h")[h] * F.col("_g.a")[a]]}
    total = lambda keep: reduce(add, (p for k, p in cells.items() if keep(*k)))
    share = {"p_home": lambda h, a: h > a, "p_draw": lambda h, a: h == a, "p_away": lambda h, a: h < a, "p_over25": lambda h, a: h + a > 2, "p_btts": lambda h, a: h > 0 and a > 0}
    whole = total(lambda h, a: True) if normalised else F.lit(1.0)
    grid = F.array(*(p for p in cells.values()))
    first = F.array_position(grid, F.array_max(grid)) - 1
    best = F.concat_ws("-", F.floor(first / len(at)), first % len(at))
    sums = made.select(*df.columns, "_g", whole.alias("_total"), *(total(keep).alias(f"_{n}") for n, keep in share.items()))
    return sums.select(*df.columns, *((F.col(f"_{n}") / F.col("_total")).alias(n) for n in share), best.alias("likely_score"))


def multiplicative_rates(df: DataFrame, avg: Column, h: tuple[Column, Column, Column], a: tuple[Column, Column, Column]) -> DataFrame:
    """Add lambda_home and lambda_away from (matches, for, against) of each side: attack times the root of the other's defence."""
    mean = F.greatest(avg, F.lit(0.1))
    ratio = lambda x, n: clamp(F.coalesce(x, F.lit(0.0)) / F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(1.0)) / mean, 0.35, 3.2)
    rate = lambda own, other: clamp(mean * ratio(own[1], own[0]) * F.sqrt(ratio(other[2], other[0])), 0.05, 4.5)
    return df.withColumns({"lambda_home": rate(h, a), "lambda_away": rate(a, h)})


def average_rates(df: DataFrame, avg: Column, h: tuple[Column, Column, Column], a: tuple[Column, Column, Column]) -> DataFrame:
    """Add lambda_home and lambda_away from (matches, for, against) of each side: the mean of own goals for and the other's against, 0.1 at least."""
    mean = lambda x, n: F.when(n > 0, x / n).otherwise(avg)
    rate = lambda own, other: F.greatest((mean(own[1], own[0]) + mean(other[2], other[0])) / 2, F.lit(0.10))
    return df.withColumns({"lambda_home": rate(h, a), "lambda_away": rate(a, h)})


def expected_total(home_for: Column, away_against: Column, away_for: Column, home_against: Column, default: Column, low: float, high: float) -> Column:
    """Expected corners, shots or cards of both sides; each missing mean is half the overall one."""
    each = [F.coalesce(c, default / 2) for c in (home_for, away_against, away_for, home_against)]
    return clamp(sum(each[1:], each[0]) / 2, low, high)


def over_logistic(expected: Column, line: float = 9.5, scale: float = 1.8) -> Column:
    return 1 / (1 + F.exp(-(expected - line) / scale))


def linear_scores(features: dict[str, Column], artifact: dict) -> list[Column]:
    """Class probabilities of a softmax artifact {classes, intercept, features, weights, calibration}: one expression."""
    logits = []
    for k in range(len(artifact["classes"])):
        z = F.lit(float(artifact["intercept"][k]))
        for spec, weights in zip(artifact["features"], artifact["weights"], strict=True):
            z = z + features[spec["name"]] * float(weights[k])
        logits.append(z)
    shrink = artifact.get("calibration") or {"shrink_alpha": 0.0, "base_probs": [1 / len(logits)] * len(logits)}
    return shrunk(softmax(*logits), shrink["shrink_alpha"], [F.lit(float(b)) for b in shrink["base_probs"]])


def shrunk(p: list[Column], alpha: float, prior: list[Column]) -> list[Column]:
    """Probabilities pulled towards a prior and normalised."""
    mixed = [(1 - alpha) * x + alpha * b for x, b in zip(p, prior, strict=True)]
    total = sum(mixed[1:], mixed[0])
    return [x / total for x in mixed]


def gold_heuristic(f: dict[str, Column]) -> dict[str, Column]:
    """Outcome, over and both-score probabilities from gold features, less sure with fewer prior matches.

    The weights, bases and defaults are fixed values.
    """
    at = lambda name, default=0.0: F.coalesce(f[name], F.lit(default)) if name in f else F.lit(default)
    sure = clamp(F.least(at("home_prior_matches"), at("away_prior_matches")) / 10.0, 0.0, 1.0)
    signal = 0.42 * at("goals_for_avg_diff") - 0.30 * at("goals_against_avg_diff") + 0.16 * at("points_avg_diff") + 0.015 * clamp(at("rest_days_diff"), -14.0, 14.0)
    event = 0.25 * at("xg_for_avg_diff") - 0.18 * at("xg_against_avg_diff") + 0.015 * at("shots_for_avg_diff")
    strength = 0.18 + sure * (signal + F.when(f.get("has_event_data", F.lit(False)), event).otherwise(0.0))
    home, draw, away = softmax(strength, -0.12 - 0.28 * F.abs(strength) + 0.08 * (1 - sure), -strength)
    goals = clamp((at("home_gf", 1.20) + at("away_gf", 1.05) + at("home_ga", 1.10) + at("away_ga", 1.20)) / 2, 0.5, 5.5)
    over = sure * sigmoid(-0.22 + 0.55 * (goals - 2.50)) + (1 - sure) * 0.52
    both = sure * sigmoid(-0.18 + 0.45 * (goals - 2.35) - 0.18 * F.abs(strength)) + (1 - sure) * 0.50
    return {"p_home": home, "p_draw": draw, "p_away": away, "p_over25": over, "p_btts": both}


def logit(p: Column, low: float = 0.02, high: float = 0.98) -> Column:
    q = clamp(p, low, high)
    return F.ln(q / (1 - q))


def scorecard(base: Column | None, weights: dict[str, float], features: dict[str, Column], intercept: float = 0.0) -> Column:
    """A clamped logistic score: intercept, the base rate's logit, and weighted features."""
    z = F.lit(intercept) if base is None else intercept + logit(base)
    for name, w in weights.items():
        z = z + w * features[name]
    return clamp(sigmoid(z), 0.02, 0.98)


#: Weights of the named scorecards; fixed values.
SCORECARDS = {
    "global_scorecard": (0.08, {"rating_diff": 1.18, "form_diff": 0.78, "rest_diff": 0.18}),
    "competition_prior_scorecard": (0.0, {"rating_diff": 0.92, "form_diff": 0.62}),
    "quality": (0.0, {"rating_diff_pre": 0.95, "form_diff_pre": 0.62, "home_away_strength_diff_pre": 0.35, "rest_diff_pre": 0.18, "congestion_diff_pre": 0.12, "promotion_status_diff": 0.20, "kind_continental": 0.08}),
    "imported_results": (0.0, {"rating_diff": 0.95, "form_diff": 0.55, "rest_diff": 0.18}),
}


def blended(implied: Column, ways: Column) -> Column:
    """Seven tenths of the implied probability and three of an even share, kept off 0 and 1."""
    return clamp(0.7 * implied + 0.3 / ways, 0.01, 0.99)


def train_softmax(df: DataFrame, features: list[str], label: str, classes: list[str], l2: float = 1e-3, max_iter: int = 100) -> dict:
    """A softmax artifact fitted by Spark's logistic regression on z-scored features, its weights for raw features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    code = F.when(F.lit(False), 0)
    for k, c in enumerate(classes):
        code = code.when(F.col(label) == c, k)
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.withColumn("_y", code.cast("double")).where("_y IS NOT NULL"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=l2, maxIter=max_iter, standardization=True).fit(rows)
    weights = model.coefficientMatrix.toArray()
    weights = np.vstack([weights, np.zeros((len(classes) - len(weights), len(features)))])
    intercept = np.append(model.interceptVector.toArray(), [-30.0] * (len(classes) - len(model.interceptVector)))
    return {"classes": classes, "intercept": intercept.tolist(), "features": [{"name": f} for f in features], "weights": weights.T.tolist()}


def hybrid_pipeline(features: list[str], label: str, c: float, rows: int):
    """Median imputation, scaling and balanced logistic regression as one pipeline; ``weight`` is the balance column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", regParam=1 / (c * max(1, rows))),
        ]
    )


def balance(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``, so that the classes weigh the same in total."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row a class
    return df.join(F.broadcast(weights), label)


def fit_hybrid(train: DataFrame, features: list[str], targets: list[str], day: str, order: list[str], c: float = 0.7) -> dict[str, tuple]:
    """For each target (a column of classes 0, 1, ...): (fitted pipeline, base rates, share of the base rates).

    The pipeline is fitted on the first four fifths of the rows and the share chosen on the rest, by log loss; then
    the pipeline is fitted on all. A target with too few rows, or one class in the first part, takes the usual share.
    Rows with a null target are left out of that target. A target of a single class raises.
    """
    from pyspark.ml.functions import vector_to_array

    from fieldlark.operators import history, walkforward
    from fieldlark.operators.lineage import stashed

    out = {}
    known = train.withColumns({t: F.col(t).cast("int") for t in targets}).select(*dict.fromkeys([*features, *targets, day, *order]))
    numbered = stashed(history.running_totals(known, day, order, {f"_at_{t}": F.when(F.col(t).isNotNull(), 1) for t in targets}))  # each fit passes over the rows many times
    for target in targets:
        rows = numbered.where(F.col(target).isNotNull()).select(*features, target, F.col(f"_at_{target}").alias("row_index"))
        counts = dict(rows.groupBy(target).count().collect())  # one row a class
        total = sum(counts.values())
        if len(counts) < 2:
            raise ValueError(f"{target} has a single class")
        base = [counts.get(k, 0) / total for k in range(max(counts) + 1)]
        fit = lambda part, n: hybrid_pipeline(features, target, c, n).fit(balance(part, target))  # noqa: B023, E731
        share, split = walkforward.USUAL_SHARE, max(20, int(total * 0.8))
        first = rows.where(F.col("row_index") < split)
        if total >= 2 * walkforward.LEAST_CHOICE and total - split >= walkforward.LEAST_CHOICE and first.select(target).distinct().count() == len(counts):
            scored = fit(first, split).transform(rows.where(F.col("row_index") >= split)).withColumn("_p", vector_to_array("probability"))
            p = {str(k): F.get("_p", F.lit(k)) for k in range(len(base))}
            losses = walkforward.share_losses(scored, [], p, {str(k): F.lit(b) for k, b in enumerate(base)}, F.col(target).cast("string"))
            share = walkforward.chosen_share(losses, []).first()["share"]
        out[target] = (fit(rows, total), base, share)
    return out


def hybrid_probabilities(df: DataFrame, fitted: dict[str, tuple]) -> DataFrame:
    """Add p_<target>, an array of the classes' probabilities, of each target of ``fit_hybrid``."""
    from pyspark.ml.functions import vector_to_array

    from fieldlark.operators import walkforward

    names = df.columns
    for target, (model, base, share) in fitted.items():
        p = F.zip_with(vector_to_array("probability"), F.array(*map(F.lit, base)), lambda x, b: walkforward.shrunk(x, b, share))  # noqa: B023
        names = [*names, f"p_{target}"]
        df = model.transform(df).withColumn(f"p_{target}", p).select(*names)
    return df
