"""Dixon-Coles models fitted for all folds of a walk-forward side by side.

The likelihood of a fold needs no match, only sums by pair of teams: weights, weighted goals, and weights of the four low
scores. ``pair_sums`` makes them in one pass over the matches; each fold is then fitted from its pairs, of which there are far
fewer. Signs: a positive ``defence`` lets the other side score more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators import joins, models, walkforward
from fieldlark.operators.lineage import checkpointed

c = F.col
#: Bounds of strengths, base rate, home advantage and rho; fixed values.
STRENGTH, BASE, HOME, RHO = 2.5, 2.0, 1.0, 0.10
#: Rounds at most, and the largest step at which a fold has settled.
ROUNDS, SETTLED = 100, 1e-7
_SUMS = ("w", "x", "y", "w00", "w01", "w10", "w11")


def pair_sums(rows: DataFrame, day: str, xi: float) -> DataFrame:
    """(fold, home, away, w, x, y, w00 .. w11): what each fold's likelihood knows of each pair of teams.

    ``rows`` are played matches with the ``fold`` they are scored by; a fold is fitted on all rows of earlier ones. A match of
    n days before the last one of the training rows weighs exp(-xi n). Sums of a pair by fold are weighed from one common
    day and carried on, so matches are read once however many folds there are. Matches without a home or away
    team, or without a day, are left out. ``xi`` times the days from the first match to the last stays below 700.
    """
    known = rows.where(c("home").isNotNull() & c("away").isNotNull() & c(day).isNotNull())
    first = known.agg(F.min(day).alias("_first"))
    age = F.datediff(day, "_first")
    weight = F.exp(xi * age)
    low = lambda i, j: F.when((c("home_goals") == i) & (c("away_goals") == j), c("_w")).otherwise(0.0)
    dated = known.crossJoin(F.broadcast(first)).select("fold", "home", "away", "home_goals", "away_goals", age.alias("_age"), weight.alias("_w"))  # one row
    sums = [F.sum("_w"), F.sum(c("_w") * c("home_goals")), F.sum(c("_w") * c("away_goals")), *(F.sum(low(i, j)) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))]
    each = checkpointed(dated.groupBy("fold", "home", "away").agg(*(s.alias(n) for s, n in zip(sums, _SUMS, strict=True)), F.max("_age").alias("_age")))
    top = each.agg(F.max("fold")).first()[0]
    days = each.groupBy("fold").agg(F.max("_age").alias("_age"))
    last = days.select("fold", F.max("_age").over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)).alias("_last"))  # one row a fold
    later = each.where(c("fold") < F.lit(top)).withColumn("fold", F.explode(F.sequence(F.greatest(c("fold") + 1, F.lit(0)), F.lit(top).cast("int"))))
    sums_ = later.groupBy("fold", "home", "away").agg(*(F.sum(n).alias(n) for n in _SUMS))
    return sums_.join(F.broadcast(last), "fold").select("fold", "home", "away", *((c(n) * F.exp(-xi * c("_last"))).alias(n) for n in _SUMS))


def _gradients(n: dict[str, np.ndarray], l: np.ndarray, m: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Derivatives of the log-likelihood by the logarithms of both rates, by pair; its derivative and curvature by rho."""
    w00, w01, w10, w11 = (n[k] for k in _SUMS[3:])
    t00, t01, t10 = (np.maximum(t, 1e-6) for t in (1 - l * m * rho, 1 + l * rho, 1 + m * rho))
    both = w00 * l * m / t00
    by_home = n["x"] - n["w"] * l - both * rho + w01 * l * rho / t01
    by_away = n["y"] - n["w"] * m - both * rho + w10 * m * rho / t10
    by_rho = (-both + w01 * l / t01 + w10 * m / t10 - w11 / (1 - rho)).sum()
    curve = (w00 * (l * m / t00) ** 2 + w01 * (l / t01) ** 2 + w10 * (m / t10) ** 2 + w11 / (1 - rho) ** 2).sum()
    return by_home, by_away, float(by_rho), float(curve)


def _settle(n: dict[str, np.ndarray], home: np.ndarray, away: np.ndarray, teams: int, l2: float) -> tuple[np.ndarray, np.ndarray, float, float, float, int, bool]:
    """(attack, defence, base, home advantage, rho, rounds, settled) of one fold's pairs; ``home`` and ``away`` are numbers of teams.

    A vector holds attacks, defences, base and home advantage. Of the curvature only products with vectors are made, from the
    pairs, so a fold of many teams needs no matrix of them.
    """
    add = lambda at_home, at_away: np.bincount(home, at_home, teams) + np.bincount(away, at_away, teams)
    by_vector = lambda l, m: np.concatenate([add(l, m), add(m, l), [l.sum() + m.sum(), l.sum()]])
    rates = lambda v: (v[-2] + v[-1] + v[home] + v[teams + away], v[-2] + v[away] + v[teams + home])
    drawn = np.full(2 * teams + 2, 2 * l2)  # the penalty's curvature; the base has none
    drawn[-2] = 0.0
    bound = np.concatenate([np.full(2 * teams, STRENGTH), [BASE, HOME]])

    def centred(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[:teams] - v[:teams].mean(), v[teams:-2] - v[teams:-2].mean(), v[-2:]])

    played, scored, let_in = add(n["w"], n["w"]), add(n["x"], n["y"]), add(n["y"], n["x"])
    mean = max(0.05, float(scored.sum() / played.sum()))
    at = centred(np.concatenate([*(np.log((g + mean) / (played * mean + mean)) for g in (scored, let_in)), [np.log(mean), 0.05]]))  # from shares of goals
    rho = 0.0
    for rounds in range(1, ROUNDS + 1):
        l, m = np.exp(np.clip(rates(at)[0], -6, 3)), np.exp(np.clip(rates(at)[1], -6, 3))
        gl, gm, gr, kr = _gradients(n, l, m, rho)
        kl, km = n["w"] * l, n["w"] * m
        product = lambda v: centred(by_vector(kl * rates(v)[0], km * rates(v)[1]) + drawn * v)  # noqa: B023, E731
        step = np.clip(_conjugate(product, centred(by_vector(gl, gm) - drawn * at), 1 / (by_vector(kl, km) + drawn), centred), -1, 1)
        new = np.clip(centred(at + step), -bound, bound)
        newer = float(np.clip(rho + (gr - 2 * l2 * rho) / (kr + 2 * l2), -RHO, RHO))
        moved, at, rho = max(float(np.abs(new - at).max()), abs(newer - rho)), new, newer
        if moved <= SETTLED:
            break
    return at[:teams], at[teams:-2], float(at[-2]), float(at[-1]), rho, rounds, moved <= SETTLED


def _conjugate(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, scale: np.ndarray, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The solution of ``product`` (x) = ``right`` by conjugate gradients, scaled by the curvature's diagonal."""
    x, r = np.zeros_like(right), right
    z = centred(scale * r)
    p, rz, least = z, float(r @ z), 1e-18 * float(r @ centred(scale * r))
    for _ in range(4 * len(right)):
        if rz <= least:
            break
        q = product(p)
        alpha = rz / float(p @ q)
        x, r = x + alpha * p, r - alpha * q
        z = centred(scale * r)
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def fit(pairs: DataFrame, l2: float = 0.10) -> DataFrame:
    """(fold, team, attack, defence, base, home_advantage, rho, rounds, settled): the penalised likelihood's optimum of every fold of a table of ``pair_sums``.

    Strengths are centred; squares of strengths, home advantage and rho are penalised by ``l2``. A round is a Newton step by
    conjugate gradients and one of rho. A fold ends when no step is over SETTLED, or after ROUNDS, with ``settled`` false. Folds are fitted
    side by side, each from its pairs of teams, however many matches these have: fewer rows than the square of its teams. No pairs: no rows.
    """
    team = pairs.schema["home"].dataType.simpleString()

    def one(rows: pa.Table) -> pa.Table:
        names = pa.chunked_array([*rows["home"].chunks, *rows["away"].chunks]).unique()
        at = [pc.index_in(rows[side], names).to_numpy() for side in ("home", "away")]
        attack, defence, *own = _settle({k: rows[k].to_numpy() for k in _SUMS}, *at, len(names), l2)
        same = lambda x, t: pa.array([x] * len(names), t)
        columns = [same(rows["fold"][0].as_py(), pa.int32()), names, pa.array(attack), pa.array(defence), *(same(x, pa.float64()) for x in own[:3]), same(own[3], pa.int32()), same(own[4], pa.bool_())]
        return pa.table(columns, ["fold", "team", "attack", "defence", "base", "home_advantage", "rho", "rounds", "settled"])

    return pairs.groupBy("fold").applyInArrow(one, f"fold int, team {team}, attack double, defence double, base double, home_advantage double, rho double, rounds int, settled boolean")


def rates(df: DataFrame, fitted: DataFrame, neutral: Column | None = None) -> DataFrame:
    """Add lambda_home, lambda_away and rho to rows with ``fold``, ``home`` and ``away``; an unknown team has strength 0.

    Home advantage counts unless ``neutral`` holds. Rows of a fold without a fit have nulls. ``fitted`` is a result of ``fit``, kept or checkpointed.
    """
    side = lambda name: fitted.select("fold", c("team").alias(name), c("attack").alias(f"_{name}_a"), c("defence").alias(f"_{name}_d"))
    folds = fitted.select("fold", "base", "home_advantage", "rho").distinct()
    out = df.join(side("home"), ["fold", "home"], "left").join(side("away"), ["fold", "away"], "left").join(joins.small(folds), "fold", "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    advantage = c("home_advantage") if neutral is None else F.when(neutral, 0.0).otherwise(c("home_advantage"))
    home, away = F.exp(c("base") + advantage + zero("_home_a") + zero("_away_d")), F.exp(c("base") + zero("_away_a") + zero("_home_d"))
    return out.select(*df.columns, home.alias("lambda_home"), away.alias("lambda_away"), "rho")


def walk_forward(matches: DataFrame, day: str, order: list[str], min_train: int, every: int, xi: float = 0.001, l2: float = 0.10, neutral: bool = True) -> DataFrame:
    """Rates, rho and probabilities of each played match after the first ``min_train``, from the fit before its fold."""
    rows = checkpointed(walkforward.folds(matches, day, order, min_train, every))
    rated = rates(rows.where("fold >= 0"), checkpointed(fit(pair_sums(rows, day, xi), l2)), F.lit(neutral))
    return models.grid_probabilities(rated, "lambda_home", "lambda_away", "rho")
