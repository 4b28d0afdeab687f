"""Queries of models that walk forward over the driver's orders read as matches, a third of which have no score."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlark.operators import dixon_coles, history, hybrid, metrics, models, refits, walkforward
from fieldlark.operators.lineage import checkpointed, scratch, stashed
from fieldlark.plans.queries import query, r6, read
from fieldlark.streaming import rated

c = F.col
#: Orders read as matches of 40 teams; one in three has no score, and statistics are there in four of five.
_M = """m AS (SELECT o_orderkey AS match_id, o_orderdate::DATE AS day, o_orderpriority AS competition, o_custkey % 40 AS home, (o_custkey % 40 + 1 + (o_orderkey // 4) % 39) % 40 AS away,
  CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey * 7 + o_custkey) % 5 END AS home_goals, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey * 3 + o_orderkey) % 4 END AS away_goals,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 13 END::DOUBLE AS home_shots, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 11 END::DOUBLE AS away_shots, (o_orderkey % 9)::DOUBLE AS home_corners, (o_custkey % 7)::DOUBLE AS away_corners FROM orders),
played AS (SELECT * FROM m WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL)"""


def _matches(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    home, played, measured = cust % 40, cust % 3 > 0, k % 5 > 0
    return read(spark, d, "orders").select(
        k.alias("match_id"), F.to_date("o_orderdate").alias("day"), c("o_orderpriority").alias("competition"), home.alias("home"), ((home + 1 + F.floor(k / 4) % 39) % 40).alias("away"),
        F.when(played, (k * 7 + cust) % 5).alias("home_goals"), F.when(played, (cust * 3 + k) % 4).alias("away_goals"),
        F.when(measured, k % 13).cast("double").alias("home_shots"), F.when(measured, cust % 11).cast("double").alias("away_shots"), (k % 9).cast("double").alias("home_corners"), (cust % 7).cast("double").alias("away_corners"),
    )


#: Rates of each played match after the first 200 from all played ones before it.
_AVERAGES = f"""{_M}, f AS (SELECT *, row_number() OVER (ORDER BY day, match_id) - 1 AS i FROM played),
l AS (SELECT i, 'home' AS side, home AS team, home_goals AS gf, away_goals AS ga FROM f UNION ALL SELECT i, 'away', away, away_goals, home_goals FROM f),
s AS (SELECT i, side, count(*) OVER w AS n, sum(gf) OVER w AS gf, sum(ga) OVER w AS ga FROM l WINDOW w AS (PARTITION BY team ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, greatest(sum(home_goals + away_goals) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / (2.0 * i), 0.5) AS mean FROM f),
r AS (SELECT o.match_id, o.i, o.home_goals, o.away_goals, CASE WHEN h.n > 0 THEN h.gf / h.n ELSE mean END AS hf, CASE WHEN h.n > 0 THEN h.ga / h.n ELSE mean END AS ha, CASE WHEN a.n > 0 THEN a.gf / a.n ELSE mean END AS af, CASE WHEN a.n > 0 THEN a.ga / a.n ELSE mean END AS aa
  FROM o JOIN s h ON h.i = o.i AND h.side = 'home' JOIN s a ON a.i = o.i AND a.side = 'away' WHERE o.i >= 200),
x AS (SELECT *, greatest((hf + aa) / 2, 0.1) AS lh, greatest((af + ha) / 2, 0.1) AS la FROM r)"""
_CELLS = """, q AS (SELECT *, exp(-lh) * lh ** h / factorial(h::INT) * exp(-la) * la ** a / factorial(a::INT) AS p FROM x, range(9) t(h), range(9) u(a)),
p AS (SELECT match_id, any_value(home_goals) AS hg, any_value(away_goals) AS ag, round(sum(p) FILTER (h > a) / sum(p), 9) AS ph, round(sum(p) FILTER (h = a) / sum(p), 9) AS pd, round(sum(p) FILTER (h < a) / sum(p), 9) AS pa,
  round(sum(p) FILTER (h + a > 2) / sum(p), 9) AS po, round(sum(p) FILTER (h > 0 AND a > 0) / sum(p), 9) AS pb FROM q GROUP BY match_id)"""


@query(f"WITH {_AVERAGES} SELECT match_id, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away FROM x")
def team_average_rates(spark, d):
    return walkforward.average_rates(_matches(spark, d), "day", ["match_id"], 200).select("match_id", r6("lambda_home").alias("lambda_home"), r6("lambda_away").alias("lambda_away"))


@query(f"""WITH {_AVERAGES}{_CELLS}
SELECT count(*) AS rows, round(avg((CASE WHEN ph >= pd AND ph >= pa THEN 'h' WHEN pa >= ph AND pa >= pd THEN 'a' ELSE 'd' END = CASE WHEN hg > ag THEN 'h' WHEN hg < ag THEN 'a' ELSE 'd' END)::INT), 6) AS accuracy,
  round(avg(-ln(CASE WHEN hg > ag THEN ph WHEN hg < ag THEN pa ELSE pd END)), 6) AS log_loss, round(avg((ph - (hg > ag)::INT) ** 2 + (pd - (hg = ag)::INT) ** 2 + (pa - (hg < ag)::INT) ** 2), 6) AS brier,
  round(avg(((po >= 0.5) = (hg + ag >= 3))::INT), 6) AS over25_accuracy, round(avg(((pb >= 0.5) = (hg > 0 AND ag > 0))::INT), 6) AS btts_accuracy FROM p""")
def team_average_evaluation(spark, d):
    """Ties are ties to nine places: sums of equal cells in another order differ beyond."""
    predicted = walkforward.team_averages(_matches(spark, d), "day", ["match_id"], 200)
    rounded = predicted.withColumns({p: F.round(p, 9) for p in ("p_home", "p_draw", "p_away", "p_over25", "p_btts")})
    return walkforward.scored(rounded, [], walkforward.AVERAGES)


#: Matches that train first and matches a refit, an eighth of all that have a score: as many refits at every size.
def _steps(matches) -> tuple[int, int]:
    eighth = max(1, walkforward.played(matches).count() // 8)
    return eighth, eighth


_EIGHTHS = f"""{_M}, e AS (SELECT greatest(1, count(*) // 8) AS q FROM played), f AS (SELECT *, row_number() OVER (ORDER BY day, match_id) - 1 AS i FROM played),
g AS (SELECT f.*, CASE WHEN i >= q THEN (i - q) // q ELSE -1 END AS fold FROM f, e), t AS (SELECT DISTINCT fold AS f FROM g WHERE fold >= 0),
w AS (SELECT t.f AS fold, g.home, g.away, g.home_goals AS x, g.away_goals AS y, exp(-0.001 * (max(day) OVER (PARTITION BY t.f) - day)) AS w FROM t JOIN g ON g.fold < t.f)"""


@query(f"""WITH {_EIGHTHS} SELECT fold::INT AS fold, home, away, round(sum(w), 6) AS w, round(sum(w * x), 6) AS x, round(sum(w * y), 6) AS y, """ + ", ".join(f"round(coalesce(sum(w) FILTER (x = {i} AND y = {j}), 0), 6) AS w{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM w GROUP BY ALL")
def dixon_coles_sums(spark, d):
    rows = checkpointed(walkforward.folds(matches := _matches(spark, d), "day", ["match_id"], *_steps(matches)))
    return dixon_coles.pair_sums(rows, "day", 0.001).select("fold", "home", "away", *(r6(x).alias(x) for x in ("w", "x", "y", "w00", "w01", "w10", "w11")))


@query(None)
def dixon_coles_fits(spark, d):
    rows = checkpointed(walkforward.folds(matches := _matches(spark, d), "day", ["match_id"], *_steps(matches)))
    fitted = dixon_coles.fit(dixon_coles.pair_sums(rows, "day", 0.001))
    return fitted.select("fold", "team", *(F.round(x, 4).alias(x) for x in ("attack", "defence", "base", "home_advantage", "rho")), "settled")


@query(None)
def dixon_coles_walk_forward(spark, d):
    return walkforward.scored(dixon_coles.walk_forward(matches := _matches(spark, d), "day", ["match_id"], *_steps(matches)), ["fold"])


_SHAPE = f"""{_M},
k AS (SELECT *, coalesce(sum(home_goals + away_goals) OVER w, 0) AS g, 2.0 * count(home_goals) OVER w AS n FROM m WINDOW w AS (ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT match_id, day, 'h' AS side, home AS team, home_goals AS gf, away_goals AS ga, home_shots AS sf, away_shots AS sa, home_corners AS cf, away_corners AS ca FROM m
  UNION ALL SELECT match_id, day, 'a', away, away_goals, home_goals, away_shots, home_shots, away_corners, home_corners FROM m),
s AS (SELECT match_id, side, day, list({{'day': day, 'gf': gf, 'ga': ga, 'sf': sf, 'sa': sa, 'cf': cf, 'ca': ca, 'p': CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END}}) FILTER (gf IS NOT NULL)
  OVER (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[-10:] AS x FROM l),
t AS (SELECT match_id, side, coalesce(len(x), 0) AS games, date_diff('day', x[-1].day, day) AS rest, """ + ", ".join(f"list_avg(list_transform(x, lambda r: r.{v})) AS {v}" for v in ("gf", "ga", "sf", "sa", "cf", "ca", "p")) + """ FROM s),
b AS (SELECT k.*, CASE WHEN n > 0 THEN greatest(g / n, 1.0) ELSE 1.25 END AS mean FROM k),
f AS (SELECT b.match_id, b.home_goals, b.away_goals, greatest((coalesce(h.gf, mean) + coalesce(a.ga, mean)) / 2, 0.15) AS lh, greatest((coalesce(a.gf, mean) + coalesce(h.ga, mean)) / 2, 0.15) AS la, h.games AS games_home, a.games AS games_away,
  coalesce(h.gf, mean) - coalesce(a.gf, mean) AS gf_diff, coalesce(h.ga, mean) - coalesce(a.ga, mean) AS ga_diff, h.sf - a.sf AS shots_for_diff, h.sa - a.sa AS shots_against_diff, h.cf - a.cf AS corners_for_diff, h.ca - a.ca AS corners_against_diff,
  coalesce(h.p, 1.0) - coalesce(a.p, 1.0) AS form_points_diff, h.rest - a.rest AS rest_days_diff FROM b JOIN t h ON h.match_id = b.match_id AND h.side = 'h' JOIN t a ON a.match_id = b.match_id AND a.side = 'a')"""
_ROUNDED = ["gf_diff", "ga_diff", "shots_for_diff", "shots_against_diff", "corners_for_diff", "corners_against_diff", "form_points_diff"]


@query(f"WITH {_SHAPE} SELECT match_id, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away, games_home, games_away, rest_days_diff, {', '.join(f'round({x}, 6) AS {x}' for x in _ROUNDED)} FROM f")
def hybrid_features(spark, d):
    out = hybrid.features(_matches(spark, d), "day", ["match_id"], grid=False)
    return out.select("match_id", r6("lambda_home").alias("lambda_home"), r6("lambda_away").alias("lambda_away"), "games_home", "games_away", "rest_days_diff", *(r6(x).alias(x) for x in _ROUNDED))


@query(None)
def hybrid_holdout(spark, d):
    """The hybrid model fitted on the first three quarters of the played matches and held against the rolling grid on the rest."""
    there = [f for f in hybrid.FEATURES if not f.startswith(("sot", "fouls", "rank"))]
    made = stashed(walkforward.played(hybrid.features(_matches(spark, d), "day", ["match_id"])).select("match_id", "day", "outcome", "over25", *there))
    rows = stashed(history.chronological_split(made, "day", ["match_id"], 0.25))
    code = F.when(c("outcome") == "H", 0).when(c("outcome") == "D", 1).otherwise(2)
    rows = rows.withColumns({"result": code, "over": c("over25")})
    fitted = models.fit_hybrid(rows.where("part = 'train'"), there, ["result", "over"], "day", ["match_id"])
    scored = models.hybrid_probabilities(rows.where("part = 'eval'"), fitted)
    p = {"H": F.get("p_result", F.lit(0)), "D": F.get("p_result", F.lit(1)), "A": F.get("p_result", F.lit(2))}
    over = lambda x: (F.round(F.avg(((x >= 0.5) == (c("over25") == 1)).cast("double")), 6).alias("over25_accuracy"),)
    mine = metrics.multiclass(scored.withColumn("_over", F.get("p_over", F.lit(1))), p, c("outcome"), [], more=over(c("_over")))
    grid = metrics.multiclass(rows.where("part = 'eval'"), {"H": c("p_home"), "D": c("p_draw"), "A": c("p_away")}, c("outcome"), [], more=over(c("p_over25")))
    return mine.withColumn("model", F.lit("hybrid")).unionByName(grid.withColumn("model", F.lit("rolling_grid")))


_SOFT = ["gf_diff", "ga_diff", "form_points_diff"]


@query(None)
def softmax_refits(spark, d):
    """Softmax models refitted for each eighth of the played matches, beside the class shares of the same training rows."""
    made = stashed(walkforward.played(hybrid.features(matches := _matches(spark, d), "day", ["match_id"], grid=False)).select("match_id", "day", "home_goals", "away_goals", "outcome", *_SOFT))
    rows = stashed(walkforward.folds(made, "day", ["match_id"], *_steps(matches)))
    scored = refits.probabilities(rows, refits.fit(rows, _SOFT, "outcome", ["H", "D", "A"]), _SOFT, ["H", "D", "A"])
    return refits.report(scored, "outcome", ["H", "D", "A"], ["fold"])


#: Ratings before each match by a recursion over a competition's matches, and form from its teams' last five ones.
_STREAMED = f"""RECURSIVE {_M}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY day, match_id) AS k FROM m),
r AS (SELECT DISTINCT competition, 0::BIGINT AS k, NULL::BIGINT AS match_id, list_transform(range(40), lambda i: 1500.0::DOUBLE) AS t, NULL::DOUBLE AS hr, NULL::DOUBLE AS ar FROM n
  UNION ALL SELECT competition, k, match_id, list_transform(range(40), lambda i: CASE WHEN i = home THEN hr + 18 * (s - e) WHEN i = away THEN ar - 18 * (s - e) ELSE t[i + 1] END), hr, ar
  FROM (SELECT *, CASE WHEN home_goals IS NULL THEN e WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END AS s FROM (SELECT n.*, t, t[home + 1] AS hr, t[away + 1] AS ar, 1 / (1 + 10 ** ((t[away + 1] - t[home + 1]) / 400)) AS e FROM r JOIN n ON n.competition = r.competition AND n.k = r.k + 1))),
l AS (SELECT match_id, competition, day, 1 AS side, home AS team, (home_goals > away_goals)::INT AS won FROM m UNION ALL SELECT match_id, competition, day, -1, away, (away_goals > home_goals)::INT FROM m),
x AS (SELECT match_id, side, list(won) FILTER (won IS NOT NULL) OVER (PARTITION BY competition, team ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[-5:] AS w FROM l),
f AS (SELECT match_id, sum(side * coalesce(list_avg(w), 0.5)) AS form_diff FROM x GROUP BY 1)"""


@query(f"WITH {_STREAMED} SELECT match_id, round(hr, 6) AS home_rating, round(ar, 6) AS away_rating, round(form_diff, 6) AS form_diff FROM r JOIN f USING (match_id) WHERE r.k > 0")
def streamed_ratings(spark, d):
    """The matches as a stream that comes in three runs, each from the state of the last; rows long after the matches let the watermark pass them."""
    path, store = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    rows = _matches(spark, d).select("competition", "match_id", F.lit("domestic").alias("kind"), F.to_timestamp("day").alias("kickoff"), c("home").cast("string").alias("home"), c("away").cast("string").alias("away"), "home_goals", "away_goals")
    end = rows.limit(1).withColumns({"match_id": F.lit(-1).cast("long"), "competition": F.lit("end"), "home_goals": F.lit(None).cast("long"), "away_goals": F.lit(None).cast("long")})
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows, end.withColumn("kickoff", F.to_timestamp(F.lit("2100-01-01"))), end.withColumn("kickoff", F.to_timestamp(F.lit("2101-01-01")))):
            part.select([c(x).cast("long").alias(x) if x.endswith("_goals") else c(x) for x in rows.columns]).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema("competition string, match_id long, kind string, kickoff timestamp, home string, away string, home_goals long, away_goals long").parquet(f"{path}/in")
            rated.rated(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    out = spark.read.schema(rated.OUT).parquet(f"{path}/out").where("competition <> 'end'")
    return out.select("match_id", r6("home_rating").alias("home_rating"), r6("away_rating").alias("away_rating"), r6("form_diff").alias("form_diff"))
