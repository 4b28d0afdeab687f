"""More queries on the driver's tables, each beside its SQL: walk-forward models, the market registry, import checks, value bets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlark.functions import text
from fieldlark.operators import aggregates, bets, history, imports, metrics, models, resolve, rules, walkforward
from fieldlark.plans import markets
from fieldlark.plans.queries import _FROM_GRID, _GRID, _P, _rates, query, r6, read
from fieldlark.streaming import snapshots

c = F.col
#: Orders read as matches, of 80 teams in five competitions.
_MATCHES = """m AS (SELECT o_orderkey AS match_id, o_orderdate::DATE AS day, o_orderpriority AS competition, o_custkey % 40 AS home, 40 + o_orderkey % 40 AS away,
  (o_orderkey * 7 + o_custkey) % 5 AS home_goals, (o_custkey * 3 + o_orderkey) % 4 AS away_goals FROM orders)"""


def _matches(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    return read(spark, d, "orders").select(
        k.alias("match_id"), F.to_date("o_orderdate").alias("day"), c("o_orderpriority").alias("competition"), (cust % 40).alias("home"), (40 + k % 40).alias("away"),
        ((k * 7 + cust) % 5).alias("home_goals"), ((cust * 3 + k) % 4).alias("away_goals"),
    )


_WALK = f"""{_MATCHES}, f AS (SELECT *, CASE WHEN i >= 1000 THEN (i - 1000) // 500 ELSE -1 END AS fold FROM (SELECT *, row_number() OVER (ORDER BY day, match_id) - 1 AS i FROM m)),
l AS (SELECT home AS team, fold, home_goals AS gf, away_goals AS ga FROM f UNION ALL SELECT away, fold, away_goals, home_goals FROM f),
t AS (SELECT team, fold, sum(n) OVER w AS n, sum(gf) OVER w AS gf, sum(ga) OVER w AS ga FROM (SELECT team, fold, count(*) AS n, sum(gf) AS gf, sum(ga) AS ga FROM l GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY team ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT fold, sum(g) OVER w / (2 * sum(n) OVER w) AS mean FROM (SELECT fold, sum(home_goals + away_goals) AS g, count(*) AS n FROM f GROUP BY 1) WINDOW w AS (ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT f.*, greatest(mean, 0.5) AS mean, h.gf / greatest(h.n, 1) AS hf, h.ga / greatest(h.n, 1) AS ha, a.gf / greatest(a.n, 1) AS af, a.ga / greatest(a.n, 1) AS aa
  FROM f JOIN o USING (fold) JOIN t h ON h.team = home AND h.fold = f.fold JOIN t a ON a.team = away AND a.fold = f.fold WHERE f.fold >= 0),
x AS (SELECT *, least(greatest(mean * least(greatest(hf / mean, 0.35), 3.2) * sqrt(least(greatest(aa / mean, 0.35), 3.2)), 0.05), 4.5) AS lh,
  least(greatest(mean * least(greatest(af / mean, 0.35), 3.2) * sqrt(least(greatest(ha / mean, 0.35), 3.2)), 0.05), 4.5) AS la FROM r)"""


@query(f"WITH {_WALK} SELECT match_id, fold::INT AS fold, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away FROM x")
def walk_forward_rates(spark, d):
    out = walkforward.poisson_rates(_matches(spark, d), "day", ["match_id"], 1000, 500)
    return out.select("match_id", "fold", r6("lambda_home").alias("lambda_home"), r6("lambda_away").alias("lambda_away"))


@query(f"""WITH {_WALK}, g AS (SELECT h, a FROM range(9) t(h), range(9) u(a)),
q AS (SELECT match_id, fold, home_goals, away_goals, h, a, exp(-lh) * lh ** h / factorial(h::INT) * exp(-la) * la ** a / factorial(a::INT) AS p FROM x, g),
p AS (SELECT match_id, fold, home_goals, away_goals, sum(p) FILTER (h > a) / sum(p) AS ph, sum(p) FILTER (h = a) / sum(p) AS pd, sum(p) FILTER (h < a) / sum(p) AS pa,
  sum(p) FILTER (h + a > 2) / sum(p) AS po, sum(p) FILTER (h > 0 AND a > 0) / sum(p) AS pb FROM q GROUP BY ALL)
SELECT fold::INT AS fold, count(*) AS rows,
  round(avg((CASE WHEN ph >= pd AND ph >= pa THEN 'h' WHEN pd >= pa THEN 'd' ELSE 'a' END = CASE WHEN home_goals > away_goals THEN 'h' WHEN home_goals < away_goals THEN 'a' ELSE 'd' END)::INT), 6) AS accuracy,
  round(avg(-ln(CASE WHEN home_goals > away_goals THEN ph WHEN home_goals < away_goals THEN pa ELSE pd END)), 6) AS log_loss,
  round(avg((ph - (home_goals > away_goals)::INT) ** 2 + (pd - (home_goals = away_goals)::INT) ** 2 + (pa - (home_goals < away_goals)::INT) ** 2), 6) AS brier,
  round(avg(((po >= 0.5) = (home_goals + away_goals >= 3))::INT), 6) AS over25_accuracy, round(avg(((pb >= 0.5) = (home_goals > 0 AND away_goals > 0))::INT), 6) AS btts_accuracy
FROM p GROUP BY 1""")
def walk_forward_evaluation(spark, d):
    return walkforward.scored(walkforward.poisson(_matches(spark, d), "day", ["match_id"], 1000, 500), ["fold"])


@query(f"""WITH {_MATCHES},
l AS (SELECT match_id, competition, day, 'home' AS side, home AS team, (home_goals > away_goals)::INT AS won FROM m UNION ALL SELECT match_id, competition, day, 'away', away, (away_goals > home_goals)::INT FROM m),
s AS (SELECT *, coalesce(avg(won) OVER (PARTITION BY competition, team ORDER BY day, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS form,
  coalesce(avg(won) OVER (PARTITION BY competition, team, side ORDER BY day, match_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0.5) AS strength,
  coalesce(date_diff('day', lag(day) OVER (PARTITION BY competition, team ORDER BY day, match_id), day), 7) AS rest FROM l)
SELECT h.match_id, h.competition, round(h.form - a.form, 6) AS form_diff, round(h.strength - a.strength, 6) AS strength_diff, round((h.rest - a.rest) / 7.0, 6) AS rest_diff,
  (a.rest <= 3)::INT - (h.rest <= 3)::INT AS congestion_diff
FROM s h JOIN s a ON h.match_id = a.match_id AND h.side = 'home' AND a.side = 'away'""")
def form_features(spark, d):
    return walkforward.form(_matches(spark, d), ["competition"], "day", ["match_id"])


_STATUS = {"F": 0.49, "O": 0.47, "P": 0.04}


@query("""
WITH x AS (SELECT o_orderpriority AS k, o_orderstatus AS y, 0.3 + (o_orderkey % 5) * 0.05 AS f, 0.3 AS o, 0.4 - (o_orderkey % 5) * 0.05 AS p FROM orders),
b AS (SELECT k, count(*) AS n, round(avg(-ln(CASE y WHEN 'F' THEN 0.49 WHEN 'O' THEN 0.47 ELSE 0.04 END)), 6) AS l FROM x GROUP BY 1),
e AS (SELECT k, count(*) AS n, round(avg(-ln(CASE y WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END)), 6) AS l FROM x WHERE k <> '1-URGENT' OR f > 0.31 GROUP BY 1)
SELECT k AS o_orderpriority, b.n AS baseline_rows, e.n AS other_rows, b.l AS baseline_log_loss, e.l AS other_log_loss, round(e.l - b.l, 6) AS log_loss_delta, b.n = e.n AS aligned FROM b JOIN e USING (k)
""")
def baseline_comparison(spark, d):
    rows, five = read(spark, d, "orders"), c("o_orderkey") % 5
    p = {"F": 0.3 + five * 0.05, "O": F.lit(0.3), "P": 0.4 - five * 0.05}
    keys, ties = ["o_orderpriority"], ("F", "O", "P")
    baseline = metrics.multiclass(rows, {k: F.lit(x) for k, x in _STATUS.items()}, c("o_orderstatus"), keys, ties=ties)
    other = metrics.multiclass(rows.where((c("o_orderpriority") != "1-URGENT") | (p["F"] > 0.31)), p, c("o_orderstatus"), keys, ties=ties)
    return walkforward.compared(baseline, other, keys).select("o_orderpriority", "baseline_rows", "other_rows", "baseline_log_loss", "other_log_loss", "log_loss_delta", "aligned")


@query("""
WITH i AS (SELECT *, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
x AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'rare' ELSE o_orderpriority END AS k, o_orderstatus AS y, i >= n - ceil(n * 0.2) AS e FROM i)
SELECT k, count(*) AS all_rows, count(*) FILTER (NOT e) AS train_rows, count(*) FILTER (e) AS rows, CASE WHEN count(*) < 1000 THEN 'blocked_too_few_rows' ELSE 'evaluated' END AS status,
  round(avg(-ln(CASE y WHEN 'F' THEN 0.49 WHEN 'O' THEN 0.47 ELSE 0.04 END)) FILTER (e), 6) AS log_loss FROM x GROUP BY 1
""")
def baseline_reports(spark, d):
    rows = read(spark, d, "orders").withColumns({"day": F.to_date("o_orderdate"), "k": F.when(c("o_orderkey") % 101 == 0, "rare").otherwise(c("o_orderpriority"))})
    parts = history.chronological_split(rows, "day", ["o_orderkey"])
    out = walkforward.baseline_report(parts, ["k"], {k: F.lit(x) for k, x in _STATUS.items()}, c("o_orderstatus"), 900, 100, ("F", "O", "P"))
    return out.select("k", "all_rows", "train_rows", "rows", "status", "log_loss")


@query("""
WITH x AS (SELECT s_suppkey, unnest([{'name': 'rating', 'v': (s_suppkey % 11 - 5) / 5.0, 'w': 0.9, 'i': 0}, {'name': 'form', 'v': (s_suppkey % 7 - 3) / 3.0, 'w': -0.6, 'i': 1},
  {'name': 'rest', 'v': (s_suppkey % 5 - 2) / 7.0, 'w': 0.3, 'i': 2}, {'name': 'home', 'v': (s_suppkey % 3)::DOUBLE, 'w': 0.2, 'i': 3}]) AS f FROM supplier)
SELECT s_suppkey, f.name AS name, round(f.v, 6) AS value, round(abs(f.v * f.w), 6) AS impact FROM x QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY round(abs(f.v * f.w), 6) DESC, f.i) <= 3
""")
def top_factors(spark, d):
    k = c("s_suppkey")
    factors = {"rating": ((k % 11 - 5) / 5.0, 0.9), "form": ((k % 7 - 3) / 3.0, -0.6), "rest": ((k % 5 - 2) / 7.0, 0.3), "home": ((k % 3).cast("double"), 0.2)}
    return read(spark, d, "supplier").select("s_suppkey", F.inline(walkforward.top_factors(factors)))


@query("SELECT s_suppkey, m AS model, round(CASE m WHEN 'flat' THEN 0.5 ELSE 1 / (1 + exp(-(s_suppkey % 11 - 5) / 5.0)) END, 6) AS p FROM supplier, (VALUES ('flat'), ('rated')) v(m)")
def rows_by_model(spark, d):
    rows = walkforward.by_model(read(spark, d, "supplier"), ["flat", "rated"])
    return rows.select("s_suppkey", "model", r6(F.when(c("model") == "flat", 0.5).otherwise(1 / (1 + F.exp(-(c("s_suppkey") % 11 - 5) / 5.0)))).alias("p"))


@query("""
SELECT * FROM (VALUES ('football', 'supported', 'regulation_time', 4, 1, 0, 3), ('football', 'prototype', 'regulation_time', 5, 3, 0, 3), ('football', 'future', 'regulation_time', 16, 5, 6, 3),
  ('football', 'future', 'after_extra_time', 1, 0, 0, 7), ('football', 'future', 'qualification', 1, 0, 0, 8), ('football', 'future', 'penalty_shootout', 1, 0, 0, 1),
  ('football', 'future', 'extra_time_only', 3, 1, 0, 4), ('football', 'future', 'first_half', 1, 0, 0, 1), ('nba', 'future', 'game_including_overtime', 4, 3, 1, 0)
) v(sport, availability, settlement_scope, markets, with_line, with_player, phases)
""")
def market_registry(spark, d):
    del d
    flag = lambda x: F.count_if(c(f"requires_{x}"))
    rows = markets.registry(spark).groupBy("sport", "availability", "settlement_scope")
    return rows.agg(F.count("*").alias("markets"), flag("line").alias("with_line"), flag("player").alias("with_player"), F.max(F.size("phase_scope")).alias("phases"))


_ALIASES = [("F", "A", "football.1x2"), ("F", "N", "football.total_goals"), ("O", "N", "nba.spread"), ("O", "R", "football.unheard_of"), ("F", "A", "football.btts")]


def _market_aliases(spark):
    return spark.createDataFrame(_ALIASES, "provider string, market_key string, market_id string")


_KNOWN = "k(provider, market_key, market_id, family, settlement_scope) AS (VALUES ('F', 'A', 'football.1x2', 'core', 'regulation_time'), ('F', 'N', 'football.total_goals', 'goals', 'regulation_time'), ('O', 'N', 'nba.spread', 'spread', 'game_including_overtime'))"


@query(f"""WITH {_KNOWN} SELECT l_orderkey, l_linenumber, k.market_id, k.family, k.settlement_scope, CASE WHEN k.market_id IS NULL THEN 'needs_review' ELSE 'resolved' END AS status,
  CASE WHEN k.market_id IS NULL THEN 'unmapped_provider_market' END AS reason FROM lineitem LEFT JOIN k ON provider = l_linestatus AND market_key = l_returnflag""")
def market_resolution(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_linestatus").alias("provider"), c("l_returnflag").alias("market_key"))
    return markets.resolved(rows, _market_aliases(spark), markets.registry(spark)).select("l_orderkey", "l_linenumber", "market_id", "family", "settlement_scope", "status", "reason")


@query(f"""WITH {_KNOWN}, g AS (SELECT l_linestatus AS provider, l_returnflag AS market_key, count(DISTINCT l_orderkey) AS events, count(DISTINCT l_suppkey) AS books, count(*) AS outcomes FROM lineitem GROUP BY 1, 2)
SELECT provider, market_key, events, books, outcomes, market_id, CASE WHEN market_id IS NULL THEN 'needs_review' ELSE 'resolved' END AS status FROM g LEFT JOIN k USING (provider, market_key)""")
def market_mapping(spark, d):
    rows = read(spark, d, "lineitem").select(c("l_linestatus").alias("provider"), c("l_returnflag").alias("market_key"), c("l_orderkey").alias("event_id"), c("l_suppkey").alias("bookmaker"))
    return markets.mapping_preview(rows, _market_aliases(spark), markets.registry(spark))


@query("""
WITH x AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'odds' WHEN 'view' THEN 'fixtures_results' WHEN 'click' THEN 'lineups_events' ELSE event_type END AS k FROM events)
SELECT event_id, CASE k WHEN 'odds' THEN 'odds_snapshot' WHEN 'fixtures_results' THEN 'fixture_result' WHEN 'lineups_events' THEN 'lineup_event_context' ELSE 'unknown' END AS row_class,
  CASE WHEN k IN ('odds', 'fixtures_results', 'lineups_events') THEN 'classified' ELSE 'review_required' END AS classification_status,
  CASE WHEN k NOT IN ('odds', 'fixtures_results', 'lineups_events') THEN 'unknown source kind: ' || k END AS review_reason FROM x
""")
def row_classes(spark, d):
    kind = F.when(c("event_type") == "purchase", "odds").when(c("event_type") == "view", "fixtures_results").when(c("event_type") == "click", "lineups_events").otherwise(c("event_type"))
    return markets.classified(read(spark, d, "events").select("event_id", kind.alias("source_kind"))).drop("source_kind")


@query("""
WITH f AS (SELECT o_orderkey AS fixture_id, o_orderdate AS kickoff, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS s FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'final' FROM orders WHERE o_orderkey % 97 = 0),
k AS (SELECT fixture_id, max(kickoff) AS kickoff FROM f GROUP BY 1),
l AS (SELECT l_orderkey + CASE WHEN l_partkey % 53 = 0 THEN 1000000000 ELSE 0 END AS fixture_id, l_shipdate - INTERVAL 30 DAY AS captured, l_linestatus = 'F' AS closing, l_quantity / 10 AS odds, l_shipdate - INTERVAL 20 DAY AS label,
  CASE l_returnflag WHEN 'A' THEN 'win' WHEN 'N' THEN 'loss' ELSE 'other' END AS result FROM lineitem),
j AS (SELECT l.*, k.kickoff FROM l LEFT JOIN k USING (fixture_id)), i AS (SELECT c_name AS raw, CASE WHEN c_custkey % 19 > 0 THEN c_custkey END AS canonical, (c_custkey % 100) / 100.0 AS confidence, c_mktsegment AS review FROM customer)
SELECT * FROM (SELECT 'error' AS severity, unnest(['duplicate_fixture_id', 'odds_missing_fixture', 'odds_after_kickoff', 'invalid_decimal_odds', 'settlement_missing_fixture', 'label_before_kickoff', 'invalid_settlement_result', 'low_confidence_identity_without_review', 'empty_identity_field']) AS rule,
  unnest([(SELECT count(*) - count(DISTINCT fixture_id) FROM f), (SELECT count(*) FROM j WHERE kickoff IS NULL), (SELECT count(*) FROM j WHERE closing AND captured > kickoff), (SELECT count(*) FROM j WHERE odds <= 1), (SELECT count(*) FROM j WHERE kickoff IS NULL),
  (SELECT count(*) FROM j WHERE label < kickoff), (SELECT count(*) FROM j WHERE result = 'other'), (SELECT count(*) FROM i WHERE confidence < 0.8 AND review <> 'BUILDING'), (SELECT count(*) FROM i WHERE canonical IS NULL)]) AS faults
UNION ALL SELECT 'warning', 'non_final_fixture', (SELECT count(*) FROM f WHERE s = 'open')) WHERE faults > 0
""")
def import_validation(spark, d):
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    fixtures = orders.select(c("o_orderkey").alias("fixture_id"), c("o_orderdate").alias("kickoff"), F.when(c("o_orderstatus") == "F", "final").otherwise("open").alias("result_status"))
    fixtures = fixtures.unionByName(fixtures.where("fixture_id % 97 = 0").withColumn("result_status", F.lit("final")))
    key, days = c("l_orderkey") + F.when(c("l_partkey") % 53 == 0, 1000000000).otherwise(0), lambda n: c("l_shipdate") - F.make_dt_interval(F.lit(n))
    odds = lines.select(key.alias("fixture_id"), c("l_linenumber").alias("selection"), days(30).alias("captured_at"), (c("l_linestatus") == "F").alias("closing"), (c("l_quantity") / 10).alias("odds"))
    settled = lines.select(key.alias("fixture_id"), c("l_linenumber").alias("selection"), days(20).alias("label_time"), F.when(c("l_returnflag") == "A", "win").when(c("l_returnflag") == "N", "loss").otherwise("other").alias("result"))
    names = read(spark, d, "customer").select(c("c_name").alias("raw_name"), F.when(c("c_custkey") % 19 > 0, c("c_custkey")).alias("canonical_id"), ((c("c_custkey") % 100) / 100.0).alias("confidence"), F.when(c("c_mktsegment") == "BUILDING", "needs_review").otherwise("open").alias("review_status"))
    return imports.report(imports.findings(fixtures, odds, settled, names))


_SAMPLE = """x AS (SELECT year(l_shipdate) + CASE WHEN l_partkey % 41 = 0 THEN 100 ELSE 0 END AS w, l_shipdate + to_days((l_partkey % 30)::INT) AS t, l_shipdate + to_days((l_suppkey % 20)::INT) AS seen, l_shipdate + to_days((l_linenumber * 6)::INT) AS settled, l_shipdate + to_days((l_quantity)::INT) AS label, l_returnflag AS family FROM lineitem),
v AS (SELECT DISTINCT year(l_shipdate) AS w, make_date(year(l_shipdate), 1, 1)::TIMESTAMP AS a, make_date(year(l_shipdate), 12, 31)::TIMESTAMP AS b, CASE WHEN year(l_shipdate) % 2 = 0 THEN 'A' ELSE 'N' END AS f FROM lineitem),
y AS (SELECT x.*, v.a, v.b, v.f FROM x LEFT JOIN v USING (w))"""
_COUNTS = {
    "prediction_time_within_evaluation_window": "a IS NULL OR t < a OR t > b",
    "feature_observed_at_lte_prediction_time": "a IS NOT NULL AND seen > t",
    "label_created_at_gte_settled_at": "a IS NOT NULL AND label < settled",
    "label_created_at_gt_prediction_time": "a IS NOT NULL AND label <= t",
    "settled_at_gt_prediction_time": "a IS NOT NULL AND settled <= t",
    "market_family_matches_window": "a IS NOT NULL AND family <> f",
    "no_random_split": "false",
    "coverage_gate_checked": "false",
}


def _checks(spark, d):
    lines, year = read(spark, d, "lineitem"), F.year("l_shipdate")
    after = lambda n: c("l_shipdate") + F.make_dt_interval(n.cast("int"))
    rows = lines.select((year + F.when(c("l_partkey") % 41 == 0, 100).otherwise(0)).alias("window_id"), after(c("l_partkey") % 30).alias("prediction_time"), after(c("l_suppkey") % 20).alias("feature_observed_at"), after(c("l_linenumber") * 6).alias("settled_at"), after(c("l_quantity")).alias("label_created_at"), c("l_returnflag").alias("market_family"))
    first = lambda m, day: F.make_date(year, F.lit(m), F.lit(day)).cast("timestamp_ntz")
    windows = lines.select(year.alias("window_id"), first(1, 1).alias("evaluation_start"), first(12, 31).alias("evaluation_end"), F.when(year % 2 == 0, "A").otherwise("N").alias("market_family")).distinct()
    return imports.walk_forward_checks(rows, windows)


@query(f"WITH {_SAMPLE} " + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({v}) AS failures FROM y" for k, v in _COUNTS.items()))
def walk_forward_checks(spark, d):
    return _checks(spark, d)


@query(f"WITH {_SAMPLE}, n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS k, count(*) FILTER ({v}) AS n FROM y" for k, v in _COUNTS.items()) + ") SELECT CASE WHEN sum(n) = 0 THEN 'ready_for_evaluation' ELSE 'blocked' END AS status, string_agg(k, ',' ORDER BY k) FILTER (n > 0) AS blockers FROM n")
def walk_forward_status(spark, d):
    return imports.ready(_checks(spark, d))


@query("""
SELECT (SELECT count(*) FROM orders) AS fixture_rows, count(*) AS odds_rows, count(DISTINCT l_returnflag) AS market_families, count(*) FILTER (l_quantity / 10 <= 1 OR l_quantity / 11 <= 1) AS price_not_above_one,
  count(*) FILTER (l_shipdate >= l_shipdate + to_days((l_partkey % 3)::INT)) AS captured_after_settlement, count(*) AS settlement_rows, count(*) FILTER (l_suppkey % 5 < 2) AS label_before_settlement, count(*) FILTER (l_linenumber > 2) AS outcome_not_binary, false AS passed FROM lineitem
""")
def sample_gate(spark, d):
    lines = read(spark, d, "lineitem")
    after = lambda n: c("l_shipdate") + F.make_dt_interval(n.cast("int"))
    odds = lines.select((c("l_quantity") / 10).alias("price"), (c("l_quantity") / 11).alias("closing_price"), c("l_shipdate").alias("captured_at"), after(c("l_partkey") % 3).alias("settled_at"), c("l_returnflag").alias("market_family"))
    settled = lines.select(after(c("l_suppkey") % 5).alias("label_created_at"), after(F.lit(2)).alias("settled_at"), (c("l_linenumber") - 1).alias("outcome"))
    return imports.sample_gate(read(spark, d, "orders"), odds, settled)


@query(f"WITH {_MATCHES} SELECT count(*) AS settled_rows, count(DISTINCT competition) AS competitions, count(*) FILTER (match_id % 9 = 0) AS label_not_after_kickoff, 80::BIGINT AS distinct_teams, false AS ready FROM m")
def model_gate(spark, d):
    rows = _matches(spark, d).select("home", "away", "competition", c("day").alias("kickoff"), F.date_add("day", F.when(c("match_id") % 9 == 0, 0).otherwise(1)).alias("label_time"))
    return imports.model_gate(rows, 200, 20, 2)


@query("""
WITH x AS (SELECT l_orderkey + CASE WHEN l_partkey % 53 = 0 THEN 1000000000 ELSE 0 END AS k, CASE WHEN l_suppkey % 7 > 0 THEN l_returnflag END AS status, l_linestatus AS kind, l_shipdate AS seen, l_shipdate + to_days((l_partkey % 3 - 1)::INT) AS captured FROM lineitem)
SELECT 'missing_status' AS check_name, count(*) FILTER (status IS NULL) AS failures FROM x UNION ALL SELECT 'not_allowed_status', count(*) FILTER (status IS NULL OR status NOT IN ('A', 'N')) FROM x UNION ALL SELECT 'not_allowed_kind', count(*) FILTER (kind <> 'O') FROM x
UNION ALL SELECT 'orphan_fixture', count(*) FILTER (k NOT IN (SELECT o_orderkey FROM orders)) FROM x UNION ALL SELECT 'observed_after_captured', count(*) FILTER (seen > captured) FROM x
""")
def context_checks(spark, d):
    lines = read(spark, d, "lineitem")
    rows = lines.select((c("l_orderkey") + F.when(c("l_partkey") % 53 == 0, 1000000000).otherwise(0)).alias("fixture_id"), F.when(c("l_suppkey") % 7 > 0, c("l_returnflag")).alias("status"), c("l_linestatus").alias("kind"), c("l_shipdate").alias("observed_at"), (c("l_shipdate") + F.make_dt_interval((c("l_partkey") % 3 - 1).cast("int"))).alias("captured_at"))
    return imports.context_faults(rows, read(spark, d, "orders").select(c("o_orderkey").alias("fixture_id")), ["status"], {"status": ("A", "N"), "kind": ("O",)})


@query("WITH " + _GRID.replace("{tau}", "") + _FROM_GRID.replace(" / sum(p)", ""))
def poisson_grid_raw(spark, d):
    return models.grid_probabilities(_rates(spark, d), "lh", "la", normalised=False).select("s_suppkey", *(r6(x).alias(x) for x in _P), "likely_score")


@query("""
SELECT event_id, row_number() OVER (ORDER BY day NULLS FIRST, ts, event_id) - 1 AS row_index, CASE WHEN row_number() OVER (ORDER BY day NULLS FIRST, ts, event_id) > count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'eval' ELSE 'train' END AS part
FROM (SELECT *, CASE WHEN event_id % 10 > 0 THEN ts::DATE END AS day FROM events)
""")
def split_with_null_days(spark, d):
    rows = read(spark, d, "events").withColumn("day", F.when(c("event_id") % 10 > 0, F.to_date("ts")))
    return history.chronological_split(rows, "day", ["ts", "event_id"]).select("event_id", "row_index", "part")


@query("""
SELECT event_id, len(l[-10:]) AS games, round(list_avg(l[-10:]), 6) AS value_avg
FROM (SELECT event_id, coalesce(list(value) FILTER (event_type = 'purchase') OVER (PARTITION BY CASE WHEN user_id % 7 > 0 THEN user_id END ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS l FROM events)
""")
def filtered_history_of_null_keys(spark, d):
    rows = read(spark, d, "events").withColumn("k", F.when(c("user_id") % 7 > 0, c("user_id")))
    return history.rolling_filtered(rows, ["k"], ["ts", "event_id"], c("event_type") == "purchase", ["value"], 10).select("event_id", "games", r6("value_avg").alias("value_avg"))


@query("""
WITH p(market, selection, p) AS (VALUES ('A', 'F', 0.55), ('N', 'O', 0.3), ('N', 'F', 0.1)), x AS (SELECT l_orderkey, l_linenumber, p, 0.9 + l_quantity / 20 AS odds FROM lineitem JOIN p ON market = l_returnflag AND selection = l_linestatus)
SELECT l_orderkey, l_linenumber, round(1 / p, 6) AS fair_odds, round(p * odds - 1, 6) AS edge, CASE WHEN odds > 1 THEN round(0.25 * least(greatest((p * odds - 1) / (odds - 1), 0), 1), 6) ELSE 0 END AS quarter_kelly FROM x
""")
def value_selections(spark, d):
    prices = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_returnflag").alias("market"), c("l_linestatus").alias("selection"), (0.9 + c("l_quantity") / 20).alias("odds"))
    p = spark.createDataFrame([("A", "F", 0.55), ("N", "O", 0.3), ("N", "F", 0.1)], "market string, selection string, p double")
    return bets.value_selections(prices, p, 0.8).select("l_orderkey", "l_linenumber", *(r6(x).alias(x) for x in ("fair_odds", "edge", "quarter_kelly")))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 1 + l_quantity / 20 AS odds FROM lineitem WHERE l_discount - 0.04 > 0), k AS (SELECT o_orderkey, 1 + o_totalprice / 1e5 AS closing FROM orders)
SELECT l_orderkey, l_linenumber, round(100 * (odds / closing - 1), 6) AS clv_percent FROM s JOIN k ON l_orderkey = o_orderkey
""")
def bet_ledger(spark, d):
    picks = read(spark, d, "lineitem").select(c("l_orderkey").alias("k"), "l_linenumber", (1 + c("l_quantity") / 20).alias("odds"), (c("l_discount") - 0.04).alias("edge"))
    orders = read(spark, d, "orders").select(c("o_orderkey").alias("k"), F.lit(1).alias("at"), (1 + c("o_totalprice") / 1e5).alias("closing_odds"))
    closing = orders.unionByName(orders.withColumns({"at": F.lit(0), "closing_odds": F.lit(9.0)}))
    return bets.ledger(picks, closing, ["k"], "at").select(c("k").alias("l_orderkey"), "l_linenumber", "clv_percent")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN 'settled' ELSE CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'settled' END END AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'win' ELSE 'loss' END AS r, l_quantity / 10 AS odds FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s IS DISTINCT FROM 'settled' THEN 'status:' || coalesce(s, 'missing') WHEN odds <= 1 THEN 'bad_price' END AS skip_reason, CASE WHEN s = 'settled' AND odds > 1 THEN CASE r WHEN 'win' THEN round(odds - 1, 6) ELSE -1.0 END END AS unit_result FROM x
""")
def settled_evaluation(spark, d):
    status = F.when(c("l_returnflag") == "A", "settled").when((c("l_returnflag") == "N") & (c("l_linestatus") == "O"), "open").when(c("l_returnflag") == "N", "settled")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", status.alias("settlement_status"), F.when(c("l_linenumber") % 2 == 0, "win").otherwise("loss").alias("settlement_result"), (c("l_quantity") / 10).alias("odds"))
    return bets.offline_evaluation(rows).select("l_orderkey", "l_linenumber", "skip_reason", "unit_result")


@query("""
WITH r AS (SELECT 'player' AS kind, 'p' || c_nationkey AS provider, c_custkey::VARCHAR AS key FROM customer UNION SELECT 'team', 'p' || (l_suppkey % 5), l_suppkey::VARCHAR FROM lineitem UNION SELECT 'team', 'p' || (s_suppkey % 5), s_suppkey::VARCHAR FROM supplier)
SELECT kind, count(*) FILTER (key::BIGINT % 3 = 0) AS resolved, count(*) FILTER (key::BIGINT % 3 > 0) AS review_required FROM r GROUP BY 1
""")
def identity_preview(spark, d):
    ref = lambda df, kind, by, key: df.select(F.lit(kind).alias("kind"), F.concat(F.lit("p"), by).alias("provider"), key.cast("string").alias("key"))
    player = ref(read(spark, d, "customer"), "player", c("c_nationkey"), c("c_custkey"))
    home, away = (ref(read(spark, d, t), "team", c(k) % 5, c(k)) for t, k in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")))
    refs = resolve.identity_refs(player=player, home=home, away=away)
    return resolve.preview(refs, refs.where(c("key").cast("long") % 3 == 0))


@query("SELECT l_suppkey AS s_suppkey, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN 'known' ELSE 'patch' END AS origin FROM lineitem GROUP BY 1 UNION SELECT s_suppkey, 'known' FROM supplier WHERE s_suppkey % 2 = 0")
def patched_dimension(spark, d):
    known = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("known").alias("origin"))
    return resolve.patched(known, read(spark, d, "lineitem").select(c("l_suppkey").alias("s_suppkey"), F.lit("patch").alias("origin")), "s_suppkey")


@query("SELECT c_custkey, round(c_acctbal / 10000, 6) AS confidence, 'canonical_id,reviewer' AS required_fields FROM customer WHERE c_acctbal / 10000 < 0.95 OR c_acctbal IS NULL")
def review_candidates(spark, d):
    out = resolve.candidates(read(spark, d, "customer"), c("c_acctbal") / 10000, ["canonical_id", "reviewer"])
    return out.select("c_custkey", r6("confidence").alias("confidence"), F.concat_ws(",", "required_fields").alias("required_fields"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS observed_at FROM events WHERE ts <= TIMESTAMP '2024-06-01' GROUP BY 1")
def visible_at_a_time(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", c("ts").alias("observed_at"))
    return snapshots.visible(rows, "2024-06-01 00:00:00", ["user_id"])


@query("SELECT o_orderkey AS run_id, o_orderdate AS started_at, f AS finished_at, CASE WHEN f IS NULL THEN 'running' ELSE 'ok' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey")
def runs_and_their_ends(spark, d):
    started = read(spark, d, "orders").select(c("o_orderkey").alias("run_id"), c("o_orderdate").alias("started_at"))
    ended = read(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(c("l_orderkey").alias("run_id")).agg(F.max("l_shipdate").alias("finished_at")).withColumn("status", F.lit("ok"))
    return snapshots.source_runs(started, ended).select("run_id", "started_at", "finished_at", "status")


@query("SELECT event_id FROM events WHERE user_id % 20 <= 15 AND value > 10 AND event_id % 3 >= user_id % 3")
def ordered_labels(spark, d):
    e, u = c("event_id"), c("user_id")
    rows = read(spark, d, "events").select("event_id", (u % 20).alias("feature_observed_at"), F.lit(15).alias("prediction_time"), (c("value") + 5).alias("settled_at"), (c("value") + 5 + (e % 3 - u % 3)).alias("label_created_at"))
    return snapshots.labelled(rows).select("event_id")


@query("""
WITH m AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, o_orderstatus AS label, 1.5 + (o_orderkey % 7) / 4.0 AS f, 1.6 + (o_custkey % 5) / 4.0 AS o, 20 + (o_orderkey % 3) * 10.0 AS p FROM orders),
n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) FILTER (label = 'F') OVER h AS cf, count(*) FILTER (label = 'O') OVER h AS co, count(*) FILTER (label = 'P') OVER h AS cp FROM m WINDOW w AS (ORDER BY day, k), h AS (ORDER BY day, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT k, label, unnest([{'s': 'F', 'c': cf, 'q': f}, {'s': 'O', 'c': co, 'q': o}, {'s': 'P', 'c': cp, 'q': p}]) AS v, i, 1 / f + 1 / o + 1 / p AS total FROM n WHERE i >= 60),
y AS (SELECT k, v.s AS selection, (v.c + 1) / (i + 3) AS p, v.q AS placed, v.q * 0.95 AS closing, 1 / v.q / total AS implied, label = v.s AS won FROM x)
SELECT k, selection, round(p, 6) AS p, round(implied, 6) AS implied_probability, round(p * placed - 1, 6) AS edge, CASE WHEN won THEN round(placed - 1, 6) ELSE -1.0 END AS profit, round(placed / closing - 1, 6) AS clv
FROM y WHERE p * placed - 1 >= 0.03 QUALIFY row_number() OVER (PARTITION BY k ORDER BY p * placed DESC, selection DESC) = 1
""")
def walk_forward_bets(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    orders = read(spark, d, "orders")
    matches = orders.select(k.alias("k"), F.to_date("o_orderdate").alias("day"), c("o_orderstatus").alias("label"))
    price = {"F": 1.5 + (k % 7) / 4.0, "O": 1.6 + (cust % 5) / 4.0, "P": 20 + (k % 3) * 10.0}
    each = F.array(*(F.struct(F.lit(s).alias("selection"), F.lit(b).alias("book"), (x * share).alias("price")) for s, x in price.items() for b, share in (("placed", 1.0), ("closing", 0.95))))
    out = bets.walk_forward_bets(matches, orders.select(k.alias("k"), F.inline(each)), "k", "day", ["k"], list(price), "placed", "closing")
    return out.select("k", "selection", *(r6(x).alias(x) for x in ("p", "implied_probability", "edge")), "profit", r6("clv").alias("clv"))


@query("""
WITH s AS (SELECT o_orderkey AS k, unnest([{'n': 'football.1x2:home', 'p': 0.3 + (o_orderkey % 5) * 0.1, 'q': 1.2 + (o_custkey % 9) / 4.0}, {'n': 'football.total_goals:over_2.5', 'p': 0.2 + (o_custkey % 7) * 0.1, 'q': 1.3 + (o_orderkey % 11) / 5.0}]) AS v FROM orders),
e AS (SELECT k, 'selection' AS kind, v.n AS name, v.p AS p, v.q AS odds FROM s UNION ALL SELECT k, 'ticket', 'Balanced Builder', least(greatest(product(v.p) * 0.78, 1e-6), 1 - 1e-6), product(v.q) FROM s GROUP BY 1)
SELECT k, kind, name, round(p, 6) AS p, round(odds, 6) AS odds, round(p * odds - 1, 6) AS edge FROM e
""")
def value_report(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    leg = lambda market, selection, p, odds: F.struct(F.lit(market).alias("market"), F.lit(selection).alias("selection"), p.alias("p"), odds.alias("odds"))
    legs = F.array(leg("football.1x2", "home", 0.3 + (k % 5) * 0.1, 1.2 + (cust % 9) / 4.0), leg("football.total_goals", "over_2.5", 0.2 + (cust % 7) * 0.1, 1.3 + (k % 11) / 5.0))
    rows = read(spark, d, "orders").select(k.alias("k"), F.inline(legs))
    out = bets.value_report(rows.drop("p"), rows.drop("odds"), "k", 0.8)
    return out.select("k", "kind", "name", *(r6(x).alias(x) for x in ("p", "odds", "edge")))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) AS reason, regexp_replace(p_name, '[^A-Za-z0-9_-]', '-', 'g') AS run_id, p_size / 1.0 AS percent,
  p_partkey % 3 = 0 AS utc FROM part
""")
def text_shapes(spark, d):
    when = F.when(c("p_partkey") % 3 == 0, "2024-01-01T00:00:00Z").when(c("p_partkey") % 3 == 1, "2024-01-01 00:00:00").otherwise(F.lit(None).cast("string"))
    return read(spark, d, "part").select("p_partkey", text.reason_slug(c("p_type")).alias("reason"), text.run_id(c("p_name")).alias("run_id"), text.percent(F.concat(F.lit(" "), c("p_size"), F.lit("%"))).alias("percent"), text.looks_utc(when).alias("utc"))


@query("""
SELECT o_orderkey, CASE WHEN NOT v THEN 'keep_for_repair' WHEN r THEN 'keep_referenced' WHEN a < 30 THEN 'keep_recent' WHEN a < 365 THEN 'archive' ELSE 'delete_candidate' END AS keeps
FROM (SELECT o_orderkey, o_orderkey % 7 > 0 AS v, o_orderstatus = 'P' AS r, o_custkey % 500 AS a FROM orders)
""")
def retention(spark, d):
    return read(spark, d, "orders").select("o_orderkey", rules.retention(c("o_orderkey") % 7 > 0, c("o_custkey") % 500, c("o_orderstatus") == "P").alias("keeps"))


@query("""
WITH x AS (SELECT least(floor((value % 40) / 100 * 5), 4)::INT AS bin, (value % 40) / 100 AS p, (event_id % 3 = 0)::INT AS hit FROM events), b AS (SELECT bin, count(*) AS rows, avg(p) AS confidence, avg(hit) AS accuracy FROM x GROUP BY 1)
SELECT r.i::INT AS bin, coalesce(rows, 0) AS rows, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(5) r(i) LEFT JOIN b ON bin = r.i
""")
def calibration_with_empty_bins(spark, d):
    out = metrics.calibration(read(spark, d, "events").withColumn("p", (c("value") % 40) / 100), c("p"), c("event_id") % 3 == 0, 5, "null")
    return out.select("bin", "rows", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


_KIND = "CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot' WHEN 'view' THEN 'card' ELSE 'other' END"


@query(f"""
SELECT user_id, event_id % 2 AS side, count(*) FILTER (k IN ('shot', 'goal')) AS shots, count(*) FILTER (k = 'goal') AS goals, round(sum(coalesce(value, 0)), 4) AS xg, count(*) FILTER (k = 'card') AS cards,
  count(*) FILTER (raw LIKE '%Corner%') AS corners, count(*) FILTER (k = 'goal' AND t <= 45) AS first_half_goals, count(*) FILTER (k = 'goal' AND t > 45) AS second_half_goals, string_agg(t, ',' ORDER BY t) FILTER (k = 'goal') AS goal_minutes
FROM (SELECT *, {_KIND} AS k, minute(ts) AS t, CASE event_id % 5 WHEN 0 THEN '{{"t": "Corner"}}' WHEN 1 THEN '{{"t": "Pass"}}' END AS raw FROM events) GROUP BY 1, 2
""")
def event_totals(spark, d):
    kind = F.when(c("event_type") == "purchase", "goal").when(c("event_type") == "click", "shot").when(c("event_type") == "view", "card").otherwise("other")
    raw = F.when(c("event_id") % 5 == 0, '{"t": "Corner"}').when(c("event_id") % 5 == 1, '{"t": "Pass"}')
    out = aggregates.event_summary(read(spark, d, "events"), "user_id", c("event_id") % 2, kind, F.minute("ts"), c("value"), raw)
    return out.withColumns({"xg": F.round("xg", 4), "goal_minutes": F.nullif("goal_minutes", F.lit(""))})


@query("""
WITH s AS (SELECT l_suppkey AS team, nullif(l_linenumber % 4, 3) AS cf, nullif(l_orderkey % 6, 5) AS ca, l_partkey % 9 AS sf, l_orderkey % 7 AS sa FROM lineitem),
m AS (SELECT avg(cf + ca) AS c, avg(sf + sa) AS s FROM s)
SELECT team, count(cf + ca) AS corners_matches, coalesce(sum(cf) FILTER (ca IS NOT NULL), 0)::BIGINT AS corners_for, coalesce(sum(ca) FILTER (cf IS NOT NULL), 0)::BIGINT AS corners_against,
  count(*) AS shots_matches, sum(sf)::BIGINT AS shots_for, sum(sa)::BIGINT AS shots_against, 0::BIGINT AS yellows_matches, 0::BIGINT AS yellows_for, 0::BIGINT AS yellows_against,
  round((SELECT c FROM m), 6) AS avg_corners, round((SELECT s FROM m), 6) AS avg_shots, 4.0::DOUBLE AS avg_yellows FROM s GROUP BY team
""")
def team_means(spark, d):
    k, line = c("l_orderkey"), c("l_linenumber")
    none = F.lit(None).cast("long")
    rows = read(spark, d, "lineitem").select(
        c("l_suppkey").alias("team"), F.nullif((line % 4).cast("long"), F.lit(3)).alias("corners_for"), F.nullif(k % 6, F.lit(5)).alias("corners_against"),
        (c("l_partkey") % 9).alias("shots_for"), (k % 7).alias("shots_against"), none.alias("yellows_for"), none.alias("yellows_against"),
    )
    return aggregates.team_means(rows)


_SHARES = """x AS (SELECT o_orderpriority AS competition, CASE o_orderstatus WHEN 'F' THEN 0.2 + (o_custkey % 7) * 0.1 WHEN 'O' THEN 0.75 - (o_custkey % 7) * 0.1 WHEN 'P' THEN 0.05 END AS p,
  CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.3 WHEN 'P' THEN 0.2 END AS b FROM orders),
l AS (SELECT competition, i / 20.0 AS share, count(*) AS rows, avg(-ln(greatest((1 - i / 20.0) * p + i / 20.0 * b, 1e-12))) AS loss FROM x, range(11) t(i) WHERE p IS NOT NULL GROUP BY 1, 2)"""


def _share_losses(spark, d):
    step = (c("o_custkey") % 7) * 0.1
    p = {"F": 0.2 + step, "O": 0.75 - step, "P": F.lit(0.05)}
    rows = read(spark, d, "orders").withColumnRenamed("o_orderpriority", "competition")
    return walkforward.share_losses(rows, ["competition"], p, {k: F.lit(b) for k, b in {"F": 0.5, "O": 0.3, "P": 0.2}.items()}, c("o_orderstatus"))


@query(f"WITH {_SHARES} SELECT competition, rows, share::DOUBLE AS share, round(loss, 6) AS log_loss FROM l")
def base_share_losses(spark, d):
    return _share_losses(spark, d).withColumn("log_loss", r6("log_loss"))


@query(f"WITH {_SHARES} SELECT competition, rows, CASE WHEN rows >= 25 THEN share ELSE 0.2 END::DOUBLE AS share, round(loss, 6) AS log_loss FROM l QUALIFY row_number() OVER (PARTITION BY competition ORDER BY loss, share) = 1")
def base_share_choice(spark, d):
    return walkforward.chosen_share(_share_losses(spark, d), ["competition"]).withColumn("log_loss", r6("log_loss"))


@query("""
WITH a AS (SELECT c_mktsegment AS alias, 'id-' || c_custkey % 9 AS v, nullif((c_nationkey % 6)::VARCHAR, '5') AS team, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'x' END AS country FROM customer WHERE c_custkey % 50 = 1),
n AS (SELECT c_custkey, c_mktsegment AS name, nullif((c_nationkey % 9)::VARCHAR, '8') AS team, CASE WHEN c_custkey % 3 = 0 THEN 'x' END AS country FROM customer),
p AS (SELECT c_custkey, min(v) FILTER ((coalesce(a.team, '') = '' OR a.team = n.team) AND (a.country = '' OR a.country = coalesce(n.country, ''))) AS fit, min(v) AS other FROM n JOIN a ON alias = name GROUP BY 1)
SELECT c_custkey, coalesce(fit, other) AS canonical_id, CASE WHEN fit IS NOT NULL THEN 0.99 ELSE 0.88 END AS confidence, fit IS NOT NULL AS auto FROM p
""")
def aliases_in_context(spark, d):
    customers = read(spark, d, "customer")
    nation, key = c("c_nationkey"), c("c_custkey")
    known = customers.where(key % 50 == 1).select(
        c("c_mktsegment").alias("alias"), F.concat(F.lit("id-"), key % 9).alias("canonical_id"), F.nullif((nation % 6).cast("string"), F.lit("5")).alias("team"), F.when(nation % 2 == 0, "").otherwise("x").alias("country")
    )
    names = customers.select("c_custkey", c("c_mktsegment").alias("name"), F.nullif((nation % 9).cast("string"), F.lit("8")).alias("team"), F.when(key % 3 == 0, "x").alias("country"))
    return resolve.resolve_in_context(names, known, ["team", "country"]).where("canonical_id IS NOT NULL").select("c_custkey", "canonical_id", "confidence", "auto")


_SCOPED = "SELECT n_name AS name, n_regionkey AS region_group, CASE n_nationkey % 4 WHEN 0 THEN 'core_train' WHEN 1 THEN 'expanded_train' WHEN 2 THEN 'reference_only' END AS default_scope FROM nation"


def _leagues(spark, d):
    k = c("n_nationkey") % 4
    scope = F.when(k == 0, "core_train").when(k == 1, "expanded_train").when(k == 2, "reference_only")
    return read(spark, d, "nation").select(c("n_name").alias("name"), c("n_regionkey").alias("region_group"), scope.alias("default_scope"))


@query(f"SELECT *, coalesce(default_scope IN ('core_train', 'expanded_train'), false) AS train_separately, coalesce(default_scope IN ('core_train', 'expanded_train'), false) AS calibrate_separately, coalesce(default_scope = 'reference_only', false) AS reference_only FROM ({_SCOPED})")
def league_universe(spark, d):
    return markets.league_universe(_leagues(spark, d))


@query(f"SELECT region_group, count(*) AS total, count(*) FILTER (default_scope = 'core_train') AS core_train, count(*) FILTER (default_scope LIKE '%train') AS trainable, count(*) FILTER (default_scope IS NULL OR default_scope NOT LIKE '%train') AS other FROM ({_SCOPED}) GROUP BY 1")
def league_counts(spark, d):
    return markets.universe_counts(_leagues(spark, d))


@query("""
SELECT 'local' AS source_id, o_orderpriority AS competition_id, year(o_orderdate)::DOUBLE AS season, o_orderkey::VARCHAR AS source_event_id, '' AS kickoff_utc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_custkey::VARCHAR END AS home_name, '' AS away_name,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 5 WHEN 1 THEN NULL ELSE o_orderkey % 5 END::DOUBLE AS home_score, NULL::DOUBLE AS away_score FROM orders
""")
def imported_rows(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    raw = read(spark, d, "orders").select(
        F.lit("local").alias("source"), F.lit(" ").alias("competition"), c("o_orderpriority").alias("league"), F.year("o_orderdate").alias("year"), k.alias("id"), cust.alias("home_team"), F.when(k % 3 == 0, c("o_orderstatus")).otherwise("").alias("home"),
        F.when(k % 4 == 0, (cust % 5).cast("string")).when(k % 4 == 1, "n/a").otherwise("").alias("home_score"), (k % 5).alias("home_goals"), F.lit("none").alias("away_score"),
    )
    return markets.imported(raw)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def wanted_rows(spark, d):
    return markets.only(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), o_orderstatus="P", o_orderpriority="all", o_orderkey=None)
