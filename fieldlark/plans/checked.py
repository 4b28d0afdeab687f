"""Queries of checks between tables, payload shapes, splits and base rates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlark.operators import checks, history, metrics, models, walkforward
from fieldlark.plans.queries import query, r6, read

c = F.col
_TIMES = "l_orderkey + CASE WHEN l_partkey % 53 = 0 THEN 1000000000 ELSE 0 END AS fixture_id, l_suppkey % 3 AS market_family, l_linenumber AS selection_id"


def _key():
    return (c("l_orderkey") + F.when(c("l_partkey") % 53 == 0, 1000000000).otherwise(0)).alias("fixture_id"), (c("l_suppkey") % 3).alias("market_family"), c("l_linenumber").alias("selection_id")


def _days(n):
    return c("l_shipdate") + F.make_dt_interval(n.cast("int"))


@query(f"""WITH s AS (SELECT {_TIMES}, CASE l_returnflag WHEN 'A' THEN 'win' WHEN 'N' THEN 'loss' ELSE 'half' END AS result, l_shipdate AS label FROM lineitem),
o AS (SELECT {_TIMES}, l_shipdate + to_days((l_partkey % 7 - 3)::INT) AS captured FROM lineitem WHERE l_suppkey % 5 > 0), f AS (SELECT fixture_id, market_family, selection_id, min(captured) AS captured FROM o GROUP BY ALL),
j AS (SELECT s.*, f.captured, k.o_orderkey FROM s LEFT JOIN f USING (fixture_id, market_family, selection_id) LEFT JOIN orders k ON k.o_orderkey = s.fixture_id)
SELECT fixture_id, market_family, selection_id, 'settlement_missing_fixture' AS fault FROM j WHERE o_orderkey IS NULL UNION ALL SELECT fixture_id, market_family, selection_id, 'settlement_missing_odds' FROM j WHERE captured IS NULL
UNION ALL SELECT fixture_id, market_family, selection_id, 'invalid_settlement_result' FROM j WHERE result = 'half' UNION ALL SELECT fixture_id, market_family, selection_id, 'label_before_prediction_time' FROM j WHERE label < captured""")
def settlement_faults(spark, d):
    lines = read(spark, d, "lineitem")
    result = F.when(c("l_returnflag") == "A", "win").when(c("l_returnflag") == "N", "loss").otherwise("half")
    odds = lines.where("l_suppkey % 5 > 0").select(*_key(), _days(c("l_partkey") % 7 - 3).alias("captured_at"))
    return checks.settlement_faults(lines.select(*_key(), result.alias("result"), c("l_shipdate").alias("label_time")), odds, read(spark, d, "orders").select(c("o_orderkey").alias("fixture_id")), ["captured_at"])


@query("""WITH o AS (SELECT l_orderkey + CASE WHEN l_partkey % 53 = 0 THEN 1000000000 ELSE 0 END AS k, l_linenumber, l_quantity / 10 AS price, CASE WHEN l_suppkey % 9 > 0 THEN l_quantity / 11 END AS closing, l_shipdate AS captured FROM lineitem)
SELECT k AS fixture_id, l_linenumber, CASE WHEN NOT (price > 1 AND coalesce(closing > 1, false)) THEN 'price_not_above_one' WHEN o_orderkey IS NULL THEN 'missing_fixture' WHEN captured >= o_orderdate + INTERVAL 60 DAY THEN 'captured_after_settlement' END AS fault FROM o LEFT JOIN orders ON o_orderkey = k""")
def priced_before_settlement(spark, d):
    odds = read(spark, d, "lineitem").select(_key()[0], "l_linenumber", (c("l_quantity") / 10).alias("price"), F.when(c("l_suppkey") % 9 > 0, c("l_quantity") / 11).alias("closing_price"), c("l_shipdate").alias("captured_at"))
    fixtures = read(spark, d, "orders").select(c("o_orderkey").alias("fixture_id"), (c("o_orderdate") + F.make_dt_interval(F.lit(60))).alias("settled_at"))
    return checks.priced_before_settlement(odds, fixtures).select("fixture_id", "l_linenumber", "fault")


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'settled' WHEN l_linenumber = 2 THEN 'open' END AS status, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 5 END AS hs, l_shipdate - INTERVAL 40 DAY AS label, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'own' END AS name FROM lineitem)
SELECT k AS fixture_id, o_orderpriority AS competition_id, CASE WHEN name = 'own' THEN 'own' ELSE o_orderstatus END AS home_name, hs AS home_score, CASE WHEN hs IS NULL THEN 'missing_required_fields' WHEN label <= o_orderdate THEN 'label_not_after_kickoff' END AS fault,
  CASE WHEN hs IS NOT NULL AND label > o_orderdate THEN 'ready_for_evaluation_preview_not_training' END AS candidate_status FROM s JOIN orders ON o_orderkey = k WHERE status = 'settled'""")
def result_candidates(spark, d):
    line, p = c("l_linenumber"), c("l_partkey")
    settled = read(spark, d, "lineitem").select(
        c("l_orderkey").alias("fixture_id"), F.when(line == 1, "settled").when(line == 2, "open").alias("status"), F.when(c("l_suppkey") % 4 > 0, p % 5).alias("home_score"), F.lit(1).alias("away_score"), _days(F.lit(-40)).alias("label_time"),
        F.when(p % 3 == 0, "").when(p % 3 == 1, "own").alias("home_name"), F.lit(None).cast("string").alias("away_name"),
    )
    fixtures = read(spark, d, "orders").select(c("o_orderkey").alias("fixture_id"), c("o_orderpriority").alias("competition_id"), c("o_orderdate").alias("kickoff"), c("o_orderstatus").alias("home_name"), c("o_orderstatus").alias("away_name"))
    return checks.result_candidates(settled, fixtures).select("fixture_id", "competition_id", "home_name", "home_score", "fault", "candidate_status")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'post_event_truth' ELSE 'event_observation' END AS snapshot_stage, (event_type = 'purchase')::INT AS final_truth_allowed, CASE WHEN event_type = 'purchase' THEN value END AS value FROM events WHERE event_type IN ('purchase', 'view')""")
def staged_features(spark, d):
    kind = F.when(c("event_type") == "purchase", "match_state").when(c("event_type") == "view", "match_event").otherwise(c("event_type"))
    return checks.staged(read(spark, d, "events").select("event_id", kind.alias("timeline_type"), "value"), ["value"]).select("event_id", "snapshot_stage", "final_truth_allowed", "value")


@query("""SELECT * FROM (SELECT 'fixtures' AS table_name, 'missing_fields' AS fault, count(*) FILTER (o_custkey % 8 = 0) AS rows FROM orders UNION ALL SELECT 'results', 'no_rows', 1 UNION ALL SELECT 'events', 'missing_fields', count(*) FILTER (user_id % 9 = 0) FROM events) WHERE rows > 0""")
def pack_faults(spark, d):
    y = F.lit("y")
    fixtures = read(spark, d, "orders").select(y.alias("source_id"), c("o_orderkey").alias("fixture_id"), c("o_orderdate").alias("kickoff_utc"), F.when(c("o_custkey") % 8 > 0, "h").otherwise("").alias("home_name"), y.alias("away_name"))
    events = read(spark, d, "events").select(y.alias("source_id"), c("event_id").alias("fixture_id"), "event_type", F.when(c("user_id") % 9 > 0, "t").alias("team_name"))
    results = fixtures.where("fixture_id < 0").withColumns({"result_label": y, "label_available_after_utc": y})
    return checks.pack_faults({"fixtures": fixtures, "results": results, "events": events})


@query("""WITH x AS (SELECT o_orderkey AS payload_id, CASE o_custkey % 5 WHEN 4 THEN 'lineup' ELSE 'odds' END AS kind, o_custkey % 5 AS m, o_orderkey % 3 AS t FROM orders)
SELECT payload_id, kind, kind = 'odds' AND m = 0 AND t > 0 AS contract_ok, CASE WHEN m = 4 THEN 'unsupported provider fixture validation: lineup' ELSE concat_ws(';', CASE m WHEN 1 THEN 'bookmakers must not be empty' WHEN 2 THEN 'bookmakers must be an array' END,
  CASE WHEN m = 3 THEN 'invalid decimal field: bookmakers.markets.outcomes.price' END, CASE WHEN t = 0 THEN 'invalid timestamp field: commence_time' END, CASE WHEN m = 3 THEN 'missing string field: bookmakers.markets.key' END, CASE WHEN m = 2 THEN 'missing string field: home_team' END) END AS blockers FROM x""")
def payload_health(spark, d):
    """Price payloads of one event made from each order, most with a fault."""
    m, t = c("o_custkey") % 5, c("o_orderkey") % 3
    fine = '"bookmakers":[{"key":"b","last_update":"2024-01-01T00:00:00Z","markets":[{"key":"h2h","outcomes":[{"name":"x","price":2.5},{"name":"y","price":3}]}]}]'
    books = F.when(m == 1, '"bookmakers":[]').when(m == 2, '"bookmakers":"none"').when(m == 3, fine.replace('"h2h"', "7").replace("2.5", '"2.5"')).otherwise(fine)
    head = F.concat(F.lit('[{"id":"'), c("o_orderkey"), F.lit('","sport_key":"s","commence_time":"'), F.when(t > 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01"), F.lit('","away_team":"a","home_team":'), F.when(m == 2, "12").otherwise('"h"'), F.lit(","))
    rows = read(spark, d, "orders").select(c("o_orderkey").alias("payload_id"), F.when(m == 4, "lineup").otherwise("odds").alias("kind"), F.concat(head, books, F.lit("}]")).alias("payload"))
    return checks.payload_health(rows).select("payload_id", "kind", "contract_ok", F.array_join("blockers", ";").alias("blockers"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 12 AS p, CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 'nan'::DOUBLE ELSE 1.5 END AS y, l_tax * 10 AS f, l_quantity / 20 AS o, CASE WHEN l_suppkey % 3 > 0 THEN 1.5 END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p <= 1 AND l_linenumber <= 3 THEN round(p - y, 6) END AS calibration_gap, CASE WHEN p <= 1 AND l_linenumber <= 2 THEN round((p - y) ** 2, 6) END AS brier, CASE WHEN p <= 1 AND f <= 1 THEN round(p - f, 6) END AS no_vig_delta, CASE WHEN o > 1 AND q > 1 THEN round(o / q - 1, 6) END AS clv_decimal FROM x""")
def checked_values(spark, d):
    line = c("l_linenumber")
    y = F.when(line == 1, 0.0).when(line == 2, 1.0).when(line == 3, 0.5).when(line == 4, float("nan")).otherwise(1.5)
    made = metrics.checked(c("l_discount") * 12, y, c("l_tax") * 10, c("l_quantity") / 20, F.when(c("l_suppkey") % 3 > 0, 1.5))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(r6(x).alias(n) for n, x in made.items()))


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus AS y, row_number() OVER w - 1 AS i, count(*) OVER () AS n, """ + ", ".join(f"(1 + count(*) FILTER (o_orderstatus = '{k}') OVER w - (o_orderstatus = '{k}')::INT) / (3 + row_number() OVER w - 1)::DOUBLE AS p_{k}" for k in "FOP") + """
  FROM orders WINDOW w AS (ORDER BY o_orderdate::DATE, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), e AS (SELECT *, round(p_F, 9) AS f, round(p_O, 9) AS o, round(p_P, 9) AS p FROM x WHERE i >= n - ceil(n * 0.2))
SELECT count(*) AS rows, round(avg((CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END = y)::INT), 6) AS accuracy, round(avg(-ln(CASE y WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END)), 6) AS log_loss,
  round(avg((f - (y = 'F')::INT) ** 2 + (o - (y = 'O')::INT) ** 2 + (p - (y = 'P')::INT) ** 2), 6) AS brier FROM e""")
def prior_through_evaluation(spark, d):
    """The prior of all rows so far, carried on through the evaluated slice."""
    rows = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    prior = history.global_prior(history.chronological_split(rows, "day", ["o_orderkey"]), "day", ["o_orderkey"], "o_orderstatus", ["F", "O", "P"])
    p = {k: F.round(f"p_{k}", 9) for k in "FOP"}
    return metrics.multiclass(prior.where("part = 'eval'"), p, c("o_orderstatus"), [], ties=("F", "O", "P"))


@query("""WITH x AS (SELECT *, o_orderdate >= DATE '1996-06-01' AS e, (o_orderstatus = 'F')::INT AS y, CASE WHEN o_orderkey % 97 = 0 THEN 'new' || o_orderpriority ELSE o_orderpriority END AS k FROM orders),
b AS (SELECT k, avg(y) AS b FROM x WHERE NOT e AND k NOT LIKE 'new%' GROUP BY 1), a AS (SELECT avg(y) AS b FROM x WHERE NOT e AND k NOT LIKE 'new%'),
s AS (SELECT x.k, y, coalesce(b.b, a.b) AS base, (o_custkey % 9 - 4) / 10.0 AS r, (o_orderkey % 5 - 2) / 10.0 AS f FROM x LEFT JOIN b USING (k), a WHERE e),
p AS (SELECT k, y, least(greatest(1 / (1 + exp(-(ln(least(greatest(base, 0.02), 0.98) / (1 - least(greatest(base, 0.02), 0.98))) + 0.95 * r + 0.55 * f))), 0.02), 0.98) AS p FROM s)
SELECT k, count(*) AS rows, round(avg(p), 6) AS mean, round(avg((p - y) ** 2), 6) AS brier FROM p GROUP BY 1""")
def base_by_competition(spark, d):
    """A scorecard whose base is the competition's share before a day, and that of all where the competition is new."""
    key = F.when(c("o_orderkey") % 97 == 0, F.concat(F.lit("new"), "o_orderpriority")).otherwise(c("o_orderpriority"))
    rows = history.split_by_date(read(spark, d, "orders").withColumns({"k": key, "y": (c("o_orderstatus") == "F").cast("int")}), "o_orderdate", "1996-06-01")
    based = walkforward.base_rates(rows.where("part = 'train' AND k NOT LIKE 'new%'"), rows.where("part = 'eval'"), ["k"], c("y"))
    p = models.scorecard(c("base"), {"r": 0.95, "f": 0.55}, {"r": (c("o_custkey") % 9 - 4) / 10.0, "f": (c("o_orderkey") % 5 - 2) / 10.0})
    return based.withColumn("p", p).groupBy("k").agg(F.count("*").alias("rows"), r6(F.avg("p")).alias("mean"), r6(F.avg((c("p") - c("y")) * (c("p") - c("y")))).alias("brier"))
