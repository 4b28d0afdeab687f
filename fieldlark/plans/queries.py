"""Queries that bind the operators to the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.functions import odds as O
from fieldlark.functions import scalars as S
from fieldlark.functions import settle, text
from fieldlark.operators import aggregates, bets, dedupe, history, joins, metrics, models, ratings, resolve, rules
from fieldlark.streaming import snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


@query("""
SELECT event_id, user_id, round(avg(value) OVER w, 6) AS value_avg, count(*) OVER w AS games,
  date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DATE, ts::DATE) AS rest_days
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
""")
def rolling_history(spark, d):
    out = history.rolling(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"], 10, "ts")
    return out.select("event_id", "user_id", r6("value_avg").alias("value_avg"), "games", "rest_days")


@query("""
SELECT event_id, round(avg(value) OVER w, 6) AS value_avg, count(*) OVER w AS games
FROM (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)
""")
def rolling_strict_days(spark, d):
    return history.rolling_strict(read(spark, d, "events"), ["user_id"], F.col("ts"), ["value"], 30).select("event_id", r6("value_avg").alias("value_avg"), "games")


@query("""
SELECT e.event_id, len(l[-10:]) AS games, round(list_avg(l[-10:]), 6) AS value_avg
FROM (SELECT event_id, coalesce(list(value) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS l FROM events) e
""")
def filtered_history(spark, d):
    out = history.rolling_filtered(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", ["value"], 10)
    return out.select("event_id", F.col("games").cast("long").alias("games"), r6("value_avg").alias("value_avg"))


@query("""
SELECT event_id, coalesce(round(avg(value) OVER w, 7), 0.0) AS value_mean, count(*) OVER w >= 3 AS history_ready
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def expanding_history(spark, d):
    return history.expanding(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"], digits=7).select("event_id", "value_mean", "history_ready")


_KINDS = ("purchase", "view", "click", "signup", "error")
_PRIOR = """p AS (SELECT event_id, event_type, ts, """ + ", ".join(f"(1 + count(*) FILTER (event_type = '{k}') OVER w) / (5 + count(*) OVER w)::DOUBLE AS p_{k}" for k in _KINDS) + """
  FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _prior(spark, d):
    return history.global_prior(read(spark, d, "events").withColumn("day", F.to_date("ts")), "day", ["ts", "event_id"], "event_type", list(_KINDS))


@query(f"WITH {_PRIOR} SELECT event_id, " + ", ".join(f"round(p_{k}, 9) AS p_{k}" for k in _KINDS) + " FROM p")
def laplace_prior(spark, d):
    return _prior(spark, d).select("event_id", *(F.round(f"p_{k}", 9).alias(f"p_{k}") for k in _KINDS))


_TOP = "CASE " + " ".join(f"WHEN p_{k} >= greatest({', '.join(f'p_{o}' for o in _KINDS[i:])}) THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@query(f"""WITH {_PRIOR}, q AS (SELECT *, CASE event_type {" ".join(f"WHEN '{k}' THEN p_{k}" for k in _KINDS)} END AS p FROM p)
SELECT date_trunc('month', ts)::DATE AS month, count(*) AS rows, round(avg(-ln(greatest(p, 1e-12))), 6) AS log_loss,
  round(avg({" + ".join(f"(p_{k} - (event_type = '{k}')::INT) ** 2" for k in _KINDS)}), 6) AS brier, round(avg((event_type = {_TOP})::INT), 6) AS accuracy
FROM q GROUP BY 1""")
def prior_evaluation(spark, d):
    p = {k: F.col(f"p_{k}") for k in _KINDS}
    rows = _prior(spark, d).withColumn("month", F.trunc("ts", "month"))
    return metrics.multiclass(rows, p, F.col("event_type"), ["month"], ties=_KINDS)


@query("""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index,
  CASE WHEN row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - least(greatest(ceil(count(*) OVER () * 0.2), 50), count(*) OVER () - 200) THEN 'eval' ELSE 'train' END AS part
FROM events
""")
def chronological_split(spark, d):
    rows = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return history.chronological_split(rows, "day", ["ts", "event_id"]).select("event_id", "row_index", "part")


@query("""
SELECT l_orderkey, l_linenumber, 'part' AS side, l_partkey AS id, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'supplier', l_suppkey, l_quantity FROM lineitem
""")
def team_long(spark, d):
    c = F.col
    views = ([c("l_partkey"), c("l_quantity")], [c("l_suppkey"), c("l_quantity")])
    out = history.team_long(read(spark, d, "lineitem"), *views, ["id", "amount"], ["l_orderkey", "l_linenumber"])
    return out.withColumn("side", F.when(c("side") == "home", "part").otherwise("supplier"))


@query("""
SELECT year(o_orderdate) AS season, count(*) AS test_rows, coalesce(sum(count(*)) OVER w, 0)::BIGINT AS train_rows, round(sum(sum(o_totalprice)) OVER w, 2) AS train_total
FROM orders GROUP BY 1 WINDOW w AS (ORDER BY year(o_orderdate) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def rolling_origin_folds(spark, d):
    out = history.rolling_origin(read(spark, d, "orders"), F.year("o_orderdate"), {"total": F.col("o_totalprice")})
    return out.withColumn("train_total", F.round("train_total", 2))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, o_orderpriority, l_shipdate >= o_orderdate AS leakage_safe FROM s JOIN orders ON l_orderkey = o_orderkey
""")
def gold_candidates(spark, d):
    out = joins.last_wins(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), read(spark, d, "orders"), ["o_orderkey"], ["o_orderdate"])
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderpriority", joins.leakage_flag(F.col("l_shipdate"), F.col("o_orderdate")).alias("leakage_safe"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_without_returns(spark, d):
    returned = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.orphans(read(spark, d, "orders"), returned, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true
""")
def as_of_click(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return joins.as_of(left, right, ["user_id"], "ts", "click_ts", ["click_id"], ["click_id"])


@query("""
WITH x AS (SELECT *, 1 + l_quantity / 10 AS odds FROM lineitem)
SELECT l_orderkey, l_linenumber, round((1 / odds) / sum(1 / odds) OVER (PARTITION BY l_orderkey), 6) AS no_vig, round(sum(1 / odds) OVER (PARTITION BY l_orderkey) - 1, 6) AS overround
FROM x
""")
def no_vig(spark, d):
    odds = 1 + F.col("l_quantity") / 10
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(O.no_vig(odds, "l_orderkey")).alias("no_vig"), r6(O.overround(odds, "l_orderkey")).alias("overround"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS p, l_quantity / 10 AS odds, 0.25 + l_tax * 10 AS trust FROM lineitem),
y AS (SELECT *, CASE WHEN odds > 1 THEN least(greatest((p * odds - 1) / (odds - 1), 0), 1) END AS k, p * odds - 1 AS edge FROM x)
SELECT l_orderkey, l_linenumber, round(1 / least(greatest(p, 1e-6), 1 - 1e-6), 6) AS fair_odds, round(CASE WHEN odds > 1 THEN edge END, 6) AS ev, round(k, 6) AS kelly, round(coalesce(k, 0), 6) AS kelly_zero,
  CASE WHEN trust < 0.5 THEN 'PAPER ONLY - model trust too low' WHEN edge < 0.02 THEN 'NO BET - edge too small' WHEN coalesce(k, 0) <= 0 THEN 'NO BET - Kelly zero'
    WHEN trust < 0.75 THEN 'WATCHLIST VALUE - model not trusted enough for staking' WHEN edge >= 0.08 THEN 'STRONG VALUE - still verify market/liquidity' ELSE 'VALUE - small stake only' END AS decision
FROM y
""")
def value_decisions(spark, d):
    p, odds, trust = F.col("l_discount") * 5, F.col("l_quantity") / 10, 0.25 + F.col("l_tax") * 10
    zero = O.kelly(p, odds, no_price=0.0)
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(O.fair_odds(p)).alias("fair_odds"), r6(O.expected_value(p, odds)).alias("ev"), r6(O.kelly(p, odds)).alias("kelly"), r6(zero).alias("kelly_zero"), O.decision(p * odds - 1, zero, trust).alias("decision")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC) <= 2
""")
def top_two_per_order(spark, d):
    out = dedupe.top_in_group(read(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.desc("l_linenumber")], 2)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first_order(spark, d):
    return dedupe.keep_first(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def upsert_last_order(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("version"))
    return dedupe.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "version").drop("version")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) > 1 AS duplicate FROM orders")
def flag_duplicates(spark, d):
    return dedupe.with_duplicates(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "duplicate")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def linked_users(spark, d):
    e = read(spark, d, "events")
    return dedupe.linked(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), "user_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def grouped_counts(spark, d):
    return aggregates.grouped(read(spark, d, "events"), "event_type")


@query("SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, d):
    return aggregates.table_counts(**{t: read(spark, d, t) for t in ("orders", "lineitem", "events")})


@query("""
SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, min(event_id) AS example_id
FROM events WHERE value IS NULL OR value < 20 GROUP BY 1, 2
""")
def unknown_queue(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return aggregates.review_queue(e, ["event_type", "day"], "ts", "event_id", F.col("value").isNull() | (F.col("value") < 20))


@query("""
SELECT o_orderpriority, count(*) AS rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(DISTINCT o_custkey) AS n_o_custkey, round(count(o_totalprice) / count(*)::DOUBLE, 6) AS o_totalprice_rate
FROM orders GROUP BY 1
""")
def source_coverage(spark, d):
    return aggregates.coverage(read(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", ["o_custkey"], ["o_totalprice"])


@query("""
WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 1e9) AS priced FROM orders)
SELECT finished, priced, concat_ws('; ', CASE WHEN finished < 100 THEN 'finished < 100' END, CASE WHEN priced < 20 THEN 'priced < 20' END) AS warnings, finished >= 100 AND priced >= 20 AS ready FROM c
""")
def walk_forward_readiness(spark, d):
    return aggregates.readiness(read(spark, d, "orders"), {"finished": (F.col("o_orderstatus") == "F", 100), "priced": (F.col("o_totalprice") > 1e9, 20)})


@query("""
SELECT user_id, event_id % 2 AS side, count(*) FILTER (event_type IN ('click', 'purchase')) AS shots, count(*) FILTER (event_type = 'purchase') AS goals,
  string_agg((minute(ts))::VARCHAR, ',' ORDER BY minute(ts)) FILTER (event_type = 'purchase') AS goal_minutes
FROM events GROUP BY 1, 2
""")
def event_summary(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "goal").when(F.col("event_type") == "click", "shot").otherwise("other")
    out = aggregates.event_summary(e, "user_id", F.col("event_id") % 2, kind, F.minute("ts"), F.col("value"))
    return out.select("user_id", "side", "shots", "goals", F.nullif("goal_minutes", F.lit("")).alias("goal_minutes"))


_BUCKET = "least(greatest(ceil((minute(ts) + hour(ts)) / 15), 1), 6)"


@query(f"""
SELECT user_id, count(*) AS goals, min(minute(ts) + hour(ts))::INT AS first_goal_minute, arg_min(event_id % 2, (minute(ts) + hour(ts)) * 1e9 + event_id) AS first_goal_side,
  {", ".join(f"count(*) FILTER ({_BUCKET} = {k}) AS bucket_{k}" for k in range(1, 7))}
FROM events WHERE event_type = 'purchase' GROUP BY 1
""")
def goal_timing(spark, d):
    goals = read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", (F.col("event_id") % 2).alias("side"), (F.minute("ts") + F.hour("ts")).alias("minute"))
    return aggregates.goal_timing(goals, "user_id", "side", "minute", "event_id")


@query(f"""
WITH t AS (SELECT user_id, min(minute(ts) + hour(ts)) AS first, count(*) FILTER ({_BUCKET} > 3) AS late, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) AS matches, round(avg(first), 6) AS mean_first_goal, round(sum(late) / sum(n)::DOUBLE, 6) AS second_half_share FROM t
""")
def goal_timing_report(spark, d):
    return aggregates.timing_report(goal_timing(spark, d)).withColumn("mean_first_goal", r6("mean_first_goal"))


_PHASE = """CASE WHEN p = '5' THEN 'penalty_shootout'
  WHEN p = '1' THEN CASE WHEN m >= 45 THEN 'regulation_first_half_stoppage' ELSE 'regulation_first_half' END
  WHEN p = '2' THEN CASE WHEN m >= 90 THEN 'regulation_second_half_stoppage' ELSE 'regulation_second_half' END
  WHEN p = '3' THEN CASE WHEN m >= 105 THEN 'extra_time_first_half_stoppage' ELSE 'extra_time_first_half' END
  WHEN p = '4' THEN CASE WHEN m >= 120 THEN 'extra_time_second_half_stoppage' ELSE 'extra_time_second_half' END
  WHEN m < 45 THEN 'regulation_first_half' WHEN m < 90 THEN 'regulation_second_half' WHEN m < 105 THEN 'extra_time_first_half' WHEN m < 120 THEN 'extra_time_second_half' ELSE 'extra_time_second_half_stoppage' END"""


def _phased(spark, d):
    e = read(spark, d, "events")
    minute, period = (F.col("event_id") % 130).cast("int"), (F.col("event_id") % 7).cast("string")
    return e.withColumns({"minute": minute, "phase": S.phase(minute, period, F.col("event_type"))})


@query(f"SELECT event_id, {_PHASE} AS phase FROM (SELECT *, event_id % 130 AS m, (event_id % 7)::VARCHAR AS p FROM events)")
def phase_of_play(spark, d):
    return _phased(spark, d).select("event_id", "phase")


@query(f"""
WITH x AS (SELECT user_id, m, {_PHASE} AS phase FROM (SELECT *, event_id % 130 AS m, (event_id % 7)::VARCHAR AS p FROM events))
SELECT user_id, count(*) FILTER (phase = 'regulation_first_half') AS regulation_first_half, count(*) FILTER (phase = 'penalty_shootout') AS penalty_shootout, max(m)::INT AS max_minute,
  count(*) FILTER (phase LIKE 'regulation%') > 0 AS regulation_time, count(*) FILTER (phase LIKE 'regulation%') > 0 AND count(*) FILTER (phase NOT LIKE 'regulation%') > 0 AS qualification
FROM x GROUP BY 1
""")
def phase_counts(spark, d):
    return aggregates.phase_counts(_phased(spark, d), "user_id", "phase", "minute").select("user_id", "regulation_first_half", "penalty_shootout", "max_minute", "regulation_time", "qualification")


@query("""
WITH e AS (SELECT user_id AS player_id, sum(value / 100) AS xg, count(*) FILTER (event_type = 'click') AS shots, count(*) FILTER (event_type = 'purchase') AS goals, count(*) FILTER (event_type = 'error') AS cards FROM events GROUP BY 1),
l AS (SELECT user_id AS player_id, sum(coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 91 END, 60)) AS minutes FROM events GROUP BY 1)
SELECT player_id, round(least(greatest(50 + 18 * coalesce(xg, 0) * 90 / m + 3 * shots * 90.0 / m + 12 * goals * 90.0 / m - 6 * cards * 90.0 / m, 0), 100), 4) AS score
FROM (SELECT *, greatest(coalesce(minutes, 60), 1) AS m FROM e LEFT JOIN l USING (player_id))
""")
def player_scores(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "player_id")
    one = lambda k: F.when(F.col("event_type") == k, 1).otherwise(0)
    done = e.select("player_id", (F.col("value") / 100).alias("xg"), one("click").alias("shots"), one("purchase").alias("goals"), one("error").alias("cards"))
    lineups = e.select("player_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 91).alias("minutes"))
    return aggregates.player_scores(lineups, done).select("player_id", F.round("score", 4).alias("score"))


@query("""
SELECT lower(split_part(p_name, ' ', 1)) AS name, count(DISTINCT p_brand) AS source_count, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS variants
FROM part GROUP BY 1
""")
def identity_groups(spark, d):
    return aggregates.identities(read(spark, d, "part"), F.lower(F.substring_index("p_name", " ", 1)), "p_brand", "p_type").withColumn("source_count", F.col("source_count").cast("long"))


@query("""
SELECT count(*) AS rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(*) FILTER (o_totalprice IS NULL) AS null_o_totalprice,
  coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)), 0)::BIGINT AS duplicate_rows
FROM orders
""")
def dataset_audit(spark, d):
    return aggregates.audit(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate").select("rows", "first_date", "last_date", "null_o_totalprice", "duplicate_rows")


_GRID = """g AS (SELECT h, a FROM range(9) t(h), range(9) u(a)),
x AS (SELECT s_suppkey, 0.4 + (s_suppkey % 17) * 0.15 AS lh, 0.3 + (s_suppkey % 13) * 0.17 AS la FROM supplier),
c AS (SELECT s_suppkey, h, a, exp(-lh) * lh ** h / factorial(h::INT) * exp(-la) * la ** a / factorial(a::INT) {tau} AS p FROM x, g)"""
_FROM_GRID = """SELECT s_suppkey, round(sum(p) FILTER (h > a) / sum(p), 6) AS p_home, round(sum(p) FILTER (h = a) / sum(p), 6) AS p_draw, round(sum(p) FILTER (h < a) / sum(p), 6) AS p_away,
  round(sum(p) FILTER (h + a > 2) / sum(p), 6) AS p_over25, round(sum(p) FILTER (h > 0 AND a > 0) / sum(p), 6) AS p_btts, arg_max(h || '-' || a, p) AS likely_score FROM c GROUP BY 1"""


def _rates(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", (0.4 + (F.col("s_suppkey") % 17) * 0.15).alias("lh"), (0.3 + (F.col("s_suppkey") % 13) * 0.17).alias("la"), F.lit(-0.08).alias("rho"))


_P = ("p_home", "p_draw", "p_away", "p_over25", "p_btts")


@query("WITH " + _GRID.replace("{tau}", "") + _FROM_GRID)
def poisson_grid(spark, d):
    return models.grid_probabilities(_rates(spark, d), "lh", "la").select("s_suppkey", *(r6(c).alias(c) for c in _P), "likely_score")


@query("WITH " + _GRID.replace("{tau}", "* CASE WHEN h = 0 AND a = 0 THEN 1 + lh * la * 0.08 WHEN h = 0 AND a = 1 THEN 1 - lh * 0.08 WHEN h = 1 AND a = 0 THEN 1 - la * 0.08 WHEN h = 1 AND a = 1 THEN 1.08 ELSE 1 END") + _FROM_GRID)
def dixon_coles_grid(spark, d):
    return models.grid_probabilities(_rates(spark, d), "lh", "la", "rho").select("s_suppkey", *(r6(c).alias(c) for c in _P), "likely_score")


_LOGIT = "1 / (1 + exp(-(o_totalprice - 150000) / 60000))"


def _scored(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderpriority", (1 / (1 + F.exp(-(F.col("o_totalprice") - 150000) / 60000))).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(f"""
WITH x AS (SELECT o_orderpriority, {_LOGIT} AS p, (o_orderstatus = 'F')::INT AS y FROM orders), q AS (SELECT *, least(greatest(p, 0.02), 0.98) AS c FROM x)
SELECT o_orderpriority, count(*) AS rows, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg((c - y) ** 2), 6) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM q GROUP BY 1
""")
def binary_metrics(spark, d):
    return metrics.binary(_scored(spark, d), F.col("p"), F.col("y"), ["o_orderpriority"])


_BINS = f"""x AS (SELECT {_LOGIT} AS p, (o_orderstatus = 'F')::INT AS y FROM orders),
b AS (SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS rows, avg(p) AS confidence, avg(y) AS accuracy FROM x GROUP BY 1),
e AS (SELECT k::INT AS bin, coalesce(rows, 0) AS rows, coalesce(confidence, 0) AS confidence, coalesce(accuracy, 0) AS accuracy FROM range(5) t(k) LEFT JOIN b ON bin = k)"""


@query(f"WITH {_BINS} SELECT bin, rows, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM e")
def calibration_bins(spark, d):
    out = metrics.calibration(_scored(spark, d), F.col("p"), F.col("y") == 1)
    return out.select("bin", "rows", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


@query(f"WITH {_BINS} SELECT round(sum(rows * abs(confidence - accuracy)) / sum(rows), 6) AS ece FROM e")
def calibration_error(spark, d):
    return metrics.calibration_error(metrics.calibration(_scored(spark, d), F.col("p"), F.col("y") == 1))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 25 THEN 'push' WHEN (l_linenumber % 2 = 1) = (l_quantity > 25) THEN 'win' ELSE 'loss' END AS result,
  CASE WHEN l_quantity = 25 THEN 0.0 WHEN (l_linenumber % 2 = 1) = (l_quantity > 25) THEN round(0.9 + l_tax, 6) ELSE -1.0 END AS unit_result
FROM lineitem
""")
def settle_totals(spark, d):
    result = settle.total(F.col("l_quantity"), F.lit(25.0), F.when(F.col("l_linenumber") % 2 == 1, "Over 25").otherwise("Under 25"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", result.alias("result"), O.unit_result(result, 1.9 + F.col("l_tax")).alias("unit_result"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS line, (l_quantity % 5) - 2 AS margin, l_returnflag = 'A' AS at_home FROM lineitem),
y AS (SELECT *, CASE WHEN at_home THEN margin + line ELSE line - margin END AS adjusted FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN adjusted > 0 THEN 'win' WHEN adjusted < 0 THEN 'loss' ELSE 'push' END AS result FROM y
""")
def settle_handicap(spark, d):
    side = F.when(F.col("l_returnflag") == "A", "H").otherwise("V")
    result = settle.handicap(F.col("l_quantity") % 5 - 2, F.col("l_linenumber") % 4, side, F.lit("H"), F.lit("V"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", result.alias("result"))


_RULES = ("no_discount", "high_tax", "late")
_BROKEN = ("l_discount = 0", "l_tax > 0.06", "l_shipdate > TIMESTAMP '1998-06-01'")


def _line_rules():
    c = F.col
    return dict(zip(_RULES, (c("l_discount") == 0, c("l_tax") > 0.06, c("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz")), strict=True))


@query("SELECT l_orderkey, l_linenumber, CASE " + " ".join(f"WHEN {b} THEN '{n}'" for n, b in zip(_RULES, _BROKEN)) + " END AS first_reason, concat_ws(',', " + ", ".join(f"CASE WHEN {b} THEN '{n}' END" for n, b in sorted(zip(_RULES, _BROKEN))) + ") AS reasons FROM lineitem")
def rule_reasons(spark, d):
    rs = _line_rules()
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.first_reason(rs).alias("first_reason"), F.array_join(rules.reasons(rs), ",").alias("reasons"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER ({b}) AS failures FROM lineitem" for n, b in zip(_RULES, _BROKEN)))
def rule_failure_counts(spark, d):
    return rules.failure_counts(read(spark, d, "lineitem"), _line_rules())


@query("WITH x AS (SELECT l_orderkey, CASE " + " ".join(f"WHEN {b} THEN '{n}'" for n, b in zip(_RULES, _BROKEN)) + " END AS r FROM lineitem) SELECT count(*) AS rows, count(*) FILTER (r IS NULL) AS accepted, " + ", ".join(f"count(*) FILTER (r = '{n}') AS {n}" for n in _RULES) + ", count(DISTINCT CASE WHEN r IS NULL THEN l_orderkey END) >= 200 AS passed FROM x")
def count_gate(spark, d):
    return rules.gate(read(spark, d, "lineitem"), _line_rules(), "l_orderkey", 200)


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_path(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT n_nationkey, sha256(n_nationkey::VARCHAR || chr(31) || n_name || chr(31)) AS row_hash, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS key, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM nation")
def text_keys(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select("n_nationkey", text.row_hash(F.col("n_nationkey"), name).alias("row_hash"), text.ascii_key(name).alias("key"), text.slug(name).alias("slug"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM part")
def text_fold(spark, d):
    return read(spark, d, "part").select("p_partkey", text.normalize(F.col("p_name"), drop=(), ampersand=False).alias("folded"))


@query("""
WITH v(i, s) AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%y') ELSE strftime(o_orderdate, '%d-%m-%Y') END FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS match_date FROM orders JOIN v ON i = o_orderkey
""")
def date_forms(spark, d):
    o = read(spark, d, "orders")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return o.select("o_orderkey", text.iso_date(shown).alias("match_date"))


@query("""
SELECT c_custkey, coalesce(round(CASE WHEN c_acctbal > 0 THEN c_acctbal - c_nationkey WHEN c_acctbal > -500 THEN c_acctbal ELSE 7.0 END, 6), 7.0) AS feature
FROM customer
""")
def feature_fallback(spark, d):
    b, n = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    # home and away known, home alone, neither
    out = S.feature(F.lit(None).cast("double"), F.when(b > -500, b), F.when(b > 0, n), 7.0)
    return read(spark, d, "customer").select("c_custkey", r6(out).alias("feature"))


@query("""
WITH a AS (SELECT n_name AS alias, n_nationkey AS id, 0.9 + (n_nationkey % 3) * 0.04 AS confidence FROM nation UNION ALL SELECT 'NATION_1', 999, 0.99)
SELECT c_custkey, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM a WHERE alias = n_name AND confidence >= 0.95) AS resolved FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def exactly_one_alias(spark, d):
    n = read(spark, d, "nation")
    extra = spark.sql("SELECT 'NATION_1' AS n_name, 999 AS resolved, CAST(0.99 AS DOUBLE) AS confidence")
    aliases = n.select("n_name", F.col("n_nationkey").alias("resolved"), (0.9 + (F.col("n_nationkey") % 3) * 0.04).alias("confidence")).unionByName(extra)
    named = read(spark, d, "customer").join(joins.small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.only_match(named, joins.small(aliases), "n_name", "resolved").select("c_custkey", "resolved")


@query("""
WITH e AS (SELECT p_brand, p_size, min(p_partkey) AS v FROM part GROUP BY 1, 2), l AS (SELECT p_brand, min(p_partkey) AS v FROM part GROUP BY 1)
SELECT s_suppkey, coalesce(e.v, l.v) AS part_id, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'name' END AS matched_by
FROM (SELECT s_suppkey, 'Brand#' || (1 + s_suppkey % 6) || (1 + s_suppkey % 5) AS p_brand, (s_suppkey % 60)::INT AS p_size FROM supplier) s LEFT JOIN e USING (p_brand, p_size) LEFT JOIN l USING (p_brand)
""")
def alias_priority(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), 1 + k % 6, 1 + k % 5).alias("p_brand"), (k % 60).cast("int").alias("p_size"))
    parts = read(spark, d, "part").select("p_brand", "p_size", F.col("p_partkey").alias("part_id"))
    return joins.by_priority(s, parts, ["p_brand", "p_size"], ["p_brand"], "part_id").select("s_suppkey", "part_id", "matched_by")


@query("""
WITH x AS (SELECT s_suppkey, 0.4 + (s_suppkey % 17) * 0.15 AS lh, 0.3 + (s_suppkey % 5) * 0.02 AS h, 0.25 AS d, 0.2 + (s_suppkey % 7) * 0.03 AS o, 0.4 AS b FROM supplier)
SELECT s_suppkey, market, selection, round(least(greatest(p, 0), 1), 6) AS p FROM x, LATERAL (VALUES
  ('football.1x2', 'home', h), ('football.1x2', 'draw', d), ('football.1x2', 'away', 1 - h - d), ('football.double_chance', '1X', h + d), ('football.double_chance', '12', 1 - d), ('football.double_chance', 'X2', 1 - h),
  ('football.total_goals', 'over_2.5', o), ('football.total_goals', 'under_2.5', 1 - o), ('football.total_goals', 'over_1.5', least(o + 0.2, 0.98)), ('football.total_goals', 'under_3.5', least(1.18 - o, 0.98)),
  ('football.btts', 'yes', b), ('football.btts', 'no', 1 - b), ('football.team_goals', 'home_over_0.5', 1 - exp(-lh)), ('football.team_goals', 'home_over_1.5', 1 - exp(-lh) * (1 + lh))) v(market, selection, p)
""")
def market_probabilities(spark, d):
    k = F.col("s_suppkey")
    h, draw, o = 0.3 + (k % 5) * 0.02, F.lit(0.25), 0.2 + (k % 7) * 0.03
    cells = bets.market_probabilities(h, draw, 1 - h - draw, o, F.lit(0.4), 0.4 + (k % 17) * 0.15)
    return read(spark, d, "supplier").select("s_suppkey", F.inline(cells)).withColumn("p", r6("p"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1e5 AS p, 1 + l_quantity / 20 AS placed, 1 + l_quantity / 21 AS closing, l_returnflag = 'A' AS won FROM lineitem),
y AS (SELECT *, p * placed - 1 AS edge FROM x WHERE p * placed - 1 >= 0.03 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY edge DESC, l_linenumber DESC) <= 1)
SELECT count(*) AS bets, sum(1.0)::DOUBLE AS stake, round(sum(CASE WHEN won THEN round(placed - 1, 6) ELSE -1.0 END), 4) AS profit,
  round(avg(edge), 6) AS avg_edge, round(avg(placed / closing - 1), 6) AS avg_clv, count(*) FILTER (placed / closing - 1 > 0) AS clv_positive FROM y
""")
def paper_bets(spark, d):
    c = F.col
    rows = read(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").alias("selection"), (c("l_extendedprice") / 1e5).alias("p"), (1 + c("l_quantity") / 20).alias("placed_odds"), (1 + c("l_quantity") / 21).alias("closing_odds"), F.when(c("l_returnflag") == "A", c("l_linenumber")).otherwise(-1).alias("result_selection"))
    out = aggregates.bets_summary(bets.paper_bets(rows, "l_orderkey"))
    return out.select("bets", "stake", F.round("profit", 4).alias("profit"), "avg_edge", "avg_clv", "clv_positive")


@query("""
WITH x AS (SELECT s_suppkey, (s_suppkey % 12) AS hp, (s_suppkey % 9) AS ap, (s_suppkey % 7 - 3) / 4.0 AS gf, (s_suppkey % 5 - 2) / 3.0 AS ga, (s_suppkey % 3 - 1) / 2.0 AS pts, (s_suppkey % 40 - 20)::DOUBLE AS rest FROM supplier),
y AS (SELECT *, least(least(hp, ap) / 10.0, 1) AS r FROM x), z AS (SELECT *, 0.18 + r * (0.42 * gf - 0.30 * ga + 0.16 * pts + 0.015 * least(greatest(rest, -14), 14)) AS s FROM y),
w AS (SELECT *, exp(s) AS eh, exp(-0.12 - 0.28 * abs(s) + 0.08 * (1 - r)) AS ed, exp(-s) AS ea FROM z)
SELECT s_suppkey, round(eh / (eh + ed + ea), 6) AS p_home, round(ed / (eh + ed + ea), 6) AS p_draw, round(ea / (eh + ed + ea), 6) AS p_away,
  round(r / (1 + exp(0.22 - 0.55 * (2.275 - 2.5))) + (1 - r) * 0.52, 6) AS p_over25, round(r / (1 + exp(0.18 - 0.45 * (2.275 - 2.35) + 0.18 * abs(s))) + (1 - r) * 0.5, 6) AS p_btts FROM w
""")
def gold_heuristic(spark, d):
    k = F.col("s_suppkey")
    f = {"home_prior_matches": (k % 12).cast("double"), "away_prior_matches": (k % 9).cast("double"), "goals_for_avg_diff": (k % 7 - 3) / 4.0, "goals_against_avg_diff": (k % 5 - 2) / 3.0, "points_avg_diff": (k % 3 - 1) / 2.0, "rest_days_diff": (k % 40 - 20).cast("double")}
    return read(spark, d, "supplier").select("s_suppkey", *(r6(c).alias(n) for n, c in models.gold_heuristic(f).items()))


@query("""
SELECT s_suppkey, round(greatest(least(1 / (1 + exp(-(ln(0.45 / 0.55) + 0.92 * x + 0.62 * y))), 0.98), 0.02), 6) AS p_prior, round(greatest(least(1 / (1 + exp(-(0.08 + 1.18 * x + 0.78 * y + 0.18 * z))), 0.98), 0.02), 6) AS p_global
FROM (SELECT s_suppkey, (s_suppkey % 11 - 5) / 5.0 AS x, (s_suppkey % 7 - 3) / 3.0 AS y, (s_suppkey % 5 - 2) / 7.0 AS z FROM supplier)
""")
def scorecards(spark, d):
    k = F.col("s_suppkey")
    f = {"rating_diff": (k % 11 - 5) / 5.0, "form_diff": (k % 7 - 3) / 3.0, "rest_diff": (k % 5 - 2) / 7.0}
    score = lambda name, base: models.scorecard(base, models.SCORECARDS[name][1], f, models.SCORECARDS[name][0])
    return read(spark, d, "supplier").select("s_suppkey", r6(score("competition_prior_scorecard", F.lit(0.45))).alias("p_prior"), r6(score("global_scorecard", None)).alias("p_global"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS observed_at FROM events WHERE ts <= TIMESTAMP '2024-06-01' GROUP BY 1
""")
def visible_snapshots(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("observed_at"))
    return snapshots.keep_last(e.where(F.col("observed_at") <= F.lit("2024-06-01").cast("timestamp_ntz")), ["user_id"], ["observed_at", "event_id"])


@query("SELECT event_type, to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2")
def match_clock_windows(spark, d):
    return snapshots.windowed_counts(read(spark, d, "events"), "ts", "event_type").select("event_type", F.col("start"), "n")


@query("""
WITH RECURSIVE m AS MATERIALIZED (SELECT o_orderkey AS match_id, c_mktsegment AS competition, c_nationkey AS h, (c_nationkey + 1 + o_orderkey % 23) % 25 AS a, trunc(o_totalprice % 4) AS x, o_orderkey % 3 AS y,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT DISTINCT competition, 0::BIGINT AS k, NULL::BIGINT AS match_id, list_transform(range(25), lambda i: 1500.0::DOUBLE) AS t, NULL::DOUBLE AS hr, NULL::DOUBLE AS ar, NULL::DOUBLE AS e FROM m
  UNION ALL SELECT competition, k, match_id, list_transform(range(25), lambda i: CASE WHEN i = h THEN hr + 18 * (s - e) WHEN i = a THEN ar - 18 * (s - e) ELSE t[i + 1] END), hr, ar, e
  FROM (SELECT m.*, t, t[h + 1] AS hr, t[a + 1] AS ar, 1 / (1 + 10 ** ((t[a + 1] - t[h + 1]) / 400)) AS e, CASE WHEN x = y THEN 0.5 WHEN x > y THEN 1.0 ELSE 0.0 END AS s FROM r JOIN m ON m.competition = r.competition AND m.k = r.k + 1))
SELECT match_id, competition, round(hr, 6) AS home_rating, round(ar, 6) AS away_rating, round(e, 6) AS expected_home FROM r WHERE k > 0
""")
def elo_ratings(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    side = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    score = (F.col("o_totalprice") % 4).cast("int").cast("double")
    rows = side.select(F.col("o_orderkey").alias("match_id"), F.col("c_mktsegment").alias("competition"), F.lit("domestic").alias("kind"), F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").cast("string").alias("home"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 23) % 25).cast("string").alias("away"), score.alias("home_goals"), (F.col("o_orderkey") % 3).cast("double").alias("away_goals"))
    return ratings.elo(rows).select("match_id", "competition", *(r6(x).alias(x) for x in ("home_rating", "away_rating", "expected_home")))


@query(None)
def fuzzy_aliases(spark, d):
    n = read(spark, d, "nation")
    names = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation "), F.col("c_nationkey")).alias("name"))
    return resolve.resolve(names, n.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("canonical_id")))


@query("""
WITH x AS (SELECT user_id, event_id, value FROM events), m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1), b AS (SELECT max(mean) AS top FROM m)
SELECT event_type AS model, 1::BIGINT AS folds, round(mean, 6) AS mean, round(mean - (SELECT min(mean) FROM m), 6) AS delta, 0.0::DOUBLE AS "range" FROM m
""")
def model_comparison(spark, d):
    folds = read(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("brier"))
    return metrics.compare(folds)


@query("""
WITH a AS (SELECT l_suppkey AS team, count(*) AS matches, sum(l_quantity) AS gf, sum(l_tax) AS ga FROM lineitem GROUP BY 1)
SELECT team, matches, round(gf, 4) AS gf, round(ga, 4) AS ga, round((SELECT greatest(coalesce(avg(l_quantity), 1.25), 0.5) FROM lineitem), 6) AS avg_goals FROM a
""")
def team_strength(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("team"), F.col("l_quantity").alias("gf"), F.col("l_tax").alias("ga"))
    out = aggregates.team_strength(rows)
    return out.select("team", "matches", F.round("gf", 4).alias("gf"), F.round("ga", 4).alias("ga"), r6("avg_goals").alias("avg_goals"))


@query("""
SELECT l_orderkey, l_linenumber, max(l_extendedprice) FILTER (l_returnflag = 'A') AS placed_odds, max(l_extendedprice) FILTER (l_returnflag = 'R') AS closing_odds
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2
""")
def placed_and_closing(spark, d):
    return joins.books(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag", "l_extendedprice", "A", "R")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey")
def leg_combinations(spark, d):
    legs = read(spark, d, "nation").select(F.col("n_nationkey").alias("leg"))
    return joins.combinations(legs, 3).select(*(F.col(f"leg_{k}.leg").alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))))


@query("""
WITH x AS (SELECT 1 / (1 + o_totalprice / 100000) AS implied, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS label, o_orderkey % 3 = 0 AS three FROM orders),
p AS (SELECT *, least(greatest(0.7 * implied + 0.3 / CASE WHEN three THEN 3 ELSE 2 END, 0.01), 0.99) AS p FROM x WHERE label IS NOT NULL)
SELECT count(*) AS scored_rows, round(avg((p - label) ** 2), 6) AS brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM p
""")
def first_model_pass(spark, d):
    from fieldlark.plans import provider

    c = F.col
    rows = read(spark, d, "orders").select(c("o_custkey").cast("string").alias("canonical_event_id"), c("o_orderkey").cast("string").alias("source_ref"), F.when(c("o_orderkey") % 3 == 0, "football_1x2_regulation").otherwise("other").alias("mapped_market_id"), (1 + c("o_totalprice") / 100000).alias("decimal_odds"), F.lit(0).alias("needs_mapping"), c("o_orderstatus"))
    graded = rows.select("canonical_event_id", "source_ref", F.when(c("o_orderstatus") == "F", "win").when(c("o_orderstatus") == "O", "loss").otherwise("push").alias("settlement_result"), F.lit("settled").alias("settlement_status"))
    scored = provider.first_pass(provider.market_snapshots(rows.drop("o_orderstatus"), graded))
    return scored.agg(F.count("*").alias("scored_rows"), r6(F.avg("brier")).alias("brier"), r6(F.avg("log_loss")).alias("log_loss"))


@query("""
WITH x AS (SELECT s_suppkey, 1.3 AS avg, 5.0 AS m, 4.0 + s_suppkey % 9 AS hf, 3.0 + s_suppkey % 7 AS ha, 2.0 + s_suppkey % 11 AS af, 1.0 + s_suppkey % 13 AS aa FROM supplier),
r AS (SELECT s_suppkey, avg, least(greatest(hf / m / avg, 0.35), 3.2) AS hatt, least(greatest(ha / m / avg, 0.35), 3.2) AS hdef, least(greatest(af / m / avg, 0.35), 3.2) AS aatt, least(greatest(aa / m / avg, 0.35), 3.2) AS adef FROM x)
SELECT s_suppkey, round(least(greatest(avg * hatt * sqrt(adef), 0.05), 4.5), 6) AS lambda_home, round(least(greatest(avg * aatt * sqrt(hdef), 0.05), 4.5), 6) AS lambda_away FROM r
""")
def multiplicative_rates(spark, d):
    k = F.col("s_suppkey")
    five = F.lit(5.0)
    out = models.multiplicative_rates(read(spark, d, "supplier"), F.lit(1.3), (five, 4.0 + k % 9, 3.0 + k % 7), (five, 2.0 + k % 11, 1.0 + k % 13))
    return out.select("s_suppkey", r6("lambda_home").alias("lambda_home"), r6("lambda_away").alias("lambda_away"))


@query("""
WITH x AS (SELECT s_suppkey, least(greatest((4 + s_suppkey % 5 + coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 3.0 + s_suppkey % 4 END, 4.9) + 5 + 4.9) / 2, 3), 16) AS corners FROM supplier)
SELECT s_suppkey, round(corners, 6) AS corners, round(1 / (1 + exp(-(corners - 9.5) / 1.8)), 6) AS over_9_5 FROM x
""")
def expected_corners(spark, d):
    k = F.col("s_suppkey")
    corners = models.expected_total((4 + k % 5).cast("double"), F.when(k % 3 > 0, 3.0 + k % 4), F.lit(5.0), F.lit(None).cast("double"), F.lit(9.8), 3.0, 16.0)
    return read(spark, d, "supplier").select("s_suppkey", r6(corners).alias("corners"), r6(models.over_logistic(corners)).alias("over_9_5"))


_ARTIFACT = {"classes": ["H", "D", "A"], "intercept": [0.2, -0.1, 0.0], "features": [{"name": "balance"}, {"name": "nation"}], "weights": [[0.4, 0.0, -0.4], [0.02, 0.01, -0.03]], "calibration": {"shrink_alpha": 0.2, "base_probs": [0.45, 0.25, 0.3]}}


@query("""
WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS b, c_nationkey AS n FROM customer), e AS (SELECT c_custkey, exp(0.2 + 0.4 * b + 0.02 * n) AS h, exp(-0.1 + 0.01 * n) AS d, exp(-0.4 * b - 0.03 * n) AS a FROM x)
SELECT c_custkey, round(0.8 * h / (h + d + a) + 0.09, 6) AS p_home, round(0.8 * d / (h + d + a) + 0.05, 6) AS p_draw, round(0.8 * a / (h + d + a) + 0.06, 6) AS p_away FROM e
""")
def linear_artifact(spark, d):
    f = {"balance": F.col("c_acctbal") / 1000, "nation": F.col("c_nationkey").cast("double")}
    return read(spark, d, "customer").select("c_custkey", *(r6(p).alias(n) for p, n in zip(models.linear_scores(f, _ARTIFACT), ("p_home", "p_draw", "p_away"), strict=True)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def order_preview(spark, d):
    return dedupe.preview(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 12)


@query("""
WITH x AS (SELECT user_id, list(DISTINCT event_type) AS present FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'refund', 'view'], lambda t: NOT list_contains(present, t))), ',') AS missing FROM x
""")
def missing_fields(spark, d):
    required = F.array(*map(F.lit, ("click", "error", "purchase", "refund", "view")))
    present = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    return present.select("user_id", F.array_join(dedupe.missing(required, F.col("present")), ",").alias("missing"))


@query("SELECT l_shipmode AS provider, l_returnflag AS market_key, count(DISTINCT l_orderkey) AS events, count(DISTINCT l_suppkey) AS books, count(*) AS outcomes FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2")
def market_groups(spark, d):
    c = F.col
    rows = read(spark, d, "lineitem").select(c("l_linestatus").alias("provider"), c("l_returnflag").alias("market_key"), c("l_orderkey").alias("event_id"), c("l_suppkey").alias("bookmaker"))
    return resolve.market_groups(rows)


@query("""
SELECT event_type AS source_id, CASE WHEN value > 50 THEN 'ok' ELSE 'partial' END AS status, max(ts) AS last_finished_at, count(*) AS runs FROM events GROUP BY 1, 2
""")
def source_runs(spark, d):
    e = read(spark, d, "events")
    return aggregates.run_summary(e.select(F.col("event_type").alias("source_id"), F.when(F.col("value") > 50, "ok").otherwise("partial").alias("status"), F.col("ts").alias("finished_at")))


@query("""
WITH x AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'pre_event_market' ELSE 'post_event_evaluation' END AS stage, CASE WHEN event_id % 9 = 0 THEN event_type END AS truth, value > 60 AS late, value IS NULL AS open FROM events)
SELECT count(*) FILTER (stage LIKE 'pre%' AND truth IS NOT NULL) AS truth_before_event, count(*) FILTER (stage LIKE 'pre%' AND late) AS cutoff_after_start, count(*) FILTER (stage LIKE 'pre%' AND open) AS no_cutoff FROM x
""")
def leak_guard(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(F.when(k % 3 == 0, "pre_event_market").otherwise("post_event_evaluation").alias("snapshot_stage"), F.when(k % 9 == 0, F.col("event_type")).alias("truth"), F.col("value").alias("cutoff_at"), F.lit(60.0).alias("commence_at"))
    return rules.leaks(rows, ["truth"])


@query("SELECT event_id, event_type FROM events WHERE contains(lower(props), '\"k\": 7')")
def marker_scan(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type", F.replace("props", F.lit('"'), F.lit("'")).alias("props"))
    return rules.secrets(rows, ["'k': 7"]).select("event_id", "event_type")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders
""")
def update_in_place(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return dedupe.update(o, o.where("o_orderkey % 5 = 0").withColumn("o_custkey", F.col("o_custkey") + 1000000), ["o_orderkey"], ["o_custkey"])


@query("""
SELECT o_orderkey, n_name AS raw, coalesce(r_name, n_name) AS resolved FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_nationkey
""")
def fallback_names(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    known = n.join(joins.small(r), n.n_nationkey == r.r_regionkey).select(F.col("n_name").alias("raw_name"), F.col("r_name").alias("canonical"))
    named = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(joins.small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.with_fallback(named.select("o_orderkey", F.col("n_name").alias("raw")), joins.small(known), "raw").select("o_orderkey", "raw", "resolved")


_LEGS = ("football.double_chance:1X", "football.total_goals:under_3.5", "football.1x2:home", "football.total_goals:over_2.5", "football.btts:yes")
_TICKETS = (("Safe Builder", 0.08, (0, 1)), ("Balanced Builder", 0.22, (2, 3)), ("Aggressive Builder", 0.38, (2, 3, 4)))


def _ticket_sql(name: str, risk: float, legs: tuple[int, ...]) -> str:
    p, odds = (" * ".join(f"{x}{i}" for i in legs) for x in "po")
    return f"SELECT l_orderkey, '{name}' AS ticket, {odds} AS odds, least(greatest({p} * (1 - {risk}), 1e-6), 1 - 1e-6) AS adjusted FROM t WHERE {odds} IS NOT NULL"


@query(f"""WITH l AS (SELECT l_orderkey, (l_linenumber - 1) % 5 AS m, l_extendedprice / 1e5 AS p, 1 + l_quantity / 20 AS o FROM lineitem),
t AS (SELECT l_orderkey, {", ".join(f"max(p) FILTER (m = {i}) AS p{i}, arg_max(o, (p, o)) FILTER (m = {i}) AS o{i}" for i in range(5))} FROM l GROUP BY 1), a AS ({" UNION ALL ".join(_ticket_sql(*x) for x in _TICKETS)})
SELECT l_orderkey, ticket, round(odds, 6) AS odds, round(adjusted, 6) AS adjusted, round(adjusted * odds - 1, 6) AS edge FROM a""")
def fixed_tickets(spark, d):
    leg = F.get(F.array(*map(F.lit, _LEGS)), (F.col("l_linenumber") - 1) % 5)
    legs = read(spark, d, "lineitem").select("l_orderkey", F.substring_index(leg, ":", 1).alias("market"), F.substring_index(leg, ":", -1).alias("selection"), (F.col("l_extendedprice") / 1e5).alias("p"), (1 + F.col("l_quantity") / 20).alias("odds"))
    return bets.tickets(legs, "l_orderkey", 0.8).select("l_orderkey", "ticket", r6("odds").alias("odds"), r6("adjusted").alias("adjusted"), r6("edge").alias("edge"))
