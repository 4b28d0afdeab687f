"""Queries of files that Spark writes from the driver's tables and reads again, of bronze checks, of reports, and of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlark.functions import odds as O
from fieldlark.functions import scalars as S
from fieldlark.functions import settle
from fieldlark.operators import bronze_rules, metrics, reports, resolve
from fieldlark.operators.lineage import scratch
from fieldlark.plans.queries import query, r6, read
from fieldlark.sources import exports, intake, lines
from fieldlark.streaming import cursors

c = F.col


@query("""SELECT 'orders' AS name, count(*) AS rows, sha256(string_agg('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || CASE WHEN o_custkey % 7 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' || chr(10), '' ORDER BY o_orderpriority, o_orderkey)) AS sha256 FROM orders""")
def exported_lines(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(c("o_custkey") % 7 > 0, c("o_orderpriority")).alias("o_orderpriority"), c("o_orderpriority").alias("_p"))
    ordered = rows.select("o_custkey", "o_orderkey", "o_orderpriority", F.struct("_p", "o_orderkey").alias("_at"))
    path = scratch(spark)
    parts = 1 + rows.count() // exports.PART
    made = ordered.repartitionByRange(parts, "_at").sortWithinPartitions("_at").select(F.to_json(F.struct("o_custkey", "o_orderkey", "o_orderpriority"), {"ignoreNullFields": "false"}).alias("value"))
    made.write.option("compression", "gzip").text(f"{path}/orders")
    rows_, sha = lines.digest(spark, exports.data_files(spark, f"{path}/orders"))
    return spark.createDataFrame([("orders", rows_, sha)], "name string, rows long, sha256 string")


@query("SELECT c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS line, c_custkey, sha256(c_custkey || '|' || c_name) AS sha256 FROM customer")
def numbered_lines(spark, d):
    """One file a segment, read in splits of its bytes."""
    path = scratch(spark)
    text = read(spark, d, "customer").select("c_mktsegment", "c_custkey", F.concat_ws("|", "c_custkey", "c_name").alias("value"))
    text.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path)
    rows = lines.raw_lines(spark, f"{path}/*")
    return rows.select(F.replace(F.regexp_extract("file", "c_mktsegment=([^/]*)/", 1), F.lit("%20"), F.lit(" ")).alias("segment"), "line", F.split("value", r"\|")[0].cast("long").alias("c_custkey"), "sha256")


@query("SELECT 'fixtures' AS name, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'odds', count(*), sum(l_orderkey)::BIGINT FROM lineitem")
def committed_snapshot(spark, d):
    path = scratch(spark)
    tables = {"fixtures": read(spark, d, "orders").select(c("o_orderkey").alias("fixture_id")), "odds": read(spark, d, "lineitem").select(c("l_orderkey").alias("fixture_id"), "l_quantity")}
    exports.commit(tables, path, "first", "2024-01-01T00:00:00Z")
    one = lambda name, df: df.agg(F.count("*").alias("rows"), F.sum("fixture_id").alias("keys")).select(F.lit(name).alias("name"), "rows", "keys")
    loaded = exports.load(spark, path)
    return one("fixtures", loaded["fixtures"]).unionByName(one("odds", loaded["odds"]))


@query("SELECT 'csv_match_rows' AS shape, count(*) AS row_count, 0::BIGINT AS bad_rows FROM supplier UNION ALL SELECT 'json_lines', count(*), (SELECT count(*) FROM nation) FROM customer")
def intake_by_shape(spark, d):
    path = scratch(spark)
    read(spark, d, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(f"{path}/a")
    good = read(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    bad = read(spark, d, "nation").select(F.concat(F.lit("not json "), "n_name").alias("value"))
    good.unionByName(bad).write.text(f"{path}/b")
    target, fs = exports._fs(spark, f"{path}/b")
    for f in fs.listStatus(target):  # Spark's text files are named .txt
        if f.getPath().getName().endswith(".txt"):
            fs.rename(f.getPath(), exports._fs(spark, f"{path}/b/{f.getPath().getName()[:-4]}.jsonl")[0])
    return intake.scan(spark, path).groupBy("shape").agg(F.sum("row_count").alias("row_count"), F.sum("bad_rows").alias("bad_rows"))


@query("SELECT event_type AS source_id, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS cursor, count(*) AS rows FROM events GROUP BY 1")
def ingest_cursors(spark, d):
    """The events read as a stream, one source a type, and how far each has come."""
    path = scratch(spark)
    read(spark, d, "events").select("event_id", c("event_type").alias("source_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("cursor")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_id long, source_id string, cursor string").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    cursors.ingest(stream, f"{path}/out", f"{path}/cursors", f"{path}/checkpoint").awaitTermination()
    return cursors.latest(spark, f"{path}/cursors").select("source_id", "cursor", "rows")


_BRONZE = """x AS (SELECT l_orderkey || '-' || l_linenumber AS row_id, CASE l_suppkey % 4 WHEN 0 THEN 'fixture_result' WHEN 1 THEN 'odds_snapshot' WHEN 2 THEN 'lineup_event_context' ELSE 'Other' END AS k, l_partkey % 19 = 0 AS none,
  CASE WHEN l_orderkey % 5 > 0 THEN 'f' END AS fixture_id, CASE WHEN l_orderkey % 7 > 0 THEN 'p' ELSE ' ' END AS provider_id, CASE l_linenumber WHEN 1 THEN '1.0' WHEN 2 THEN 'x' WHEN 3 THEN '1e3' ELSE '2.50' END AS price,
  CASE WHEN l_partkey % 3 > 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-01' END AS time, CASE WHEN l_suppkey % 11 = 0 THEN 'partial' ELSE 'schema_ok' END AS status FROM lineitem),
r AS (SELECT row_id, k, list_sort(list_filter([
  CASE WHEN status <> 'schema_ok' THEN 'schema_not_ok' END, CASE WHEN status <> 'schema_ok' THEN 'missing_fields:a,b' END, CASE WHEN status <> 'schema_ok' THEN 'schema_review:to_be_seen' END, CASE WHEN none THEN 'missing_value_payload' END,
  CASE WHEN NOT none AND k = 'Other' THEN 'unsupported_row_class:Other' END, CASE WHEN NOT none AND k <> 'Other' AND fixture_id IS NULL THEN 'empty_or_missing:fixture_id' END,
  CASE WHEN NOT none AND k IN ('odds_snapshot', 'lineup_event_context') AND provider_id = ' ' THEN 'empty_or_missing:provider_id' END, CASE WHEN NOT none AND k = 'odds_snapshot' AND price <> '2.50' THEN 'invalid_decimal_price:price_decimal' END,
  CASE WHEN NOT none AND k = 'fixture_result' AND time = '2024-01-01' THEN 'invalid_timestamp_shape:kickoff_utc' WHEN NOT none AND k = 'odds_snapshot' AND time = '2024-01-01' THEN 'invalid_timestamp_shape:snapshot_utc'
    WHEN NOT none AND k = 'lineup_event_context' AND time = '2024-01-01' THEN 'invalid_timestamp_shape:observed_at_utc' END], lambda v: v IS NOT NULL)) AS why FROM x)"""


def _bronze(spark, d):
    order, line, part, supp = c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    kind = F.when(supp % 4 == 0, "fixture_result").when(supp % 4 == 1, "odds_snapshot").when(supp % 4 == 2, "lineup_event_context").otherwise("Other")
    time = F.when(part % 3 > 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01")
    price = F.when(line == 1, "1.0").when(line == 2, "x").when(line == 3, "1e3").otherwise("2.50")
    said = {"fixture_id": F.when(order % 5 > 0, "f"), "provider_id": F.when(order % 7 > 0, "p").otherwise(" "), "price_decimal": price, "kickoff_utc": time, "snapshot_utc": time, "observed_at_utc": time}
    said |= {f: F.lit("y") for f in ("home_team", "away_team", "result_status", "bookmaker_id", "market_key", "selection_key", "entity_id", "event_type")}
    values = F.when(part % 19 > 0, F.create_map(*(x for k, v in said.items() for x in (F.lit(k), v))))
    broken = supp % 11 == 0
    rows = read(spark, d, "lineitem").select(
        F.concat_ws("-", order, line).alias("row_id"), kind.alias("row_class"), F.when(broken, "partial").otherwise("schema_ok").alias("schema_status"), F.when(broken, F.array(F.lit("a"), F.lit("b"))).alias("missing_fields"),
        F.when(broken, " To be: seen!").alias("review_reason"), values.alias("values"),
    )
    return bronze_rules.validated(rows)


@query(f"WITH {_BRONZE} SELECT row_id, k AS row_class, CASE WHEN len(why) = 0 THEN 'value_ok' ELSE 'review_required' END AS value_status, array_to_string(why, ';') AS reasons FROM r")
def bronze_values(spark, d):
    return _bronze(spark, d).select("row_id", "row_class", "value_status", F.array_join("review_reasons", ";").alias("reasons"))


@query(f"WITH {_BRONZE} SELECT unnest(why) AS reason, count(*) AS rows FROM r GROUP BY 1")
def bronze_reasons(spark, d):
    return bronze_rules.reason_counts(_bronze(spark, d))


@query(f"""WITH {_BRONZE}, n AS (SELECT unnest(why) AS reason, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS total_rows, count(*) FILTER (len(why) = 0) AS value_ok_rows, count(*) FILTER (len(why) > 0) AS blocked_rows,
  'review_required_rows:' || count(*) FILTER (len(why) > 0) || ';' || (SELECT string_agg(reason || ':' || n, ';' ORDER BY reason || ':' || n) FROM n) AS blockers FROM r""")
def bronze_readiness(spark, d):
    return bronze_rules.readiness(_bronze(spark, d)).select("total_rows", "value_ok_rows", "blocked_rows", F.array_join("blockers", ";").alias("blockers"))


@query("""SELECT (SELECT count(*) FROM customer) AS players_total, count(*) AS lineup_rows, count(DISTINCT l_orderkey) FILTER (l_partkey % 3 > 0) AS matches_with_lineups, round(count(DISTINCT l_orderkey) FILTER (l_partkey % 3 > 0) / (SELECT count(*) FROM orders), 6) AS lineup_match_coverage,
  count(*) FILTER (l_linenumber <= 2) AS starter_rows, count(*) FILTER (l_returnflag <> 'A') AS minutes_known_rows FROM lineitem""")
def player_coverage(spark, d):
    lines_ = read(spark, d, "lineitem").select(F.when(c("l_partkey") % 3 > 0, c("l_orderkey")).alias("match_id"), (c("l_linenumber") <= 2).cast("int").alias("started"), F.when(c("l_returnflag") != "A", c("l_quantity")).alias("minutes_played"))
    return reports.player_coverage(read(spark, d, "orders"), read(spark, d, "customer"), lines_)


@query("""WITH x AS (SELECT l_orderkey AS k, CASE l_suppkey % 5 WHEN 0 THEN 'Pinnacle/PS' WHEN 1 THEN 'My CLOSING book' WHEN 2 THEN 'pinnacle' WHEN 3 THEN 'other' END AS b FROM lineitem WHERE l_partkey % 4 > 0)
SELECT count(*) AS odds_rows, count(DISTINCT k) AS matches_with_odds, count(*) FILTER (b <> 'other') AS closing_odds_rows, count(DISTINCT k) FILTER (b <> 'other') AS matches_with_closing_odds, round(count(DISTINCT k) / (SELECT count(*) FROM orders), 6) AS odds_match_coverage,
  round(count(DISTINCT k) FILTER (b <> 'other') / (SELECT count(*) FROM orders), 6) AS closing_odds_match_coverage FROM x""")
def odds_coverage(spark, d):
    m = c("l_suppkey") % 5
    book = F.when(m == 0, "Pinnacle/PS").when(m == 1, "My CLOSING book").when(m == 2, "pinnacle").when(m == 3, "other")
    return reports.odds_coverage(read(spark, d, "orders"), read(spark, d, "lineitem").where("l_partkey % 4 > 0").select(c("l_orderkey").alias("match_id"), book.alias("bookmaker")))


@query("SELECT l_linenumber AS provider, l_returnflag AS bookmaker, count(*) FILTER (l_suppkey % 3 = 0) AS mapped, count(*) FILTER (l_suppkey % 3 > 0) AS unknown FROM lineitem GROUP BY 1, 2")
def mapped_outcomes(spark, d):
    m = c("l_suppkey") % 3
    rows = read(spark, d, "lineitem").select(c("l_linenumber").alias("provider"), c("l_returnflag").alias("bookmaker"), F.when(m == 0, "id").when(m == 1, "").alias("canonical_id"))
    return reports.mapped_by(rows, ["provider", "bookmaker"], "canonical_id")


@query("""SELECT l_linenumber AS market, l_linestatus AS status, CASE l_returnflag WHEN 'A' THEN 'win' WHEN 'N' THEN 'loss' ELSE 'push' END AS result, count(*) AS rows, round(sum(CASE l_returnflag WHEN 'A' THEN l_quantity / 10 WHEN 'N' THEN -1 ELSE 0 END), 6) AS units FROM lineitem GROUP BY ALL""")
def settlement_counts(spark, d):
    result = F.when(c("l_returnflag") == "A", "win").when(c("l_returnflag") == "N", "loss").otherwise("push")
    units = F.when(result == "win", c("l_quantity") / 10).when(result == "loss", -1.0).otherwise(0.0)
    return reports.settlement_counts(read(spark, d, "lineitem").select(c("l_linenumber").alias("market"), c("l_linestatus").alias("status"), result.alias("result"), units.alias("unit_result")))


@query("""WITH x AS (SELECT l_quantity AS stake, CASE WHEN l_returnflag = 'A' THEN 'win' WHEN l_returnflag = 'N' AND l_linenumber > 1 THEN 'loss' WHEN l_returnflag = 'R' THEN 'push' END AS result, 1 + l_partkey % 5 AS odds, CASE WHEN l_suppkey % 2 = 0 THEN l_tax - 0.04 END AS clv FROM lineitem),
y AS (SELECT *, CASE result WHEN 'win' THEN stake * (odds - 1) WHEN 'loss' THEN -stake WHEN 'push' THEN 0 END AS profit FROM x)
SELECT count(*) AS bets, count(result) AS settled, count(*) FILTER (result = 'win') AS won, count(*) FILTER (result = 'loss') AS lost, count(*) FILTER (result IS NULL) AS open, round(sum(stake), 6) AS stake, round(sum(profit), 6) AS profit,
  round(sum(profit) FILTER (result IS NOT NULL) / sum(stake) FILTER (result IS NOT NULL), 6) AS roi, round(avg(clv), 6) AS mean_clv FROM y""")
def ledger_summary(spark, d):
    flag, stake = c("l_returnflag"), c("l_quantity")
    result = F.when(flag == "A", "win").when((flag == "N") & (c("l_linenumber") > 1), "loss").when(flag == "R", "push")
    profit = F.when(result == "win", stake * (c("l_partkey") % 5)).when(result == "loss", -stake).when(result == "push", 0.0)
    rows = read(spark, d, "lineitem").select(stake.alias("stake"), result.alias("result"), profit.alias("profit"), F.when(c("l_suppkey") % 2 == 0, c("l_tax") - 0.04).alias("clv"))
    return reports.ledger_summary(rows)


@query("""WITH x AS (SELECT event_type AS entity_type, (user_id % 5)::VARCHAR AS raw_value, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'id' END AS canonical_id, CASE WHEN event_id % 3 = 0 THEN 0.99 WHEN event_id % 3 = 1 THEN 0.9 END::DOUBLE AS confidence,
  CASE WHEN event_id % 5 > 1 THEN true WHEN event_id % 5 = 1 THEN false END AS auto, ts FROM events)
SELECT entity_type, raw_value, canonical_id, confidence, count(*) AS candidates, min(ts) AS first_seen, max(ts) AS last_seen FROM x WHERE NOT coalesce(auto, false) OR confidence < 0.95 OR coalesce(canonical_id, '') = '' GROUP BY ALL""")
def resolver_review_queue(spark, d):
    e, none = c("event_id"), F.lit(None).cast("string")
    rows = read(spark, d, "events").select(
        c("event_type").alias("entity_type"), (c("user_id") % 5).cast("string").alias("raw_value"), none.alias("normalized_raw_value"), F.lit("p").alias("provider_id"), none.alias("context"), F.when(e % 4 == 1, "").when(e % 4 > 1, "id").alias("canonical_id"),
        none.alias("display_name"), F.lit("fuzzy_alias").alias("strategy"), F.when(e % 3 == 0, 0.99).when(e % 3 == 1, 0.9).alias("confidence"), F.lit("review").alias("reason"), F.when(e % 5 > 1, True).when(e % 5 == 1, False).alias("auto"), c("ts").alias("created_at"),
    )
    return reports.review_queue(rows).select("entity_type", "raw_value", "canonical_id", "confidence", "candidates", "first_seen", "last_seen")


@query("""SELECT * FROM (SELECT 'market_without_field' AS fault, count(*) FILTER (s_suppkey % 4 = 0) AS rows FROM supplier UNION ALL SELECT 'alias_needs_review', count(*) FILTER (c_custkey % 6 = 0) FROM customer
UNION ALL SELECT 'alias_of_another_market', count(*) FILTER (c_mktsegment <> 'BUILDING') FROM customer UNION ALL SELECT 'automatic_use_allowed', 1) WHERE rows > 0""")
def patch_faults(spark, d):
    k = c("s_suppkey")
    markets = read(spark, d, "supplier").select(k.cast("string").alias("canonical_market_id"), F.when(k % 4 > 0, "core").otherwise(" ").alias("family"), *(F.lit("x").alias(f) for f in resolve.MARKET_FIELDS[2:]))
    aliases = read(spark, d, "customer").select(c("c_mktsegment").alias("provider_market_key"), (c("c_custkey") % 6 == 0).alias("review_required"))
    return resolve.patch_faults({"scope": "offline_sample_only", "production_use_allowed": True}, markets, aliases, ["BUILDING"])


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 4 END AS h, (o_custkey // 4) % 4 AS a, CASE o_orderkey % 5 WHEN 0 THEN ' 3.7 ' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'x1' ELSE '-2' END AS t, CASE o_orderkey % 4 WHEN 0 THEN ' Finished' WHEN 1 THEN '' WHEN 2 THEN 'live' END AS s, (o_orderkey % 11) / 10.0 AS trust, o_orderkey % 130 AS m FROM orders)
SELECT o_orderkey, CASE WHEN h > a THEN 'H' WHEN h = a THEN 'D' WHEN h < a THEN 'A' END AS outcome, CASE WHEN h > a THEN 3 WHEN h = a THEN 1 WHEN h < a THEN 0 END AS points, CASE WHEN h + a > 2.5 THEN 1 WHEN h IS NOT NULL THEN 0 END AS over25, CASE WHEN h > 0 AND a > 0 THEN 1 END AS btts_gold,
  CASE t WHEN ' 3.7 ' THEN 3.7 WHEN '-2' THEN -2.0 END::DOUBLE AS number, CASE t WHEN ' 3.7 ' THEN 3 WHEN '-2' THEN -2 END::BIGINT AS whole, CASE WHEN trim(t) <> '' THEN trim(t) ELSE 'none' END AS filled, coalesce(s, '') <> 'live' AS final,
  CASE WHEN m <= 45 THEN '1' WHEN m <= 90 THEN '2' WHEN m <= 105 THEN '3' WHEN m <= 120 THEN '4' ELSE '5' END AS period, CASE WHEN trust >= 0.65 THEN 'high' WHEN trust >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def row_scalars(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    h, a = F.when(k % 6 > 0, cust % 4), F.floor(cust / 4) % 4
    t = F.when(k % 5 == 0, " 3.7 ").when(k % 5 == 1, "nan").when(k % 5 == 2, "").when(k % 5 == 3, "x1").otherwise("-2")
    s = F.when(k % 4 == 0, " Finished").when(k % 4 == 1, "").when(k % 4 == 2, "live")
    return read(spark, d, "orders").select(
        "o_orderkey", S.outcome(h, a).alias("outcome"), S.points(h, a).alias("points"), S.over_target(h, a).alias("over25"), S.btts_target(h, a, None).alias("btts_gold"), S.number(t).alias("number"), S.whole(t).alias("whole"), S.first_filled(t, F.lit("none")).alias("filled"),
        S.is_final(s).alias("final"), S.period_of_minute(k % 130).alias("period"), S.confidence_label((k % 11) / 10.0).alias("confidence"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS w, CASE l_partkey % 2 WHEN 0 THEN 'home' ELSE 'away' END AS s, CASE l_partkey % 3 WHEN 0 THEN 'home_or_draw' WHEN 1 THEN 'away_or_draw' ELSE 'home_or_away' END AS dc FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s = w THEN 'win' ELSE 'loss' END AS result, CASE WHEN w = 'draw' THEN 'push' WHEN s = w THEN 'win' ELSE 'loss' END AS no_draw, CASE WHEN contains(dc, w) THEN 'win' ELSE 'loss' END AS double_chance FROM x""")
def settle_results(spark, d):
    m, p = c("l_suppkey") % 3, c("l_partkey")
    w, s = F.when(m == 0, "home").when(m == 1, "draw").otherwise("away"), F.when(p % 2 == 0, "home").otherwise("away")
    dc = F.when(p % 3 == 0, "home_or_draw").when(p % 3 == 1, "away_or_draw").otherwise("home_or_away")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", settle.result(s, w).alias("result"), settle.draw_no_bet(s, w).alias("no_draw"), settle.double_chance(dc, w).alias("double_chance"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 5 + 0.3 AS p, CASE WHEN l_linenumber = 4 THEN 1.0 ELSE 1 + l_quantity / 20 END AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o > 1 THEN round(greatest((p * o - 1) / (o - 1), 0), 6) END AS uncapped, CASE WHEN o > 1 THEN round(1 / o, 6) END AS implied, round(1 / least(greatest(p, 1e-6), 1 - 1e-6), 6) AS fair, CASE WHEN o > 1 THEN round(p * o - 1, 6) END AS ev FROM x""")
def price_values(spark, d):
    p, o = c("l_discount") * 5 + 0.3, F.when(c("l_linenumber") == 4, 1.0).otherwise(1 + c("l_quantity") / 20)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(O.kelly(p, o, cap=None)).alias("uncapped"), r6(O.implied(o)).alias("implied"), r6(O.fair_odds(p)).alias("fair"), r6(O.expected_value(p, o)).alias("ev"))


@query("""WITH x AS (SELECT 1 / (1 + exp(-(o_totalprice - 150000) / 60000)) AS p, (o_orderstatus = 'F')::INT AS y FROM orders), b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS rows, avg(p) AS confidence, avg(y) AS accuracy FROM x GROUP BY 1)
SELECT bin, rows, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(greatest(accuracy - 1.96 * sqrt(greatest(accuracy * (1 - accuracy), 1e-4) / rows), 0), 6) AS low, round(least(accuracy + 1.96 * sqrt(greatest(accuracy * (1 - accuracy), 1e-4) / rows), 1), 6) AS high FROM b""")
def calibration_intervals(spark, d):
    rows = read(spark, d, "orders").select((1 / (1 + F.exp(-(c("o_totalprice") - 150000) / 60000))).alias("p"), (c("o_orderstatus") == "F").cast("int").alias("y"))
    out = metrics.calibration(rows, c("p"), c("y") == 1, 10, "omit", True)
    return out.select("bin", "rows", *(r6(x).alias(x) for x in ("confidence", "accuracy", "low", "high")))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'blocked_sample' WHEN o_custkey % 5 = 1 THEN 'sample_only' WHEN (o_orderkey % 10) / 10.0 < 0.5 THEN 'paper_only' ELSE 'evaluated' END AS status FROM orders""")
def report_status(spark, d):
    k = c("o_custkey") % 5
    return read(spark, d, "orders").select("o_orderkey", metrics.status(k == 0, k == 1, (c("o_orderkey") % 10) / 10.0).alias("status"))
