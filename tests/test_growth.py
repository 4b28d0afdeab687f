"""What keeps the cost of a query from growing faster than its tables."""

import hashlib

from pyspark.sql import functions as F

from fieldlark.operators import bets, bronze_rules, history, hybrid, lineage, models, walkforward
from fieldlark.plans import walks
from fieldlark.sources import hashes


def _plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")


def test_a_hash_is_carried_on_from_its_state():
    text = b"a line\n" * 1000
    h = hashes.Sha256()
    h.update(text[:777])
    h = hashes.Sha256(h.state())
    h.update(text[777:])
    assert h.hexdigest() == hashlib.sha256(text).hexdigest() and len(h.state()) == 112


def test_checks_and_grids_have_no_lambda(spark):
    rows = spark.createDataFrame([("1", "Other", "schema_ok", None, None, None)], "row_id string, row_class string, schema_status string, missing_fields array<string>, review_reason string, values map<string,string>")
    assert "lambda" not in _plan(bronze_rules.validated(rows))
    rates = spark.createDataFrame([(1.2, 0.8)], "h double, a double")
    assert "lambda" not in _plan(models.grid_probabilities(rates, "h", "a"))


def test_few_probabilities_are_broadcast(spark):
    prices = spark.createDataFrame([("A", "F", 2.0)], "market string, selection string, odds double")
    p = spark.createDataFrame([("A", "F", 0.55)], "market string, selection string, p double")
    assert "BroadcastHashJoin" in _plan(bets.value_selections(prices, p, 0.8))


def test_more_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(lineage, "DEALT", 10)
    day = spark.range(95).select(F.lit("c").alias("k"), F.to_date(F.lit("2024-01-01")).alias("day"), F.col("id"), (F.col("id") % 4).alias("home"), (F.col("id") % 4 + 4).alias("away"), F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"))
    assert lineage.tasks(day) == 10
    out = walkforward.form(day, ["k"], "day", ["id"])
    assert ", 20), REPARTITION_BY_NUM" in _plan(out) and out.count() == 95


def test_hybrid_features_deal_rows_and_make_no_unused_grid(spark, monkeypatch):
    assert "EXP(" not in _plan(walks.hybrid_features(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(lineage, "DEALT", 10)
    rows = spark.range(95).select(F.to_date(F.lit("2024-01-01")).alias("day"), F.col("id"), (F.col("id") % 4).alias("home"), (F.col("id") % 4 + 4).alias("away"), F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"))
    whole, plain = hybrid.features(rows, "day", ["id"]), hybrid.features(rows, "day", ["id"], grid=False)
    assert ", 20), REPARTITION_BY_NUM" in _plan(plain)
    assert whole.drop(*hybrid.GRID).columns == plain.columns and sorted(whole.drop(*hybrid.GRID).collect()) == sorted(plain.collect())


def test_filtered_history_carries_columns_of_the_last_counted_row(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, None), ("b", 5, None), (None, 6, 1), (None, 7, 2)], "team string, id long, goals int")
    got = {r.id: (r.games, r.id_last) for r in history.rolling_filtered(rows, ["team"], ["id"], F.col("goals").isNotNull(), ["goals"], 4, ("id",)).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 3), 5: (0, None), 6: (0, None), 7: (1, 6)}
