"""Validation of imported match data: rules over fixtures, prices, settlements and identities, as frames of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import rules
from fieldlark.operators.lineage import dealt, tasks

RESULTS = ("win", "loss", "push", "void")
#: The checks of a walk-forward sample.
CHECKS = (
    "prediction_time_within_evaluation_window", "feature_observed_at_lte_prediction_time", "label_created_at_gte_settled_at", "label_created_at_gt_prediction_time",
    "settled_at_gt_prediction_time", "market_family_matches_window", "no_random_split", "coverage_gate_checked",
)


def findings(fixtures: DataFrame, odds: DataFrame, settlements: DataFrame, identities: DataFrame) -> DataFrame:
    """(severity, rule, key, detail) of every fault, one row each; none: the pack may be imported.

    fixtures: fixture_id, kickoff, result_status; odds: fixture_id, selection, captured_at, closing, odds;
    settlements: fixture_id, selection, label_time, result; identities: raw_name, canonical_id, confidence, review_status.
    """
    c, text = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    fault = lambda rule, key, detail=F.lit(""): F.struct(F.lit(rule).alias("rule"), key.alias("key"), detail.alias("detail"))
    some = lambda *pairs: F.inline(F.array_compact(F.array(*(F.when(bad, s) for bad, s in pairs))))
    n = tasks(fixtures, odds, settlements)
    kickoffs = dealt(fixtures, ["fixture_id"], n).groupBy("fixture_id").agg(F.max("kickoff").alias("kickoff"), F.count("*").alias("_n"))
    again = kickoffs.where("_n > 1").select(F.explode(F.sequence(F.lit(2), c("_n").cast("int"))), c("fixture_id")).select(F.lit("duplicate_fixture_id").alias("rule"), text("fixture_id").alias("key"), F.lit("").alias("detail"))
    known = kickoffs.select("fixture_id", "kickoff", F.lit(True).alias("_there"))
    orphan = c("_there").isNull()
    o = dealt(odds, ["fixture_id"], n).join(known, "fixture_id", "left").select(
        some(
            (orphan, fault("odds_missing_fixture", text("fixture_id"))),
            (~orphan & c("closing") & (c("captured_at") > c("kickoff")), fault("odds_after_kickoff", text("fixture_id"), text("selection"))),
            (F.coalesce(c("odds").isNull() | F.isnan("odds") | (c("odds") <= 1) | (c("odds") == float("inf")), F.lit(True)), fault("invalid_decimal_odds", text("fixture_id"), text("selection"))),
        )
    )
    s = dealt(settlements, ["fixture_id"], n).join(known, "fixture_id", "left").select(
        some(
            (orphan, fault("settlement_missing_fixture", text("fixture_id"))),
            (~orphan & (c("label_time") < c("kickoff")), fault("label_before_kickoff", text("fixture_id"), text("selection"))),
            (~F.coalesce(c("result").isin(*RESULTS), F.lit(False)), fault("invalid_settlement_result", text("fixture_id"), text("selection"))),
        )
    )
    i = identities.select(
        some(
            ((c("confidence") < 0.80) & (F.coalesce("review_status", F.lit("")) != "needs_review"), fault("low_confidence_identity_without_review", text("raw_name"))),
            ((text("canonical_id") == "") | (text("raw_name") == ""), fault("empty_identity_field", text("raw_name"))),
        )
    )
    errors = again.unionByName(o).unionByName(s).unionByName(i).withColumn("severity", F.lit("error"))
    pending = fixtures.where(F.coalesce(c("result_status"), F.lit("")) != "final").select(F.lit("non_final_fixture").alias("rule"), text("fixture_id").alias("key"), F.lit("").alias("detail"), F.lit("warning").alias("severity"))
    return errors.unionByName(pending)


def report(found: DataFrame) -> DataFrame:
    """(severity, rule, faults) of the rules that were broken."""
    return found.groupBy("severity", "rule").agg(F.count("*").alias("faults"))


def walk_forward_checks(rows: DataFrame, windows: DataFrame, random_split: bool = False, covered: bool = True) -> DataFrame:
    """(check_name, failures) of the eight checks of predictions beside their evaluation windows.

    rows: window_id, prediction_time, feature_observed_at, settled_at, label_created_at, market_family; windows:
    window_id, evaluation_start, evaluation_end, market_family. A row without a window fails the first check alone.
    """
    c = F.col
    held = windows.select("window_id", "evaluation_start", "evaluation_end", c("market_family").alias("_family"), F.lit(True).alias("_there"))
    both = rows.join(held, "window_id", "left")
    there, at = c("_there").isNotNull(), c("prediction_time")
    broken = {
        CHECKS[0]: ~there | (at < c("evaluation_start")) | (at > c("evaluation_end")),
        CHECKS[1]: there & (c("feature_observed_at") > at),
        CHECKS[2]: there & (c("label_created_at") < c("settled_at")),
        CHECKS[3]: there & (c("label_created_at") <= at),
        CHECKS[4]: there & (c("settled_at") <= at),
        CHECKS[5]: there & (c("market_family") != c("_family")),
    }
    counts = both.agg(*(F.count_if(bad).alias(n) for n, bad in broken.items()), F.lit(int(random_split)).cast("long").alias(CHECKS[6]), F.lit(int(not covered)).cast("long").alias(CHECKS[7]))
    return counts.unpivot([], list(CHECKS), "check_name", "failures")


def ready(checks: DataFrame) -> DataFrame:
    """One row: ready_for_evaluation, or blocked and by which checks."""
    blockers = F.sort_array(F.collect_list(F.when(F.col("failures") > 0, F.col("check_name"))))
    return checks.agg(blockers.alias("blockers")).select(F.when(F.size("blockers") == 0, "ready_for_evaluation").otherwise("blocked").alias("status"), F.concat_ws(",", "blockers").alias("blockers"))


def sample_gate(fixtures: DataFrame, odds: DataFrame, settlements: DataFrame, least: tuple[int, int, int] = (2, 4, 4)) -> DataFrame:
    """One row: counts of the sample, how many rows break each rule, and whether it passes.

    odds: fixture_id, price, closing_price, captured_at, settled_at, market_family; settlements: label_created_at, settled_at, outcome.
    """
    c = F.col
    o = odds.agg(F.count("*").alias("odds_rows"), F.countDistinct("market_family").alias("market_families"), F.count_if((c("price") <= 1) | (c("closing_price") <= 1)).alias("price_not_above_one"), F.count_if(c("captured_at") >= c("settled_at")).alias("captured_after_settlement"))
    s = settlements.agg(F.count("*").alias("settlement_rows"), F.count_if(c("label_created_at") < c("settled_at")).alias("label_before_settlement"), F.count_if(~c("outcome").isin(0, 1)).alias("outcome_not_binary"))
    rows = fixtures.agg(F.count("*").alias("fixture_rows")).crossJoin(F.broadcast(o)).crossJoin(F.broadcast(s))  # one row each
    enough = (c("fixture_rows") >= least[0]) & (c("odds_rows") >= least[1]) & (c("settlement_rows") >= least[2])
    clean = c("price_not_above_one") + c("captured_after_settlement") + c("label_before_settlement") + c("outcome_not_binary") == 0
    return rows.withColumn("passed", enough & clean)


def model_gate(candidates: DataFrame, rows: int, teams: int, competitions: int) -> DataFrame:
    """One row: settled rows, distinct teams and competitions against what a real model needs, and label times.

    candidates: home, away, competition, kickoff, label_time.
    """
    c = F.col
    sides = candidates.select(F.explode(F.array("home", "away")).alias("team")).agg(F.countDistinct("team").alias("distinct_teams"))
    found = candidates.agg(F.count("*").alias("settled_rows"), F.countDistinct("competition").alias("competitions"), F.count_if(~F.coalesce(c("label_time") > c("kickoff"), F.lit(False))).alias("label_not_after_kickoff"))
    both = found.crossJoin(F.broadcast(sides))  # one row each
    return both.withColumn("ready", (c("settled_rows") >= rows) & (c("distinct_teams") >= teams) & (c("competitions") >= competitions) & (c("label_not_after_kickoff") == 0))


def context_faults(rows: DataFrame, fixtures: DataFrame, required: list[str], enums: dict[str, tuple[str, ...]], observed: str = "observed_at", captured: str = "captured_at") -> DataFrame:
    """Counts by rule of context rows: a required field that is empty, a value outside its list, no fixture, observed after captured."""
    known = fixtures.select("fixture_id").distinct().withColumn("_there", F.lit(True))
    both = rows.join(known, "fixture_id", "left")
    broken = {f"missing_{f}": F.coalesce(F.col(f).cast("string"), F.lit("")) == "" for f in required}
    broken |= {f"not_allowed_{f}": ~F.coalesce(F.col(f).isin(*allowed), F.lit(False)) for f, allowed in enums.items()}
    broken |= {"orphan_fixture": F.col("_there").isNull(), "observed_after_captured": F.coalesce(F.col(observed) > F.col(captured), F.lit(False))}
    return rules.failure_counts(both, broken)


def readiness(df: DataFrame, least: dict[str, int], true: dict[str, Column]) -> DataFrame:
    """One row: for each column of ``least`` its distinct values and whether they are enough, each condition of ``true`` over all rows, and all of it."""
    found = df.agg(*(F.countDistinct(k).alias(k) for k in least), *(F.coalesce(F.bool_and(v), F.lit(False)).alias(k) for k, v in true.items()))
    fine = F.lit(True)
    for k, n in least.items():
        fine = fine & (F.col(k) >= n)
    for k in true:
        fine = fine & F.col(k)
    return found.withColumn("ready", fine)


def blockers(counts: dict[str, Column], least: dict[str, int]) -> Column:
    """The names of the counts that are below what is needed, comma-separated, in order."""
    return F.concat_ws(",", *(F.when(counts[k] < n, F.lit(f"{k}_below_{n}")) for k, n in least.items()))
