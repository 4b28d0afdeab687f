"""Validation: rules as data, first and all reasons, gates, contracts, leak checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def first_reason(rules: Rules) -> Column:
    """The name of the first rule that a row breaks (its condition holds), null if none."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))


def reasons(rules: Rules) -> Column:
    """All rules that a row breaks, sorted, each once."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))))


def failures(df: DataFrame, rules: Rules, key: str) -> DataFrame:
    """One row for each rule a row breaks."""
    return df.select(key, F.explode(reasons(rules)).alias("reason"))


def failure_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """(check, failures) of every rule, those never broken too; one pass."""
    counts = df.agg(*(F.count_if(bad).alias(name) for name, bad in rules.items()))
    return counts.unpivot([], list(rules), "check_name", "failures")


def gate(df: DataFrame, rules: Rules, key: str, least: int) -> DataFrame:
    """One row: accepted rows, rejected ones by first reason, and whether enough distinct keys were accepted."""
    checked = df.withColumn("_reason", first_reason(rules))
    return checked.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_reason").isNull()).alias("accepted"), *(F.count_if(F.col("_reason") == name).alias(name) for name in rules),
        (F.countDistinct(F.when(F.col("_reason").isNull(), F.col(key))) >= least).alias("passed"),
    )


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows that break nothing, rows that do with their reasons)."""
    checked = df.withColumn("reasons", reasons(rules))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def price_rules(odds: Column, captured: Column, kickoff: Column, label: Column) -> dict[str, Column]:
    return {
        "missing_price": odds.isNull(),
        "price_not_above_one": F.isnan(odds) | (odds <= 1),
        "captured_after_kickoff": captured > kickoff,
        "label_before_kickoff": label < kickoff,
    }


def window_rules(row: dict[str, Column]) -> dict[str, Column]:
    """Walk-forward checks of a prediction beside its window (left-joined)."""
    return {
        "window_missing": row["window_id"].isNull(),
        "prediction_outside_window": (row["prediction_time"] < row["evaluation_start"]) | (row["prediction_time"] > row["evaluation_end"]),
        "feature_after_prediction": row["feature_observed_at"] > row["prediction_time"],
        "label_before_settlement": row["label_created_at"] < row["settled_at"],
        "settled_before_prediction": row["settled_at"] <= row["prediction_time"],
    }


def leaks(df: DataFrame, truth: list[str], stage: str = "snapshot_stage", cutoff: str = "cutoff_at", start: str = "commence_at") -> DataFrame:
    """Counts of leak kinds among snapshots; all 0 in a clean table."""
    pre = F.col(stage).startswith("pre_event")
    known = F.greatest(*(F.col(c).isNotNull().cast("int") for c in truth), F.lit(0)) == 1
    return df.agg(F.count_if(pre & known).alias("truth_before_event"), F.count_if(pre & (F.col(cutoff) > F.col(start))).alias("cutoff_after_start"), F.count_if(pre & F.col(cutoff).isNull()).alias("no_cutoff"))


def masked(df: DataFrame, truth: list[str], allowed: Column) -> DataFrame:
    """Truth columns nulled unless the row's stage allows them."""
    return df.withColumns({c: F.when(allowed, F.col(c)) for c in truth})


def secrets(df: DataFrame, markers: list[str]) -> DataFrame:
    """Rows whose serialised form holds a marker."""
    text = F.lower(F.to_json(F.struct(*df.columns)))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m.lower()))
    return df.where(hit)


def contract(document: dict, items: dict[str, list[str]] = {}, true: list[str] = (), false: list[str] = (), least: dict[str, float] = {}) -> list[str]:  # noqa: B006
    """What a JSON contract breaks: required array items, flags, minimums."""
    out = [f"{k}: missing {x}" for k, need in items.items() for x in need if x not in (document.get(k) or [])]
    out += [f"{k}: not true" for k in true if document.get(k) is not True]
    out += [f"{k}: not false" for k in false if document.get(k) is not False]
    return out + [f"{k}: below {n}" for k, n in least.items() if not isinstance(document.get(k), int | float) or document[k] < n]


def retention(verified: Column, age_days: Column, referenced: Column) -> Column:
    """What becomes of a stored bundle."""
    return F.when(~verified, "keep_for_repair").when(referenced, "keep_referenced").when(age_days < 30, "keep_recent").when(age_days < 365, "archive").otherwise("delete_candidate")


def missing_tables(spark, expected: list[str]) -> list[str]:
    there = {t.name for t in spark.catalog.listTables()}
    return sorted(set(expected) - there)
