"""Evaluation: picks, losses, calibration, comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.scalars import clamp

CLASSES = ("H", "D", "A")


def pick(p: dict[str, Column], order: tuple[str, ...] = CLASSES) -> Column:
    """The likeliest class; among equals the first in ``order``."""
    out = F.lit(order[-1])
    for i in range(len(order) - 2, -1, -1):
        out = F.when(F.greatest(*(p[c] for c in order[i + 1 :])) <= p[order[i]], order[i]).otherwise(out) if len(order[i + 1 :]) > 1 else F.when(p[order[i + 1]] <= p[order[i]], order[i]).otherwise(out)
    return out


#: Orders in which the reports break ties; fixed values.
TIES = {"inference": ("H", "A", "D"), "linear": ("H", "D", "A"), "baseline": ("H", "D", "A")}


def of_label(p: dict[str, Column], label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for c, x in p.items():
        out = out.when(label == c, x)
    return out


def multiclass(df: DataFrame, p: dict[str, Column], label: Column, keys: list[str], floor: float = 1e-12, ties: tuple[str, ...] = CLASSES, more: tuple[Column, ...] = ()) -> DataFrame:
    """Rows, accuracy, log loss and Brier score (summed over the classes) by ``keys``, and ``more`` aggregates in the same pass."""
    squares = [(x - (label == c).cast("double")) * (x - (label == c).cast("double")) for c, x in p.items()]
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.round(F.avg((pick(p, ties) == label).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(-F.ln(F.greatest(of_label(p, label), F.lit(floor)))), 6).alias("log_loss"), F.round(F.avg(sum(squares[1:], squares[0])), 6).alias("brier"), *more,
    )


def binary(df: DataFrame, p: Column, label: Column, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows, accuracy at a half on the raw probability, Brier score and log loss on the clamped one."""
    q = clamp(p, low, high)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.round(F.avg(((p >= 0.5) == (label == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg((q - label) * (q - label)), 6).alias("brier"),
        F.round(F.avg(-(label * F.ln(q) + (1 - label) * F.ln(1 - q))), 6).alias("log_loss"),
    )


def calibration(df: DataFrame, p: Column, hit: Column, bins: int = 5, empty: str = "zero", interval: bool = False) -> DataFrame:
    """Rows, mean confidence and hit rate by bin of width 1/bins, the last closed. Empty bins: "zero", "null" or "omit"."""
    spark = df.sparkSession
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(at.alias("bin")).agg(F.count("*").alias("rows"), F.avg(p).alias("confidence"), F.avg(hit.cast("double")).alias("accuracy"))
    if empty != "omit":
        every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        fill = (lambda c: F.coalesce(c, F.lit(0.0))) if empty == "zero" else (lambda c: F.col(c))
        found = every.join(found, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"), fill("confidence").alias("confidence"), fill("accuracy").alias("accuracy"))
    if interval:
        half = 1.96 * F.sqrt(F.greatest(F.col("accuracy") * (1 - F.col("accuracy")), F.lit(1e-4)) / F.col("rows"))
        found = found.withColumns({"low": F.greatest(F.col("accuracy") - half, F.lit(0.0)), "high": F.least(F.col("accuracy") + half, F.lit(1.0))})
    return found


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: the mean gap of confidence and hit rate over bins, weighted by rows."""
    gap = F.abs(F.coalesce("confidence", F.lit(0.0)) - F.coalesce("accuracy", F.lit(0.0)))
    return bins.agg(F.round(F.try_divide(F.sum(F.col("rows") * gap), F.sum("rows")), 6).alias("ece"))


def compare(folds: DataFrame, model: str = "model", metric: str = "brier") -> DataFrame:
    """Models by their mean over folds, the best first, with the loss to the best and the spread over folds."""
    each = folds.groupBy(model).agg(F.avg(metric).alias("mean"), F.min(metric).alias("lowest"), F.max(metric).alias("highest"), F.count("*").alias("folds"))
    best = each.agg(F.min("mean").alias("_best"))
    return each.crossJoin(F.broadcast(best)).select(model, "folds", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.col("_best"), 6).alias("delta"), F.round(F.col("highest") - F.col("lowest"), 6).alias("range"))


def domain(value: Column, fine: Column) -> Column:
    """A value where its inputs are in their domain, else null; rows with null go to quarantine."""
    return F.when(fine, value)


def is_probability(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False))


def is_price(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > 1) & (x < float("inf")), F.lit(False))


def checked(predicted: Column, observed: Column, fair: Column, taken: Column, closing: Column) -> dict[str, Column]:
    """Gap, Brier score, difference to the fair share and closing value of a row, each null where its inputs are out of their domain.

    ``observed`` is a hit rate for the gap and an outcome of 0 or 1 for the score.
    """
    one, two = is_probability(predicted), is_probability(observed)
    return {
        "calibration_gap": domain(predicted - observed, one & two), "brier": domain((predicted - observed) * (predicted - observed), one & F.coalesce(observed.isin(0.0, 1.0), F.lit(False))),
        "no_vig_delta": domain(predicted - fair, one & is_probability(fair)), "clv_decimal": domain(taken / closing - 1, is_price(taken) & is_price(closing)),
    }


def status(blocked: Column, sample: Column, trust: Column) -> Column:
    """The trust ladder of a report."""
    return F.when(blocked, "blocked_sample").when(sample, "sample_only").when(trust < 0.5, "paper_only").otherwise("evaluated")
