"""Joins of the match, price and settlement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.dedupe import keep_last

#: Rows of a dimension that are broadcast at most; beyond, Spark shuffles.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; counting stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_wins(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Join to the last row of each key of ``right``."""
    return left.join(keep_last(right, keys, order), keys, how)


def with_fallback(df: DataFrame, names: DataFrame, on: str, canonical: str = "canonical", name: str = "resolved") -> DataFrame:
    """Left join by a raw name; the canonical name, else the raw one."""
    known = names.select(F.col("raw_name").alias(on), F.col(canonical).alias("_canonical"))
    return df.join(known, on, "left").withColumn(name, F.coalesce("_canonical", on)).drop("_canonical")


def orphans(df: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no parent has."""
    return df.join(parents.select(*keys).distinct(), keys, "left_anti")


def by_priority(df: DataFrame, aliases: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """``value`` by the exact keys, else by the looser ones, with ``matched_by``."""
    a = aliases.groupBy(*exact).agg(F.min(value).alias("_a"))
    b = aliases.groupBy(*loose).agg(F.min(value).alias("_b"))
    out = df.join(a, exact, "left").join(b, loose, "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).withColumn("matched_by", F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "name")).drop("_a", "_b")


def only_match(df: DataFrame, aliases: DataFrame, on: str, value: str, confidence: float = 0.95) -> DataFrame:
    """``value`` of the alias on ``on``, if exactly one alias of enough confidence has it, else null."""
    found = aliases.where(F.col("confidence") >= confidence).groupBy(on).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return df.join(found, on, "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], order: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key at or before its time.

    Both sides are stacked and one window carries the last right row forward; right rows come first at equal
    times, and ``order`` breaks ties among them. No pair of rows is formed.
    """
    names = left.columns
    stamp = F.struct(F.col(right_time).alias("t"), *(F.col(v).alias(v) for v in values))
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*order).alias("_order"), stamp.alias("_right"))
    own = F.struct(*names)
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), own.alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    frame = Window.partitionBy(*keys).orderBy("_t", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_right", ignorenulls=True).over(frame)).where("_side = 1")
    return carried.select("_left.*", F.col("_last.t").alias(right_time), *(F.col(f"_last.{v}").alias(v) for v in values))


def books(odds: DataFrame, keys: list[str], selection: str, book: str, price: str, placed: str, closing: str) -> DataFrame:
    """The placed and the closing book's price of each selection, in one row."""
    at = lambda b: F.max(F.when(F.col(book) == b, F.col(price)))
    return odds.where(F.col(book).isin(placed, closing)).groupBy(*keys, selection).agg(at(placed).alias("placed_odds"), at(closing).alias("closing_odds"))


def stacked(**parts: DataFrame) -> DataFrame:
    """Frames one under another, each tagged by its name in ``stage``."""
    out = None
    for stage, df in parts.items():
        tagged = df.withColumn("stage", F.lit(stage))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def combinations(legs: DataFrame, n: int, index: str = "leg", most: int = 200) -> DataFrame:
    """Each set of ``n`` legs of a fixed small list once, as leg_1 .. leg_n structs in order of ``index``; refuses more than ``most`` legs."""
    if legs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} legs to combine")
    rows = legs.select(F.struct(*legs.columns).alias("leg_1"))
    for k in range(2, n + 1):
        other = F.broadcast(legs.select(F.struct(*legs.columns).alias(f"leg_{k}")))
        rows = rows.join(other, F.col(f"leg_{k - 1}.{index}") < F.col(f"leg_{k}.{index}"))
    return rows


def leakage_flag(label_time: Column, captured: Column) -> Column:
    return label_time >= captured
