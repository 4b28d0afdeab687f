"""Leakage-safe history: team-long rows, rolling and expanding features, priors, splits and folds.

"History" is what precedes a row in the sort order of its key, never the row itself. Orders must be total (end
in an id), so that frames do not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def team_long(matches: DataFrame, home: list[Column], away: list[Column], names: list[str], keep: list[str]) -> DataFrame:
    """Two rows a match: ``home`` and ``away`` hold the columns ``names`` from each side's view; ``side`` tells which."""
    view = lambda side, columns: F.struct(F.lit(side).alias("side"), *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    return matches.select(*keep, F.inline(F.array(view("home", home), view("away", away))))


def before(keys: list[str], order: list[str], n: int | None = None):
    """The frame of the last ``n`` rows before each row, or of all of them."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n if n else Window.unboundedPreceding, -1)


def rolling(df: DataFrame, keys: list[str], order: list[str], values: list[str], n: int = 10, date: str | None = None) -> DataFrame:
    """Means of ``values`` over the last ``n`` rows (nulls left out), ``games`` in it, and ``rest_days`` since the last ``date``."""
    frame = before(keys, order, n)
    made = {f"{v}_avg": F.avg(v).over(frame) for v in values} | {"games": F.count(F.lit(1)).over(frame)}
    if date:
        made["rest_days"] = F.datediff(date, F.lag(date).over(Window.partitionBy(*keys).orderBy(*order)))
    return df.withColumns(made)


def rolling_strict(df: DataFrame, keys: list[str], day: Column, values: list[str], days: int) -> DataFrame:
    """Means over rows of earlier days alone, back to ``days`` before: rows of one day do not see each other."""
    number = F.datediff(day, F.lit("1970-01-01"))
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-days, -1)
    return df.withColumn("_day", number).withColumns({f"{v}_avg": F.avg(v).over(frame) for v in values} | {"games": F.count(F.lit(1)).over(frame)}).drop("_day")


def rolling_filtered(df: DataFrame, keys: list[str], order: list[str], counted: Column, values: list[str], n: int = 10, carried: tuple[str, ...] = ()) -> DataFrame:
    """As ``rolling``, but only rows where ``counted`` holds enter the history; all rows get features, and as ``_last`` the ``carried`` columns of the last row that counts.

    Rows that do not count sort before those that do, with their values hidden, so that a frame of ``n`` rows
    holds the last counted ones; what a counted row sees is then carried to the rows after it. Both windows have
    the same keys: one shuffle, and a null key is a key.
    """
    inside = F.coalesce(counted, F.lit(False))
    own = Window.partitionBy(*keys).orderBy("_in", *order).rowsBetween(1 - n, 0)
    means = (F.avg(F.when(F.col("_in"), F.col(v))).over(own).alias(f"{v}_avg") for v in values)
    seen = F.struct(F.count(F.when(F.col("_in"), F.lit(1))).over(own).alias("games"), *means, *(F.col(k).alias(f"{k}_last") for k in carried))
    rows = df.withColumn("_in", inside).withColumn("_seen", F.when(F.col("_in"), seen))
    last = rows.withColumn("_last", F.last("_seen", ignorenulls=True).over(before(keys, order)))
    return last.select(*df.columns, F.coalesce("_last.games", F.lit(0).cast("long")).alias("games"), *(F.col(f"_last.{x}").alias(x) for x in (*(f"{v}_avg" for v in values), *(f"{k}_last" for k in carried))))


def expanding(df: DataFrame, keys: list[str], order: list[str], values: list[str], digits: int = 4, ready: int = 3) -> DataFrame:
    """Means over all earlier rows, rounded, 0 when there is none, and whether at least ``ready`` rows precede."""
    frame = before(keys, order)
    made = {f"{v}_mean": F.coalesce(F.round(F.avg(v).over(frame), digits), F.lit(0.0)) for v in values}
    return df.withColumns(made | {"history_ready": F.count(F.lit(1)).over(frame) >= ready})


def global_prior(df: DataFrame, day: str, order: list[str], label: str, classes: list[str], start: int = 1) -> DataFrame:
    """Laplace-smoothed class shares over all earlier rows of the whole table, in (day, order), a null day first.

    Counts by day are small and get running sums; each day adds its own prefix. No task sorts the whole table.
    """
    per_day = df.groupBy(day).agg(*(F.count_if(F.col(label) == c).alias(f"_d{i}") for i, c in enumerate(classes)))
    running = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = per_day.select(day, *(F.coalesce(F.sum(f"_d{i}").over(running), F.lit(0)).alias(f"_b{i}") for i in range(len(classes))))
    frame = before([day], order)
    own = [F.coalesce(F.count_if(F.col(label) == c).over(frame), F.lit(0)) for c in classes]
    rows = df.withColumns({f"_o{i}": c for i, c in enumerate(own)}).join(days.withColumnRenamed(day, "_day"), F.col(day).eqNullSafe(F.col("_day")))
    counts = [F.col(f"_o{i}") + F.col(f"_b{i}") + start for i in range(len(classes))]
    total = sum(counts[1:], counts[0])
    return rows.select(*df.columns, *((c / total).alias(f"p_{name}") for c, name in zip(counts, classes, strict=True)))


def running_totals(df: DataFrame, day: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add the sums of each of ``sums`` over all earlier rows of the whole table, in (day, order), a null day first, with the two levels of ``global_prior``; 0 where nothing precedes."""
    valued = df.withColumns({f"_v{i}": x for i, x in enumerate(sums.values())})
    per_day = valued.groupBy(day).agg(*(F.sum(f"_v{i}").alias(f"_d{i}") for i in range(len(sums))))
    running = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = per_day.select(F.col(day).alias("_day"), *(F.coalesce(F.sum(f"_d{i}").over(running), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    own = valued.withColumns({f"_o{i}": F.coalesce(F.sum(f"_v{i}").over(before([day], order)), F.lit(0)) for i in range(len(sums))})
    rows = own.join(days, F.col(day).eqNullSafe(F.col("_day")))
    return rows.select(*df.columns, *((F.col(f"_o{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(sums)))


def row_number_in(df: DataFrame, day: str, order: list[str], name: str = "row_index") -> DataFrame:
    """The row's place in the whole table by (day, order), a null day first, from 0, with the two levels of ``global_prior``."""
    per_day = df.groupBy(day).count()
    days = per_day.select(day, F.coalesce(F.sum("count").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(day).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(days.withColumnRenamed(day, "_day"), F.col(day).eqNullSafe(F.col("_day"))).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*df.columns, name)


def eval_size(total: Column, fraction: float, min_eval: int, min_train: int) -> Column:
    """Rows of the last slice: the fraction, at least ``min_eval``, leaving ``min_train``."""
    return F.least(F.greatest(F.ceil(total * fraction), F.lit(min_eval)), total - min_train)


def chronological_split(df: DataFrame, day: str, order: list[str], fraction: float = 0.2, min_eval: int = 50, min_train: int = 200) -> DataFrame:
    """Add row_index and ``part``: train, then eval for the last slice; blocked if there are too few rows."""
    rows = row_number_in(df, day, order)
    total = df.agg(F.count("*").alias("_total"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    size = eval_size(F.col("_total"), fraction, min_eval, min_train)
    return out.withColumn("part", F.when(F.col("_total") < min_train + min_eval, "blocked").when(F.col("row_index") >= F.col("_total") - size, "eval").otherwise("train")).drop("_total")


def split_by_date(df: DataFrame, day: str, cut: str) -> DataFrame:
    """Add ``part``: train before the day ``cut``, eval from it on; a null day trains."""
    return df.withColumn("part", F.when(F.col(day) >= F.lit(cut).cast("date"), "eval").otherwise("train"))


def refit_fold(index: Column, min_train: int, every: int) -> Column:
    """Which refit a row is scored by: a new one every ``every`` rows, none before ``min_train``."""
    return F.when(index >= min_train, F.floor((index - min_train) / every)).cast("int")


def rolling_origin(df: DataFrame, season: Column, values: dict[str, Column]) -> DataFrame:
    """One row a season with the sums of ``values`` over all earlier seasons: the training side of each fold."""
    each = df.groupBy(season.alias("season")).agg(F.count("*").alias("test_rows"), *(F.sum(c).alias(f"_{n}") for n, c in values.items()))
    past = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row a season
    return each.select("season", "test_rows", F.coalesce(F.sum("test_rows").over(past), F.lit(0)).alias("train_rows"), *(F.sum(f"_{n}").over(past).alias(f"train_{n}") for n in values))
