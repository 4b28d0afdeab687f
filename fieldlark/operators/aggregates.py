"""Coverage reports, review queues, event summaries and ratings by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.scalars import PHASES, clamp, goal_bucket, rate


def grouped(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Counts by a key, null as empty, the largest first, then by key."""
    out = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(n) if n else out


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def review_queue(df: DataFrame, keys: list[str], time: str, example: str, keep: Column) -> DataFrame:
    """Rows that need review by ``keys``: how many, first and last time, an example id."""
    return df.where(keep).groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.min(example).alias("example_id"))


def needs_mapping(flag: Column, mapped: Column) -> Column:
    return (flag == 1) | mapped.isNull() | (mapped == "")


def coverage(df: DataFrame, keys: list[str], date: str, distinct: list[str], present: list[str]) -> DataFrame:
    """Rows, date range, distinct ids and the share of rows with a value, by ``keys``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        *(F.countDistinct(c).alias(f"n_{c}") for c in distinct),
        *(rate(F.count(c), F.count("*")).alias(f"{c}_rate") for c in present),
    )


def readiness(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """One row: the count of each check and the warnings of those under their threshold."""
    counts = df.agg(*(F.count_if(c).alias(name) for name, (c, _) in checks.items()))
    short = F.array_compact(F.array(*(F.when(F.col(name) < least, F.lit(f"{name} < {least}")) for name, (_, least) in checks.items())))
    return counts.withColumn("warnings", F.array_join(short, "; ")).withColumn("ready", F.size(short) == 0)


def event_summary(events: DataFrame, match: str, side: Column, kind: Column, minute: Column, xg: Column, raw: Column | None = None) -> DataFrame:
    """Shots, goals, expected goals, cards, corners and half goals by match and side, and the goal minutes in order.

    Corners are the events whose ``raw`` text names one; without it there are none.
    """
    goal = kind == "goal"
    corner = F.coalesce(F.contains(raw, F.lit("Corner")), F.lit(False)) if raw is not None else F.lit(False)
    return events.groupBy(match, side.alias("side")).agg(
        F.count_if(kind.isin("shot", "goal")).alias("shots"), F.count_if(goal).alias("goals"), F.sum(F.coalesce(xg, F.lit(0.0))).alias("xg"),
        F.count_if(kind == "card").alias("cards"), F.count_if(corner).alias("corners"), F.count_if(goal & (minute <= 45)).alias("first_half_goals"), F.count_if(goal & (minute > 45)).alias("second_half_goals"),
        F.array_join(F.sort_array(F.collect_list(F.when(goal, minute))), ",").alias("goal_minutes"),
    )


def goal_timing(goals: DataFrame, match: str, side: str, minute: str, order: str) -> DataFrame:
    """First goal (minute, side) and goals in each fifteen minutes, by match; goals without a minute count in none."""
    bucket = goal_bucket(F.col(minute))
    timed = F.when(F.col(minute).isNotNull(), F.struct(minute, order))
    return goals.groupBy(match).agg(
        F.count("*").alias("goals"), F.min(minute).alias("first_goal_minute"), F.min_by(side, timed).alias("first_goal_side"), *(F.count_if(bucket == k).alias(f"bucket_{k}") for k in range(1, 7))
    )


def timing_report(timing: DataFrame) -> DataFrame:
    """One row over matches: how many, the mean first goal, the share of goals after the third bucket."""
    late, every = sum((F.col(f"bucket_{k}") for k in (5, 6)), F.col("bucket_4")), sum((F.col(f"bucket_{k}") for k in range(2, 7)), F.col("bucket_1"))
    return timing.agg(F.count("*").alias("matches"), F.avg("first_goal_minute").alias("mean_first_goal"), rate(F.sum(late), F.sum(every)).alias("second_half_share"))


def phase_counts(events: DataFrame, match: str, phase: str, minute: str) -> DataFrame:
    """Events by phase and match, the last minute, and which settlement scopes the match reached."""
    out = events.groupBy(match).agg(*(F.count_if(F.col(phase) == p).alias(p) for p in PHASES), F.max(minute).alias("max_minute"))
    some = lambda prefix: sum((F.col(p) for p in PHASES if p.startswith(prefix)), F.lit(0)) > 0
    regular, extra, shootout = some("regulation"), some("extra_time"), F.col("penalty_shootout") > 0
    return out.withColumns({"regulation_time": regular, "extra_time_only": extra, "after_extra_time": regular & extra, "qualification": regular & (extra | shootout)})


#: A player's base rating, points for each of these in ninety minutes, and minutes where unknown; fixed values.
PLAYER_BASE, PLAYER_POINTS, PLAYER_MINUTES = 50, {"xg": 18, "shots": 3, "goals": 12, "cards": -6}, 60


def player_scores(lineups: DataFrame, events: DataFrame, player: str = "player_id") -> DataFrame:
    """Ratings per ninety minutes of players with events: 50 plus weighted rates, clamped to 0 and 100.

    Minutes are 60 where unknown and at least 1.
    """
    minutes = lineups.groupBy(player).agg(F.sum(F.coalesce("minutes", F.lit(PLAYER_MINUTES))).alias("minutes"))
    done = events.groupBy(player).agg(F.sum("xg").alias("xg"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"), F.sum("cards").alias("cards"))
    rows = done.join(minutes, player, "left").withColumn("minutes", F.greatest(F.coalesce("minutes", F.lit(PLAYER_MINUTES)), F.lit(1)))
    per = lambda c: F.coalesce(F.col(c), F.lit(0)) * 90.0 / F.col("minutes")
    total = sum((points * per(c) for c, points in PLAYER_POINTS.items()), F.lit(PLAYER_BASE))
    return rows.withColumn("score", F.round(clamp(total, 0.0, 100.0), 6))


def team_strength(matches: DataFrame, team: str = "team", scored: str = "gf", conceded: str = "ga") -> DataFrame:
    """Matches and goals by team from team-long rows, beside the mean goals of all (at least 0.5, 1.25 without rows)."""
    teams = matches.groupBy(team).agg(F.count("*").alias("matches"), F.sum(scored).alias("gf"), F.sum(conceded).alias("ga"))
    mean = matches.agg(F.greatest(F.coalesce(F.avg(scored), F.lit(1.25)), F.lit(0.5)).alias("avg_goals"))
    return teams.crossJoin(F.broadcast(mean))  # one row


#: The mean of a match where no row tells: corners, shots and yellow cards of both sides; fixed values.
USUAL = {"corners": 9.5, "shots": 24.0, "yellows": 4.0}


def team_means(matches: DataFrame, team: str = "team", values: dict[str, float] = USUAL) -> DataFrame:
    """By team the rows that tell each value, its sums for and against, and beside them the mean of a match over all.

    ``matches`` is team-long with <value>_for and <value>_against; a row counts for a value where both are known.
    """
    told = {v: F.col(f"{v}_for").isNotNull() & F.col(f"{v}_against").isNotNull() for v in values}
    total = lambda v, side: F.coalesce(F.sum(F.when(told[v], F.col(f"{v}_{side}"))), F.lit(0))
    teams = matches.groupBy(team).agg(*(x for v in values for x in (F.count_if(told[v]).alias(f"{v}_matches"), total(v, "for").alias(f"{v}_for"), total(v, "against").alias(f"{v}_against"))))
    mean = {v: rate(total(v, "for") + total(v, "against"), F.count_if(told[v])) for v in values}
    means = matches.agg(*(F.when(m > 0, m).otherwise(values[v]).alias(f"avg_{v}") for v, m in mean.items()))
    return teams.crossJoin(F.broadcast(means))  # one row


def identities(df: DataFrame, name: Column, source: str, raw: str) -> DataFrame:
    """Candidates by normalised name: sources and spellings, distinct and in order."""
    sets = df.groupBy(name.alias("name")).agg(F.sort_array(F.collect_set(source)).alias("_s"), F.sort_array(F.collect_set(raw)).alias("_v"))
    return sets.select("name", F.size("_s").alias("source_count"), F.array_join("_s", ",").alias("sources"), F.array_join("_v", ",").alias("variants"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def count_map(df: DataFrame, key: str) -> DataFrame:
    """One row: a map from key to its count. For keys of a few kinds."""
    return df.groupBy(key).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))).alias("counts"))


def audit(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """One row: rows, rows of repeated keys, date range, and the nulls of each column."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    each = df.agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns))
    return each.crossJoin(F.broadcast(dup))  # one row


def bets_summary(bets: DataFrame) -> DataFrame:
    """One row: bets, stake, profit, return on it, mean edge and closing-line value, and its signs."""
    return bets.agg(
        F.count("*").alias("bets"), F.sum("stake").alias("stake"), F.sum("profit").alias("profit"), rate(F.sum("profit"), F.sum("stake")).alias("roi"), F.round(F.avg("edge"), 6).alias("avg_edge"),
        F.round(F.avg("clv"), 6).alias("avg_clv"), F.count_if(F.col("clv") > 0).alias("clv_positive"), F.count_if(F.col("clv") < 0).alias("clv_negative"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_id", "status").agg(F.max("finished_at").alias("last_finished_at"), F.count("*").alias("runs"))
