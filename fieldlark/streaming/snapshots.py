"""Append-only point-in-time snapshots, scoring and counting of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fieldlark.operators.dedupe import keep_last


def visible(snapshots: DataFrame, at: str, keys: list[str], observed: str = "observed_at") -> DataFrame:
    """The last snapshot of each key observed at or before a time."""
    return keep_last(snapshots.where(F.col(observed) <= F.lit(at)), keys, [observed])


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of snapshots to Parquet; earlier rows are never rewritten."""
    out = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def score(stream: DataFrame, features: Callable[[], DataFrame], keys: list[str], model: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, observed: str = "observed_at") -> StreamingQuery:
    """Score each batch beside the latest features seen up to each row, and append the result.

    A batch that is replayed writes its own partition again.
    """
    from fieldlark.operators.joins import as_of

    def batch(rows: DataFrame, number: int) -> None:
        known = features()
        values = [c for c in known.columns if c not in (*keys, observed)]
        joined = as_of(rows, known.withColumnRenamed(observed, "feature_observed_at"), keys, observed, "feature_observed_at", values, ["feature_observed_at"])
        model(joined).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by key and window of event time; rows later than ``late`` are dropped and windows then close."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def labelled(rows: DataFrame) -> DataFrame:
    """Rows whose times are in order: features before the prediction, the prediction before the settlement, the label last."""
    return rows.where("feature_observed_at <= prediction_time AND prediction_time < settled_at AND settled_at <= label_created_at")


def source_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with their end, or open ones."""
    return started.join(finished, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("running")))
