"""Ingest cursors: how far each source has been read, kept in step with what was written of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

CURSOR = "source_id string, cursor string, rows long, batch long"


def ingest(stream: DataFrame, path: str, cursors: str, checkpoint: str, source: str = "source_id", cursor: str = "cursor", prepared: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Write each batch of ``stream``, ``prepared``, to ``path``, and then each source's largest ``cursor`` and rows to ``cursors``.

    Both are partitioned by the batch's number and a batch that is run again writes its own partitions again, rows first and
    cursors last. So a batch that failed at any point neither skips nor doubles rows, and no cursor is ahead of its rows.
    Rows with a null source are written and have no cursor; a null cursor does not move one.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        _replace(prepared(rows).withColumn("batch", F.lit(number).cast("long")), path)
        whole = spark.read.option("basePath", path).parquet(f"{path}/batch={number}") if _there(spark, f"{path}/batch={number}") else None
        if whole is not None:
            moved = whole.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source_id")).agg(F.max(F.col(cursor).cast("string")).alias("cursor"), F.count("*").alias("rows"))
            _replace(moved.withColumn("batch", F.lit(number).cast("long")), cursors)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def latest(spark: SparkSession, cursors: str) -> DataFrame:
    """(source_id, cursor, rows, batch): of each source its largest cursor, all rows so far, and the last batch that had some. Nothing ingested: no rows."""
    if not _there(spark, cursors):
        return spark.createDataFrame([], CURSOR)
    moved = spark.read.schema(CURSOR).parquet(cursors)
    return moved.groupBy("source_id").agg(F.max("cursor").alias("cursor"), F.sum("rows").alias("rows"), F.max("batch").alias("batch"))


def after(rows: DataFrame, known: DataFrame, source: str = "source_id", cursor: str = "cursor") -> DataFrame:
    """The rows that no cursor of ``latest`` covers yet: those beyond their source's, and those of sources without one."""
    at = known.select(F.col("source_id").alias(source), F.col("cursor").alias("_at"))
    return rows.join(at, source, "left").where(F.col("_at").isNull() | (F.col(cursor).cast("string") > F.col("_at"))).select(*rows.columns)
