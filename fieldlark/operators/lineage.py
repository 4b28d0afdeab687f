"""Checkpoints of the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which driver and executors share: the one that ``spark.checkpoint.dir`` names.

    A folder of this machine is made only for a local master that names none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from it; the copy outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stashed(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from it, by the columns that a reader needs."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task of ``dealt``, about.
DEALT = 500_000


def tasks(*frames: DataFrame) -> int:
    """Tasks over which the largest of the frames is dealt."""
    return 1 + max(df.count() for df in frames) // DEALT


def dealt(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``df`` by its keys in ``n`` tasks, as many as its rows need: what sorts or groups by these keys or more holds no more at a larger size."""
    return df.repartition(n, *keys)
