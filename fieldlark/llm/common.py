"""Helpers that the corpus operators share: durable intermediate tables, exact prefix sums, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which driver and executors share.

    It is the session's ``spark.checkpoint.dir``; a folder of this machine is made only for a local master.
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


#: Tables that ``stash`` has written and nobody has released.
_WRITTEN: dict[str, SparkSession] = {}


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor. ``release`` removes the copy, at the latest the
    driver's end does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def written() -> set[str]:
    """The paths of stashed tables that nobody has released."""
    return set(_WRITTEN)


def release_paths(paths: set[str]) -> None:
    for path in paths & set(_WRITTEN):
        _remove(path)


def release(*tables: DataFrame) -> None:
    """Remove stashed tables that nothing will read again."""
    for t in tables:
        _remove(t._stash)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        _remove(path)


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    sc = spark and spark.sparkContext
    if not sc or sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: Groups that ``joined_groups`` broadcasts at most, and rows that a group holds at least to be one of them.
HOT_GROUPS, HOT_ROWS = 250_000, 1000


def joined_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with its ``groups``, a stashed table of one row per ``keys`` and n, the group's rows in ``df``.

    Groups of more than HOT_ROWS rows and a HOT_GROUPS-th of all are broadcast: fewer than HOT_GROUPS can be so
    large. Their rows stay where they are; the others meet in a shuffle, where no group is hot.
    """
    total, most = groups.agg(F.sum("n"), F.max("n")).first()
    least = max(HOT_ROWS, (total or 0) // HOT_GROUPS)
    if (most or 0) <= least:
        return df.join(groups, keys)
    return df.join(F.broadcast(groups.where(F.col("n") > least)), keys).unionByName(df.join(groups.where(F.col("n") <= least), keys))


def with_groups(df: DataFrame, keys: list[str], *aggs: Column, where: str = "n > 1") -> tuple[DataFrame, DataFrame]:
    """(``df`` with n and ``aggs`` of each row's group, the stashed groups), of the groups where ``where`` holds. Null keys have none."""
    groups = stash(df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs).where(where))
    return joined_groups(df, groups, keys), groups


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str, bucket: str, weight: str | None = None) -> DataFrame:
    """Add the exclusive running sum of ``weight`` (1 if None) within ``keys``, ordered by (bucket, order).

    Two levels keep a hot key out of one task: sums by (keys, bucket) are small and get running offsets,
    and each (keys, bucket) runs its own window. ``bucket`` names a column that splits every key evenly,
    such as a hash of the row's id modulo a count that grows with the rows.
    """
    amount = F.col(weight) if weight else F.lit(1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).cast("long").alias("_sum"))
    offsets = sums.select(*keys, bucket, (F.sum("_sum").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_sum")).alias("_offset"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = F.sum(amount).over(within) - amount
    return df.withColumn("_inner", inner).join(offsets, [*keys, bucket]).withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long")).drop("_inner", "_offset")


#: Edges that one task can meet: up to so many in all, ``components`` joins without looking for hot nodes.
EDGES = 1_000_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of the undirected ``edges`` (a long, b long): rows (node, component), the component's smallest node.

    Alternates large-star and small-star steps; each is a grouped minimum joined back, so no node's
    neighbours are ever gathered, a node of very many is met where they are, and the rounds grow with the
    logarithm of the longest path. Raises if ``rounds`` do not suffice. No edges: no rows. Self-loops and
    repeated edges do no harm.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = now.count() <= EDGES  # the steps never add edges
    for _ in range(rounds):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, done = _with_least(both, few)
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if few else stash(large)
        small, more = _with_least(large, few)
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(least).distinct())
        release(now, *done, *more, *([] if few else [large]))
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _with_least(edges: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(``edges`` with m, the least v of each u, tables to release)."""
    least = F.min("v").alias("m")
    if few:
        return edges.join(edges.groupBy("u").agg(least), "u"), []
    out, groups = with_groups(edges, ["u"], least, where="n > 0")
    return out, [groups]


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, to a v that is no u: each component is a star about its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("root")).where("n > 1 OR (n > 0 AND root = 0)").isEmpty()
