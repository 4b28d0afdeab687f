"""Exports of feature tables: ordered JSON lines with a hash over all of them, and snapshots of tables that are committed as one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.sources import lines, writers

#: Lines of a part of an export, about.
PART = 1_000_000
MANIFEST = "name string, rows long, sha256 string, format string, parts array<string>"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder, in the order of their names."""
    target, fs = _fs(spark, folder)
    return sorted(str(f.getPath()) for f in fs.listStatus(target) if f.getPath().getName().startswith("part-"))


def write_lines(df: DataFrame, order: list[str], path: str) -> list[str]:
    """Write ``df`` as gzipped JSON lines, keys in order of name, rows in ``order``; the parts, which make up the whole one after another.

    Parts are ranges of ``order``, which must be the rows' key: rows are sorted by Spark, a range in a task.
    """
    parts = 1 + df.count() // PART
    text = F.to_json(F.struct(*(F.col(f"`{n}`") for n in sorted(df.columns))), {"ignoreNullFields": "false"})
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(text.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return data_files(df.sparkSession, path)


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Export each table (rows, order) and, when all are there, a manifest (name, rows, sha256, format, parts), which is returned.

    The hash is of all lines in order, as of one file of them, so it does not depend on the parts. An export without its manifest
    is not complete.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    found = []
    for name, (df, order) in tables.items():
        parts = write_lines(df, order, f"{path}/{name}")
        found.append((name, *lines.digest(spark, parts), "jsonl.gz", [p.rpartition("/")[2] for p in parts]))
    manifest = spark.createDataFrame(found, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def verify_export(spark: SparkSession, path: str) -> DataFrame:
    """(name, status): ok, missing, or changed, by the hash of what is there."""
    out = []
    for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect():  # one row a table
        names = [p.rpartition("/")[2] for p in (data_files(spark, f"{path}/{r['name']}") if exists(spark, f"{path}/{r['name']}") else [])]
        if set(r["parts"]) - set(names):
            out.append((r["name"], "missing"))
        else:
            there = lines.digest(spark, [f"{path}/{r['name']}/{p}" for p in names])
            out.append((r["name"], "ok" if there == (r["rows"], r["sha256"]) else "changed"))
    return spark.createDataFrame(out, "name string, status string")


#: The tables of a provider snapshot; fixed values.
TABLES = ("source_manifests", "fixtures", "odds", "market_discovery", "events", "lineups", "statistics")


def commit(tables: dict[str, DataFrame], path: str, snapshot: str, created_at: str, known: tuple[str, ...] = TABLES) -> DataFrame:
    """Write the tables of a snapshot, and then the manifest that makes them one; the manifest, by file, is returned.

    The tables lie in a folder of the snapshot's own, so what another one wrote is never touched; until the manifest is there, nobody
    loads them. A snapshot that is committed already, one without rows, and tables not ``known`` are errors; tables left out are not in it.
    """
    spark = next(iter(tables.values())).sparkSession
    if others := sorted(set(tables) - set(known)):
        raise ValueError(f"not tables of a snapshot: {', '.join(others)}")
    if exists(spark, f"{path}/committed/{snapshot}"):
        raise ValueError(f"snapshot {snapshot} is committed")
    written = writers.write_pack(f"{path}/data/{snapshot}", tables, "parquet")
    if not written.agg(F.sum("rows")).first()[0]:
        raise ValueError("a snapshot holds rows")
    kinds = {name: df.schema.json() for name, df in tables.items()}
    about = {"snapshot": F.lit(snapshot), "created_at": F.lit(created_at), "kinds": F.lit(json.dumps(kinds, sort_keys=True))}
    written.withColumns(about).coalesce(1).write.json(f"{path}/committed/{snapshot}.writing")
    source, fs = _fs(spark, f"{path}/committed/{snapshot}.writing")
    if not fs.rename(source, _fs(spark, f"{path}/committed/{snapshot}")[0]):  # one step: the manifest is there, or is not
        raise OSError(f"snapshot {snapshot} could not be committed")
    return spark.read.json(f"{path}/committed/{snapshot}")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, created_at, tables, rows) of the committed ones."""
    if not exists(spark, f"{path}/committed"):
        return spark.createDataFrame([], "snapshot string, created_at string, tables long, rows long")
    target, fs = _fs(spark, f"{path}/committed")
    found = [str(f.getPath()) for f in fs.listStatus(target) if not f.getPath().getName().endswith(".writing")]
    return spark.read.schema("snapshot string, created_at string, table_name string, rows long").json(found).groupBy("snapshot", "created_at").agg(F.countDistinct("table_name").alias("tables"), F.sum("rows").alias("rows"))


def load(spark: SparkSession, path: str, snapshot: str | None = None) -> dict[str, DataFrame]:
    """The tables of a committed snapshot, the one created last if none is named; only files that its manifest names.

    Sizes and hashes are checked first: a file that is missing or changed is an error, and one that the manifest does not name is not read.
    """
    if snapshot is None:
        last = snapshots(spark, path).orderBy(F.desc("created_at"), F.desc("snapshot")).first()
        if last is None:
            raise ValueError("nothing is committed")
        snapshot = last["snapshot"]
    if not exists(spark, f"{path}/committed/{snapshot}"):
        raise ValueError(f"snapshot {snapshot} is not committed")
    manifest = spark.read.json(f"{path}/committed/{snapshot}")
    want = manifest.select("table_name", "file", "bytes", "sha256").collect()  # one row a file
    kinds = json.loads(manifest.first()["kinds"])
    out = {}
    for name, kind in kinds.items():
        mine = {r["file"]: (r["bytes"], r["sha256"]) for r in want if r["table_name"] == name}
        folder = f"{path}/data/{snapshot}/tables/{name}"
        have = {r["file"]: (r["bytes"], r["sha256"]) for r in writers.files(spark, folder).collect()} if exists(spark, folder) else {}
        if bad := sorted(f for f, x in mine.items() if have.get(f) != x):
            raise ValueError(f"table {name} is not as committed: {', '.join(bad)}")
        schema = T.StructType.fromJson(json.loads(kind))
        out[name] = spark.read.schema(schema).parquet(*(f"{folder}/{f}" for f in sorted(mine))) if mine else spark.createDataFrame([], schema)
    return out
