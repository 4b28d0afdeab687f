"""Packs: compressed tables with a manifest, their verification, run archives and storage plans."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The codec of each pack format; fixed values.
CODECS = {"json": "jsonl.gzip", "parquet": "parquet.zstd"}
#: Rows of a data file at most, so that each can be hashed in one piece, and of a Parquet row group.
FILE_ROWS, GROUP_ROWS = 1_000_000, 100_000


def write_pack(path: str, tables: dict[str, DataFrame], fmt: str = "json", file_rows_: int = FILE_ROWS) -> DataFrame:
    """Write each table (JSON lines with gzip, or Parquet with zstd) and a manifest of its files; return the manifest.

    A file has its rows, bytes, hash and codec, its bytes as JSON lines (raw_bytes), the share of these that it
    takes (ratio), and its table's schema. Files have ``file_rows_`` rows at most. A file without rows, or with none but null ones, has 0 raw bytes and no ratio.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = None
    for name, df in tables.items():
        folder = f"{path}/tables/{name}"
        if fmt == "json":
            df.select(*sorted(df.columns)).write.mode("overwrite").option("maxRecordsPerFile", file_rows_).option("compression", "gzip").json(folder)
        else:
            options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.block.row.count.limit": str(GROUP_ROWS), "maxRecordsPerFile": file_rows_}
            df.write.mode("overwrite").options(**options).parquet(folder)
        about = {"table_name": F.lit(name), "codec": F.lit(CODECS[fmt]), "schema": F.lit(df.schema.json())}
        part = files(spark, folder).join(file_rows(spark, folder, CODECS[fmt]), "file", "left").fillna(0, ["rows", "raw_bytes"]).withColumns(about)
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.withColumn("ratio", F.when(F.col("raw_bytes") > 0, F.round(F.col("bytes") / F.col("raw_bytes"), 4)))
    parts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(parts.schema).json(f"{path}/manifest")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the data files of a folder, hashed where they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_rows(spark: SparkSession, folder: str, codec: str) -> DataFrame:
    """(file, rows, raw_bytes) of the data files of a folder, counted where they are read; files without rows are absent."""
    if codec == CODECS["json"]:
        lines = spark.read.option("pathGlobFilter", "part-*").text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    else:
        rows = spark.read.option("pathGlobFilter", "part-*").parquet(folder)
        lines = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value"), F.col("_metadata.file_name").alias("file"))
    return lines.groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.octet_length("value") + 1).alias("raw_bytes"))


def verify_pack(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, file, status): ok, changed, missing, unexpected, rows_differ or codec_unknown.

    Rows are counted in tables whose files are all as the manifest has them, since others may not be readable.
    """
    manifest = spark.read.json(f"{path}/manifest")
    want = manifest.select("table_name", "file", "codec", "rows", F.col("sha256").alias("_want"))
    tables = manifest.select("table_name", "codec").distinct().collect()  # one row a table
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    there = union(files(spark, f"{path}/tables/{t}").select(F.lit(t).alias("table_name"), "file", F.col("sha256").alias("_have")) for t in {t for t, _ in tables})
    both = want.join(there, ["table_name", "file"], "full")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_have") != F.col("_want"), "changed")
    status = status.when(~F.col("codec").isin(*CODECS.values()), "codec_unknown").otherwise("ok")
    found = both.select("table_name", "file", "rows", status.alias("status"))
    bad = {t for (t,) in found.where("status <> 'ok'").select("table_name").distinct().collect()}
    counted = [file_rows(spark, f"{path}/tables/{t}", codec).select(F.lit(t).alias("table_name"), "file", F.col("rows").alias("_rows")) for t, codec in tables if t not in bad]
    if counted:
        found = found.join(union(counted), ["table_name", "file"], "left")
        differ = (F.col("status") == "ok") & ~F.col("table_name").isin(*bad or [""]) & (F.col("rows") != F.coalesce("_rows", F.lit(0)))
        found = found.withColumn("status", F.when(differ, "rows_differ").otherwise(F.col("status")))
    return found.select("table_name", "file", "status")


def plan(df: DataFrame, sample: int = 200) -> dict:
    """Rows, and bytes as JSON lines estimated from ``sample`` rows."""
    rows = df.count()
    some = df.limit(sample).select(F.avg(F.octet_length(F.to_json(F.struct(*df.columns))) + 1)).first()[0]
    return {"rows": rows, "estimated_bytes": int(rows * (some or 0))}


def bronze(df: DataFrame, key: str) -> DataFrame:
    """Raw rows as (key, payload, sha256)."""
    payload = F.to_json(F.struct(*df.columns))
    return df.select(F.col(key).cast("string").alias("blob_id"), payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))


def archive(report: DataFrame, path: str, run: str, finished_at: str) -> None:
    """Append a run's report, in a partition of its own; a run that is repeated is replaced."""
    rows = report.withColumns({"run_id": F.lit(run), "finished_at": F.lit(finished_at)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.join(runs.agg(F.max_by("run_id", "finished_at").alias("run_id")), "run_id", "left_semi")


def manifest_hash(document: dict, field: str = "sha256") -> str:
    """The hash of a manifest without its own hash field."""
    import hashlib

    return hashlib.sha256(json.dumps({k: v for k, v in document.items() if k != field}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Rebuild the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
