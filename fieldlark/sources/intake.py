"""Intake of a folder of mixed files: each read by the reader of its shape, and counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.sources import lines

c = F.col
#: Shapes by extension, and the arrays that hold the rows of a JSON document, the first that is there; fixed values.
SHAPES = {"csv": "csv_match_rows", "json": "json_rows", "jsonl": "json_lines", "gz": "json_lines"}
ARRAYS = ("matches", "events", "fixtures", "settlements")
SCAN = "path string, extension string, shape string, row_count long, bad_rows long, status string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, extension, shape, length) of every file below ``folder`` whose shape is known, from one listing; files are not opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    shape = F.lit(None).cast("string")
    for e, s in SHAPES.items():
        shape = F.when(extension == e, s).otherwise(shape)
    return found.select("path", F.concat(F.lit("."), extension).alias("extension"), shape.alias("shape"), "length").where("shape IS NOT NULL")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SCAN, one row a file: its rows by the reader of its shape.

    Rows of a CSV file are its lines that are not blank after the header, of JSON lines its lines that are objects, of a JSON document the elements of
    the first of ARRAYS that it has. ``status``: ok; no_rows; unreadable, a document that does not parse; bad_rows, of JSON lines where
    some do not. Files of other shapes are left out. Text files are read in splits; a document is read by one task.
    """
    files = listing(spark, folder)
    by = {s: [r.path for r in files.where(c("shape") == s).select("path").collect()] for s in set(SHAPES.values())}  # names of files
    counts = []
    if by["csv_match_rows"]:
        read = lines.numbered(spark, by["csv_match_rows"]).where(F.trim("value") != "")
        counts.append(read.groupBy(c("file").alias("path")).agg((F.count("*") - 1).alias("row_count"), F.lit(0).cast("long").alias("bad_rows")))
    if by["json_lines"]:
        read = spark.read.option("lineSep", "\n").text(by["json_lines"]).select(c("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
        good = F.from_json("value", "map<string,string>").isNotNull() & F.trim("value").startswith("{")
        counts.append(read.groupBy("path").agg(F.count_if(good).alias("row_count"), F.count_if(~good).alias("bad_rows")))
    if by["json_rows"]:
        schema = ", ".join(f"{a} array<string>" for a in ARRAYS) + ", _wrong string"
        read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_wrong").option("multiLine", True).json(by["json_rows"])
        rows = F.coalesce(*(F.when(c(a).isNotNull(), F.size(a)) for a in ARRAYS), F.lit(0))
        counts.append(read.groupBy(c("_metadata.file_path").alias("path")).agg(F.sum(rows).cast("long").alias("row_count"), F.sum(c("_wrong").isNotNull().cast("long")).alias("bad_rows")))
    if not counts:
        return spark.createDataFrame([], SCAN)
    found = reduce(DataFrame.unionByName, counts).withColumn("_at", lines.plain(c("path"))).drop("path")
    rows, bad = F.coalesce("row_count", F.lit(0)), F.coalesce("bad_rows", F.lit(0))
    status = F.when((bad > 0) & (c("shape") == "json_rows"), "unreadable").when(bad > 0, "bad_rows").when(rows <= 0, "no_rows").otherwise("ok")
    return files.withColumn("_at", lines.plain(c("path"))).join(found, "_at", "left").select("path", "extension", "shape", F.greatest(rows, F.lit(0)).cast("long").alias("row_count"), bad.cast("long").alias("bad_rows"), status.alias("status"))


def gate(scanned: DataFrame, preview: int, baseline: int) -> DataFrame:
    """One row: files, rows, whether there are enough for a preview and for a baseline, and the status of the intake."""
    total = scanned.agg(F.count("*").alias("files"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))
    enough = c("rows") >= baseline
    return total.select("files", "rows", (c("rows") >= preview).alias("preview_count_ok"), enough.alias("baseline_count_ok"), F.when(enough, "row_count_ready").otherwise("needs_more_rows").alias("status"))
