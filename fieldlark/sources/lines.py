"""Lines of split files: their numbers, and the hash of lines in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlark.operators import joins
from fieldlark.operators.lineage import scratch
from fieldlark.sources import hashes

c = F.col


def plain(path: Column) -> Column:
    """A path of a local file as one of the ways in which Spark writes it; other paths as they are."""
    return F.when(path.rlike("^(file:)?/"), F.regexp_replace(F.regexp_replace(path, "^(file:)?/+", "file:/"), "%20", " ")).otherwise(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line of text files, numbered from 1 within its file, whichever way the files are split.

    Two levels: a task knows where the block that it reads begins, lines by block get running offsets by file, and a line's
    place in its block is its distance from the block's first. No file is read whole by one task, and lines are not shuffled.
    Lines end with a line feed; a carriage return before it stays with the line, as does a byte order mark.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    placed = rows.select(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = placed.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - c("_n")  # one row a block
    offsets = blocks.select("file", "_block", (before - c("_first") + 1).alias("_shift"))
    return placed.join(joins.small(offsets), ["file", "_block"]).select("file", (c("_id") + c("_shift")).alias("line"), "value")


def digest(spark: SparkSession, files: list[str]) -> tuple[int, str]:
    """(lines, sha256) of the lines of text files, one file after another, each line with its line feed.

    A hash of bytes in order cannot be shared out, but it can be carried on: each file is hashed by a task of its own, which begins with
    the hash's state after the file before and gives back its own, of 112 bytes. The driver gets no text. A file that is read in several
    blocks is written again in order, in compressed pieces, which are read whole.
    """
    rows, h = 0, hashes.Sha256()
    for file in files:
        text = spark.read.option("lineSep", "\n").text(file)
        pieces = [file]
        if (n := text.rdd.getNumPartitions()) > 1:
            from fieldlark.sources import exports  # which needs this module

            path = scratch(spark)
            placed = text.select(c("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
            ordered = placed.repartitionByRange(n, "b", "i").sortWithinPartitions("b", "i").select("value")
            ordered.write.option("lineSep", "\n").option("compression", "gzip").text(path)
            pieces = exports.data_files(spark, path)
        for piece in pieces:
            found = spark.read.option("lineSep", "\n").text(piece).mapInArrow(_hashed(h.state()), "n long, state binary").collect()  # one row a piece
            for r in found:
                rows += r["n"]
                h = hashes.Sha256(bytes(r["state"]))
    return rows, h.hexdigest()


def _hashed(state: bytes):
    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h = 0, hashes.Sha256(state)
        for part in parts:
            if part.num_rows:
                n += part.num_rows
                lines = pc.binary_join_element_wise(part.column(0).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))  # each line and its line feed, one after another
                _, offsets, data = lines.buffers()
                ends = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
                h.update(memoryview(data)[ends[0] : ends[-1]])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h.state()], pa.binary())], ["n", "state"])

    return each


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, sha256) of the lines that are not blank, with their numbers in the file."""
    return numbered(spark, path).where(F.trim("value") != "").withColumn("sha256", F.sha2("value", 256))


def candidate_rows(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Preview rows of source files (task_id, source_id, source_kind, path): each line that is not blank, numbered from 1 among these.

    (row_id, task_id, source_id, source_kind, path, row_number, raw_line_sha256, quarantine_only): nothing of it is
    imported. Row numbers count lines without the blank ones, in the two levels of ``numbered``. Paths are full ones.
    """
    paths = [r.path for r in files.select("path").distinct().collect()]  # a list of files, as small as its manifest
    lines = numbered(spark, paths).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "")
    spans = lines.withColumn("_span", F.floor(c("line") / 100_000))
    counts = spans.groupBy("file", "_span").agg(F.count("*").alias("_n"))
    offsets = counts.select("file", "_span", (F.sum("_n").over(Window.partitionBy("file").orderBy("_span")) - c("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("file", "_span").orderBy("line"))
    rows = spans.withColumn("_own", own).join(offsets, ["file", "_span"]).withColumn("row_number", (c("_own") + c("_before")).cast("long"))
    told = files.withColumn("_at", plain(c("path")))
    return rows.withColumn("_at", plain(c("file"))).join(joins.small(told), "_at").select(
        F.concat("task_id", F.lit("::row_"), "row_number").alias("row_id"), "task_id", "source_id", "source_kind", "path", "row_number", F.sha2(F.regexp_replace("value", r"\r$", ""), 256).alias("raw_line_sha256"), F.lit(True).alias("quarantine_only")
    )
