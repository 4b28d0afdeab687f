import datetime as dt
import gzip
import hashlib
import json
import random

import pyarrow.parquet as pq
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import ratings, walkforward
from fieldlark.sources import exports, intake, lines, writers
from fieldlark.streaming import cursors, rated

# Lines and exports


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rnd = random.Random(1)
    want = {}
    for name in ("a.txt", "b b.txt"):
        text = [rnd.choice(["", "  ", "x" * rnd.randrange(40), "é\r"]) for _ in range(900)]
        (tmp_path / name).write_bytes("\n".join(text).encode())
        want |= {(name[0], i + 1): t for i, t in enumerate(text) if t.strip(" ")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        rows = lines.raw_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        manifest = spark.createDataFrame([("t1", "s", "csv", f"file://{tmp_path}/a.txt")], "task_id string, source_id string, source_kind string, path string")
        preview = {r.row_number: r for r in lines.candidate_rows(spark, manifest).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.file.rpartition("/")[2][0], r.line): r.value for r in rows} == want
    assert all(r.sha256 == hashlib.sha256(r.value.encode()).hexdigest() for r in rows)
    text = [t.rstrip("\r") for (f, _), t in sorted(want.items()) if f == "a" and t.strip()]
    assert [preview[i + 1].raw_line_sha256 for i in range(len(text))] == [hashlib.sha256(t.encode()).hexdigest() for t in text] and len(preview) == len(text)
    assert preview[1].row_id == "t1::row_1" and preview[1].quarantine_only


def test_export_hash_is_that_of_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "PART", 40)
    df = spark.range(150).select(F.col("id"), F.concat(F.lit("v"), F.col("id") % 7).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("a")).repartition(5)
    manifest = {r.name: r for r in exports.export({"rows": (df, ["b", "id"]), "none": (df.limit(0), ["id"])}, str(tmp_path / "x")).collect()}
    order = sorted(df.collect(), key=lambda r: (r.b, r.id))
    whole = "".join(json.dumps({"a": r.a, "b": r.b, "id": r.id}, separators=(",", ":")) + "\n" for r in order)
    assert (manifest["rows"].rows, manifest["rows"].sha256) == (150, hashlib.sha256(whole.encode()).hexdigest()) and len(manifest["rows"].parts) >= 4
    assert b"".join(gzip.open(tmp_path / "x/rows" / p).read() for p in manifest["rows"].parts) == whole.encode()
    assert (manifest["none"].rows, manifest["none"].sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert {tuple(r) for r in exports.verify_export(spark, str(tmp_path / "x")).collect()} == {("rows", "ok"), ("none", "ok")}
    victim = tmp_path / "x/rows" / manifest["rows"].parts[1]
    victim.with_name(f".{victim.name}.crc").unlink()
    with gzip.open(victim, "wt") as f:
        f.write("{}\n")
    assert dict(map(tuple, exports.verify_export(spark, str(tmp_path / "x")).collect()))["rows"] == "changed"
    victim.unlink()
    assert dict(map(tuple, exports.verify_export(spark, str(tmp_path / "x")).collect()))["rows"] == "missing"


def test_snapshots_are_there_as_a_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "s")
    assert exports.snapshots(spark, path).count() == 0
    with pytest.raises(ValueError, match="nothing is committed"):
        exports.load(spark, path)
    one = {"fixtures": spark.range(3), "odds": spark.range(4).withColumn("price", F.col("id") / 2), "events": spark.range(0)}
    exports.commit(one, path, "s1", "2024-01-01")
    writers.write_pack(f"{path}/data/s2", {"fixtures": spark.range(9)}, "parquet")  # written in part: no manifest
    (tmp_path / "s/committed/s2.writing").mkdir()
    got = exports.load(spark, path)
    assert {n: df.count() for n, df in got.items()} == {"fixtures": 3, "odds": 4, "events": 0} and got["odds"].columns == ["id", "price"]
    assert [tuple(r) for r in exports.snapshots(spark, path).collect()] == [("s1", "2024-01-01", 3, 7)]
    exports.commit({"fixtures": spark.range(5)}, path, "s3", "2024-01-02")
    assert exports.load(spark, path)["fixtures"].count() == 5 and exports.load(spark, path, "s1")["fixtures"].count() == 3
    next((tmp_path / "s/data/s1/tables/odds").glob("part-*")).with_name("part-stray.parquet").write_bytes(b"x")
    assert exports.load(spark, path, "s1")["odds"].count() == 4  # a file that the manifest does not name
    for bad, tables, name in (("committed", one, "s1"), ("not tables", {"teams": spark.range(1)}, "s4"), ("holds rows", {"odds": spark.range(0)}, "s5")):
        with pytest.raises(ValueError, match=bad):
            exports.commit(tables, path, name, "2024-01-03")
    victim = next((tmp_path / "s/data/s1/tables/fixtures").glob("part-*"))
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_bytes(b"x")
    with pytest.raises(ValueError, match="fixtures is not as committed"):
        exports.load(spark, path, "s1")


def test_packs_keep_files_and_row_groups_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "GROUP_ROWS", 100)
    rows = writers.write_pack(str(tmp_path / "p"), {"a": spark.range(900).coalesce(1)}, "parquet", 400).collect()
    assert sorted(r.rows for r in rows) == [100, 400, 400]
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "p/tables/a").glob("part-*")) == 4


def test_intake_sends_each_file_to_its_reader(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n\n3,4\n")
    (tmp_path / "empty.CSV").write_text("x,y\n")
    (tmp_path / "deep/m.json").write_text(json.dumps({"matches": [{"a": 1}, {"a": 2}], "events": [1]}))
    (tmp_path / "deep/f.json").write_text(json.dumps({"fixtures": [{"a": {"b": 1}}]}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "l l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nno\n')
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"a": {"b": [1]}}\n')
    (tmp_path / "notes.md").write_text("x")
    scanned = intake.scan(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2].replace("%20", " "): (r.shape, r.row_count, r.bad_rows, r.status) for r in scanned.collect()}
    assert got == {
        "a.csv": ("csv_match_rows", 2, 0, "ok"), "empty.CSV": ("csv_match_rows", 0, 0, "no_rows"), "m.json": ("json_rows", 2, 0, "ok"), "f.json": ("json_rows", 1, 0, "ok"),
        "other.json": ("json_rows", 0, 0, "no_rows"), "bad.json": ("json_rows", 0, 1, "unreadable"), "l l.jsonl": ("json_lines", 2, 1, "bad_rows"), "z.jsonl.gz": ("json_lines", 1, 0, "ok"),
    }
    assert tuple(intake.gate(scanned, 5, 100).first()) == (8, 8, True, False, "needs_more_rows")


# State


def test_streamed_ratings_equal_the_batch_row_by_row(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(90):
        comp, day = f"c{i % 2}", i // 4
        h, a = rnd.sample("abcd", 2)
        x = None if i % 11 == 5 else rnd.randrange(4)
        rows.append((comp, i, "domestic" if comp == "c0" else "continental", dt.datetime(2024, 1, 1) + dt.timedelta(days=day), h, a, x, rnd.randrange(3)))
    schema = "competition string, match_id long, kind string, kickoff timestamp, home string, away string, home_goals int, away_goals int"
    late = [rows[j] for i in range(0, 90, 6) for j in rnd.sample(range(i, min(i + 6, 90)), min(6, 90 - i))]  # out of order within two days
    end = [(c, 900 + k, "domestic", dt.datetime(2024, 3, 1 + k), "a", "b", None, None) for c in ("c0", "c1") for k in (0, 9)]
    parts = [late[:40], late[40:], end[:1] + end[2:3], end[1:2] + end[3:]]
    for k, part in enumerate(parts):  # each a run of its own, from the checkpoint that the last has left
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = rated.rated(stream, "3 days").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query = out.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, k
    got = {r.match_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(range(90)) <= set(got) and spark.read.parquet(str(tmp_path / "out")).groupBy("competition", "match_id").count().where("count > 1").isEmpty()
    matches = spark.createDataFrame(rows, schema).withColumn("day", F.to_date("kickoff"))
    batch = ratings.elo(matches.select("match_id", "competition", "kind", "day", "home", "away", F.col("home_goals").cast("double"), F.col("away_goals").cast("double")))
    form = walkforward.form(matches, ["competition"], "day", ["match_id"])
    for r in batch.join(form, ["competition", "match_id"]).collect():
        s = got[r.match_id]
        assert (s.home_rating, s.away_rating, s.expected_home) == pytest.approx((r.home_rating, r.away_rating, r.expected_home)), r.match_id
        assert (s.form_diff, s.strength_diff, s.rest_diff, s.congestion_diff) == pytest.approx((r.form_diff, r.strength_diff, r.rest_diff, r.congestion_diff), abs=2e-6), r.match_id


def test_waiting_matches_are_packed_by_competition_and_time(spark):
    """A backlog is sent and kept by the pack: a state call a match made the longest task 474 microseconds a match."""
    schema = pa.schema([("competition", pa.string()), ("kickoff", pa.timestamp("us", "UTC")), *((f.name, f.type) for f in rated._ROW)])
    rows = [(f"c{i % 2}", dt.datetime(2024, 1, 1 + i // 3000, tzinfo=dt.timezone.utc), i // 3000, i, f"h{i % 7}", "a", i % 8) for i in range(6000)]
    parts = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 1000], strict=True), schema, strict=True)], schema=schema) for k in range(0, 6000, 1000)]
    packs = [r for b in rated._packed(iter(parts)) for r in b.to_pylist()]
    assert sorted((p["competition"], p["time"]) for p in packs) == [("c0", 0), ("c0", 1), ("c1", 0), ("c1", 1)]
    back = [(p["competition"], p["kickoff"], *r.values()) for p in packs for b in rated._unpacked(len(p["pack"]).to_bytes(8, "little") + p["pack"]) for r in b.to_pylist()]
    assert sorted(back) == sorted(rows)


def test_a_failed_batch_neither_skips_nor_doubles_rows(spark, tmp_path):
    schema = "source_id string, cursor string, n int"
    path, at, checkpoint = (str(tmp_path / x) for x in ("out", "cursors", "c"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(prepared=lambda rows: rows):
        query = cursors.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, at, checkpoint, prepared=prepared)
        try:
            query.awaitTermination(60)
        except Exception:
            return False
        return query.exception() is None

    assert cursors.latest(spark, at).count() == 0
    add([("a", "2024-01-01", 1), ("a", "2024-01-03", 2), ("b", None, 3), (None, "2024-09-09", 4)])
    assert run()
    add([("a", "2024-01-02", 5), ("b", "2024-02-01", 6)])
    replace, done = cursors._replace, []

    def failing(rows, where):
        replace(rows, where)
        done.append(where)
        raise RuntimeError("the cluster is gone")  # the rows are written, their cursors are not

    cursors._replace = failing
    try:
        assert not run()
    finally:
        cursors._replace = replace
    assert done == [path] and {r.source_id: r.cursor for r in cursors.latest(spark, at).collect()} == {"a": "2024-01-03", "b": None}
    assert run() and run()
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.source_id: (r.cursor, r.rows) for r in cursors.latest(spark, at).collect()} == {"a": ("2024-01-03", 3), "b": ("2024-02-01", 2)}
    new = spark.createDataFrame([("a", "2024-01-03", 7), ("a", "2024-01-04", 8), ("c", "2023-01-01", 9)], schema)
    assert sorted(r.n for r in cursors.after(new, cursors.latest(spark, at)).collect()) == [8, 9]
