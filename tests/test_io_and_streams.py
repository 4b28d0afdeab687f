import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from fieldlark.plans import medallion
from fieldlark.sources import readers, writers
from fieldlark.streaming import snapshots


def test_season_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,B365H,B365D,B365A,B365>2.5\n9/3/24,"Red, FC",Blue,2,1,1.9,3.4,x,1.8\n,,,,,,,,\n10/03/2024,Blue,Red FC,,,1.0,3,4,\n')
    m = readers.season(spark, str(tmp_path / "s.csv"), "lg", "2324")
    rows = sorted(m.select("match_id", "home_goals", "away_goals").collect())
    assert [tuple(r) for r in rows] == [("lg:2324:2024-03-09:Red, FC:Blue", 2, 1), ("lg:2324:2024-03-10:Blue:Red FC", None, None)]
    p = readers.season_prices(m).collect()
    assert len(p) == 7 and sum(r.valid for r in p) == 5
    with pytest.raises(ValueError, match="HomeTeam"):
        readers.require(spark.range(1), ["HomeTeam"])


def test_match_list_and_envelope(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "cup", "matches": [{"round": "1", "date": "2024-01-01", "team1": "a", "team2": "b", "score": {"ft": [2, 1]}}, {"team1": "a", "team2": "c"}]}))
    rows = readers.match_list(spark, str(tmp_path / "m.json")).collect()
    assert (rows[0].home_goals, rows[0].home_half, rows[1].home_goals) == (2, None, None)
    (tmp_path / "e.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert readers.envelope(spark, str(tmp_path / "e.json"), "a:int").count() == 2


def test_odds_payload(spark, tmp_path):
    event = {"id": "e", "sport_key": "s", "commence_time": "t", "bookmakers": [{"key": "b", "last_update": "u", "markets": [{"key": "h2h", "outcomes": [{"name": "x", "price": 2.0}, {"name": "y", "price": 1.8, "point": 1.5}]}]}]}
    (tmp_path / "o.json").write_text(json.dumps([event, {"id": "none"}]))
    df = readers.odds_payload(spark, str(tmp_path / "o.json"))
    assert df.count() == 3 and {r.selection for r in df.collect()} == {"x", "y", None}
    assert readers.discovered_markets(df.where("market_key = 'h2h'")).first().has_line


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": oops}\n')
    rows = readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), "a int").collect()
    assert [(r.a, r._corrupt_record is None) for r in rows] == [(1, True), (None, False)]
    assert [r.rows for r in readers.file_rows(spark, str(tmp_path)).collect()] == [2]


def test_pack_verifies_until_it_is_changed(spark, tmp_path):
    path = str(tmp_path / "pack")
    for fmt in ("json", "parquet"):
        manifest = writers.write_pack(path, {"a": spark.range(5), "b": spark.range(3)}, fmt)
        rows = manifest.collect()
        assert {r.table_name for r in rows} == {"a", "b"} and sum(r.rows for r in rows) == 8
        assert sum(r.raw_bytes for r in rows) == 8 * len('{"id":0}\n') and all(r.ratio == round(r.bytes / r.raw_bytes, 4) for r in rows if r.rows)
        assert {r.codec for r in rows} == {writers.CODECS[fmt]} and all("long" in r.schema for r in rows)
        assert {r.status for r in writers.verify_pack(spark, path).collect()} == {"ok"}
    victim = next((tmp_path / "pack/tables/b").glob("part-*"))
    victim.with_name(f".{victim.name}.crc").unlink()
    victim.write_bytes(b"x")
    assert {r.status for r in writers.verify_pack(spark, path).collect()} == {"ok", "changed"}
    victim.unlink()
    assert "missing" in {r.status for r in writers.verify_pack(spark, path).collect()}


def test_pack_with_other_rows_than_its_manifest_says(spark, tmp_path):
    path = str(tmp_path / "pack")
    rows = writers.write_pack(path, {"a": spark.range(5).coalesce(1), "none": spark.range(0)}).collect()
    assert {r.status for r in writers.verify_pack(spark, path).collect()} == {"ok"}
    for change, status in (({"rows": 6}, "rows_differ"), ({"codec": "zip"}, "codec_unknown")):
        spark.createDataFrame([r.asDict() | change for r in rows if r.table_name == "a"], "table_name string, file string, sha256 string, codec string, rows long").write.mode("overwrite").json(f"{path}/manifest")
        assert {r.status for r in writers.verify_pack(spark, path).collect()} == {status}


def test_run_archive_replaces_a_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    writers.archive(spark.range(3), path, "r1", "2024-01-01")
    writers.archive(spark.range(2), path, "r2", "2024-01-02")
    writers.archive(spark.range(1), path, "r1", "2024-01-03")
    assert spark.read.parquet(path).count() == 3 and writers.latest_run(spark, path).count() == 1
    assert writers.manifest_hash({"a": 1, "sha256": "x"}) == writers.manifest_hash({"sha256": "y", "a": 1})


def test_medallion(spark):
    odds = spark.createDataFrame([("f", "s", "1x2", "home", "b", "2024-01-01", 2.0, False), ("f", "s", "1x2", "away", "b", "2024-01-01", 2.0, False)], "fixture_id string, source_id string, market_family string, selection_id string, bookmaker string, captured_at_utc string, decimal_odds double, is_closing_snapshot boolean")
    settled = spark.createDataFrame([("f", "1x2", "home", "2024-01-02", "loss", "2024-01-03"), ("f", "1x2", "home", "2024-01-04", "win", "2023-12-31")], "fixture_id string, market_family string, selection_id string, settled_at_utc string, settlement_result string, label_available_after_utc string")
    assert {r.no_vig for r in medallion.silver_odds(odds).collect()} == {0.5}
    gold = medallion.gold_candidates(odds, settled).collect()
    assert [(r.settlement_result, r.leakage_safe) for r in gold] == [("win", False)]
    with pytest.raises(ValueError, match="review"):
        medallion.silver_facts(False, odds=odds)


def test_stream_appends_and_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a") for m in (1, 2, 20)]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    snapshots.append(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = snapshots.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_streamed_scores_see_only_the_past(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h)) for h in (1, 3)], "k string, observed_at timestamp").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 2), 7)], "k string, observed_at timestamp, x int")
    stream = spark.readStream.schema("k string, observed_at timestamp").parquet(str(tmp_path / "in"))
    snapshots.score(stream, lambda: known, ["k"], lambda df: df.withColumn("p", F.col("x") / 10), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert [(r.observed_at.hour, r.p) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("observed_at").collect()] == [(1, None), (3, 0.7)]


def test_prices_with_short_and_bad_rows(spark, tmp_path):
    import pytest

    (tmp_path / "p.csv").write_text("market_id,selection,odds,bookmaker\nm,home,1.5,b\nm,away\n\nm,draw,3.25,\n")
    assert [tuple(r) for r in readers.prices(spark, str(tmp_path / "p.csv")).collect()] == [("m", "home", 1.5, "b"), ("m", "draw", 3.25, "")]
    (tmp_path / "q.csv").write_text("market_id,selection,odds,bookmaker\nm,home,high,b\n")
    with pytest.raises(Exception, match="malformed price"):
        readers.prices(spark, str(tmp_path / "q.csv")).collect()
