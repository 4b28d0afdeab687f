import json

from pyspark.sql import functions as F

from fieldlark.plans import provider
from fieldlark.sources import lines, providers

STATE = {
    "response": [
        {
            "fixture": {"id": 7, "date": "2024-01-01T12:00:00Z", "status": {"short": "FT", "elapsed": 90}},
            "league": {"id": 1, "name": "L", "season": 2024},
            "teams": {"home": {"id": 1, "name": "Red"}, "away": {"id": 2, "name": "Blue"}},
            "goals": {"home": 2, "away": 1},
            "score": {"halftime": {"home": 1, "away": 1}},
            "events": [{"time": {"elapsed": 50}, "team": {"id": 1}, "player": {"id": 9}, "type": "Card", "detail": "Yellow Card"}],
            "lineups": [{"team": {"id": 1}, "startXI": [{"player": {"id": 9, "name": "P", "number": 4, "pos": "D"}}], "substitutes": [{"player": {"id": 10}}]}],
            "statistics": [{"team": {"id": 1}, "statistics": [{"type": "Corner Kicks", "value": 5}, {"type": "Ball Possession", "value": "55%"}]}, {"team": {"id": 2}, "statistics": [{"type": "Corner Kicks", "value": 4}]}],
        }
    ]
}


def test_match_state(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(STATE))
    s = providers.match_state(spark, str(tmp_path / "s.json"))
    m = providers.matches(s)
    assert (m.first().outcome, m.first().home_half) == ("H", 1) and providers.teams(s).count() == 2
    e, stats = providers.events(s), providers.statistics(s)
    assert (e.first().period, e.first().type) == ("2", "card") and [r.starts for r in providers.lineups(s).collect()] == [True, False]
    assert {r.value for r in stats.where("type = 'Ball Possession'").collect()} == {55.0}
    got = {r.truth: r.value for r in providers.truths(m, stats, e).collect()}
    assert got == {"home_goals": 2, "away_goals": 1, "score_margin_home": 1, "total_goals": 3, "total_corners": 9, "yellow_cards": 1, "red_cards": 0}


def test_raw_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    assert [(r.line, r.value) for r in lines.raw_lines(spark, str(tmp_path / "a.txt")).collect()] == [(1, "x"), (3, "y")]


def test_first_pass_scores_settled_rows_alone(spark):
    markets = spark.createDataFrame([("e", "1", "football_1x2_regulation", 2.0, 0), ("e", "2", "", 2.0, 0), ("e", "3", "m", 4.0, 0), ("e", "4", "m", 4.0, 1)], "canonical_event_id string, source_ref string, mapped_market_id string, decimal_odds double, needs_mapping int")
    graded = spark.createDataFrame([("e", "1", "win", "settled"), ("e", "3", "push", "settled"), ("e", "4", "win", "settled")], "canonical_event_id string, source_ref string, settlement_result string, settlement_status string")
    snaps = provider.market_snapshots(markets, graded)
    assert snaps.where("snapshot_stage = 'pre_event_market' AND settlement_result IS NOT NULL").count() == 0
    rows = provider.first_pass(snaps).collect()
    assert [r.source_ref for r in rows] == ["1"] and abs(rows[0].p - 0.45) < 1e-9


def test_results_and_reports(spark):
    fixtures = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "fixture_id string, kickoff string")
    results = spark.createDataFrame([("a", "2024-01-03", 1), ("b", "2024-01-01", 2), ("c", "2024-01-03", 3)], "fixture_id string, label_time string, goals int")
    good, bad = provider.results_into_fixtures(fixtures, results)
    assert {r.fixture_id: r.goals for r in good.collect()} == {"a": 1, "b": None}
    assert {r.fixture_id: r.error for r in bad.collect()} == {"b": "label_before_kickoff", "c": "orphan"}
    rows = spark.createDataFrame([(0, "k", 1), (1, "k", 2), (2, "j", None)], "position int, id string, v int")
    r = provider.import_report(rows, "id", F.when(F.col("v").isNull(), "no_value")).first()
    assert (r.input_rows, r.accepted, r.refused) == (3, 1, {"duplicate": 1, "no_value": 1})
