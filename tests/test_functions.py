import math

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import odds as O
from fieldlark.functions import scalars as S
from fieldlark.functions import settle, text
from fieldlark.operators import metrics


def values(spark, schema, rows, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_phases(spark):
    cases = [
        (10, "1", "Pass", "regulation_first_half"),
        (45, "1", "Shot", "regulation_first_half_stoppage"),
        (89, "2", "Pass", "regulation_second_half"),
        (90, "2", "Shot", "regulation_second_half_stoppage"),
        (94, "3", "Pass", "extra_time_first_half"),
        (105, "3", "Shot", "extra_time_first_half_stoppage"),
        (110, "4", "Pass", "extra_time_second_half"),
        (120, "4", "Shot", "extra_time_second_half_stoppage"),
        (121, "5", "Penalty Shootout", "penalty_shootout"),
        (50, None, None, "regulation_second_half"),
        (None, "", "", "regulation_first_half"),
    ]
    got = values(spark, "m int, p string, t string, want string", cases, got=S.phase(F.col("m"), F.col("p"), F.col("t")), want=F.col("want"))
    assert all(a == b for a, b in got), got


def test_outcomes_and_targets(spark):
    rows = [(2, 1), (1, 1), (0, 3), (None, 1)]
    h, a = F.col("h"), F.col("a")
    got = values(spark, "h int, a int", rows, o=S.outcome(h, a), p=S.points(h, a), store=S.over_target(h, a), gold=S.over_target(h, a, otherwise=None), b=S.btts_target(h, a))
    assert got == [("H", 3, 1, 1, 1), ("D", 1, 0, None, 1), ("A", 0, 1, 1, 0), (None, None, None, None, None)]


def test_numbers_from_text(spark):
    rows = [(" 3.7 ",), ("",), ("x",), ("NaN",), (None,)]
    got = values(spark, "x string", rows, n=S.number(F.col("x")), w=S.whole(F.col("x")))
    assert got == [(3.7, 3), (None, None), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize(("given", "pivot", "want"), [("2024-03-09", 70, "2024-03-09"), ("9/3/24", 70, "2024-03-09"), ("09-03-99", 70, "1999-03-09"), ("09/03/99", None, "2099-03-09"), ("31/02/2024", 70, "2024-02-31"), ("32/01/2024", 70, None), ("soon", 70, None)])
def test_dates(spark, given, pivot, want):
    assert values(spark, "x string", [(given,)], d=text.iso_date(F.col("x"), pivot)) == [(want,)]


def test_text_forms(spark):
    x = F.col("x")
    got = values(spark, "x string", [("The São Paulo F.C. & Co",), (None,)], n=text.normalize(x), k=text.ascii_key(x), s=text.slug(x))
    assert got == [("sao paulo f c and co", "thesopaulofcco", "the-s-o-paulo-f-c-co"), (None, None, None)]


def test_odds(spark):
    p, o = F.col("p"), F.col("o")
    got = values(spark, "p double, o double", [(0.5, 2.2), (0.5, 1.0), (0.1, 2.0), (1.0, 3.0)], ev=O.expected_value(p, o), k=O.kelly(p, o), z=O.kelly(p, o, no_price=0.0), imp=O.implied(o))
    assert got[0] == pytest.approx((0.1, 0.1 / 1.2, 0.1 / 1.2, 1 / 2.2))
    assert got[1] == (None, None, 0.0, None)
    assert got[2][1] == 0.0 and got[3][1] == 1.0


def test_no_vig_of_bad_legs(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 1.0)], "g string, o double")
    null = [r[0] for r in df.select(O.no_vig(F.col("o"), "g").alias("x"), "g", "o").orderBy("g", F.desc("o")).collect()]
    drop = [r[0] for r in df.select(O.no_vig(F.col("o"), "g", bad="drop").alias("x"), "g", "o").orderBy("g", F.desc("o")).collect()]
    assert null == pytest.approx([1 / 3, 2 / 3, None, None]) and drop == pytest.approx([1 / 3, 2 / 3, 1.0, None])


def test_settlement(spark):
    rows = [(3.0, 2.5, "Over"), (2.0, 2.0, "Over"), (1.0, 2.5, "under 2.5"), (3.0, None, "Over"), (3.0, 2.5, "Home")]
    got = values(spark, "v double, l double, s string", rows, r=settle.total(F.col("v"), F.col("l"), F.col("s")))
    assert [r[0] for r in got] == ["win", "push", "win", "unsettled", "unsettled"]
    rows = [(1.0, -1.0, "H"), (1.0, -0.5, "H"), (1.0, 0.5, "A"), (1.0, 1.0, "X")]
    got = values(spark, "m double, l double, s string", rows, r=settle.handicap(F.col("m"), F.col("l"), F.col("s"), F.lit("H"), F.lit("A")))
    assert [r[0] for r in got] == ["push", "win", "loss", "unsettled"]
    truth = {"winner_name": F.lit("Red"), "total_goals": F.lit(3), "total_corners": F.lit(9), "total_shots_on_target": F.lit(4), "score_margin_home": F.lit(1), "home_team_name": F.lit("Red"), "away_team_name": F.lit("Blue")}
    rows = [("football_1x2_regulation", "Red", None), ("football_total_goals_regulation", "Under", 3.0), (None, "Red", None), ("football_player_shots_on_target_regulation", "x", 1.0)]
    got = values(spark, "m string, s string, l double", rows, r=settle.grade(F.col("m"), F.col("s"), F.col("l"), truth))
    assert [tuple(r[0]) for r in got] == [("win", "settled"), ("push", "settled"), ("unsettled", "unmapped"), ("unsettled", "unsupported")]


def test_ladder(spark):
    cells = settle.ladder(F.lit(2), F.lit(1), F.lit(1), F.lit(0), F.lit(11), F.lit("draw"))
    got = {(r.family, r.selection): (r.result, r.status) for r in spark.range(1).select(F.inline(cells)).collect()}
    assert got["both_teams_to_score", "Yes"] == ("win", "settled") and got["draw_no_bet", "away"] == ("loss", "settled")
    assert got["double_chance", "away_or_draw"][0] == "loss" and got["first_half_1x2", "home"][0] == "loss"
    assert got["to_qualify", "home"] == ("unsettled", "unsupported") and len(got) == 14


@pytest.mark.parametrize(("p", "want"), [((0.4, 0.4, 0.2), {"inference": "H", "linear": "H"}), ((0.2, 0.4, 0.4), {"inference": "A", "linear": "D"}), ((1 / 3, 1 / 3, 1 / 3), {"inference": "H", "linear": "H"})])
def test_ties(spark, p, want):
    row = dict(zip("HDA", map(F.lit, p), strict=True))
    got = spark.range(1).select(*(metrics.pick(row, metrics.TIES[k]).alias(k) for k in want)).first().asDict()
    assert got == want


def test_log_loss_is_finite_at_the_ends(spark):
    got = values(spark, "p double, y int", [(0.0, 1), (1.0, 0), (0.5, 1)], x=O.log_loss(F.col("p"), F.col("y")))
    assert got[2][0] == pytest.approx(math.log(2)) and all(math.isfinite(r[0]) for r in got)
