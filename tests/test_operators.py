import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import aggregates, bets, dedupe, dixon_coles, history, hybrid, joins, metrics, models, ratings, refits, resolve, rules, walkforward


def team_rows(n=300, seed=3):
    rnd = random.Random(seed)
    return [(i, f"t{rnd.randrange(9)}", dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60)), rnd.choice([None, *range(5)])) for i in range(n)]


SCHEMA = "id int, team string, day date, goals int"


def test_filtered_history_is_a_sequential_simulation(spark):
    rows = team_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("goals", F.col("goals").cast("double"))
    got = {r.id: (r.games, r.goals_avg) for r in history.rolling_filtered(df, ["team"], ["day", "id"], F.col("goals").isNotNull(), ["goals"], 4).collect()}
    past = {}
    for i, team, _, goals in sorted(rows, key=lambda r: (r[2], r[0])):
        last = past.setdefault(team, [])[-4:]
        assert got[i][0] == len(last) and got[i][1] == (pytest.approx(sum(last) / len(last)) if last else None)
        if goals is not None:
            past[team].append(goals)


def test_rolling_history_does_not_leak(spark):
    df = spark.createDataFrame(team_rows(), SCHEMA)
    cut = dt.date(2024, 2, 1)
    whole = history.rolling(df, ["team"], ["day", "id"], ["goals"], 10, "day").where(F.col("day") < cut)
    early = history.rolling(df.where(F.col("day") < cut), ["team"], ["day", "id"], ["goals"], 10, "day")
    assert sorted(map(str, whole.collect())) == sorted(map(str, early.collect()))


def test_strict_history_ignores_the_same_day(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), 2), (2, "a", dt.date(2024, 1, 2), 4), (3, "a", dt.date(2024, 1, 2), 6)], SCHEMA)
    got = {r.id: r.goals_avg for r in history.rolling_strict(df, ["team"], F.col("day"), ["goals"], 30).collect()}
    assert got == {1: None, 2: 2.0, 3: 2.0}


def test_prior_sums_to_one_and_starts_even(spark):
    rows = [(i, dt.date(2024, 1, 1 + i // 4), "HDA"[i % 3]) for i in range(20)]
    got = history.global_prior(spark.createDataFrame(rows, "id int, day date, y string"), "day", ["id"], "y", list("HDA")).orderBy("id").collect()
    assert tuple(got[0])[3:] == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    for k, r in enumerate(got):
        seen = [y for _, _, y in rows[:k]]
        assert (r.p_H, r.p_D, r.p_A) == pytest.approx(tuple((1 + seen.count(c)) / (3 + k) for c in "HDA"))


def test_split_leaves_the_training_minimum(spark):
    df = spark.range(300).withColumn("day", F.expr("date_add(DATE '2024-01-01', CAST(id % 9 AS INT))"))
    counts = {r[0]: r[1] for r in history.chronological_split(df, "day", ["id"], 0.5).groupBy("part").count().collect()}
    assert counts == {"train": 200, "eval": 100}
    assert history.chronological_split(df.limit(20), "day", ["id"]).select("part").distinct().first()[0] == "blocked"


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 7, "z"), ("a", 2, "w")], "k string, rt int, v string")
    got = {r.id: (r.rt, r.v) for r in joins.as_of(left, right, ["k"], "t", "rt", ["v"], ["v"]).collect()}
    assert got == {1: (5, "y"), 2: (None, None), 3: (None, None)}


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, None)], "k string, n int, v string")
    assert {tuple(r) for r in dedupe.keep_first(df, ["k"], ["n"]).collect()} == {("a", 1, "x"), (None, 3, None)}
    assert {tuple(r) for r in dedupe.keep_last(df, ["k"], ["n"]).collect()} == {("a", 2, "y"), (None, 3, None)}


def test_update_keeps_what_has_no_change(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, m string")
    new = spark.createDataFrame([(2, "c")], "id int, m string")
    assert sorted(map(tuple, dedupe.update(df, new, ["id"], ["m"]).collect())) == [(1, "a"), (2, "c")]


def test_poisson_grid(spark):
    import math

    df = spark.createDataFrame([(1.4, 0.9)], "h double, a double")
    r = models.grid_probabilities(df, "h", "a").first()
    pmf = lambda m, k: math.exp(-m) * m**k / math.factorial(k)
    cells = {(i, j): pmf(1.4, i) * pmf(0.9, j) for i, j in itertools.product(range(9), repeat=2)}
    total = sum(cells.values())
    assert r.p_home == pytest.approx(sum(p for (i, j), p in cells.items() if i > j) / total)
    assert r.p_home + r.p_draw + r.p_away == pytest.approx(1) and r.likely_score == "1-0"


def dense_dixon_coles(rows, xi, l2):
    """The optimum by Newton steps on numeric derivatives, from the matches themselves."""
    teams = sorted({t for r in rows for t in r[2:4]})
    n, last = len(teams), max(r[1] for r in rows)
    h, a = (np.array([teams.index(r[k]) for r in rows]) for k in (2, 3))
    x, y = (np.array([r[k] for r in rows], float) for k in (4, 5))
    w = np.exp(-xi * np.array([(last - r[1]).days for r in rows]))

    def loss(p):
        at, de, (base, own, rho) = p[:n] - p[:n].mean(), p[n : 2 * n] - p[n : 2 * n].mean(), p[2 * n :]
        l, m = np.exp(base + own + at[h] + de[a]), np.exp(base + at[a] + de[h])
        tau = np.select([(x == i) & (y == j) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))], [1 - l * m * rho, 1 + l * rho, 1 + m * rho, 1 - rho + 0 * l], 1.0)
        return -(w * (x * np.log(l) - l + y * np.log(m) - m + np.log(tau))).sum() + l2 * ((at**2).sum() + (de**2).sum() + own**2 + rho**2)

    eye, p = np.eye(2 * n + 3), np.zeros(2 * n + 3)
    slope = lambda q: np.array([(loss(q + 1e-5 * e) - loss(q - 1e-5 * e)) / 2e-5 for e in eye])
    for _ in range(8):
        curve = np.array([(slope(p + 1e-4 * e) - slope(p - 1e-4 * e)) / 2e-4 for e in eye])
        p = p - np.linalg.lstsq(curve, slope(p), rcond=1e-9)[0]
    return {t: (p[i] - p[:n].mean(), p[n + i] - p[n : 2 * n].mean()) for i, t in enumerate(teams)}, p[2 * n :]


def dixon_coles_matches(n, teams="abcdef", seed=1):
    rnd = random.Random(seed)
    goals = lambda m: sum(rnd.random() < m / 20 for _ in range(20))
    out = []
    for i in range(n):
        h, a = rnd.sample(teams, 2)
        out.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), h, a, goals(2.4 if h == "a" else 1.5), goals(1.8 if a == "a" else 1.1)))
    return out


MATCHES = "id int, day date, home string, away string, home_goals int, away_goals int"


def test_dixon_coles_fits_equal_dense_optima_of_each_fold(spark):
    rows = dixon_coles_matches(600)
    odd = [(900, dt.date(2020, 1, 5), "a", "b", None, 3), (901, None, "a", "c", 2, 1), (902, dt.date(2020, 1, 6), None, "c", 9, 0)]  # no score; no day, and no team, which have an index alone
    df = spark.createDataFrame(rows + odd, MATCHES)
    folds = walkforward.folds(df, "day", ["id"], 322, 200)
    fitted = dixon_coles.fit(dixon_coles.pair_sums(folds, "day", 0.004), 0.05).toPandas()
    order = sorted(rows + odd[1:], key=lambda r: (r[1] or dt.date(1, 1, 1), r[0]))
    assert sorted(set(fitted.fold)) == [0, 1] and fitted.settled.all()
    for fold, part in fitted.groupby("fold"):
        train = [r for r in order[: 322 + 200 * fold] if r[1] and r[2]]
        strengths, own = dense_dixon_coles(train, 0.004, 0.05)
        assert {t: (a, d) for t, a, d in part[["team", "attack", "defence"]].itertuples(index=False)} == {t: pytest.approx(v, abs=1e-4) for t, v in strengths.items()}
        assert part[["base", "home_advantage"]].iloc[0].tolist() == pytest.approx(own[:2], abs=1e-4)
        assert part.rho.iloc[0] == pytest.approx(np.clip(own[2], -0.1, 0.1), abs=1e-4) or abs(own[2]) > 0.1
    assert dixon_coles.fit(dixon_coles.pair_sums(folds.limit(0), "day", 0.004)).count() == 0


def test_dixon_coles_walk_forward_uses_earlier_matches_only(spark):
    rows = dixon_coles_matches(80)
    df = spark.createDataFrame(rows, MATCHES)
    run = lambda df: {r.id: r for r in dixon_coles.walk_forward(df, "day", ["id"], 50, 15).collect()}
    got, later = run(df), run(df.withColumn("home_goals", F.when(F.col("id") >= 65, 9).otherwise(F.col("home_goals"))))
    assert sorted(got) == list(range(50, 80)) and all(got[i].lambda_home == pytest.approx(later[i].lambda_home) for i in range(50, 80))
    assert got[51].p_home + got[51].p_draw + got[51].p_away == pytest.approx(1)
    fitted = dixon_coles.checkpointed(dixon_coles.fit(dixon_coles.pair_sums(walkforward.folds(df, "day", ["id"], 50, 15), "day", 0.001)))
    two = spark.createDataFrame([(0, "a", "b"), (0, "new", "b"), (7, "a", "b")], "fold int, home string, away string")
    by = {(r.fold, r.home): r for r in dixon_coles.rates(two, fitted).collect()}
    assert by[0, "a"].lambda_home > by[0, "new"].lambda_home and by[7, "a"].lambda_home is None
    neutral = {r.home: r.lambda_home for r in dixon_coles.rates(two.where("fold = 0"), fitted, F.lit(True)).collect()}
    assert by[0, "a"].lambda_home == pytest.approx(neutral["a"] * math.exp(fitted.where("fold = 0").first().home_advantage))


def test_walk_forward_leaves_out_unplayed_matches(spark):
    rnd = random.Random(5)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), *rnd.sample("abcd", 2), None if i % 3 == 1 else rnd.randrange(4), rnd.randrange(3) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, MATCHES)
    known = [r for r in rows if r[4] is not None and r[5] is not None]
    for every in (1, 4):
        got = {r.id: r for r in walkforward.team_averages(df, "day", ["id"], 8, every).collect()}
        assert sorted(got) == [r[0] for r in known[8:]]
        for k, (i, _, home, away, *_) in enumerate(known[8:], 8):
            past = known[: k - (k - 8) % every]
            sides = [(h, x, y) for _, _, h, a, x, y in past] + [(a, y, x) for _, _, h, a, x, y in past]
            mean = max(sum(x for _, x, _ in sides) / len(sides), 0.5)
            of = lambda t, j: float(np.mean(v)) if (v := [s[j] for s in sides if s[0] == t]) else mean  # noqa: B023, E731
            assert (got[i].lambda_home, got[i].lambda_away) == pytest.approx((max((of(home, 1) + of(away, 2)) / 2, 0.1), max((of(away, 1) + of(home, 2)) / 2, 0.1)))
    assert walkforward.scored(spark.createDataFrame([(0, None, 1, 0.5, 0.3, 0.2, 0.5, 0.5)], "fold int, home_goals int, away_goals int, p_home double, p_draw double, p_away double, p_over25 double, p_btts double"), ["fold"]).count() == 0
    plan = walkforward.average_rates(df, "day", ["id"], 8)._jdf.queryExecution().toString()
    assert "Window" in plan


def test_running_sums_by_fold_have_two_levels(spark, monkeypatch):
    monkeypatch.setattr(walkforward, "WIDTH", 3)
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(-1, 20), rnd.randrange(5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "team string, fold int, g int")
    got = {(r.team, r.fold): (r.g, r.n) for r in walkforward.trained(df, ["team"], {"g": F.col("g"), "n": F.lit(1)}).collect()}
    assert got == {(t, f): (sum(g for u, k, g in rows if u == t and k < f), sum(u == t and k < f for u, k, _ in rows)) for t, f, _ in rows}
    assert {r.fold: r.g for r in walkforward.trained(df, [], {"g": F.col("g")}).collect()} == {f: sum(g for _, k, g in rows if k < f) for _, f, _ in rows}


def test_form_counts_played_matches(spark):
    rows = [(i, dt.date(2020, 1, 1 + 2 * i), "x", f"o{i}", None if i in (2, 5) else 2, 1 if i % 2 else 3) for i in range(10)]
    out = {r.id: r for r in walkforward.form(spark.createDataFrame(rows, MATCHES), [], "day", ["id"], last=2).collect()}
    won = [None if r[4] is None else int(r[4] > r[5]) for r in rows]
    for i in range(10):
        past = [w for w in won[:i] if w is not None][-2:]
        assert out[i].form_diff == pytest.approx((sum(past) / len(past) if past else 0.5) - 0.5)
    assert out[6].rest_diff == pytest.approx((4 - 7) / 7, abs=1e-6)  # since match 4, as match 5 was not played


def test_softmax_artifact_scores_as_trained(spark):
    rnd = random.Random(2)
    rows = [(x := rnd.uniform(-2, 2), "H" if x + rnd.gauss(0, 0.5) > 0 else "A") for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y string")
    artifact = models.train_softmax(df, ["x"], "y", ["H", "D", "A"])
    p = models.linear_scores({"x": F.col("x")}, artifact)
    out = df.select("x", *(c.alias(n) for c, n in zip(p, "HDA", strict=True))).collect()
    assert sum((r.H > r.A) == (r.x > 0) for r in out) > 190 and all(r.D < 0.05 for r in out)


def test_elo_is_zero_sum(spark):
    rows = [(i, f"c{i % 2}", "domestic", dt.date(2024, 1, 1 + i), "abc"[i % 3], "abc"[(i + 1) % 3], float(i % 3), None if i == 7 else 1.0) for i in range(12)]
    schema = "match_id long, competition string, kind string, day date, home string, away string, home_goals double, away_goals double"
    got = {r.match_id: r for r in ratings.elo(spark.createDataFrame(rows, schema)).collect()}
    for c in ("c0", "c1"):
        table = ratings.Elo(18.0)
        for i, comp, _, _, h, a, x, y in rows:
            if comp == c:
                want = table.play(h, a, x, float("nan") if y is None else y)
                assert (got[i].home_rating, got[i].away_rating) == pytest.approx(want[:2])
        assert sum(table.ratings.values()) == pytest.approx(1500 * len(table.ratings))


def test_fuzzy_resolution_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    aliases = [("manchester united", "1"), ("manchester city", "2"), ("shots on target", "3"), ("corners", "4"), ("shots", "5")]
    names = ["manchester united", "manchestr united", "cornere", "shots on targets", "nothing", "shots"]
    got = {r.name: (r.canonical_id, r.confidence, r.auto) for r in resolve.resolve(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(aliases, "alias string, canonical_id string")).collect()}
    for n in names:
        best = max((0.99 if n == a else SequenceMatcher(None, n, a).ratio(), v) for a, v in aliases)
        assert got[n] == ((best[1], pytest.approx(best[0]), best[0] >= 0.95) if best[0] >= 0.84 else (None, None, False)), n


def test_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5), (3, None, 5)], "id int, odds double, line int")
    rs = {"price": F.coalesce(F.col("odds") <= 1, F.lit(True)), "line": F.col("line").isNull()}
    assert [tuple(r) for r in df.select(rules.first_reason(rs), F.array_join(rules.reasons(rs), ",")).collect()] == [("price", "line,price"), (None, ""), ("price", "price")]
    good, bad = rules.quarantine(df, rs)
    assert [r.id for r in good.collect()] == [2] and sorted(r.id for r in bad.collect()) == [1, 3]
    assert {r.check_name: r.failures for r in rules.failure_counts(df, rs).collect()} == {"price": 2, "line": 1}
    assert rules.contract({"fields": ["a"], "live": False, "rows": 3}, {"fields": ["a", "b"]}, true=["live"], least={"rows": 5}) == ["fields: missing b", "live: not true", "rows: below 5"]


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 1)], "p double, y int")
    got = [tuple(r) for r in metrics.calibration(df, F.col("p"), F.col("y") == 1, empty="null").orderBy("bin").collect()]
    assert [g[1] for g in got] == [1, 0, 0, 0, 2] and got[1][2] is None and got[4][2] == pytest.approx(0.975)
    assert metrics.calibration(df, F.col("p"), F.col("y") == 1, empty="omit").count() == 2


def test_tickets_and_combinations(spark):
    legs = spark.range(1).select(F.inline(bets.derived_legs(F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0.55), F.lit(0.5)))).withColumn("odds", 1.05 / F.col("p"))
    assert legs.count() == 19
    pairs = joins.combinations(legs, 2)
    assert pairs.count() == 19 * 18 // 2
    best = bets.best_ticket(pairs.withColumn("m", F.lit(1)), 2, ["m"]).first()
    assert best.risk == 0 and best.edge == pytest.approx(1.05**2 - 1)


def test_player_minutes_are_imputed(spark):
    events = spark.createDataFrame([(1, 0.5, 2, 1, 0), (2, 0.0, 0, 0, 3)], "player_id int, xg double, shots int, goals int, cards int")
    lineups = spark.createDataFrame([(1, None)], "player_id int, minutes int")
    got = {r.player_id: r.score for r in aggregates.player_scores(lineups, events).collect()}
    assert got[1] == pytest.approx(min(100, 50 + 1.5 * (9 + 6 + 12))) and got[2] == pytest.approx(50 - 1.5 * 18)


def test_fuzzy_resolution_of_short_names(spark):
    from difflib import SequenceMatcher

    aliases = ["koln", "lyon", "abcdef", "ab", "a", "roma fc", "xyzxyzxy"]
    names = ["koeln", "lyxon", "abxcdyef", "ac", "b", "romafc", "rxoma fc", "xyazxybzxy"]
    got = {r.name: (r.canonical_id, r.confidence) for r in resolve.resolve(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a, a) for a in aliases], "alias string, canonical_id string")).collect()}
    want = {}
    for n in names:
        score, alias = min((-SequenceMatcher(None, n, a).ratio(), a) for a in aliases)
        want[n] = (alias, -score) if -score >= resolve.NEAR else (None, None)
    assert got == want and [got[n][0] for n in names[:3]] == ["koln", "lyon", "abcdef"]


def test_filtered_history_of_null_keys_and_values(spark):
    rows = [(None, 1, 1.0, True), (None, 2, 2.0, True), (None, 3, None, True), (None, 4, 9.0, False), (1, 1, 5.0, False), (1, 2, 7.0, None)]
    df = spark.createDataFrame(rows, "k int, at int, v double, counted boolean")
    got = {(r.k, r.at): (r.games, r.v_avg) for r in history.rolling_filtered(df, ["k"], ["at"], F.col("counted"), ["v"], 2).collect()}
    assert got == {(None, 1): (0, None), (None, 2): (1, 1.0), (None, 3): (2, 1.5), (None, 4): (2, 2.0), (1, 1): (0, None), (1, 2): (0, None)}


def test_rows_without_a_day_come_first(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("2024-01-01", 2, "b"), ("2024-01-02", 3, "a")], "day string, id int, label string").withColumn("day", F.to_date("day"))
    assert [r.row_index for r in history.row_number_in(df, "day", ["id"]).orderBy("id").collect()] == [0, 1, 2]
    p = {r.id: (r.p_a, r.p_b) for r in history.global_prior(df, "day", ["id"], "label", ["a", "b"]).collect()}
    assert p == {1: (0.5, 0.5), 2: (2 / 3, 1 / 3), 3: (0.5, 0.5)}


def test_too_many_legs_are_refused(spark):
    import pytest

    from fieldlark.operators import joins

    with pytest.raises(ValueError, match="more than 3 legs"):
        joins.combinations(spark.range(4).withColumnRenamed("id", "leg"), 2, most=3)


def test_import_findings_on_odd_rows(spark):
    from fieldlark.operators import imports

    fixtures = spark.createDataFrame([(1, 10, "final"), (1, 12, None)], "fixture_id int, kickoff int, result_status string")
    odds = spark.createDataFrame([(1, "h", 13, True, 2.0), (2, "h", 1, False, None), (None, "h", 1, False, float("nan"))], "fixture_id int, selection string, captured_at int, closing boolean, odds double")
    settled = spark.createDataFrame([(1, "h", 11, "win"), (1, "a", 12, None)], "fixture_id int, selection string, label_time int, result string")
    names = spark.createDataFrame([("", "x", 0.9, None), ("n", None, 0.5, "needs_review")], "raw_name string, canonical_id string, confidence double, review_status string")
    got = sorted((r.rule, r.key) for r in imports.findings(fixtures, odds, settled, names).collect())
    assert got == sorted([
        ("duplicate_fixture_id", "1"), ("non_final_fixture", "1"), ("odds_after_kickoff", "1"), ("odds_missing_fixture", "2"), ("invalid_decimal_odds", "2"), ("odds_missing_fixture", ""), ("invalid_decimal_odds", ""),
        ("label_before_kickoff", "1"), ("invalid_settlement_result", "1"), ("empty_identity_field", ""), ("empty_identity_field", "n"),
    ])
    assert imports.findings(fixtures.limit(0), odds.limit(0), settled.limit(0), names.limit(0)).count() == 0


def test_aliases_in_context(spark):
    known = spark.createDataFrame([("j silva", "p1", "t1", None), ("j silva", "p2", "t2", "br"), ("k", "p3", "", ""), ("k", "p0", "t9", None), ("k", "p3", "", "")], "alias string, canonical_id string, team string, country string")
    names = [(1, "j silva", "t1", None), (2, "j silva", "t2", "br"), (3, "j silva", "t2", "pt"), (4, "j silva", None, None), (5, "k", None, None), (6, "j silvaa", "t1", None), (7, None, "t1", None), (8, "zz", None, None), (1, "j silva", "t1", None)]
    got = resolve.resolve_in_context(spark.createDataFrame(names, "id int, name string, team string, country string"), known, ["team", "country"]).collect()
    assert len(got) == 9 and [r.confidence for r in got if r.id == 6] == [pytest.approx(14 / 15)]
    assert {r.id: (r.canonical_id, r.confidence, r.auto) for r in got if r.id != 6} == {
        1: ("p1", 0.99, True), 2: ("p2", 0.99, True), 3: ("p1", 0.88, False), 4: ("p1", 0.88, False), 5: ("p3", 0.99, True), 7: (None, None, False), 8: (None, None, False),
    }


def test_hybrid_chooses_its_share_by_loss(spark):
    rows = [(i, i // 4, float(i % 7) if i % 5 else None, float(i % 3), (i * i) % 3, int(i % 7 > 3)) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, day int, x double, z double, outcome int, over int").coalesce(2)
    fitted = models.fit_hybrid(df, ["x", "z"], ["outcome", "over"], "day", ["id"])
    out = models.hybrid_probabilities(df, fitted).collect()
    assert len(out) == 160 and all(abs(sum(r.p_outcome) - 1) < 1e-9 and len(r.p_over) == 2 for r in out)
    assert fitted["over"][1] == pytest.approx([sum(1 - r[5] for r in rows) / 160, sum(r[5] for r in rows) / 160])
    assert 0 <= fitted["outcome"][2] <= 0.5 and sum((r.p_over[1] > 0.5) == (r.over == 1) for r in out) > 120
    few = models.fit_hybrid(df.where("id < 40"), ["x", "z"], ["over"], "day", ["id"])
    assert few["over"][2] == 0.2
    with pytest.raises(ValueError):
        models.fit_hybrid(df.where("over = 1"), ["x"], ["over"], "day", ["id"])


def test_shares_without_rows_and_with_ties(spark):
    rows = spark.createDataFrame([("a", "h", 0.5)] * 30 + [("b", "h", 0.9), ("b", "?", 0.1)], "k string, label string, p double")
    losses = walkforward.share_losses(rows, ["k"], {"h": F.col("p")}, {"h": F.lit(0.5)}, F.col("label"))
    assert {r.k: (r.rows, r.share) for r in walkforward.chosen_share(losses, ["k"]).collect()} == {"a": (30, 0.0), "b": (1, 0.2)}
    assert walkforward.share_losses(rows.limit(0), ["k"], {"h": F.col("p")}, {"h": F.lit(0.5)}, F.col("label")).count() == 0


def softmax_rows(n=240, seed=8):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rnd.gauss(3, 2), rnd.gauss(0, 1)
        y = rnd.choices("HDA", [np.exp(0.5 * (x - 3)), 1.0, np.exp(-z)])[0]
        out.append((i, -1 if i < 100 else (i - 100) // 50, x, z, 4.0, y))
    return out


def sequential_softmax(rows, l2):
    """One fold's optimum by plain gradient descent to the end, on scaled features."""
    x = np.array([r[2:5] for r in rows])
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0, ddof=1) > 1e-6, x.std(axis=0, ddof=1), 1)
    z, y = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.array([[r[5] == k for k in "HDA"] for r in rows], float)
    w = np.zeros((4, 3))
    for _ in range(8000):
        p = np.exp(z @ w)
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 * (z.T @ (p - y) / len(x) + l2 * np.vstack([w[:3], np.zeros((1, 3))]))
    return lambda v: (e := np.exp(np.append((np.array(v) - mean) / scale, 1) @ w)) / e.sum()


def test_softmax_refits_equal_sequential_ones(spark):
    rows = softmax_rows()
    odd = [(900, -1, None, 1.0, 4.0, "H"), (901, -1, float("nan"), 1.0, 4.0, "H"), (902, -1, 1.0, 1.0, 4.0, "?"), (903, -1, 1.0, 1.0, 4.0, None)]
    df = spark.createDataFrame(rows + odd, "id int, fold int, x double, z double, flat double, y string")
    names = ["x", "z", "flat"]
    fitted = refits.fit(df.repartition(3), names, "y", list("HDA"), 0.03)
    got = fitted.toPandas().set_index("fold")
    assert list(got.index) == [0, 1, 2] and got.settled.all() and got.rows.tolist() == [100, 150, 200]
    out = {r.id: r for r in refits.probabilities(df, fitted, names, list("HDA")).collect()}
    assert sorted(out) == list(range(100, 240))
    for fold in range(3):
        one = sequential_softmax([r for r in rows if r[1] < fold], 0.03)
        assert all((out[r[0]].p_H, out[r[0]].p_D, out[r[0]].p_A) == pytest.approx(tuple(one(r[2:5])), abs=1e-6) for r in rows if r[1] == fold)
    train = [r for r in rows if r[1] < 1]
    assert out[150].prior_H == pytest.approx((1 + sum(r[5] == "H" for r in train)) / (3 + len(train)))
    shown = {r.fold: r for r in refits.report(refits.probabilities(df, fitted, names, list("HDA")), "y", list("HDA"), ["fold"]).collect()}
    assert all(r.aligned for r in shown.values()) and shown[2].other_rows == 40
    assert shown[2].other_log_loss == pytest.approx(np.mean([-np.log(out[r[0]][f"p_{r[5]}"]) for r in rows if r[1] == 2]), abs=1e-6)
    assert refits.fit(df.limit(0), names, "y", list("HDA")).count() == 0
    none = refits.fit(df.where("fold >= 0"), names, "y", list("HDA")).where("fold = 0").first()
    assert none.rows == 0 and none.intercept == [0.0] * 3 and none.prior == pytest.approx([1 / 3] * 3)


def test_hybrid_features_know_earlier_matches_only(spark):
    rnd = random.Random(9)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), *rnd.sample(["a", "b", "c"], 2), rnd.choice([None, 0, 1, 2, 3]), rnd.randrange(3), float(rnd.randrange(9)), None if i % 4 else 5.0) for i in range(40)]
    schema = MATCHES + ", home_shots double, away_shots double"
    ranks = spark.createDataFrame([("a", 3), ("b", 9)], "team string, rank int")
    make = lambda rows: {r.id: r for r in hybrid.features(spark.createDataFrame(rows, schema), "day", ["id"], 3, ranks).collect()}
    got = make(rows)
    for k, (i, day, home, away, x, y, *_) in enumerate(rows):
        past = [r for r in rows[:k] if r[4] is not None]
        mean = max(1.0, sum(r[4] + r[5] for r in past) / (2 * len(past))) if past else 1.25
        view = lambda t: [(r[1], *((r[4], r[5], r[6], r[7]) if r[2] == t else (r[5], r[4], r[7], r[6]))) for r in past if t in r[2:4]][-3:]  # noqa: B023, E731
        avg = lambda t, j, other=None: float(np.mean(v)) if (v := [m[j] for m in view(t) if m[j] is not None]) else other  # noqa: B023, E731
        r = got[i]
        assert r.lambda_home == pytest.approx(max(0.15, (avg(home, 1, mean) + avg(away, 2, mean)) / 2)) and r.games_home == len(view(home))
        sf = avg(home, 3), avg(away, 3)
        assert r.shots_for_diff == (None if None in sf else pytest.approx(sf[0] - sf[1])) and r.sot_for_diff is None
        assert r.rank_diff == {"a": 3, "b": 9}.get(away, 70) - {"a": 3, "b": 9}.get(home, 70)
        rest = [(day - v[-1][0]).days if (v := view(t)) else None for t in (home, away)]
        assert r.rest_days_diff == (None if None in rest else rest[0] - rest[1])
        assert r.outcome == (None if x is None else "H" if x > y else "A" if x < y else "D") and r.p_home + r.p_draw + r.p_away == pytest.approx(1)
    changed = make(rows[:30] + [(*r[:4], 9, 9, 9.0, 9.0) for r in rows[30:]])
    assert all(changed[i][f] == got[i][f] for i in range(31) for f in ("lambda_home", "lambda_away", "shots_for_diff"))


@pytest.mark.parametrize("least", [0.84, 0.6, 0.95])
def test_similar_pairs_equal_all_pairs(spark, least):
    from difflib import SequenceMatcher

    rnd = random.Random(10)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 24))).strip() or "x" for _ in range(60)]

    def noisy(text):
        t = list(text)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(t) + 1)
            kind = rnd.randrange(3)
            t[at : at + (kind > 0)] = [rnd.choice("abcde ")] if kind < 2 else []
        return "".join(t)

    names = list({noisy(rnd.choice(base)) for _ in range(700)})
    one = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.a, r.b): r.similarity for r in resolve.similar_pairs(one([*names, None, ""]), one([*base, base[0], None, ""]), least).collect()}
    want = {}
    for b in set(base):
        m = SequenceMatcher(None, "", b)
        for a in names:
            m.set_seq1(a)
            if a and b and m.real_quick_ratio() >= least and m.quick_ratio() >= least and (s := m.ratio()) >= least:
                want[a, b] = s
    assert got == pytest.approx(want) and len(want) > 100
