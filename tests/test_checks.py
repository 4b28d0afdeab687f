import json

from pyspark.sql import functions as F

from fieldlark.operators import bronze_rules, checks, metrics, resolve


def test_state_payloads_by_shape(spark):
    fine = {"fixture": {"id": 1, "date": "2024-01-01T00:00:00Z"}, "teams": {"home": {"id": 1}, "away": {"id": 2}}, "goals": {"home": 0, "away": 1}, "events": [{"time": {"elapsed": 3}, "team": {"id": 1}, "type": "Goal", "player": {"id": 9}}]}
    cases = {
        "fine": ({"response": [fine]}, []),
        "empty": ({"response": []}, ["response must not be empty"]),
        "none": ({}, ["response must be an array"]),
        "no events": ({"response": [{**fine, "events": None}]}, ["response.events must be an array"]),
        "fields": (
            {"response": [{**fine, "goals": {"home": "2"}, "events": [{"time": {}, "team": {"id": 1}, "type": " "}]}]},
            ["missing number field: response.events.player.id", "missing number field: response.events.time.elapsed", "missing number field: response.goals.away", "missing number field: response.goals.home", "missing string field: response.events.type"],
        ),
    }
    rows = [(k, "match_state", json.dumps(p)) for k, (p, _) in cases.items()] + [("bad", "match_state", "{oops"), ("null", "odds", None), ("other", None, "{}")]
    got = {r.payload_id: (r.blockers, r.contract_ok) for r in checks.payload_health(spark.createDataFrame(rows, "payload_id string, kind string, payload string")).collect()}
    assert {k: got[k] for k in cases} == {k: (want, not want) for k, (_, want) in cases.items()}
    assert got["bad"][0] == ["response must be an array"] and got["null"][0] == ["odds fixture must be an array"] and got["other"] == (["unsupported provider fixture validation: "], False)


def test_patches_add_what_is_not_known(spark):
    markets = spark.createDataFrame([("m1", "core")], "canonical_market_id string, family string")
    aliases = spark.createDataFrame([("p", "k1", "m1")], "provider_id string, provider_market_key string, canonical_market_id string")
    new = spark.createDataFrame([("m1", "other"), ("m2", "goals")], markets.schema)
    more = spark.createDataFrame([("p", "k1", "m2"), ("p", "k2", "m2"), ("q", "k1", "m2")], aliases.schema)
    a, b = resolve.applied(markets, aliases, new, more)
    assert sorted(map(tuple, a.collect())) == [("m1", "core"), ("m2", "goals")]
    assert sorted(map(tuple, b.collect())) == [("p", "k1", "m1"), ("p", "k2", "m2"), ("q", "k1", "m2")]
    full = spark.createDataFrame([("m", "f", "s", "x", "c")], "canonical_market_id string, family string, settlement_rule string, selection_scope string, correlation_group string")
    said = spark.createDataFrame([("k", False)], "provider_market_key string, review_required boolean")
    assert resolve.patch_faults({"scope": "offline_sample_only"}, full, said, ["k"]).count() == 0
    assert {r.fault for r in resolve.patch_faults({}, full.limit(0), said.limit(0), ["k"]).collect()} == {"scope_not_offline", "no_markets", "no_aliases"}


def test_bronze_values_that_no_table_has(spark):
    texts = ["1.5", " 2 ", "1", "1000", "1.5f", "nan", "inf", "1e2", ".5e1", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(bronze_rules.price_fault(F.trim(F.coalesce("t", F.lit(""))))).collect()]
    assert got == [False, False, True, True, True, True, True, False, False, True, True]
    row = spark.createDataFrame([("r", None, None, None, None, None)], "row_id string, row_class string, schema_status string, missing_fields array<string>, review_reason string, values map<string,string>")
    assert bronze_rules.validated(row).first().review_reasons == ["missing_value_payload", "schema_not_ok"]
    empty = bronze_rules.readiness(bronze_rules.validated(row.limit(0))).first()
    assert (empty.total_rows, empty.blocked_rows, empty.blockers, empty.ready_for_training) == (0, 0, [], False)


def test_domains(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (1.2,), (float("inf"),)], "x double")
    assert [tuple(r) for r in df.select(metrics.is_probability(F.col("x")), metrics.is_price(F.col("x"))).collect()] == [(True, False), (False, False), (False, False), (False, True), (False, False)]
