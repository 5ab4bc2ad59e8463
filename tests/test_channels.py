"""Search channels, routes, states of subjects and timelines on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracefold.functions import urls
from tracefold.operators import channels, ledger, snapshots


def test_public_addresses(spark):
    given = ["https://a.example/x#part", "a.example/y", " http://a.example ", "", None, "ftp://a.example/", "http://10.0.0.1/", "https://u@a.example/", "mailto:x"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "k int, url string")
    got = [r[0] for r in rows.select("k", urls.public_address(F.col("url")).alias("u")).orderBy("k").select("u").collect()]
    assert got == ["https://a.example/x", "https://a.example/y", "http://a.example", None, None, None, None, None, None]


RESULTS = [
    ("c", "r1", 1, "https://a.example/x", "s"),
    ("c", "r1", 2, "https://a.example/x#again", None),
    ("c", "r1", 3, "https://google.com/search?q=x", "s"),
    ("c", "r2", 4, "https://b.example/", None),
    ("c", "r2", 5, "https://old.example/", "s"),
    ("c", "r2", 6, "http://127.0.0.1/", "s"),
    ("d", "r3", 7, "https://a.example/x", None),
    ("d", "r3", 8, None, "s"),
    (None, "r4", 9, "https://a.example/x", "s"),
]


def judged(spark):
    rows = spark.createDataFrame(RESULTS, "case_id string, run string, seq int, url string, snippet string")
    return channels.judged(rows, spark.createDataFrame([("c", "https://old.example/"), ("c", "https://old.example/"), ("d", "https://b.example/")], "case_id string, key string"))


def test_each_result_has_one_disposition(spark):
    got = {r.seq: r.disposition for r in judged(spark).collect()}
    assert got == {1: "stored", 2: "duplicate", 3: "rejected", 4: "stored", 5: "seen", 6: "rejected", 7: "stored", 8: "rejected", 9: "duplicate"}
    assert judged(spark).count() == len(RESULTS)


def test_profiles_share_a_key_whatever_their_query(spark):
    rows = spark.createDataFrame([("c", "r", 1, "https://github.com/x?tab=a", "s"), ("c", "r", 2, "https://github.com/x/", "s"), ("c", "r", 3, "https://a.example/?p=1", "s"), ("c", "r", 4, "https://a.example/?p=2", "s")], "case_id string, run string, seq int, url string, snippet string")
    got = {r.seq: r.disposition for r in channels.judged(rows, spark.createDataFrame([], "case_id string, key string")).collect()}
    assert got == {1: "stored", 2: "duplicate", 3: "stored", 4: "stored"}


def test_accounts_and_coverage_of_runs(spark):
    runs = [("c", "r1", "p", True, 3, "ok"), ("c", "r2", "p", True, 2, "rate_limited"), ("d", "r3", "p", True, 1, "ok"), ("e", "r5", "p", False, 1, "unavailable"), ("e", "r6", "p", True, 1, "budget_exhausted"), ("e", "r7", "p", True, 1, "failed"), ("e", "r8", "p", True, 0, "ok"), ("e", "r9", "p", True, 1, "ok"), ("e", "r10", "p", True, 1, "rate_limited")]
    runs = spark.createDataFrame(runs, "case_id string, run string, provider string, configured boolean, planned int, outcome string")
    tried = [("c", "r1", "q", False), ("c", "r1", "q", False), ("c", "r1", "w", True), ("c", "r2", "q", None), ("d", "r3", "q", False), ("e", "r7", "q", True), ("e", "r9", "q", False), ("e", "r10", "q", False)]
    searches = spark.createDataFrame(tried, "case_id string, run string, query string, failed boolean")
    out = {r.run: r for r in channels.coverage(channels.accounts(runs, searches, judged(spark))).collect()}
    r1, r2 = out["r1"], out["r2"]
    assert (r1.planned, r1.queries_run, r1.distinct_queries, r1.failures, r1.results_seen, r1.results_stored, r1.duplicates, r1.rejected_urls, r1.low_context_results) == (3, 2, 1, 1, 3, 1, 1, 1, 0)
    assert (r2.results_seen, r2.results_stored, r2.duplicates, r2.rejected_urls, r2.low_context_results) == (3, 1, 1, 1, 1)
    states = {run: (r.state, r.partial) for run, r in out.items()}
    assert states == {
        "r1": ("FOUND", False), "r2": ("FOUND", True), "r3": ("FOUND", False), "r5": ("PROVIDER_NOT_CONFIGURED", False), "r6": ("SKIPPED", False),
        "r7": ("FAILED", False), "r8": ("NOT_SEARCHED", False), "r9": ("NO_MATCH_RETURNED", False), "r10": ("SKIPPED", True),
    }


@pytest.mark.parametrize(
    ("payload", "source", "route"),
    [
        ('{"access": "reference_only"}', "provider_search", "supplied_anchor"),
        ('{"signal": "SAME_USERNAME"}', None, "supplied_anchor"),
        ('{"evidence": "profile_exists_for_supplied_handle"}', "orcid", "handle_check"),
        ('{"corroborated_by": ["username"]}', "provider_search", "provider_search"),
        ('{"corroborated_by": ["employer", "username"]}', "orcid", "supplied_anchor"),
        ('{"corroborated_by": "username"}', "orcid", "api_record"),
        ("[]", "manual_search_recon", "manual_import"),
        (None, None, "name_search"),
    ],
)
def test_routes(spark, payload, source, route):
    rows = spark.createDataFrame([(payload, source)], "p string, s string")
    assert rows.select(channels.route(F.try_parse_json("p"), F.col("s"))).first()[0] == route


def test_all_routes_are_kept_the_strongest_first(spark):
    rows = spark.createDataFrame([("a", r) for r in ("provider_search", "odd", "published_link", "provider_search", None, "")] + [("b", None)], "k string, route string")
    got = channels.routes_of(rows, ["k"]).collect()
    assert [(r.k, r.strongest, r.routes) for r in got] == [("a", "published_link", ["published_link", "provider_search", "odd"])]


def test_standings(spark):
    rows = spark.createDataFrame([("github",), ("orcid",), ("x",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(channels.standing(F.col("s")).alias("t")).select("t", channels.standing_rank(F.col("t"))).collect()]
    assert got == [("PUBLIC_SELF_PUBLISHED", 2), ("PUBLIC_PROFESSIONAL", 1), ("UNVERIFIED_PUBLIC_REFERENCE", 3), ("UNVERIFIED_PUBLIC_REFERENCE", 3)]


def observed(spark, subject, states):
    at = dt.datetime(2024, 5, 1)
    return spark.createDataFrame([(subject, s, "observer", at) for s in states], "subject_type string, state string, collector string, observed_at timestamp")


def test_states_come_back_with_defaults(spark):
    got = snapshots.rehydrated(observed(spark, "RELATIONSHIP", ['{"id": "1", "type": "", "confidence": null}', "{"]), "RELATIONSHIP", []).collect()
    for r in got:
        assert (r.type, r.strength, r.confidence, r.collector, r.confidence_reasons) == ("MENTIONS", "WEAK_ASSOCIATION", 0.0, "observer", [])
    assert sorted(r.id or "" for r in got) == ["", "1"]
    found = snapshots.rehydrated(observed(spark, "FINDING", ['{"kind": "DOMAIN", "collector": "", "observed_at": "no date", "redacted": true}']), "FINDING", []).first()
    assert (found.kind, found.collector, found.observed_at, found.redacted, found.classification, found.summary) == ("DOMAIN", "observer", None, True, "PUBLIC", None)
    assert snapshots.rehydrated(observed(spark, "EVIDENCE", ["{}"]), "EVIDENCE", []).first().retrieved_at == dt.datetime(2024, 5, 1)


def test_a_state_survives_another_time_zone_and_nests(spark):
    rows = spark.createDataFrame([(7, 0.12345678, '{"a": {"b": [1, null]}}', ["z", "a"], dt.datetime(2024, 1, 2, 3, 4, 5, 678901))], "id long, confidence double, j string, evidence_sha256 array<string>, observed_at timestamp")
    kept = snapshots.snapshots(rows.withColumn("data", F.parse_json("j")).withColumn("case_id", F.lit("c")), "FINDING", ["case_id"]).collect()
    assert (kept[0].case_id, kept[0].subject_type, kept[0].subject_id) == ("c", "FINDING", "7")
    zone = spark.conf.get("spark.sql.session.timeZone")
    want = rows.select(F.unix_micros("observed_at")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        back = snapshots.rehydrated(observed(spark, "FINDING", [kept[0].state]), "FINDING", ["subject_type"])
        r = back.select("*", F.unix_micros("observed_at").alias("us"), F.to_json("data").alias("json")).drop("data").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.id, r.confidence, r.us, r.json, r.evidence_sha256) == ("7", 0.123457, want, '{"a":{"b":[1,null]}}', ["a", "z"])


def test_timeline_shows_known_parts_only(spark):
    day = dt.datetime(2024, 1, 1)
    data = '{"domain": "a.example", "secret": "x", "issuer": null, "repository": {"name": "r"}}'
    rows = [("c", 1, "CERTIFICATE", day, "t" * 400, data), ("c", 2, "ODD_KIND", day, None, "[1]"), ("c", 3, "CERTIFICATE", None, "t", data), ("c", 4, "COMMIT_ACTIVITY", day + dt.timedelta(1), "t", None)]
    rows = spark.createDataFrame(rows, "case_id string, finding_id int, kind string, observed_at timestamp, title string, data string")
    got = {r.finding_id: r for r in ledger.timeline_entries(rows).collect()}
    assert sorted(got) == [1, 2, 4] and len(got[1].title) == 300
    assert got[1].attributes == {"domain": "a.example", "issuer": None, "repository": '{"name":"r"}'}
    assert got[2].attributes == got[4].attributes == {} and got[2].entry == "odd_kind"
    assert [r.finding_id for r in ledger.in_order(ledger.timeline_entries(rows), "observed_at", "finding_id").collect()] == [1, 2, 4]
    assert [r.finding_id for r in ledger.in_order(ledger.timeline_entries(rows, ["certificate", "odd_kind"]), "observed_at", "finding_id", True).collect()] == [2, 1]
    assert [(r.finding_id, r.rank) for r in ledger.timeline_preview(ledger.timeline(rows), ["case_id"], "observed_at", "finding_id", 2).orderBy("rank").collect()] == [(4, 1), (2, 2)]
