"""Ways, filtered graphs, agreements, write-back and shared websites against plain versions."""

import random
from collections import Counter, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracefold.functions import scoring
from tracefold.operators import graph, infer

CLAIM = "case_id string, record long, source string, identifier string, value string, imported_from array<string>"


def lines_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def distance(pairs, a):
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    seen, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def test_a_long_way_is_found(spark):
    chain = [f"n{k:02}" for k in range(40)]
    got = graph.paths(lines_of(spark, zip(chain, chain[1:], strict=False)), spark.createDataFrame([("n39", "n00"), ("n03", "n03"), ("n00", "zz")], "origin string, target string")).collect()
    assert {(r.origin, r.target): r.path for r in got} == {("n39", "n00"): chain[::-1], ("n03", "n03"): ["n03"]}


def test_ways_are_shortest_ones(spark):
    rng = random.Random(2)
    names = [f"v{k}" for k in range(40)]
    pairs = {tuple(rng.sample(names, 2)) for _ in range(48)} | {("v0", "v0")}
    ends = [tuple(rng.choices(names, k=2)) for _ in range(25)]
    links = {frozenset(p) for p in pairs}
    got = {(r.origin, r.target): r.path for r in graph.paths(lines_of(spark, pairs), spark.createDataFrame(ends, "origin string, target string")).collect()}
    for a, b in set(ends):
        far = distance(pairs, a).get(b)
        assert (far is None) == ((a, b) not in got)
        if far is not None:
            way = got[a, b]
            assert way[0] == a and way[-1] == b and len(way) == far + 1
            assert all(frozenset(step) in links for step in zip(way, way[1:], strict=False))
    few = graph.paths(lines_of(spark, pairs), spark.createDataFrame(ends, "origin string, target string"), most=2).collect()
    assert {(r.origin, r.target) for r in few} == {k for k, way in got.items() if len(way) <= 3}


def test_edge_filters_drop_no_node(spark):
    nodes = spark.createDataFrame([("a", "DOMAIN"), ("b", "IP"), ("c", "ACCOUNT"), ("isolated", "EMAIL")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "R", 0.95), ("b", "c", "S", 0.3)], "src string, dst string, type string, confidence double")
    ids = lambda rows: {r.id for r in rows.collect()}
    kept, some = graph.subgraph(nodes, edges, least=0.9)
    assert ids(kept) == {"a", "b", "c", "isolated"} and [r.src for r in some.collect()] == ["a"]
    kept, some = graph.subgraph(nodes, edges, types=["DOMAIN", "IP"])
    assert ids(kept) == {"a", "b"} and some.count() == 1
    assert [r.src for r in graph.subgraph(nodes, edges, edge_types=["S"])[1].collect()] == ["b"]
    assert [(r.component, r.n) for r in graph.component_sizes(graph.components(nodes, edges)).collect()] == [("a", 3), ("isolated", 1)]
    assert {(r.part, r.type): r.n for r in graph.type_counts(nodes, edges).collect()}["edge", "R"] == 1


def test_blank_values_and_other_kinds_agree_on_nothing(spark):
    rows = [("c", 1, "orcid", "doi", None, []), ("c", 2, "crossref", "doi", None, []), ("c", 1, "orcid", "orcid", "  ", []), ("c", 2, "wikidata", "orcid", "\t", []), ("c", 1, "a", "shoe_size", "42", []), ("c", 2, "b", "shoe_size", "42", []), ("c", 1, "orcid", "doi", "10.1/x", []), ("c", 2, "crossref", "doi", " 10.1/X \n", [])]
    got = infer.agreements(spark.createDataFrame(rows, CLAIM)).collect()
    assert [(r.identifier, r.value, r.records) for r in got] == [("doi", "10.1/x", 2)]


def run(spark, claims, records=None, edges=()):
    rows = [("case", k, source, kind, value, imported) for k, (source, kind, value, imported) in enumerate(claims)]
    own = records or [("case", k, ["same_person_name"], 0.15) for k in range(len(claims))]
    table = spark.createDataFrame(own, "case_id string, record long, signal_keys array<string>, score double")
    links = spark.createDataFrame(list(edges), "case_id string, src string, dst long, type string, score double")
    said = spark.createDataFrame(rows, CLAIM)
    back = lambda r, e: infer.written_back(r, e, said, infer.lineage_table(spark), scoring.rules_table(spark))
    return back, *back(table, links)


@pytest.mark.parametrize(
    "claims",
    [
        [("crossref", "orcid", "x", []), ("reddit", "orcid", "x", [])],
        [("provider_search", "orcid", "x", []), ("openalex", "orcid", "x", [])],
        [("orcid", "orcid", "x", []), ("orcid", "orcid", "x", [])],
        [("orcid", "orcid", "x", []), ("wikidata", "orcid", "X ", [])],
        [("orcid", "github_login", "x", ["github"]), ("github", "github_login", "x", [])],
    ],
)
def test_agreement_without_independence_changes_no_score(spark, claims):
    _, records, _ = run(spark, claims)
    for r in records.collect():
        assert r.score == 0.15 and r.corroborating_sources == [] and r.band == "WEAK_ASSOCIATION"
        assert [(x.value, x.independence in ("DEPENDENT", "UNKNOWN")) for x in r.shared_identifiers] == [("x", True)]


def test_independent_agreement_is_written_back_once(spark):
    claims = [("orcid", "github_login", "x", []), ("github_people", "github_login", "X", []), ("reddit", "doi", "y", []), (None, "doi", "y", [])]
    records = [("case", 0, ["same_person_name", "no_such_rule"], 0.15), ("case", 1, None, 0.15), ("case", 2, ["same_person_name"], 0.4), ("case", 9, [], 0.9)]
    edges = [("case", "s", 0, "POSSIBLY_SAME_ENTITY", 0.2), ("case", "s", 1, "POSSIBLY_SAME_ENTITY", 0.97), ("case", "s", 1, "MENTIONS", 0.1), ("case", "s", 2, "POSSIBLY_SAME_ENTITY", 0.3), ("other", "s", 0, "POSSIBLY_SAME_ENTITY", 0.2)]
    back, first, lines = run(spark, claims, records, edges)
    got = {r.record: r for r in first.collect()}
    lifted = round(1 - 0.85 * 0.45, 4)
    assert got[0].score == got[1].score == lifted and got[0].corroborating_sources == ["github_people", "orcid"] and got[0].band == "POSSIBLE_MATCH" and got[0].shared_identifiers == []
    assert got[2].score == 0.4 and got[9].score == 0.9 and got[9].band == "LIKELY_MATCH" and got[9].shared_identifiers == []
    risen = sorted((r.case_id, r.dst, r.type, r.score, r.band) for r in lines.collect())
    assert risen == [("case", 0, "POSSIBLY_SAME_ENTITY", lifted, "POSSIBLE_MATCH"), ("case", 1, "MENTIONS", 0.1, "WEAK_ASSOCIATION"), ("case", 1, "POSSIBLY_SAME_ENTITY", 0.97, "LIKELY_MATCH"), ("case", 2, "POSSIBLY_SAME_ENTITY", 0.3, "WEAK_ASSOCIATION"), ("other", 0, "POSSIBLY_SAME_ENTITY", 0.2, "WEAK_ASSOCIATION")]
    again = back(first.select("case_id", "record", "signal_keys", "score"), lines.drop("band"))
    assert sorted(again[0].collect()) == sorted(first.collect()) and sorted(again[1].collect()) == sorted(lines.collect())


def test_shared_sites_hold_all_pairs(spark):
    rng = random.Random(6)
    accounts = [("c", f"a{k}", rng.choice([None, " ", "Ann", "ann ", "bob", "cy"])) for k in range(60)]
    links = []
    for _ in range(150):
        pair = (f"a{rng.randrange(60)}", f"s{rng.randrange(9)}")
        links.append(("c", *(pair if rng.random() < 0.5 else pair[::-1])))
    links.append(("d", "a1", "s1"))
    table = spark.createDataFrame(accounts, "case_id string, account string, handle string")
    members = infer.site_members(spark.createDataFrame(links, "case_id string, src string, dst string"), table)
    sites = {}
    for c, a, b in links:
        if c == "c":
            sites.setdefault(b if b[0] == "s" else a, set()).add(a if a[0] == "a" else b)
    handle = {a: (h or "").strip().lower() or None for _, a, h in accounts}
    alike = lambda a, b: handle[a] is not None and handle[a] == handle[b]
    pairs = {s: Counter(alike(a, b) for a, b in combinations(sorted(own), 2)) for s, own in sites.items() if len(own) > 1}
    assert {r.site: (r.same_pairs, r.other_pairs) for r in infer.site_groups(members).collect()} == {s: (n[True], n[False]) for s, n in pairs.items()}
    found = infer.site_links(members).collect()
    assert all(alike(r.a, r.b) == (r.rule_key == "same_username_shared_website") and {r.a, r.b} <= sites[r.site] and r.a < r.b for r in found)
    per = Counter(r.site for r in found)
    assert all(per[s] == len(own) - 1 for s, own in sites.items() if len(own) > 1)


def test_shared_handles_link_each_account_once(spark):
    rows = [("c", "1", "Annie", "x"), ("c", "2", "annie", "x"), ("c", "3", "ANNIE", "y"), ("c", "4", "annie", "z"), ("c", "5", "only", "x"), ("c", "6", "only", "x"), ("c", "7", "abc", "x"), ("c", "8", "abc", "y"), ("d", "9", "annie", "y")]
    accounts = spark.createDataFrame(rows, "case_id string, key string, handle string, platform string")
    got = sorted((r.case_id, r.handle, r.a, r.b, r.rule_key) for r in infer.handle_links(accounts).collect())
    assert got == [("c", "annie", "1", "3", "same_common_username"), ("c", "annie", "1", "4", "same_common_username"), ("c", "annie", "3", "2", "same_common_username")]
    assert infer.handle_groups(accounts).filter(F.col("pairs") != 5).count() == 0
