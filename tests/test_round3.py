"""Findings of the third round."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as entry

from tracefold.operators import graph, infer, linkage, report
from tracefold.plans import streams
from tracefold.streaming import incremental


def test_owner_of_equally_early_rows_is_the_smallest_source(spark):
    rows = [(1, s, 5) for s in (9, 3, 7)] + [(2, 3, 4), (2, 1, 6)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "k int, source int, seq int").coalesce(1)
        got = {r.k: (r.source, r.also_seen_in) for r in report.also_seen(table, ["k"], "source", "seq").collect()}
        assert got == {1: (3, [7, 9]), 2: (3, [1])}


def test_all_words_of_a_place_stand_in_one_text(spark):
    stated = spark.createDataFrame([(1, "New houses"), (1, "city of York"), (2, "in New York City"), (3, "york, new"), (4, ""), (5, None)], "a int, stated string")
    places = spark.createDataFrame([("New York",), ("New City",), ("City",), ("New York",), ("--",), ("Newton",)], "place string")
    got = sorted(map(tuple, linkage.places_matched(stated, places).collect()))
    assert got == [(1, "City"), (2, "City"), (2, "New City"), (2, "New York"), (3, "New York")]


@pytest.mark.parametrize("name", ["canonical_targets", "payload_privacy"])
def test_costly_rows_of_a_small_file_are_dealt_over_all_tasks(spark, tmp_path, name):
    rows = [(k, f"c{k}", 1, 9100.0 - 100 * k, "SEG") for k in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    assert "RoundRobinPartitioning(3)" in got._jdf.queryExecution().executedPlan().toString()
    assert got.select("c_custkey").distinct().count() == 200


def sql_rows(query, table, rows):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", rows)
    return sorted(con.sql(entry.oracle_sql()[query]).fetchall())


REFERENCES = ["a&amp", "a&ampb &lt;&gt", "x&#65;&#x1F600;&#128;&#0;", "&#xD800;&#99999999999999999999;", "&notit; &notin; &foo; & &", "a&nbsp;b\x85c&eacute", "&amp;quot;&#", ""]


@pytest.mark.parametrize("name", ["page_metadata", "page_visible_text"])
def test_sql_of_pages_decodes_references_as_the_query_does(spark, tmp_path, name):
    rows = [(k, f"https://h{k}.example/", f'<html lang="en"><head><title>{x}</title></head><body><p>{x}</p>{x} <b>&amp</b></body></html>') for k, x in enumerate(REFERENCES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == sql_rows(name, "pages", rows)


def test_neighbours_of_alike_starts_are_those_of_a_search(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)] + [(f"s{k}", f"n{k % 4}") for k in range(12)] + [("s20", "s21"), ("s22", "s22")]
    starts = [f"s{k}" for k in range(25)] + [f"n{k}" for k in range(30)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    lines, ends = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "id string")
    for depth in (1, 2, 3):
        want = []
        for s in starts:
            far = {s: 0}
            level = [s]
            for step in range(1, depth + 1):
                level = sorted({y for x in level for y in near.get(x, ())} - far.keys())
                far |= dict.fromkeys(level, step)
            want += [(s, x, k) for x, k in far.items() if k]
        assert sorted(map(tuple, graph.neighbours(lines, ends, depth).collect())) == sorted(want)


def test_neighbours_start_from_each_supplier():
    assert "id LIKE 's%'" in entry.oracle_sql()["graph_neighbors"]


def test_sessions_that_are_open_at_the_end_are_given_too(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    for k, hits in enumerate([[("a", 0), ("a", 10), ("b", 3000)], [("a", 20), ("c", 5000)], [("a", 100), ("c", 5010), (None, 7)]]):
        spark.createDataFrame([(u, day + dt.timedelta(minutes=m)) for u, m in hits], "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    rows = incremental.closed_sessions(stream, "k", "ts", "30 minutes", "60 days").collect()
    got = sorted((str(r.k), round((r.started - day).total_seconds() / 60), round((r.ended - day).total_seconds() / 60), r.n) for r in rows)
    assert got == [("None", 7, 37, 1), ("a", 0, 50, 3), ("a", 100, 130, 1), ("b", 3000, 3030, 1), ("c", 5000, 5040, 2)]


def test_short_trees_need_no_components_and_ids_may_be_numbers(spark, monkeypatch):
    monkeypatch.setattr(graph, "components", None)
    lines = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long")
    ends = spark.createDataFrame([(1, 3), (1, 8)], "origin long, target long")
    assert [tuple(r) for r in graph.paths(lines, ends).collect()] == [(1, 3, [1, 2, 3])]


def test_sites_are_linked_in_one_sort_and_large_ones_by_classes(spark):
    rng = random.Random(8)
    handle = {f"a{k}": rng.choice([None, "ann", "bob", "cy"]) for k in range(50)}
    own = {("c", f"s{rng.randrange(8)}", f"a{rng.randrange(50)}") for _ in range(120)} | {("d", "s1", f"a{k}") for k in range(30)} | {("d", "s2", "a1")}
    want = []
    for c, s, b in own:
        of = {x for k, t, x in own if (k, t) == (c, s)}
        first = min(x for x in of if x == b or handle[b] is not None and handle[x] == handle[b])
        want += [(c, s, first, b, "same_username_shared_website")] if first != b else [(c, s, min(of), b, "shared_infrastructure")] if min(of) != b else []
    own |= {("c", None, "a1"), ("c", None, "a2"), (None, "s1", "a1"), (None, "s1", "a2")}  # link nothing
    members = spark.createDataFrame([(*m, handle[m[2]]) for m in own], "case_id string, site string, account string, handle string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for rows in batches:
            calls.add(len(rows))
            yield rows

    for whole in (0, 20, 100):
        before = calls.value
        assert sorted(map(tuple, infer.site_links(members.mapInPandas(seen, members.schema), whole).collect())) == sorted(want)
        assert calls.value - before == len(own)


def test_a_week_of_findings_is_dealt_over_files_and_written_once(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    rows = [(k % 40, "view", f'{{"k": {k % 7}}}', day + dt.timedelta(hours=k)) for k in range(500)]
    spark.createDataFrame(rows, "user_id long, event_type string, props string, ts timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for module in (streams, incremental):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # so that a file is a partition
    try:
        got = sorted(map(tuple, entry.queries()["stream_stored_findings"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == sorted({(k % 40, "view", str(k % 7), 1) for k in range(500)})
    weeks = {}
    for f in tmp_path.glob("shared/weeks-*/stream/week=*/*.parquet"):
        weeks.setdefault(int(f.parent.name[5:]), []).append(f.stat().st_mtime_ns)
    assert len(weeks) >= 3 and {len(times) for times in weeks.values()} == {3}
    order = sorted(weeks)
    assert all(max(weeks[a]) < min(weeks[b]) for a, b in zip(order, order[1:], strict=False))
    assert [p.name[:5] for p in tmp_path.glob("shared/*") if not p.name.startswith("findings-")] == ["weeks"]
