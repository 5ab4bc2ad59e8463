import gzip
import hashlib
import io

from tracefold.llm import warc

LONG = "é" * 60
ROWS = [(3, "http://a/", LONG), (1, "http://b/\r\nx", LONG), (2, None, LONG), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/", None), (7, "u", "<p>" + "long " * 50_000), (None, "v", LONG), (8, "w", "\r\n\r\nhead\r\n\r\n" * 20), (1, "again", LONG)]


def test_round_trip_with_revisits(spark, tmp_path):
    warc.register(spark)
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, payload string")
    warc.archive(docs, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in warc.records_of(spark, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        again = html == LONG and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


def test_filters_reach_the_source_and_payloads_stay_undecoded(spark, tmp_path):
    warc.register(spark)
    docs = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.archive(docs, str(tmp_path / "w"))
    stored = spark.read.format("warc").load(str(tmp_path / "w"))
    assert stored.filter("record_type = 'revisit'").count() == 3
    assert stored.filter("record_type IN ('revisit', 'response') AND target_uri = 'http://c/'").count() == 1
    reader = warc.WarcReader({"path": str(tmp_path / "w"), "payload": "true"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and reader.tests == [("warc-type", {"revisit"})]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 3 and all(r[-1] is None for r in rows)


def test_partitions_hold_files_up_to_a_size(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"x" * 100)
    reader = warc.WarcReader({"path": str(tmp_path), "partitionBytes": "250"})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 1]


def test_archives_of_others_are_read_without_lengths():
    block = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(block) + gzip.compress(block.replace(b"resource", b"warcinfo")) + gzip.compress(block)
    stream = warc._Buffered(io.BytesIO(data), block=16)
    rows = list(warc.records(stream, lambda head: head["warc-type"] == "resource", True))
    assert [r[-1] for r in rows] == [b"hello", b"hello"]


def test_a_refused_record_is_not_inflated():
    row = dict.fromkeys(warc.HEADERS) | {"record_type": "response", "payload": bytes(range(256)) * 4000}
    data = bytearray(warc.record(row))
    data[len(data) // 2] ^= 0xFF
    good = warc.record(row | {"record_type": "other", "payload": b"ok"})
    rows = list(warc.records(warc._Buffered(io.BytesIO(bytes(data) + good)), lambda head: head["warc-type"] == "other", True))
    assert [r[-1] for r in rows] == [b"ok"]


def test_empty_table(spark, tmp_path):
    warc.register(spark)
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.records_of(spark, str(tmp_path / "w")).count() == 0


def block(text, kind="resource"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n".encode()


def read(data, errors="raise", keep=True, payloads=True, size=16):
    rows = list(warc.records(warc._Buffered(io.BytesIO(data), block=size), lambda head: keep, payloads, errors))
    return [r[-1] if r[-2] is None else r[-2] for r in rows]


def test_all_records_of_a_member_and_of_plain_files():
    three = block("one") + block("x" * 200_000) + block("")
    for data in (gzip.compress(three) + gzip.compress(block("two")), three + block("two")):
        assert read(data) == [b"one", b"x" * 200_000, b"", b"two"]
        assert read(data, payloads=False) == [None] * 4 and read(data, keep=False) == []
    assert read(b"") == [] and read(gzip.compress(b"")) == [] and read(gzip.compress(b"\r\n\r\n") + gzip.compress(block("a"))) == [b"a"]


def test_nothing_is_lost_without_a_word():
    good = [gzip.compress(block(t)) for t in ("one", "two", "three" * 9000)]
    cases = {
        "no head": (good[0] + gzip.compress(b"no record at all") + good[1] + good[2], [b"one", "no head", b"two", b"three" * 9000]),
        "truncated": (good[0] + good[1] + good[2][:-30], [b"one", b"two", "truncated gzip member"]),
        "cut inside": (good[0] + good[2][:40] + good[1], [b"one", "damaged", b"two"]),
        "garbage": (good[0] + b"garbage" * 900 + good[1], [b"one", "no gzip member", b"two"]),
        "short record": (gzip.compress(block("abc") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nabc") + good[1], [b"abc", "truncated record", b"two"]),
        "no length": (gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\nabc") + good[1], ["a record without its length", b"two"]),
        "plain": (block("one") + block("two")[:-6], [b"one", "truncated record"]),
    }
    for data, want in cases.values():
        got = read(data, "rows")
        assert len(got) == len(want) and all(a == b or isinstance(b, str) and a.startswith(b) for a, b in zip(got, want, strict=True)), got
        try:
            read(data)
        except warc.Damaged:
            continue
        raise AssertionError("nothing was raised")
    assert read(good[0] + b"garbage", "rows", keep=False) == ["no gzip member at byte " + str(len(good[0]))]
    row = dict.fromkeys(warc.HEADERS) | {"record_type": "response", "payload": b"p" * 5000}
    assert read(warc.record(row)[:-20], "rows", keep=False) == ["truncated gzip member at byte 0"]


def test_damage_ends_the_job_or_is_a_row(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc").write_bytes(block("plain"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(block("packed")) + b"garbage")
    (tmp_path / "c.txt").write_bytes(b"no archive")
    stored = spark.read.format("warc").option("errors", "rows").load(str(tmp_path))
    assert sorted((r.payload, r.error is None) for r in stored.filter("error IS NULL").collect()) == [(bytearray(b"packed"), True), (bytearray(b"plain"), True)]
    assert stored.filter("error IS NOT NULL").count() == 1
    assert [bytes(r.payload) for r in spark.read.format("warc").load(str(tmp_path / "a.warc")).collect()] == [b"plain"]
    try:
        spark.read.format("warc").load(str(tmp_path)).count()
    except Exception as e:
        assert "no gzip member" in str(e)
    else:
        raise AssertionError("nothing was raised")
