import base64
import gzip
import hashlib
import tracemalloc
import zlib

from quire.llm import warc


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a.b/x y", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>"), (4, "http://d", ""), (None, "http://e", "<p>é</p>"), (5, "http://f", "a\r\n\r\nWARC/1.1\r\n"), (1, "http://a.b/x y", "<p>é</p>"), (6, "http://g", "\0" * 20_000_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", warc.F.lit(1))
    path = warc.archive(df)
    found = warc.captures(spark, path).collect()
    assert len(found) == len(rows)
    got = sorted((r.metadata.fields.get("sourceId", ""), r.response.type, r.metadata.fields.get("refersToSourceId"), r.response.payload_bytes, r.response.payload_digest) for r in found)
    want = []
    for i, _, h in rows:
        e = (h or "").encode()
        revisit = i in (3, 4)
        want.append((str(i or ""), "revisit" if revisit else "response", {3: "1", 4: "2"}.get(i), len(e), base64.b32encode(hashlib.sha1(e).digest()).decode()))
    assert got == sorted(want)
    payloads = {r.metadata.fields.get("sourceId"): r.response.payload for r in found}
    assert bytes(payloads["5"]) == b"a\r\n\r\nWARC/1.1\r\n" and payloads["3"] is None
    assert all(r.request.http_headers.startswith("GET /") for r in found)


def test_every_record_is_a_gzip_member(spark):
    df = spark.createDataFrame([(i, "http://a", "x" * i) for i in range(50)], "page_id bigint, url string, html string")
    path = warc.archive(df.coalesce(2), file_bytes=10 * (49 + warc.HEADERS_BYTES))
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(files) >= 5 and all(len(list(warc.members(f))) <= 30 for f in files)
    n = 0
    for content in files:
        text = gzip.decompress(content)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        members = list(warc.members(content))
        assert b"".join(members) == text
        assert all(len(list(warc.parse(m))) == 1 for m in members)
        n += len(members)
    assert n == 150


def test_long_records_end_in_a_zero_byte():
    made = warc.record(b"resource", [], b"ab" * 9_000_000) + b"\0"
    assert zlib.decompress(made, 31).endswith(b"abab\r\n\r\n")
    assert [m for m in warc.members(made) if m][0].endswith(b"\r\n\r\n")


def test_short_payloads_can_stay_responses_and_empty_tables_work(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    found = warc.captures(spark, warc.archive(df, least_revisit=5))
    assert sorted(r.response.type for r in found.collect()) == ["response"] * 3 + ["revisit"]
    assert warc.captures(spark, warc.archive(df.limit(0))).count() == 0


def shuffled_bytes(spark):
    store, doubles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, doubles, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_payloads_are_not_shuffled_to_find_copies(spark):
    payload = warc.F.concat_ws("", *(warc.F.sha2(warc.F.concat_ws("-", warc.F.col("id") % 400, warc.F.lit(i)), 512) for i in range(40)))
    df = spark.range(0, 500, 1, 4).select(warc.F.col("id").alias("page_id"), warc.F.lit("http://a").alias("url"), payload.alias("html"))
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        path = warc.archive(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled_bytes(spark) - before < 500 * 128 * 40 // 8
    found = warc.captures(spark, path, payloads=False).collect()
    assert {int(r.metadata.fields["sourceId"]): int(r.metadata.fields["refersToSourceId"]) for r in found if r.response.type == "revisit"} == {i: i - 400 for i in range(400, 500)}
    assert len(found) == 500


def test_copies_are_marked_alike_by_broadcast_and_by_shuffle(spark):
    rows = [(1, "u1", "abc"), (1, "u0", "abc"), (2, "u2", "abc"), (2, None, "xyz"), (2, "u2", "abc"), (3, "u3", "xyz"), (None, "u4", "abc"), (None, "u5", None), (7, "u6", None), (9, None, ""), (4, "u7", "only")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = []
    for most in (0, 1 << 20):
        found = warc.captures(spark, warc.archive(df, most_broadcast=most)).collect()
        made.append(sorted((r.metadata.fields.get("sourceId", ""), r.target_uri, r.response.type, r.metadata.fields.get("refersToSourceId", ""), r.response.refers_to_uri or "", r.response.payload_digest) for r in found))
    assert made[0] == made[1] and len(made[0]) == len(rows)
    marks = [(i, kind, first, uri) for i, _, kind, first, uri, _ in made[1] if kind == "revisit"]
    assert marks == [("2", "revisit", "1", "u0"), ("2", "revisit", "1", "u0"), ("3", "revisit", "2", "urn:x-unknown:"), ("9", "revisit", "7", "u6")]


def test_members_copy_no_more_than_a_piece_of_the_file():
    payload = hashlib.sha512(b"x").hexdigest().encode() * 8
    content = (warc.record(b"resource", [], payload) + b"\0") * 4000
    tracemalloc.start()
    n = sum(1 for m in warc.members(content) if m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and len(content) > 500_000 and peak < 200_000
    assert list(warc.members(content[:-len(content) // 4000])) == list(warc.members(content))[:-1]
    long = warc.record(b"resource", [], bytes(range(256)) * 4000) + b"\0"
    assert [len(m) for m in warc.members(long * 2)] == [len(zlib.decompress(long, 31))] * 2
