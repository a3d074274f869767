"""Readers, decoders, archives."""

import struct

import pytest

from tidegauge.lang.parser import parse_type
from tidegauge.lang.tree import LanguageError
from tidegauge.plans.planner import Engine
from tidegauge.series.archive import Archive, replay
from tidegauge.sources import external, protocols


def test_read_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,true,"one",[1;2],10.0.0.1,4294967295\n2,false,,[],10.0.0.300,7\nx,true,bad,[],1.2.3.4,1\n')
    e = Engine(spark)
    df = e.query(f'FROM (READ FROM FILES "{tmp_path}/*.csv" AS CSV SEPARATOR "," (n u8, b bool, name string?, v u16[], ip ip4?, big u32)) SELECT *, n + 1 AS m, ip IN 10.0.0.0/8 AS local')
    rows = sorted(df.collect(), key=lambda r: r.n)
    assert [(r.n, r.b, r.name, r.v, r.ip, r.big, r.m, r.local) for r in rows] == [(1, True, "one", [1, 2], 167772161, 4294967295, 2, True), (2, False, None, [], None, 7, 3, None)]


def test_csv_null_and_no_quotes(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a\t\\N\n"q"\t3\n')
    df = Engine(spark).query(f'FROM (READ FILE "{tmp_path}/b.csv" AS CSV SEPARATOR "\\t" NULL "\\\\N" NO QUOTES (s string, n i32?)) SELECT s, n')
    assert sorted(map(tuple, df.collect())) == [('"q"', 3), ("a", None)]


def test_csv_vectors(spark, tmp_path):
    """Quoted elements may hold separators; ClickHouse syntax, and vectors of characters as strings (an empty field is null)."""
    (tmp_path / "v.csv").write_text("['a, b', 'it\\'s', \"c\"]\t[1, 2,x]\tabc\n[]\t[]\t\n\\N\t[7]\t[d]\n")
    q = 'READ FILE "{}/v.csv" AS CSV SEPARATOR "\\t" NULL "\\\\N" NO QUOTES ESCAPE WITH "^" {} (s string[]?, n i32?[]?, c char[]?)'
    rows = Engine(spark).query("FROM (" + q.format(tmp_path, "VECTORS OF CHARS AS STRING CLICKHOUSE SYNTAX") + ") SELECT *").collect()
    assert [(r.s, r.n, r.c) for r in rows] == [(["a, b", "it's", '"c"'], [1, 2, None], ["a", "b", "c"]), ([], [], None), (None, [7], ["[", "d", "]"])]
    (tmp_path / "w.csv").write_text("[\"a;b\"; c d;'e'; f's]\t[1;2]\n")
    rows = Engine(spark).query(f'FROM (READ FILE "{tmp_path}/w.csv" AS CSV SEPARATOR "\\t" NO QUOTES (s string[], n i32[])) SELECT *').collect()
    assert [(r.s, r.n) for r in rows] == [(["a;b", "c d", "e", "f's"], [1, 2])]


def test_files_are_watched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1\n2\n")
    op = f'FROM (READ FROM FILES "{tmp_path}/in" THEN DELETE AS CSV (n i32)) SELECT n * 2 AS m'
    with pytest.raises(LanguageError):
        Engine(spark).query(op)
    df = Engine(spark, watch=True).query(op)
    assert df.isStreaming
    q = df.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.m for r in spark.table("watched").collect()) == [2, 4]


def test_on_site(spark):
    df = spark.createDataFrame([(1, "paris"), (2, "perth"), (3, "lyon"), (4, None)], "n int, site string")
    e = Engine(spark, site="lyon").table("t", df, ["n"])
    ids = lambda op: sorted(r.n for r in e.query(op).collect())
    assert ids('FROM t ON SITE "p*" SELECT n') == [1, 2] and ids("FROM t ON THIS SITE SELECT n") == [3] and ids("FROM t SELECT n") == [1, 2, 3, 4]
    with pytest.raises(LanguageError):
        Engine(spark).table("t", df, ["n"]).query("FROM t ON THIS SITE SELECT n")
    with pytest.raises(LanguageError):
        Engine(spark, site="x").table("t", df.drop("site"), ["n"]).query('FROM t ON SITE "x" SELECT n')


def test_rowbinary_round_trip(spark, tmp_path):
    head = "columns format version: 1\n5 columns:\n`a` UInt32\n`b` Nullable(String)\n`c` Array(String)\n`d` Nullable(FixedString(16))\n`e` Float64"
    kinds = [k for _, _, k in external.names_and_types(head)]
    assert kinds == ["UInt32", "Nullable(String)", "Array(String)", "Nullable(FixedString(16))", "Float64"]
    rows = [[1, "x" * 300, ["p", "q"], b"\1" * 16, 1.5], [2, None, [], None, -2.0]]
    data = external.encode_rowbinary(rows, kinds)
    assert list(external.decode_rowbinary(data, kinds)) == rows
    assert list(external.decode_rowbinary(data[:-3], kinds)) == rows[:1]
    (tmp_path / "u.chb").write_bytes(data)
    df = Engine(spark).query(f'FROM (READ FROM FILE "{tmp_path}/u.chb" AS ROWBINARY ({head})) SELECT a, b, c, e')
    assert sorted(map(tuple, df.collect())) == [(1, "x" * 300, ["p", "q"], 1.5), (2, None, [], -2.0)]


def test_kafka_messages_are_decoded(spark):
    from tidegauge.lang.parser import parse

    op = parse('DEFINE k AS READ FROM KAFKA TOPIC "t" WITH OPTIONS "metadata.broker.list" = "h:9092" AS CSV (year u16, name string, co float?)').functions[0].op
    messages = spark.createDataFrame([(bytearray(b"1999,a,\n2000,b,1.5\n"),), (bytearray(b"2001,c,2"),)], "value binary")
    assert sorted(map(tuple, external.decode_messages(messages, op).collect())) == [(1999, "a", None), (2000, "b", 1.5), (2001, "c", 2.0)]


def test_convert(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1,a\n2,b\n")
    columns = [("n", parse_type("i32")), ("s", parse_type("string"))]
    external.convert(spark, str(tmp_path / "c.csv"), "csv", str(tmp_path / "o"), "orc", columns)
    external.convert(spark, str(tmp_path / "o"), "orc", str(tmp_path / "p"), "parquet")
    external.convert(spark, str(tmp_path / "p"), "parquet", str(tmp_path / "back"), "csv")
    assert sorted(map(tuple, external.read_csv(spark, str(tmp_path / "back"), columns, {}).collect())) == [(1, "a"), (2, "b")]


def flow(first, last):
    return struct.pack(">IIIHHIIIIHHBBBBHHBBH", 1, 2, 3, 4, 5, 6, 700, first, last, 80, 443, 0, 2, 6, 0, 10, 20, 24, 16, 0)


def test_netflow(spark):
    head = struct.pack(">HHIIIIBBH", 5, 2, 10_000, 1000, 500_000_000, 42, 1, 2, (1 << 14) | 100)
    payload = head + flow(2_000, 4_000) + flow((1 << 32) - 1000, 500)
    rows = list(protocols.netflow(payload, "r1"))
    assert (rows[0]["start"], rows[0]["stop"], rows[0]["bytes"], rows[0]["sampling_rate"], rows[0]["sampling_type"]) == (992.5, 994.5, 700, 100, 1)
    assert rows[1]["start"] == pytest.approx(989.5) and rows[1]["stop"] == 991.0
    assert len(list(protocols.netflow(payload[:-10]))) == 1 and not list(protocols.netflow(b"x" * 30)) and not list(protocols.netflow(b""))
    df = protocols.decoded(spark.createDataFrame([(bytearray(payload), "r1"), (None, "r2")], "payload binary, sender string"), "netflow")
    assert sorted(r.src_port for r in df.collect()) == [80, 80]


def part(kind, body):
    return struct.pack(">HH", kind, 4 + len(body)) + body


def test_collectd(spark):
    values = struct.pack(">H", 2) + bytes([1, 2]) + struct.pack("<d", 1.5) + struct.pack(">q", -7)
    payload = part(0, b"host\0") + part(8, struct.pack(">Q", 100 << 30)) + part(2, b"cpu\0") + part(4, b"load\0") + part(5, b"idle\0") + part(6, values) + part(3, b"1\0") + part(6, values)
    rows = list(protocols.collectd(payload))
    assert [(r["host"], r["plugin"], r["instance"], r["type_name"], r["type_instance"], r["start"], r["value"], r["value2"], r["value3"]) for r in rows] == [
        ("host", "cpu", None, "load", "idle", 100.0, 1.5, -7.0, None), ("host", "cpu", "1", "load", "idle", 100.0, 1.5, -7.0, None)]
    assert not list(protocols.collectd(b"\0\0\0\1")) and len(list(protocols.collectd(payload[:-5]))) == 1
    assert protocols.decoded(spark.createDataFrame([(bytearray(payload),)], "payload binary"), "collectd").count() == 2


def test_graphite(spark):
    text = b"a.b;host=x;dc=y 1.5 100\nc 2 -1\nbad line here now\nd nope 3\n"
    df = protocols.decoded(spark.createDataFrame([(bytearray(text), "s", 9.0)], "payload binary, sender string, received double"), "graphite")
    rows = sorted(df.collect(), key=lambda r: r.metric)
    assert [(r.metric, r.value, r.start, [tuple(t) for t in r.tags]) for r in rows] == [("a.b", 1.5, 100.0, [("host", "x"), ("dc", "y")]), ("c", 2.0, 9.0, [])]


def test_archive_and_replay(spark, tmp_path):
    rows = [(float(t), f"k{t % 3}", t % 5) for t in range(0, 20_000, 50)]
    df = spark.createDataFrame(rows, "start double, k string, v int")
    a = Archive(spark, str(tmp_path / "archive"))
    a.write("base", df)
    text = """DEFINE base AS FROM raw SELECT start, k, v; DEFINE BEST AFTER 1h f AS FROM base SELECT k, start // 600 AS w, MIN start AS start, SUM v AS s GROUP BY k, start // 600 COMMIT AFTER in.start > (out.w + 2) * 600"""
    got = replay(Engine(spark), a, text, "f", 6000, 12_000)
    whole = Engine(spark).table("raw", df, ["start"]).run(text, "f").filter("start >= 6000 and start <= 12000")
    # The last window is cut by the end of the range in the replay only.
    key = lambda x: {(r.k, r.w): r.s for r in x.collect() if r.w < 20}
    assert key(got) == key(whole) and key(got)
    a.expire("base", 7200)
    assert a.read("base", 0, 1e9).agg({"start": "min"}).collect()[0][0] == 7200


def test_listen_topic_and_notify(spark):
    payload = struct.pack(">HHIIIIBBH", 5, 1, 10_000, 1000, 0, 42, 1, 2, 0) + flow(2_000, 4_000)
    e = Engine(spark).listen("netflow", spark.createDataFrame([(bytearray(payload), "r1")], "payload binary, sender string"))
    e.topic("cars", spark.createDataFrame([(bytearray(b"1999,a\n2001,b"),)], "value binary"))
    text = """DEFINE flows AS LISTEN FOR NETFLOWV5;
      DEFINE big AS FROM flows SELECT start, bytes, source AS exporter "who" FACTORS exporter;
      DEFINE cars AS READ FROM KAFKA TOPIC "cars" WITH OPTIONS "metadata.broker.list" = "h" AS CSV (year u16, name string);
      DEFINE late AS FROM cars SELECT year, name WHERE year > 2000 COMMIT AND NOTIFY "late car" AFTER true"""
    r = e.run(text)
    assert [tuple(x) for x in r["big"].collect()] == [(992.0, 700, "r1")]
    assert r["big"].schema["exporter"].metadata["factor"] and r["big"].schema["exporter"].metadata["doc"] == "who"
    sent = e.notifications(text, "late").collect()
    assert [(x.name, x.params) for x in sent] == [("late car", {"year": '{"v":2001}', "name": '{"v":"b"}'})]
    with pytest.raises(ValueError):
        e.notifications(text, "big")
    with pytest.raises(ValueError):
        Engine(spark).run("DEFINE f AS LISTEN FOR COLLECTD", "f")
