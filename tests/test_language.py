"""Expressions, programs and errors of the language."""

import math

import pytest

from tidegauge.lang.parser import parse, parse_expr, parse_type
from tidegauge.lang.tree import LanguageError
from tidegauge.plans.planner import Engine, Run

INF = float("inf")
VALUES = [
    ("2069 & 31", 21), ("2053 | 6", 2055), ("77 # 13", 64), ("999 >> 4", 62), ("11 << 2", 44), ("-9 >> 2", -3),
    ("17 IN [4; 17; 90]", True), ("10.96.3.4 IN 10.64.0.0/12", False), ("fd00:12::9 IN fd00::/8", True),
    ('INDEX("lighthouse", #\\h)', 3), ('INDEX("lighthouse", #\\H)', -1), ('INDEX FROM END("lighthouse", #\\h)', 5),
    ("75th PERCENTILE [40; 10; 30; 20; 50]", 40), ("[0th; 50th; 100th] PERCENTILE [9; 4; 7; 1]", [1, 7, 9]),
    ('SUBSTRING("anchorage", 3, 6)', "hor"), ('SUBSTRING("anchorage", -3, 9)', "age"), ('SUBSTRING("anchorage", -6, -3)', "hor"), ('SUBSTRING("pier", 7, 11)', ""),
    ("MIN [ 81; 12; 33 ]", 12), ("MIN SKIP NULLS [ NULL ; u32?(8) ; u32?(6) ]", 6), ("MIN KEEP NULLS [ u32?(8) ; u32?(6) ; NULL ]", None),
    ("SUM [ 100; -1; 11 ]", 110), ("AVG [ 1; 2; 2; 7 ]", 3.0), ("AND [ TRUE ; TRUE ]", True),
    ("OR KEEP NULLS [ NULL ; bool?(FALSE) ; bool?(TRUE) ]", None), ("BITAND [ 31; 28; 22 ]", 20), ("BITOR [ 8; 1; 9 ]", 9), ("BITXOR [ 7; 7; 12; 1 ]", 13),
    ("FIRST [ 70; 60; 50; 40 ]", 70), ("LAST [ 70; 60; 50; 40 ]", 40), ("GROUP [70; 60; 50]", [50, 60, 70]), ("COUNT [ FALSE ; FALSE ; TRUE ; FALSE ]", 1),
    ('DISTINCT [ "a"; "b" ]', True), ("DISTINCT [ 6; 5; 4; 6 ]", False), ("FIT [10; 13; 16; 19; 0]", 22.0), ("FIT [(7; 2); (10; 3); (16; 5); (0; 10)]", 31.0),
    ("SQRT 0.25", 0.5), ("SQRT(-9)", None), ("SQ(-7)", 49), ("CEIL 8.01", 9.0), ("FLOOR(-0.2)", -1.0), ("ROUND 17.6", 18.0), ("LOG(-5)", None), ("LOG 0", -INF), ("EXP 0", 1.0), ("COS PI", -1.0), ("LOG10 1000", 3.0),
    ("TRUNCATE(987.6, 25)", 975.0), ("TRUNCATE 0.9", 0.0), ("TRUNCATE(-7.1)", -8.0), ("RELDIFF(30, 40)", 0.25), ("RELDIFF(5, -20)", 1.25), ("RELDIFF(0, 0)", 0.0),
    ("-8 / 0", -INF), ("0 / 0", None), ("-17 // 5", -3), ("-9 % 4", -1), ("3 ^ 5", 243), ("(-8) ^ 0.5", None), ("u8(250) + u8(9)", 3), ("i8(-100) - i8(60)", 96),
    ('BASENAME "harbour/log.d/today.csv"', "today.csv"), ("IPFAMILY fd00::1", 6), ("CHR 122", "z"), ('4 * "ab"', "abababab"), ('"-" * 3', "---"), ('LENGTH "größe"', 7),
    ("PEEK U16 [ 1u8; 2u8 ]", 513), ("PEEK U32 BIG ENDIAN CAST([0x0A; 0x00; 0x00; 0xFE] AS U8[4])", 167772414),
    ('PEEK I16 BIG ENDIAN "\001\002"', 258), ('PEEK U32 LITTLE ENDIAN "\001"', None),
    ("UUID_OF_U128 0xa1b2c3d4e5f60718293a4b5c6d7e8f", "00a1b2c3-d4e5-f607-1829-3a4b5c6d7e8f"),
    ('(PARSE_TIME "2001-03-04 23:59:59") // 24h', 11385.0), ('PARSE_TIME "1999-12-31T10:00:05" = PARSE_TIME "1999-12-31 10:00:05"', True), ('PARSE_TIME "next tide"', None),
    ('FORMAT_TIME("%Y/%m/%d %H:%M it\'s %A%n%B 100%%", 951868799.5)', "2000/02/29 23:59 it's Tuesday\nFebruary 100%"), ('FORMAT_TIME("%j|%S", 951868799.5)', "59|59.50"), ('FORMAT_TIME("%a %b %y %I %p %F %T", 0)', "Thu Jan 70 12 AM 1970-01-01 00:00:00"),
    ("MIN(14, 3, 8)", 3), ("MAX([1; 20], [1; 3])", [1, 20]), ("MIN(NULL, 4)", None), ("(2; 9) <= (2; 8)", False), ("NULL |? 23", 23), ("NULL OR true", True), ("NULL OR false", None), ("NULL AND false", False),
    ("(3 = NULL) IS NULL", True), ("IF 9 < 2 THEN 5", None), ("IF (4 <> 4, 10, 20)", 20), ("[8;6;4][2]", 4), ("[8;6;4][3]", None), ('{tide: 3; name: "spring"}.name', "spring"), ("3rd (7; 8; 9)", 9),
    ('i32?("low tide")', None), ('i32("-81")', -81), ("string(0.25)", "0.25"), ("7k", 7000), ("90s", 90.0), ("250ms", 0.25), ("2Mi", 2097152), ('"Quay" LIKE "q_a%"', True), ('"Quay" CASE SENSITIVE LIKE "q%"', False),
    ('string(192.0.2.7)', "192.0.2.7"), ('ip4?("192.0.2.7")', 3221225991), ("END OF 192.0.2.0/29", 3221225991), ("20 - 3 * 4", 8), ("2 ^ 2 ^ 3", 256), ("30 - 9 - 4", 17), ("2 | 3 * 8", 24),
]


def near(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isfinite(a) and math.isfinite(b):
        return abs(a - b) < 1e-9 * max(1, abs(a))
    return a == b


def test_values_in_spark_and_in_the_machine(spark):
    """One plan for all; the Python meaning of each must agree with its column."""
    from tidegauge.lang.tree import Aggregate
    from tidegauge.plans.commit import Clause, Ctx
    from tidegauge.plans.resolve import Resolver

    row = Engine(spark).query("YIELD " + ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(VALUES))).collect()[0]
    for i, (text, want) in enumerate(VALUES):
        assert near(row[f"v{i}"], want), (text, row[f"v{i}"], want)
        got = Clause(Resolver(Aggregate([]), {}, {}).typed(parse_expr(text), "select", True)).eval(Ctx({}))
        assert near(got, want), ("python", text, got, want)


@pytest.mark.parametrize(
    "text",
    [
        "FROM t SELECT nope", "FROM t SELECT k + 1", "FROM t SELECT n WHERE n", "FROM t SELECT SUM k", "FROM t SELECT n AS a, k AS a",
        "FROM t SELECT n GROUP BY SUM n", "FROM t SELECT LOWER n", "FROM t SELECT n WHERE out.n = 1", "FROM t SELECT n EVERY 1s", "FROM t SELECT * - nope",
        "FROM nowhere SELECT 1", "FROM t SELECT n = k", "FROM t SELECT 50th PERCENTILE n", "FROM t SELECT", "FROM t SELECT CASE WHEN n THEN 1 END", "FROM t SELECT sort_first.n",
    ],
)
def test_errors(spark, text):
    e = Engine(spark).table("t", spark.createDataFrame([(1, "a")], "n long, k string"), ["n"])
    with pytest.raises(LanguageError):
        e.query(text)


def test_types():
    assert str(parse_type("u32?[4]")) == "u32?[4]"
    assert parse_type("(string; u8)").args[1].kind == "u8"
    assert parse_type("string[u8]").kind == "map"


def test_program_parts():
    p = parse("""PARAMETERS a u8 DEFAULTS TO 3, b float {seconds} DEFAULTS TO 1.5;
      DECLARE WITH PROGRAM SCOPE m string[string]; RUN IF param.a > 1;
      DEFINE LAZY x AS YIELD 1 AS one EVERY 1s; DEFINE PERSIST FOR 1h BEST AFTER 5min y AS FROM x SELECT one AS start, 2 AS two "doc" AGGREGATE USING max
      EVENT STARTING AT start WITH DURATION 10 FACTORS two;""")
    assert p.functions[0].lazy and p.functions[1].persist == 3600 and p.functions[1].best_after == 300 and set(p.params) == {"a", "b"}
    assert p.functions[1].op.fields[1].aggregate == "max" and p.functions[1].op.factors == ["two"]


def test_programs(spark):
    n123 = spark.createDataFrame([(1, True, "one"), (2, False, "two"), (3, True, None)], "n long, b boolean, name string")
    e = Engine(spark, generate=12).table("numbers/small", n123, ["n"])
    q = lambda text, **p: [tuple(r) for r in e.query(text, **p).collect()]
    assert q("FROM numbers/small SELECT n, moveavg(1, n) AS a, avg lag latest 1 n AS b, moveavg(2, n) AS c, avg lag latest 2 n AS d COMMIT AFTER n = 3") == [(3, 2.0, 2.0, 1.5, 1.5)]
    assert q("FROM numbers/small SELECT SUM n COMMIT BEFORE sum_n > 4") == [(3,)]
    assert q("FROM numbers/small SELECT OR (not b) AS x COMMIT AFTER sum 1 = 2") == [(True,)]
    assert sorted(q("FROM numbers/small SELECT n, lag n AS l, lag(2, n) AS m")) == [(1, None, None), (2, 1, None), (3, 2, 1)]
    assert sorted(q('FROM numbers/small SELECT name |? "three" AS x')) == [("one",), ("three",), ("two",)]
    assert q("YIELD 1 + (previous.t |? 0) AS t EVERY 10ms")[-1] == (12,)
    r = e.run("PARAMETER p u16 DEFAULTS TO 2; DEFINE a AS FROM numbers/small SELECT n, b; DEFINE c AS FROM a SELECT n WHERE n >= p", p=3)
    assert [x.n for x in r["c"].collect()] == [3]
    words = e.query('FROM (YIELD split(" ", "to be or not to be") AS w) SELECT w')
    assert sorted(x.w for x in words.collect()) == ["be", "be", "not", "or", "to", "to"]
    got = e.query("FROM numbers/small SELECT *, 1 AS _private")
    assert got.columns == ["n", "b", "name"]


OPS = [
    "SELECT id, SUM v AS s, COUNT v AS c, MIN v AS lo, MAX KEEP NULLS v AS hi, AVG v AS m GROUP BY k KEEP",
    "SELECT id, LAG v AS a, LAG(2, v) AS b, MOVEAVG(3, v) AS c, SEASON_MOVEAVG(2, 2, v) AS d, DERIVE(v, t) AS e GROUP BY k KEEP",
    "SELECT id, FIRST v AS f, LAST v AS l, LATEST 2 v AS p, LATEST UP TO 3 v AS q, DISTINCT v AS d, ONE OUT OF 2 v AS o GROUP BY k KEEP",
    "SELECT id, HYSTERESIS(v, 2, 4) AS h, EVERY(3, true, t, v) AS e, REMEMBER(0.1, 3, v, t) AS r, GROUP v AS g GROUP BY k KEEP",
    "SELECT id, SUM GLOBALLY v AS s, LAG KEEP NULLS v AS l WHERE (LAG v < 3) |? true",
    "SELECT k, SUM v AS s, COUNT id AS c, LAST v AS l, FIRST v AS f, COUNT DISTINCT v AS d, LARGEST 2 v BY v AS big, SMALLEST UP TO 2 v BY v AS small, HISTOGRAM(v, 0, 4, 2) AS h COMMIT AFTER SUM 1 >= 4",
    "SELECT k, t // 4 AS w, SUM v AS s, AVG v AS a, LAST id AS l, 50th PERCENTILE (GROUP v) AS p, BITOR v AS bo, OR (v > 3) AS o GROUP BY k, t // 4 COMMIT AFTER in.t > (out.w + 2) * 4",
]


@pytest.mark.parametrize("op", OPS)
def test_native_plans_agree_with_the_machine(spark, op, monkeypatch):
    import random

    r = random.Random(7)
    rows = [(i, i // 2, r.choice(["a", "b", None]), r.choice([None, 1, 2, 3, 4, 5])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t long, k string, v long")

    def run():
        e = Engine(spark).table("t", df, ["id"])
        out = e.query("FROM t " + op)
        return e.plans["result"], sorted(map(repr, out.collect()))

    kind, native = run()
    assert kind != "machine"
    monkeypatch.setattr(Run, "kind", lambda self, op, r: "machine")
    kind, slow = run()
    assert kind == "machine" and [x for x in zip(native, slow) if x[0] != x[1]] == [] and len(native) == len(slow)


def test_states_without_a_window_form(spark):
    rows = [(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])]
    e = Engine(spark).table("t", spark.createDataFrame(rows, "start long, v double"), ["start"])
    got = e.query("FROM t SELECT start, SMOOTH(0.5, v) AS s, FIT LATEST 3 v AS f, PAST 3 OF v AT TIME start AS p, ONCE EVERY 3 start AS e, RECALL(0.1, 4, v, start) AS r").collect()
    s = 3.0
    for i, row in enumerate(got):
        s = row.s if i == 0 else s * 0.5 + rows[i][1] * 0.5
        assert row.s == pytest.approx(s)
        assert row.p == [v for t, v in rows[max(0, i - 2) : i + 1]]
    assert [row.e for row in got] == [0, None, None, 3, None, None, 6, None]
    assert [row.r for row in got] == [False, False, False, True, False, False, False, False]


def test_top_counts_heavy_hitters(spark):
    rows = [(i, "abacabad"[i % 8]) for i in range(80)]
    e = Engine(spark).table("t", spark.createDataFrame(rows, "i long, x string"), ["i"])
    last = e.query("FROM t SELECT i, LIST TOP 2 x AS top, RANK OF x IN TOP 2 AS rank, IS x IN TOP 2 AS hit").collect()[-1]
    assert (last.top, last.rank, last.hit) == (["a", "b"], None, False)


def test_sort_keeps_what_is_left_in_its_buffer(spark):
    e = Engine(spark).table("t", spark.createDataFrame([(i, (i * 37) % 11) for i in range(11)], "i long, v long"), ["i"])
    assert [r.v for r in e.query("FROM t SORT LAST 11 BY v SELECT v").collect()] == [0]
    assert len(e.query("FROM t SORT LAST 3 BY v SELECT v").collect()) == 9


def test_empty_input(spark):
    e = Engine(spark).table("t", spark.createDataFrame([], "id long, t long, k string, v long"), ["id"])
    for op in OPS:
        assert e.query("FROM t " + op).collect() == []


def test_globals_and_now(spark):
    text = """DECLARE WITH PROGRAM SCOPE var string[string];
      DEFINE f AS SELECT IF RANDOM > 0.5 THEN "a" ELSE "b" AS x, MAPADD(var, "k", x) AS _y, var["k"] IN ["a"; "b"] AS ok, NOW > 1.7e9 AS late, AGE(NOW) < 60 AS fresh EVERY 0.1s"""
    rows = Engine(spark, generate=5).run(text, "f").collect()
    assert len(rows) == 5 and all(r.ok and r.late and r.fresh for r in rows)


def test_commits_across_groups(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("a", 5), ("c", 6)])]
    e = Engine(spark).table("t", spark.createDataFrame(rows, "i long, k string, v long"), ["i"])
    got = e.query("FROM t SELECT k, SUM v AS s GROUP BY k COMMIT AFTER in.k <> out.k").collect()
    assert [tuple(r) for r in got] == [("a", 3), ("b", 7), ("a", 5)]
    got = e.query("FROM t SELECT k, SUM v AS s COMMIT BEFORE in.k <> FIRST k").collect()
    assert [tuple(r) for r in got] == [("a", 3), ("b", 7), ("a", 5)]
    got = e.query("FROM t SELECT k, SUM v AS s, previous.s AS was GROUP BY k COMMIT AND KEEP AFTER true").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("a", 1, None), ("a", 3, 1), ("b", 3, None), ("b", 7, 3), ("a", 8, 3), ("c", 6, None)]))


def test_hash_is_one_function(spark):
    """On a map plan and in the machine, for every kind of value."""
    values = spark.createDataFrame([(1, "a", -5, 2.5, True, [1, 2], "é" * 40), (2, None, 1 << 40, -0.0, False, [], "")], "n int, s string, big long, f double, b boolean, v array<int>, w string")
    fields = ", ".join(f"HASH {c} AS h_{c}" for c in values.columns)
    e = Engine(spark).table("t", values, ["n"])
    column = e.query(f"FROM t SELECT n, {fields}").collect()
    machine = e.query(f"FROM t SELECT n, {fields}, n + (previous.x |? 0) AS x").collect()
    assert [tuple(r)[:8] for r in sorted(column)] == [tuple(r)[:8] for r in sorted(machine)] and len({r.h_big for r in column}) == 2
