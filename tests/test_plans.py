"""Plans that spread an operation over tasks, against the commit machine."""

import random

import pytest

from tidegauge.plans import planner
from tidegauge.plans.planner import Engine


@pytest.fixture(scope="module")
def inputs(spark):
    r = random.Random(4)
    rows = [(i, float(i // 3), r.choice("aaab"), r.choice([1.0, 2.0, 3.0]), r.choice(["x", "y", None]), r.choice("pq")) for i in range(400)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "id long, start double, kind string, v double, maybe string, k string").repartition(5)


OPERATIONS = [
    "FROM t SELECT id, v WHERE (LAG v < v) |? false",
    "FROM t SELECT id, LAG v AS l, v - (LAG v |? 0.) AS d, LAG kind AS p KEEP",
    "FROM t SELECT id, kind COMMIT AFTER (CHANGED kind |? true) AND KEEP",
    "FROM t SELECT id, maybe COMMIT AFTER (CHANGED maybe |? true) AND KEEP",
    "FROM t SELECT id, maybe WHERE v > 1 GROUP BY k COMMIT AFTER (CHANGED maybe |? true) AND KEEP",
    "FROM t SELECT kind, COUNT id AS n, FIRST id AS f, LAST id AS l, SUM v AS s, MAX v AS m COMMIT BEFORE COALESCE(in.kind <> FIRST kind, false)",
    "FROM t SELECT kind, COUNT id AS n WHERE v < 3 COMMIT BEFORE COALESCE(in.kind <> FIRST kind, false)",
]


@pytest.mark.parametrize("op", OPERATIONS)
def test_chained_plans_equal_the_machine(spark, inputs, op, monkeypatch):
    engines = []
    for keep in (True, False):
        e = Engine(spark).table("t", inputs if keep else inputs, ["start", "id"], ["id", "start", "kind", "v", "k"])
        if not keep:
            monkeypatch.setattr(planner.Run, "kind", lambda *a: "machine")
        engines.append((e, e.query(op)))
    (e, chained), (_, machine) = engines
    assert e.plans["result"] == "chained"
    text = chained._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "MapInArrow" not in text
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, chained.collect()), key=key) == sorted(map(tuple, machine.collect()), key=key)
    assert len(chained.columns) == len(machine.columns)


@pytest.mark.parametrize("op", OPERATIONS)
def test_chained_plans_of_nothing(spark, inputs, op):
    for rows in (inputs.limit(0), inputs.filter("id = 7")):
        got = Engine(spark).table("t", rows, ["start", "id"], ["id", "start", "kind", "v", "k"]).query(op).collect()
        assert len(got) <= rows.count()


def test_what_is_not_chained(spark, inputs):
    e = Engine(spark).table("t", inputs, ["start", "id"], ["id", "start", "kind", "v", "k"])
    for op in ("FROM t SELECT id, LAG(2, v) AS l KEEP", "FROM t SELECT id, LAG v AS l, SUM v AS s KEEP", "FROM t SELECT id, LAG maybe AS l KEEP"):
        e.query(op)
        assert e.plans["result"] == "running"
