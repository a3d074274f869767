"""Resampling, pivots, alerts, notifications, requests."""

import json
import random

import pytest

from tidegauge.series import alert, notify, pivot, resample
from tidegauge.series.api import Api


def test_resample_points_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.uniform(-50, 150), r.choice(["a", "b"]), r.choice([None, r.uniform(-9, -1)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "start double, k string, v double")
    got = {(x.t, x.k): x for x in resample.resample(df, 0, 100, 10, {"v": "max"}, ["k"], at="begin").collect()}
    assert len(got) == 20
    for b in range(10):
        for k in "ab":
            vs = [v for s, kk, v in rows if kk == k and b * 10 <= s < b * 10 + 10 and v is not None]
            assert got[(b * 10.0, k)].v == (max(vs) if vs else None)


def test_resample_weighs_intervals(spark):
    df = spark.createDataFrame([(5.0, 25.0, 2.0), (40.0, 50.0, 3.0)], "start double, stop double, v double")
    sums = [x.v for x in resample.resample(df, 0, 60, 6, {"v": "sum"}, stop="stop").orderBy("t").collect()]
    assert sums == [1.0, 2.0, 1.0, None, 3.0, None]
    avgs = [x.v for x in resample.resample(df, 0, 60, 6, {"v": "avg"}, stop="stop").orderBy("t").collect()]
    assert avgs == [2.0, 2.0, 2.0, None, 3.0, None]
    assert resample.aligned(7, 23, 5) == (5, 25, 4)
    with pytest.raises(ValueError):
        resample.resample(df, 0, 0, 6, {"v": "sum"})


def test_possible_values_and_reaggregation(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, "b", 2), (61.0, "a", 5)], "start double, k string, v int")
    assert sorted(r.k for r in resample.possible_values(df, "k", 0, 10).collect()) == ["a", "b"]
    got = sorted(map(tuple, resample.reaggregate(df, ["k"], 60, ["v"]).collect()))
    assert got == [("a", 0, 1), ("a", 60, 5), ("b", 0, 2)]
    assert df.filter(resample.simple_filter([{"lhs": "v", "op": ">", "rhs": 1}, {"lhs": "k", "op": "=", "rhs": "a"}])).count() == 1


def test_pivot(spark):
    df = spark.createDataFrame([(1.0, "h", "cpu.idle", 10.0), (2.0, "h", "CPU.user", 4.0), (3.0, "h", "cpu.user", 8.0), (70.0, "h", "mem", 1.0)], "start double, host string, kind string, v double")
    spec = {"keys": ["host"], "duration": 60, "type": "kind", "value": "v", "fields": [
        {"name": "user", "pattern": "%user"}, {"name": "cpu", "pattern": "cpu%", "aggregates": ["sum", "count", "last", {"percentiles": [50]}]}]}
    rows = sorted(pivot.pivot(df, spec).collect(), key=lambda r: r.start)
    assert (rows[0].user, rows[0].sum_cpu, rows[0].count_cpu, rows[0].last_cpu, rows[0]["50th_cpu"], rows[0].stop) == (6.0, 22.0, 3, 8.0, 8.0, 60.0)
    assert (rows[1].user, rows[1].count_cpu) == (None, 0)


def test_pivot_tops(spark):
    rows = [(1.0, "h", "disk", v, w) for v, w in [("a", 1), ("b", 5), ("a", 1), ("c", 1), ("c", 2), ("a", 1), (None, 9)]]
    rows += [(70.0, None, "disk", "z", None), (5.0, "h", "net", "q", 1), (130.0, "h", "net", "q", 1)]
    df = spark.createDataFrame(rows, "start double, host string, kind string, v string, w int")
    spec = {"keys": ["host"], "duration": 60, "type": "kind", "value": "v", "fields": [
        {"name": "disk", "pattern": "disk", "aggregates": [{"top": 2}]}, {"name": "heavy", "pattern": "disk", "aggregates": ["count", {"top": 2, "by": "w"}]}]}
    got = {(r.host, r.start): (r.disk, r.top_heavy, r.count_heavy) for r in pivot.pivot(df, spec).collect()}
    assert got == {("h", 0): (["a", "c"], ["b", "a"], 6), (None, 60): (["z"], ["z"], 1), ("h", 120): (None, None, 0)}
    only = {"keys": [], "duration": 60, "type": "kind", "value": "v", "fields": [{"name": "t", "pattern": "net", "aggregates": [{"top": 1}]}]}
    assert {r.start: r.t for r in pivot.pivot(df, only).collect()} == {0: ["q"], 60: None, 120: ["q"]}


def test_alert(spark):
    values = [1, 1, 9, 9, 6, 6, 1, 1]
    df = spark.createDataFrame([(float(i), "a", float(v)) for i, v in enumerate(values)], "start double, k string, v double")
    spec = {"column": "v", "threshold": 8, "recovery": 5, "keys": ["k"]}
    assert [(r.start, r.firing) for r in alert.alert(df, spec).orderBy("start").collect()] == [(2.0, True), (6.0, False)]
    spec |= {"duration": 2, "ratio": 1.0}
    assert [(r.start, r.firing) for r in alert.alert(df, spec).orderBy("start").collect()] == [(4.0, True), (6.0, False)]
    base = alert.judged(df, {"column": "v", "baseline": {"avg_window": 3, "percentile": 50, "max_distance": 2}})
    assert [r.ok for r in base.orderBy("start").collect()][:3] == [True, True, False]


def test_alerter(spark):
    sent = []
    a = notify.Alerter({"": [notify.Contact("ops", lambda m, p: sent.append((m, p["time"])), resend=60)]}, debounce=10)
    df = spark.createDataFrame([("x", 0.0, True), ("y", 1.0, True), ("y", 5.0, False)], "name string, start double, firing boolean")
    a.deliver(df)
    a.tick(75)
    assert sent == [("x is firing", 10.0), ("x is firing", 70.0)]
    a.ack("x", "ops")
    a.tick(500)
    a.notify("x", 501.0, firing=False)
    assert sent[-1] == ("x is over", 501.0) and len(sent) == 3 and len(a.closed) == 2
    strict = notify.Alerter({"": []}, allowed_false=0)
    strict.notify("p", 0.0, certainty=0.3)
    strict.notify("q", 1.0, certainty=1.0)
    assert not strict.open["p"].passed and strict.open["q"].passed
    strict.notify("z", 2.0, timeout=5)
    strict.tick(10)
    assert "z" not in strict.open


def test_api(spark):
    df = spark.createDataFrame([(float(i), f"h{i % 2}", float(i)) for i in range(20)], "start double, host string, load double")
    api = Api({"sys/load": (df, ["host"])})
    call = lambda m, **p: json.loads(api.call(json.dumps({"id": 1, "method": m, "params": p})))
    assert call("get-tables", prefix="sys")["result"] == {"sys/load": ""}
    assert call("get-columns", tables=["sys/load"])["result"]["sys/load"]["host"]["factor"]
    r = call("get-timeseries", table="sys/load", since=0, until=20, num_points=2, select=["load"], consolidation="max", factors=["host"])["result"]
    assert sorted((x["host"], x["load"]) for x in r) == [("h0", 8.0), ("h0", 18.0), ("h1", 9.0), ("h1", 19.0)]
    assert "error" in call("nope") and call("version")["result"]
    assert [n["id"] for n in api.find("sys/load.h*")] == ["sys/load.h0", "sys/load.h1"]
    assert [n["id"] for n in api.find("sys/load.h1.*")] == ["sys/load.h1.load"]
    rows = api.render("sys/load.h*.load", 0, 20, 2).collect()
    assert {x.target for x in rows} == {"sys/load.h0.load", "sys/load.h1.load"} and len(rows) == 4
    api.set_alerts({"sys/load": [{"column": "load", "threshold": 3}]})
    with pytest.raises(KeyError):
        api.set_alerts({"none": []})


def test_find_among_many_values(spark):
    df = spark.range(2500).selectExpr("cast(id as double) start", "concat('h', id) host", "cast(id as double) load")
    api = Api({"t": (df, ["host"])})
    for name in ("h7", "h1234", "h2499"):
        assert [n["id"] for n in api.find(f"t.{name}")] == [f"t.{name}"]
        assert [n["id"] for n in api.find(f"t.{name}.load")] == [f"t.{name}.load"]
    assert {n["text"] for n in api.find("t.h249[0-4]")} == {f"h249{i}" for i in range(5)}
    assert len(api.find("t.h2???")) == 500 and api.find("t.x*") == []
    for query in ("t.*", "t.h*.load"):
        with pytest.raises(ValueError):
            api.find(query)


def test_seasonal_baseline(spark):
    """Windows of 10 s, every other one high: only the season's own past is a baseline."""
    level = [10, 100, 10, 100, 20, 100, 10, 10]
    rows = [(w * 10.0 + i, k, float(v)) for k in ("a", None) for w, v in enumerate(level) for i in range(10)]
    df = spark.createDataFrame(rows, "start double, k string, v double")
    base = {"avg_window": 10, "percentile": 50, "max_distance": 0.2, "seasonality": 2, "smooth_factor": 0.5}
    spec = {"column": "v", "keys": ["k"], "baseline": base}
    j = alert.judged(df, spec)
    assert j.count() == len(rows)
    bad = {(r.k, r.start // 10) for r in j.collect() if not r.ok}
    # 20 against 10; 10 against the smoothed (10 + 20) / 2; 10 against 100.
    assert bad == {(k, w) for k in ("a", None) for w in (4, 6, 7)}
    bad = {r.start // 10 for r in alert.judged(df, spec | {"baseline": base | {"smooth_factor": 0.05}}).collect() if not r.ok}
    assert bad == {4, 7}
    api = Api({"t": (df, ["k"])})
    api.set_alerts({"t": [spec]})
    assert {(r.k, r.start, r.firing) for r in api.changes["t"][0].collect()} == {(k, *c) for k in ("a", None) for c in ((40.0, True), (50.0, False), (60.0, True))}
