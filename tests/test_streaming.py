"""Streams run to completion give what the batch plans give."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidegauge.lang.tree import LanguageError
from tidegauge.operators import panes
from tidegauge.plans.planner import Engine
from tidegauge.streaming.panes import PaneState, revisions_stream


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


@pytest.fixture
def source(spark, tmp_path):
    rows = [(i, float(i * 7 % 600 + i), ["a", "b"][i % 2], float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, start double, k string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return df, stream


def test_map(spark, source, tmp_path):
    df, stream = source
    op = 'FROM t SELECT id, v * 2 AS w WHERE k = "a"'
    got = run(Engine(spark).table("t", stream, ["id"]).query(op), tmp_path, "m1")
    assert sorted(got) == sorted(Engine(spark).table("t", df, ["id"]).query(op).collect())


def test_machine(spark, source, tmp_path):
    df, stream = source
    op = "FROM t SELECT id, SUM v AS s, LAG v AS l, SMOOTH(0.5, v) AS m GROUP BY k KEEP"
    got = run(Engine(spark).table("t", stream, ["id"]).query(op), tmp_path, "m2")
    assert sorted(got) == sorted(Engine(spark).table("t", df, ["id"]).query(op).collect())


def test_sort_buffer_is_kept_between_batches(spark, source, tmp_path):
    df, _ = source
    for k in range(0, 60, 15):
        f = tmp_path / "sorted" / f"{k:05}.parquet"
        f.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table(dict(zip(df.columns, map(list, zip(*sorted(map(tuple, df.collect()))[k : k + 15]))))), f)
        os.utime(f, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sorted"))
    for n, op in enumerate(["FROM t SORT LAST 8 BY start SELECT id, start", "FROM t SORT LAST 30 OR UNTIL sort_greatest.start > sort_smallest.start + 200 BY start SELECT id, LAG start AS l"]):
        got = run(Engine(spark).table("t", stream, ["id"]).query(op), tmp_path, f"sorted{n}")
        want = Engine(spark).table("t", df, ["id"]).query(op).collect()
        assert got == want and 0 < len(want) < 60


def test_lateness_follows_from_the_condition(spark, source):
    _, stream = source
    e = Engine(spark).table("t", stream, ["id"])
    for bound, late in [("(out.w + 2) * 10", 10.0), ("out.w * 10 + 25", 15.0), ("10 * (out.w + 1)", 0.0), ("out.first + 1.5 * 10", 5.0)]:
        plan = e.query(f"FROM t SELECT MIN start AS first, start // 10 AS w, COUNT id AS n GROUP BY start // 10 COMMIT AFTER in.start > {bound}")
        text = plan._jdf.queryExecution().analyzed().toString()
        assert f"{int(late)} seconds" in text or late == 0 and "0 seconds" in text, (bound, text)
    with pytest.raises(LanguageError):
        e.query("FROM t SELECT start // 10 AS w, COUNT id AS n GROUP BY start // 10 COMMIT AFTER in.start > out.w * out.w")


def test_split_with_state_is_refused(spark, source):
    _, stream = source
    with pytest.raises(LanguageError):
        Engine(spark).table("t", stream, ["id"]).query('FROM t SELECT SPLIT(" ", k) AS x, SUM v AS s GROUP BY k KEEP')


def test_tumbling_watermark(spark, source, tmp_path):
    df, stream = source
    op = "FROM t SELECT k, start // 100 AS w, SUM v AS s, COUNT id AS n GROUP BY k, start // 100 COMMIT AFTER in.start > out.w * 100 + 200"
    e = Engine(spark, lateness=0.0).table("t", stream, ["id"])
    got = {(r.k, r.w): (r.s, r.n) for r in run(e.query(op), tmp_path, "m3")}
    whole = {(r.k, r.w): (r.s, r.n) for r in Engine(spark).table("t", df, ["id"]).query(op).collect()}
    assert got and all(whole[k] == v for k, v in got.items())


SLIDING = panes.Slicing(size=900, slide=300, delay=30, cutoff=930, tick=30)


def arrivals(spec, n=300, seed=1):
    """Records of two busy keys and one that falls silent, in the order of receipt."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        got = 86_400 + 20.0 * i
        late = r.choice([0, 0, 1, 5, 40, 400, 800, 1200, 3000])
        rows.append(("ab"[i % 2], got - late, got, r.choice([None, 1.0, 2.5])))
        if i < 40:
            rows.append(("silent", got - late / 2, got, 1.0))
    # The clock of the stream, and of the busy keys, passes every cut-off.
    end = 86_400 + 20.0 * n + spec.size + spec.cutoff + 1000
    return rows + [(k, end, end + 1, None) for k in "ab"] + [("clock", end, end + 10_000, None)]


def batch_of(spark, rows, spec):
    """What the batch publishes, but for the windows that only the last records open."""
    df = spark.createDataFrame(rows, "k string, event_time double, received double, value double")
    last = max(r[1] for r in rows)
    want = panes.revisions(df, ["k"], spec).collect()
    return df, sorted((r.k, r.period_start, r.revision, r.published_at, r.n, r.total) for r in want if r.period_start + spec.size <= last - spec.size)


@pytest.mark.parametrize("spec", [panes.Slicing(), SLIDING, panes.Slicing(size=600, slide=300, delay=0, cutoff=60, tick=60)])
def test_pane_states_publish_what_the_batch_does(spark, spec):
    rows = arrivals(spec)
    _, want = batch_of(spark, rows, spec)
    states, got = {}, []
    for k, event, received, value in rows:
        got += [(k, *w) for w in states.setdefault(k, PaneState(spec)).add(event, received, value)]
    for k, s in states.items():
        got += [(k, *w) for w in s.advance(rows[-1][2])]
    last = max(r[1] for r in rows)
    got = sorted(r for r in got if r[1] + spec.size <= last - spec.size)
    assert got == want and len(got) == len({r[:3] for r in got}) and len(want) > 40


def test_panes_on_a_stream_every_revision(spark, tmp_path):
    """Several micro-batches, sliding windows, a key that falls silent and is then forgotten."""
    rows = arrivals(SLIDING)
    df, want = batch_of(spark, rows, SLIDING)
    (tmp_path / "p").mkdir()
    for k in range(0, len(rows), 60):
        # Files are read in the order of their times.
        f = tmp_path / "p" / f"{k:05}.parquet"
        pq.write_table(pa.table(dict(zip(df.columns, map(list, zip(*rows[k : k + 60]))))), f)
        os.utime(f, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    q = revisions_stream(stream, ["k"], SLIDING, disorder=100.0)
    got = run(q, tmp_path, "panes_every")
    last = max(r[1] for r in rows)
    got = sorted((r.k, r.period_start, r.revision, r.published_at, r.n, r.total) for r in got if r.period_start + SLIDING.size <= last - SLIDING.size)
    assert [r for r in got if r[0] == "silent"] and got == want


def test_pane_state_ignores_what_is_too_late_and_forgets():
    s = PaneState(panes.Slicing())
    assert list(s.add(10.0, 11.0, 1.0)) == []
    assert list(s.add(20.0, 331.0, None)) == [(0, 0, 330, 1, 1.0)]
    assert list(s.add(30.0, 3901.0, 1.0)) == [(0, 1, 360, 2, 1.0)]
    assert list(s.advance(1e9)) == [] and s.next_due() is None and not s.panes and not s.revision
    assert list(s.add(40.0, 5.0, 1.0)) == [] and not s.panes
