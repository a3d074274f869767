"""General operators against brute force, and their defined edge cases."""

import math
import random

import numpy as np
import pytest

from tidegauge.operators import grid, intervals, panes, spikes, widen
from tidegauge.sources.monitoring import readings

METRIC = "metric_id long, host string, time double, plugin_name string, plugin_instance string, type_name string, type_instance string, num_values int, values array<double>, recv_time double, extra string, s1 string"
TYPES = "type_name string, value_pos int, ds_name string, ds_type string, min_value double, max_value double"


def metric(i, t, v, host="h", plugin="p", inst=None, kind="g", ti=None, recv=None):
    return (i, host, t, plugin, inst, kind, ti, None if v is None else len(v), v, t + 1 if recv is None else recv, "x", "clash")


# -- panes


def test_panes_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.uniform(0, 3000)]), r.choice([None, r.uniform(0, 8000)]), r.choice([None, 1.0, 2.0]), "z") for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, event_time double, received double, value double, epoch string")
    for spec in (panes.Slicing(), panes.Slicing(size=900, slide=300, delay=60, cutoff=1260, tick=60)):
        got = {(x.k, x.period_start): (x.first_n, x.final_n, x.late_n, x.dropped_n) for x in panes.windows(df, ["k"], spec).collect()}
        want = {}
        for k, e, rec, _, _ in rows:
            if k is None or e is None or rec is None:
                continue
            for w in range(int(e // 300) * 300 - spec.size + 300, int(e // 300) * 300 + 1, spec.slide):
                c = want.setdefault((k, w), [0, 0, 0, 0])
                end = w + spec.size
                if rec <= end + spec.delay:
                    c[0] += 1
                    c[1] += 1
                elif rec <= end + spec.cutoff:
                    c[1] += 1
                    c[2] += 1
                else:
                    c[3] += 1
        assert got == {k: tuple(v) for k, v in want.items()}
        last = {}
        for x in sorted(panes.revisions(df, ["k"], spec).collect(), key=lambda x: x.revision):
            last[(x.k, x.period_start)] = x.n
        assert last == {k: v[1] for k, v in got.items() if v[1]}


def test_panes_empty_and_invalid(spark):
    df = spark.createDataFrame([], "k string, event_time double, received double, value double")
    assert panes.windows(df, ["k"]).collect() == [] == panes.revisions(df, ["k"]).collect()
    with pytest.raises(ValueError):
        panes.Slicing(tick=7)


# -- intervals


def brute(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_interval_map():
    r = random.Random(1)
    for _ in range(50):
        m, spans = intervals.IntervalMap(), []
        for _ in range(r.randrange(1, 40)):
            s = r.randrange(200)
            spans.append((s, s + r.choice([0, 1, 5, 60])))
            m.insert(*spans[-1])
        assert list(zip(m.starts, m.ends)) == brute(spans)
        n = intervals.IntervalMap()
        n.insert_many(np.array([s for s, _ in spans]), np.array([e for _, e in spans]))
        assert (n.starts, n.ends) == (m.starts, m.ends)
        assert m.gaps() == [(a[1], b[0]) for a, b in zip(brute(spans), brute(spans)[1:])]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_intervals_across_chunks(spark, kind):
    r = random.Random(2)
    rows = []
    for _ in range(600):
        s = r.randrange(20_000)
        rows.append((str(r.choice([1, 1, 1, 2, 3])) if kind == "string" else r.choice([1, 1, 1, 2, 3]), s, s + r.choice([-5, 0, 3, 20, 4000 if r.random() < 0.05 else 10]), "x"))
    rows += [(None, 1, 2, "x"), (rows[0][0], None, 4, "x"), (rows[0][0], 5, None, "x"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, f"entity {kind}, start long, end long, chunk string").repartition(3)
    want = {}
    for k, s, e, _ in rows:
        if k is not None and s is not None and e is not None and e >= s:
            want.setdefault(k, []).append((s, e))
    want = {k: brute(v) for k, v in want.items()}
    got = sorted((x.entity, x.period_start, x.period_end) for x in intervals.periods(df, 500).collect())
    assert got == sorted((k, a, b) for k, v in want.items() for a, b in v)
    gaps = sorted((x.entity, x.gap_start, x.gap_end) for x in intervals.gaps(df, 500).collect())
    assert gaps == sorted((k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:]))


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "entity long, start long, end long")
    assert intervals.gaps(df).collect() == [] == intervals.periods(df).collect()


# -- spikes


def test_spikes_against_brute_force(spark):
    r = random.Random(5)
    rows, i = [], 0
    for s in range(6):
        v = 50.0
        for t in range(80):
            i += 1
            v = v if 20 <= t < 20 + 12 + s else round(r.gauss(50, 2), 1)
            x = [v, 7.0] if s % 2 else [v]
            if r.random() < 0.04:
                x[0] = r.choice([float("nan"), float("inf"), 101.0, -3.0, 90.0, 0.0])
            rows.append(metric(i, 1000.0 + 7200 * t, x, inst=str(s)))
    rows += [metric(9001, 5.0, None), metric(9002, 5.0, []), metric(9003, None, [1.0], recv=1.0), metric(9004, 9.0, [None, 3.0], inst="0"), rows[5], metric(9005, 1.0, [500.0], kind="d")]
    rows += [metric(10_000 + k, float(k), [5.0], inst="same") for k in range(30)]
    df = spark.createDataFrame(rows, METRIC)
    types = spark.createDataFrame([("g", 0, "v", "gauge", 0.0, 100.0), ("g", 1, "w", "gauge", None, None), ("d", 0, "x", "derive", 0.0, 1.0)], TYPES)
    got = {x.metric_id for x in spikes.confirmed(spikes.spikes(readings(df), types)).collect()}
    series = {}
    for m in rows:
        if m[2] is not None and m[8] and m[5] == "g":
            series.setdefault(m[4], []).append(m)
    want = set()
    for ms in series.values():
        good, varies = {}, False
        for m in ms:
            for p, v in enumerate(m[8]):
                if v is None:
                    continue
                if not math.isfinite(v) or p == 0 and not 0 <= v <= 100:
                    want.add(m[0])
                else:
                    good.setdefault(p, []).append((v, m[0]))
        for vs in good.values():
            x = np.array([v for v, _ in vs])
            if x.min() == x.max():
                continue
            varies = True
            c = np.median(x)
            mad = np.median(np.abs(x - c))
            want |= {k for v, k in vs if abs(v - c) > 12 * mad}
        if varies:
            ms.sort(key=lambda m: (m[2], m[0]))
            run = [ms[0]]
            for m in [*ms[1:], None]:
                if m is not None and m[8] == run[-1][8]:
                    run.append(m)
                    continue
                if len(run) >= 15:
                    want |= {x[0] for x in run}
                run = [m]
    assert got == want
    assert 9002 not in got and 10_005 not in got


def heavy_tailed(n, seed):
    """Normal values with a season of two levels and a few far spikes."""
    g = np.random.default_rng(seed)
    v = g.normal(0, 1, n) + np.where(np.arange(n) // 60 % 24 < 12, 0.0, 0.5)
    far = g.choice(n, 12, replace=False)
    v[far] = g.choice([-60.0, 45.0, 200.0], 12)
    return v, set(far.tolist())


def test_the_fit_sets_the_cutoff(spark):
    rows, far = [], set()
    for s in range(3):
        v, f = heavy_tailed(2000, s)
        rows += [metric(s * 10_000 + i, 60.0 * i, [float(x)], inst=str(s)) for i, x in enumerate(v)]
        far |= {s * 10_000 + i for i in f}
    df = spark.createDataFrame(rows, METRIC)
    types = spark.createDataFrame([("g", 0, "v", "gauge", None, None)], TYPES)

    def tails(risk, **rules):
        flags = spikes.spikes(readings(df), types, spikes.Rules(risk=risk, **rules)).filter("rule = 'tail'").collect()
        return {x.metric_id: x for x in flags}

    runs = [tails(r) for r in (1e-2, 1e-3, 1e-4, 1e-6)]
    sizes = [len(x) for x in runs]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    assert all(set(b) <= set(a) for a, b in zip(runs, runs[1:]))
    # At a risk of 1 in 10 000 the spikes and about that share of normal values are left.
    assert far <= set(runs[2]) and len(set(runs[2]) - far) <= 6
    cutoffs = {x.cutoff / x.scale for x in runs[2].values()}
    assert len(cutoffs) == 3 and all(4 < c < 9 for c in cutoffs) and {x.fit for x in runs[2].values()} == {"series"}
    # Untrimmed, the spikes inflate the fit and hide behind it.
    assert not far <= set(tails(1e-4, trim_mads=1e9))
    assert {x.fit for x in tails(1e-4, least_peaks=10**9).values()} == {"none"}
    assert {x.fit for x in tails(1e-4, prior=1000).values()} == {"pooled"}


def test_spikes_empty(spark):
    df, types = spark.createDataFrame([], METRIC), spark.createDataFrame([], TYPES)
    assert spikes.spikes(readings(df), types).collect() == []


# -- grid


def test_ssa_recovers_a_sine():
    x = np.sin(np.arange(300) / 7.0) * 10 + 100
    y = x.copy()
    holes = np.r_[40:46, 120, 200:204, 299]
    y[holes] = np.nan
    z = grid.ssa_fill(y, rank=4, rounds=50, tol=1e-6)
    assert np.abs(z[holes] - x[holes]).max() < 1.0 and (z[~np.isnan(y)] == y[~np.isnan(y)]).all()
    linear = np.interp(holes, np.flatnonzero(~np.isnan(y)), y[~np.isnan(y)])
    assert np.abs(z[holes[:-1]] - x[holes[:-1]]).mean() < np.abs(linear[:-1] - x[holes[:-1]]).mean()


@pytest.mark.parametrize("period", [40, 96])
def test_ssa_converges_over_long_holes(period):
    t = np.arange(300)
    true = 3 * np.sin(2 * np.pi * t / period) + 10
    y = true + np.random.default_rng(0).normal(0, 0.1, 300)
    holes = np.arange(140, 160)
    y[holes] = np.nan
    z = grid.ssa_fill(y)
    assert np.sqrt(np.mean((z[holes] - true[holes]) ** 2)) < 0.15
    # A fixed point of the plain iteration: averaging the diagonals again changes nothing.
    h = np.lib.stride_tricks.sliding_window_view(z - np.nanmean(y), 16)
    _, v = np.linalg.eigh(h.T @ h)
    near = h @ v[:, -3:] @ v[:, -3:].T
    plain = [np.mean([near[s, k - s] for s in range(k - 15, k + 1)]) + np.nanmean(y) for k in holes]
    assert np.abs(plain - z[holes]).max() < 0.01


def test_solve_of_the_holes_against_dense():
    r = np.random.default_rng(5)
    holes, width = np.sort(r.choice(900, 300, replace=False)), 16
    band = r.normal(size=(900, width))
    full = np.zeros((900, 900))
    for s in range(900 - width + 1):
        full[s : s + width, s : s + width] += np.outer(band[s], band[s]) + 0.1 * np.eye(width)
    links = np.array([[full[h, h + k] if 0 <= h + k < 900 else 0.0 for k in range(1 - width, width)] for h in holes])
    right = r.normal(size=300)
    assert np.allclose(grid._solve(links, holes, right, width), np.linalg.solve(full[np.ix_(holes, holes)], right))


def test_unconverged_entries_have_their_state(spark):
    r = np.random.default_rng(1)
    rows = [metric(k, 10.0 * k, [float("nan") if k == 9 else float(r.normal())]) for k in range(60) if k not in (20, 21)]
    df = readings(spark.createDataFrame(rows, METRIC))
    hosts = spark.createDataFrame([("h", 10, "s", 4)], "host string, step_s int, site string, n_cores int")
    states = {n: {x.slot_start: x.state for x in grid.regular(df, hosts, rounds=n).collect()} for n in (1, 2000)}
    assert (states[1][90], states[1][200], states[1][210], states[1][100]) == ("no_value_unconverged", "unconverged", "unconverged", "observed")
    assert (states[2000][90], states[2000][200]) == ("no_value", "filled")
    assert sorted(x.slot_start for x in grid.missing_slots(grid.regular(df, hosts, rounds=1, holes_only=True)).collect()) == [200, 210]


@pytest.mark.parametrize("x", [[np.nan] * 4, [1.0], [1.0, np.nan], [2.0, 2.0, np.nan, 2.0, 2.0, np.nan, 2.0, 2.0], [np.nan, 3.0, np.nan]])
def test_ssa_on_short_and_constant_series(x):
    y = grid.ssa_fill(np.array(x))
    known = ~np.isnan(np.array(x))
    assert (y[known] == np.array(x)[known]).all()
    if known.any():
        assert not np.isnan(y).any()


def test_how_holes_came_by_their_values():
    r = np.random.default_rng(3)
    noisy = r.normal(size=60)
    noisy[[7, 8, 30]] = np.nan
    flat = np.array([2.0, 2.0, np.nan] * 20)
    assert grid.ssa_impute(noisy)[1] == grid.FILLED and grid.ssa_impute(noisy, rounds=1)[1] == grid.UNCONVERGED
    assert grid.ssa_impute(flat)[1] == grid.INTERPOLATED == grid.ssa_impute(np.array([1.0, np.nan, 3.0]))[1]
    assert grid.ssa_impute(np.full(4, np.nan))[1] == grid.UNKNOWN and grid.ssa_impute(np.arange(3.0))[1] == grid.FILLED
    assert grid.STATES[2 + 2 * grid.UNCONVERGED] == "unconverged" and grid.STATES[1 + 2 * grid.UNKNOWN] == "no_value_unknown"


def test_grid(spark):
    nan = float("nan")
    rows = [metric(k, float(t), [v]) for k, (t, v) in enumerate([(3, 1.0), (14, 2.0), (55, nan), (58, 4.0), (71, 5.0), (72, 7.0), (109, nan)])]
    rows += [metric(50, 25.0, [1.0], inst="other"), metric(51, 86_405.0, [1.0]), metric(52, 10.0, [1.0], host="unknown"), metric(53, None, [1.0], recv=3.0), metric(54, 30.0, [], plugin="p")]
    df = readings(spark.createDataFrame(rows, METRIC))
    hosts = spark.createDataFrame([("h", 10, "s", 4), ("z", None, "s", 1)], "host string, step_s int, site string, n_cores int")
    g = grid.regular(df, hosts)
    cells = {(x.plugin_instance, x.slot_start): (x.state, x.value) for x in g.collect()}
    assert len(cells) == 11 * 2 + 1
    assert cells[(None, 70)] == ("observed", 6.0) and cells[(None, 100)][0] == "no_value_interpolated" and cells[(None, 20)][0] == "interpolated"
    assert cells[(None, 20)][1] is not None
    missing = sorted(x.slot_start for x in grid.missing_slots(g).collect())
    assert missing == [30, 40, 60, 80, 90]
    assert sorted(x.slot_start for x in grid.missing_slots(grid.regular(df, hosts, holes_only=True)).collect()) == missing
    empty = grid.regular(readings(spark.createDataFrame([], METRIC)), hosts)
    assert empty.collect() == [] == grid.missing_slots(empty).collect()


# -- wide tables


def test_wide(spark):
    rows = [("h", 1, "b", 2.0, 5.0, 1), ("h", 1, "a", 1.5, 5.0, 2), ("h", 1, "a", 1.7, 4.0, 3), ("h", 1, "a", 1.7, 4.0, 3), ("h", 2, "host", 9.0, 1.0, 4), ("h", 2, None, 9.0, 1.0, 5),
            ("h", 2, "b", float("nan"), 1.0, 6), (None, 2, "b", 1.0, 1.0, 7), ("h", 3, "b", None, 1.0, 8), ("h", 2, "a", 3e30, 1.0, 9)]
    df = spark.createDataFrame(rows, "host string, time_ms long, attribute string, value double, recv_time double, metric_id long")
    names = widen.dictionary(df)
    assert names == ["a", "b", "host"]
    got = {x.time_ms: x for x in widen.wide(df, ["host", "time_ms"], names, ["recv_time", "metric_id"], {"b": "bigint", "a": "int"}).collect()}
    assert (got[1].a, got[1].b, got[1].attr_host, got[1].conflicts) == (1, 2, None, ["a"])
    assert (got[2].a, got[2].b, got[2].attr_host, got[2].conflicts) == (None, None, 9.0, [])
    assert set(got) == {1, 2}
    assert widen.wide(df.limit(0), ["host", "time_ms"], names, ["recv_time"]).collect() == []
    assert widen.wide(df, ["host", "time_ms"], [], ["recv_time"]).collect() == []
