"""Operators on identifier sets and corpora: brute force, round trips, edge cases."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tidegauge.llm import frequent, kmv, mixing, quality, tokens
from tidegauge.llm.queries import QUERIES, SQL

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tokenizer = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizers")
DOC = "doc_id long, text string, source string, n_tokens string, ids string, shard string"


def doc(i, text, source="s"):
    return (i, text, source, "clash", "clash", "clash")


# -- frequent items


def test_top_k_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, None]), int(r.paretovariate(0.8)) if r.random() < 0.9 else None, "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g long, item long, n string").repartition(4)
    got = {}
    for x in frequent.top_k(df.select("g", "item"), ["g"], "item", 5).collect():
        got.setdefault(x.g, []).append((x["rank"], x.item, x.n))
    for g in (1, 2, None):
        c = Counter(i for gg, i, _ in rows if gg == g and i is not None)
        want = sorted(c.items(), key=lambda t: (-t[1], t[0]))[:5]
        assert sorted(got[g]) == [(k + 1, i, n) for k, (i, n) in enumerate(want)]
    assert frequent.top_k(df.limit(0).select("g", "item"), ["g"], "item", 5).collect() == []
    with pytest.raises(ValueError):
        frequent.top_k(df, ["g"], "item", 5000)


def test_items_of_arrays(spark):
    df = spark.createDataFrame([([1, 1, None], None), (None, [2, 3]), ([], [])], "a array<long>, b array<int>")
    rows = df.select(F.explode(frequent.items_of({"a": "a", "b": "b"})).alias("x")).select("x.*").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 2), ("b", 3)]


def test_heavy_items_whatever_a_row_holds(spark):
    r = random.Random(9)
    rows = [(1, [int(r.paretovariate(0.6)) for _ in range(r.choice([0, 1, 25]))], None if r.random() < 0.1 else [7]) for _ in range(400)] + [(2, None, None), (2, [3], [])]
    df = spark.createDataFrame(rows, "g long, a array<long>, b array<int>")
    most = frequent.most_items(df, ["a", "b"])
    assert most == 25 and frequent.most_items(df.limit(0), ["a", "b"]) == 1 and frequent.most_items(df.filter("g = 2"), ["a"]) == 1
    items = df.select("g", F.explode(frequent.items_of({"a": "a"})).alias("x")).select("g", "x.item")
    totals = df.groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    for share in (0.05, 0.02):  # 500 and 1250 candidates
        got = {(x.g, x.item, x.n) for x in frequent.heavy(items, totals, ["g"], "item", share, most).collect()}
        c = Counter((g, i) for g, a, _ in rows for i in set(a or []))
        n = Counter(g for g, _, _ in rows)
        assert got == {(g, i, k) for (g, i), k in c.items() if k >= share * n[g]}


def test_local_limit_comes_before_the_shuffle(spark):
    plan = frequent.top_k(spark.range(100).selectExpr("id % 3 g", "id item"), ["g"], "item", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# -- distinct counts


def test_kmv_estimates(spark):
    k = 256
    df = spark.range(60_000).selectExpr("id % 3 g", "id v").select("g", kmv.hashed(F.col("v")).alias("h"))
    df = df.unionByName(df).unionByName(spark.createDataFrame([(0, None), (9, None)], "g long, h long"))
    c = kmv.counts(df, ["g"], k)
    lo, hi = kmv.bounds(F.col("n"), F.col("kth"), k)
    for r in c.select("g", kmv.estimate(F.col("n"), F.col("kth"), k).alias("e"), lo.alias("lo"), hi.alias("hi")).collect():
        assert abs(r.e - 20_000) < 4 * 20_000 / (k - 2) ** 0.5 and r.lo < r.e < r.hi
    small = kmv.counts(df.filter("h > 9.2e18"), ["g"], k)
    assert all(r.n < k for r in small.collect())
    assert {r.g for r in c.collect()} == {0, 1, 2}
    assert kmv.counts(df.limit(0), ["g"], k).collect() == []


def test_kmv_merge_and_set_operations(spark):
    k = 512
    rows = spark.range(30_000).selectExpr("explode(case when id < 10000 then array('a') when id < 20000 then array('a','b') else array('b') end) g", "id v")
    s = kmv.sketches(rows.select("g", kmv.hashed(F.col("v")).alias("h")), ["g"], k)
    whole = kmv.merge(s.select(F.lit(1).alias("all"), "kmv"), ["all"], k).collect()[0].kmv
    direct = kmv.sketches(rows.select(F.lit(1).alias("all"), kmv.hashed(F.col("v")).alias("h")), ["all"], k).collect()[0].kmv
    assert whole == direct
    a, b = (s.filter(F.col("g") == g).select(F.col("kmv").alias(g)) for g in "ab")
    j = a.crossJoin(b)  # one row each
    both, lo, hi = kmv.intersection(F.col("a"), F.col("b"), k)
    new, nlo, nhi = kmv.difference(F.col("a"), F.col("b"), k)
    r = j.select(both.alias("both"), lo.alias("lo"), hi.alias("hi"), new.alias("new"), nlo.alias("nlo"), nhi.alias("nhi"), kmv.size_of(kmv.union(F.col("a"), F.col("b"), k), k).alias("u")).collect()[0]
    assert abs(r.u - 30_000) < 6000 and r.lo <= 10_000 <= r.hi and r.nlo <= 10_000 <= r.nhi
    assert abs(r.both - 10_000) < 2500 and abs(r.new - 10_000) < 2500


def test_bounds_stay_open_where_a_sketch_shows_none_or_all(spark):
    k = 256
    rows = spark.range(40_000).selectExpr("explode(case when id < 20050 and id >= 20000 then array('a','b') when id < 20000 then array('a') else array('b') end) g", "id v")
    s = kmv.sketches(rows.select("g", kmv.hashed(F.col("v")).alias("h")), ["g"], k)
    a, b = (s.filter(F.col("g") == g).select(F.col("kmv").alias(g)) for g in "ab")
    both, lo, hi = kmv.intersection(F.col("a"), F.col("b"), k)
    none, nlo, nhi = kmv.difference(F.col("a"), F.col("a"), k)
    r = a.crossJoin(b).select(both, lo.alias("lo"), hi.alias("hi"), none.alias("none"), nlo.alias("nlo"), nhi.alias("nhi")).collect()[0]
    assert r.lo <= 50 <= r.hi and r.none == r.nlo == 0 < r.nhi < 1000


def test_map_tasks_sketch_before_the_shuffle(spark):
    """A group sends k hashes a task at most, repeats included, however many rows it has."""
    k = 64
    hot = spark.range(0, 40_000, 1, 4).selectExpr("cast(null as string) g", "id % 3 d", "xxhash64(id % 9000) h")
    rows = hot.unionByName(spark.createDataFrame([("x", 1, 5), ("x", 1, 5), ("x", 2, None)], "g string, d long, h long"))
    tasks = rows.rdd.getNumPartitions()
    parts = kmv.partials(rows, ["g", "d"], [["g"], ["d"], ["g", "d"]], k, buffer=1_000_000).collect()
    for i, groups in enumerate((2, 3, 4)):
        mine = [p for p in parts if p._g == i]
        assert len(mine) <= groups * k * tasks and len({(p.g, p.d) for p in mine}) == groups
    assert all(p.d is None for p in parts if p._g == 0) and all(p.g is None for p in parts if p._g == 1)
    want = sorted(r.h for r in hot.select("h").distinct().collect())[:k]
    for buffer in (1_000_000, 100):
        got = kmv.counts_of(kmv.partials(rows, ["g"], [["g"]], k, buffer), ["g"], k).collect()
        assert {(r.g, r.n, r.kth) for r in got} == {(None, k, want[-1]), ("x", 1, 5)}
    assert kmv.partials(rows.limit(0), ["g"], [["g"], []], k).collect() == []
    assert kmv.counts_of(kmv.partials(rows, ["g"], [[]], k), ["_g"], k).collect()[0].n == k


# -- tokens


@needs_tokenizer
def test_tokens_equal_the_other_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", " ", "\r\n\t ", "Hello, world's 42nd <|endoftext|> test", "naïve ſtraße — “quoted” 日本 🙂 x", "a" * 3000, "x y " * 40_000, "don't'll " + "9" * 200, "end  "]
    rows = [doc(i, x) for i, x in enumerate(texts)] + [doc(1, "")]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.ids for r in tokens.encode(df, ["doc_id"]).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
        assert tokens.decode_bytes(got[i]) == (x or "").encode()
    counts = {r.doc_id: r.n_tokens for r in tokens.count(df, ["doc_id"]).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.limit(0), ["doc_id"]).collect() == []
    back = {r.doc_id: r.bytes for r in tokens.decode(tokens.encode(df, ["doc_id"]), ["doc_id"]).collect()}
    assert bytes(back[5]) == texts[5].encode()


@needs_tokenizer
def test_parts_cut_where_the_pattern_does():
    r = random.Random(2)
    encode = tokens.encoding().encode_ordinary
    for _ in range(300):
        s = "".join(r.choice(["a", "bc", " ", "  ", "\n", "'s", "9", "é", "—", "!", " '", "ß", "٣", " "]) for _ in range(200))
        assert "".join(tokens.parts(s, 5)) == s
        assert tokens.encode_text(s, encode, 5) == encode(s)


# -- mixing


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 900, 3000).astype(float)
    p = rng.random(3000)
    q = mixing.flight(p, t, rng)
    assert q.sum() == pytest.approx(p.sum()) and (q * t).sum() == pytest.approx((p * t).sum())
    assert ((q > 0) & (q < 1)).sum() <= 2
    done = mixing.landing(q, rng)
    assert set(np.unique(done)) <= {0.0, 1.0} and abs((done * t).sum() - (p * t).sum()) < 900


def test_flight_is_fair():
    rng = np.random.default_rng(1)
    p, t = np.full(9, 0.3), np.arange(1.0, 10.0)
    mean = np.mean([mixing.landing(mixing.flight(p, t, rng), rng) for _ in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_whole_selection_is_fair_and_balanced():
    """Blocks, levels and landing together draw each document with its own probability."""
    import pandas as pd

    rng = np.random.default_rng(2)
    n, block = 60, 20
    p = rng.choice([0.2, 0.5, 0.8], n)
    t = np.append(rng.integers(1, 60, n - 1), 4000)
    h = rng.permutation(n)
    docs = pd.DataFrame({"doc_id": range(n), "n_tokens": t, "p": p, "_h": h, "_s": 5, "shards": 3, "shard": h % 3})
    drawn, off, runs = np.zeros(n), [], 1500
    for seed in range(runs):
        flown = pd.concat([mixing._walk(seed, 0, block, False)(x) for _, x in docs.groupby("shard")])
        rest = (flown.p > 0) & (flown.p < 1)
        assert rest.sum() <= 3 * 3 + block // mixing.RESERVE
        done = pd.concat([flown[~rest], mixing._walk(seed, 1, block, True)(flown[rest].assign(shard=0))]).sort_values("doc_id")
        assert set(done.p) <= {0.0, 1.0} and abs(done.p.sum() - p.sum()) < 2
        drawn += done.p.to_numpy()
        off.append((done.p.to_numpy() - p)[:-1] @ t[:-1] + (done.p.to_numpy() - p)[-1] * t[-1])
    assert np.abs(drawn / runs - p).max() < 4 * 0.5 / runs**0.5
    assert abs(np.mean(off)) < 4 * np.std(off) / runs**0.5


@needs_tokenizer
def test_short_sources_come_from_the_mix(spark):
    """Through the walk, and as the definition says; with a reachable total none is short."""
    plan = QUERIES["p9_found"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan
    from tidegauge.sources.monitoring import table

    encode = tokens.encoding().encode_ordinary
    have = Counter()
    for r in table(spark, D, "documents").select("source", "text").collect():
        have[r.source] += len(encode(r.text)) if r.text else 0
    targets = table(spark, D, "mix_target").collect()
    total = sum(have[x.source] for x in targets)
    short = {x.source for x in targets if x.weight * total > x.max_repeats * have[x.source]}
    report = {r.source: r for r in QUERIES["p9_report"](spark, D).collect()}
    assert {r.source for r in QUERIES["p9_found"](spark, D).collect()} == short == {k for k, r in report.items() if r.short}
    for x in targets:
        assert report[x.source].wanted == pytest.approx(x.weight * total) and report[x.source].tokens == have[x.source]
    even = QUERIES["p9_balanced"](spark, D).collect()
    weights = sum(r.weight for r in even if r.tokens)
    assert all(not r.short for r in even if r.tokens)
    largest = max((r.tokens / max(r.docs, 1) for r in even), default=0)
    assert all(abs(r.reached - r.wanted) < 20 * largest and r.most_copies <= r.max_repeats for r in even if r.tokens) and weights <= 1 + 1e-9


@needs_tokenizer
def test_mix(spark):
    r = random.Random(3)
    rows = [doc(i, "word " * r.randrange(1, 60), ["a", "b", "c", "d", None][min(4, int(r.expovariate(1)))]) for i in range(900)]
    rows += [doc(1000, None, "a"), doc(1001, "", "b")]
    df = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.15, 3), ("e", 0.05, 4), (None, 0.0, 1)], "source string, weight double, max_repeats int")
    counted = mixing.counted(df, targets)
    plan = mixing.plan(counted, targets)
    for block in (20_000, 100, 20):
        m = mixing.mix(counted, plan, block=block)
        report = {x.source: x for x in mixing.report(m, plan).collect()}
        total = sum(x.tokens for x in report.values())
        assert set(report) == {"a", "b", "c", "e"} and report["e"].short and report["e"].reached == 0
        for s in "abc":
            x = report[s]
            want = min(x.wanted, x.max_repeats * x.tokens)
            assert abs(x.reached - want) <= 0.02 * total and x.most_copies <= x.max_repeats
            assert x.short == (x.wanted > x.max_repeats * x.tokens)
        assert sum(x.share for x in report.values()) == pytest.approx(1)
        assert m.count() == m.select("doc_id").distinct().count()
    none = mixing.counted(df.limit(0), targets)
    assert mixing.mix(none, mixing.plan(none, targets)).collect() == []


# -- quality

COMMON = frozenset("the of and to in a was is it that had be by for with on at from".split())


@pytest.mark.parametrize(
    ("text", "prose"),
    [
        ("The treasurer of the society was met by a crowd\nand it is said that he had to be carried to the\npier by the men of the town.", True),
        ("1. It was said that the boiler of the mill had to be\nrepaired by the men.\n2. The rest of it was sold to a man from the town.", True),
        ("— Neand, P., pier\n— Trean, B., loom;\n— Kouth, T., cargo,\n— Fum, P., chapel", False),
        ("Town\tShop\tSociety\nFulau\t133\t39\nWerkville\t9\t45\nTholm\t139\t90", False),
        ("A7C1AE&CF;$F1B&86\n2%75C3l92%2:FDFC69164CB\n%C1#3979iB %7;", False),
        ("TO LET — chimney with garden, £54 p.a.\nWANTED, A LOWER TENDER. BOX 207.\n*** cargo, pump, fire: Weadin ***", False),
        ("IT WAS SAID THAT THE BOILER OF THE MILL HAD TO BE\nREPAIRED BY THE MEN OF THE TOWN AT ONCE AND THAT\nIT IS NOW IN A GOOD STATE.", True),
        ("the boiler of the mill was sold to a man from the town and it is said that he had to be carried " * 40, True),
    ],
)
def test_prose_or_not(text, prose):
    names = [n for n, _ in quality.FIELDS]
    m = dict(zip(names, quality.measure(text, COMMON)))
    assert (m["prose_share"] >= 0.5) == prose


def _stat(text, name="prose_share", **off):
    weights = quality.WEIGHTS | off
    return dict(zip([n for n, _ in quality.FIELDS], quality.measure(text, COMMON, weights)))[name]


#: Lines of one length without a common word: nothing speaks for or against prose.
PLAIN = ["harvest mills crew", "coal ladders boats", "pier chapels looms", "rope cargo anchors"] * 3
#: Each signal alone turns the page.
TURNED = {
    "aligned": [x.replace(" ", "  ") for x in PLAIN],
    "periodic": [("   " if i % 2 else "") + x for i, x in enumerate(PLAIN)],
    "uneven": [x if i % 2 else x + " over" * 9 for i, x in enumerate(PLAIN)],
    "symbols": [x.replace("r", "~=") for x in PLAIN],
    "commas": [x.replace(" ", ", ", 1) for x in PLAIN],
    "capitals": [x.title() for x in PLAIN],
    "ends": [x + "!" for x in PLAIN],
}


@pytest.mark.parametrize("signal", TURNED)
def test_every_signal_decides(signal):
    assert _stat("\n".join(PLAIN)) == 1
    page = "\n".join(TURNED[signal])
    assert _stat(page) < 0.5 <= _stat(page, **{signal: 0.0})


def test_common_words_decide_only_with_the_rest():
    sentences = ["1. It was said that the boiler", "of the mill had to be repaired", "2. It was sold to a man of the", "town and the rest of it is his"] * 3
    page = "\n".join(sentences)
    assert _stat(page) == 1 and _stat(page, common=0.0) < 0.5
    # Tables are told by layout though words of theirs are common ones.
    rows = "\n".join(["the mill wool  rope  sea loom", "at pier coal  boat  oar crew"] * 4)
    assert _stat(rows, "common_share") == pytest.approx(1 / 6) and _stat(rows) == 0
    assert _stat(rows, aligned=0.0) == 1


def test_delimiters_at_the_same_position():
    rows = ["the mill".ljust(20) + "rope", "a pier".ljust(20) + "cargo".ljust(9) + "chapel"] * 3
    shifted = [" " * 3 * (i % 2) + x for i, x in enumerate(rows)]
    assert [_stat("\n".join(x), "aligned_share") for x in (rows, shifted)] == [1, 0]
    # Columns of running text beside each other are no table.
    columns = ["the boiler of the mill was    sold to a man from the town", "and it is said that he was    carried to the pier at once"] * 3
    assert _stat("\n".join(columns), "aligned_share") == 0 and _stat("\n".join(columns)) == 1


def test_very_long_and_ragged_texts():
    assert _stat("of the mill " * 50_000) == 1
    assert _stat("x" * 200_000, "n_words") == 1
    assert _stat("\n" * 1000 + "." * 5000) == 0


def test_quality_statistics(spark):
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t"), doc(4, "…"), doc(5, "the cat, of a\nmat."), doc(5, "the cat, of a\nmat.")]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in quality.statistics(df, COMMON).collect()}
    assert got[1].n_words is None and got[2].prose_share is None and got[3].n_lines is None
    assert (got[4].n_words, got[4].prose_share, got[4].symbol_ratio) == (0, 0.0, 1.0)
    x = got[5]
    assert (x.n_words, x.n_lines, x.punct_end_share) == (5, 2, 0.5) and x.mean_word_length == pytest.approx(12 / 5) and x.common_share == pytest.approx(3 / 5)
    assert quality.statistics(df.limit(0), COMMON).collect() == []
    words = spark.createDataFrame([("en", "The"), ("de", None), ("en", "the")], "lang string, word string")
    assert quality.common_words(words) == {"the"}


# -- queries


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name not in SQL:
        df = QUERIES[name](spark, D)
        rows = df.collect()
        assert len(set(df.columns)) == len(df.columns) and len(rows) > 0
        return
    (ca, a), (cb, b) = compare(spark, duck(D), D, QUERIES[name], SQL[name])
    assert ca == cb and a == b


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_counts_have_every_grouping(spark):
    """All seven subsets of day, source and sender, counted one by one."""
    from tidegauge.llm.queries import _contacts

    keys = ["utc_day", "source", "addr"]
    got = {}
    for r in QUERIES["p3_counts"](spark, D).collect():
        got.setdefault(r.grouping, {})[(*(r[k] for k in keys), r.counted)] = (r.estimate, r.lower, r.upper)
    want = {}
    for r in _contacts(spark, D).distinct().collect():
        for m in range(1, 8):
            names = [k for i, k in enumerate(keys) if m >> i & 1]
            group = (*(r[k] if k in names else None for k in keys), r.counted)
            want.setdefault(",".join(names), {}).setdefault(group, set()).add(r.h)
    assert set(got) == set(want) and len(want) == 7
    for g, groups in want.items():
        assert set(got[g]) == set(groups)
        for key, hashes in groups.items():
            e, lo, hi = got[g][key]
            assert (e, lo, hi) == (len(hashes),) * 3 if len(hashes) < kmv.K else lo < e < hi and abs(e / len(hashes) - 1) < 0.15


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_exporters_compare_addresses_and_ports(spark):
    from tidegauge.llm.queries import _contacts

    sets = {}
    for r in _contacts(spark, D).distinct().collect():
        sets.setdefault((r.utc_day, r.source, r.counted), set()).add(r.h)
    got = {(r.utc_day, r.source, r.counted): r for r in QUERIES["p3_exporters"](spark, D).collect()}
    assert set(got) == {k for k in sets if k[1] is not None and (k[0] - 1, *k[1:]) in sets}
    assert {k[2] for k in got} == {"addr", "port"}
    for k, r in got.items():
        a, b = sets[k], sets[k[0] - 1, *k[1:]]
        for x, lo, hi, want in ((r.both, r.both_lower, r.both_upper, a & b), (r.new, r.new_lower, r.new_upper, a - b)):
            assert (x, lo, hi) == pytest.approx((len(want),) * 3) if len(a | b) < kmv.K else lo <= x <= hi and abs(x - len(want)) < 0.2 * len(a | b)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_found_pages_agree_with_readers(spark):
    """Readers' labels, a few of which are wrong, on the labelled pages; and no kind
    of evidence alone gives the rows found."""
    from tidegauge.sources.monitoring import table

    d = D.replace("sf0.001", "sf0.01") if os.path.isdir(D.replace("sf0.001", "sf0.01")) else D
    labels = {}
    for r in table(spark, d, "page_label").collect():
        labels.setdefault(r.doc_id, []).append(r.label)
    found = {r.doc_id for r in QUERIES["p10_found"](spark, d).collect()}
    same = [(k in found) == ("prose" not in v) for k, v in labels.items() if len(set(v)) == 1]
    assert not same or np.mean(same) >= 0.95
    docs, common = table(spark, d, "documents"), quality.common_words(table(spark, d, "common_word"))

    def rows(*off):
        w = quality.WEIGHTS | dict.fromkeys(off, 0.0)
        return {r.doc_id for r in quality.not_prose(quality.statistics(docs, common, weights=w)).select("doc_id").collect()}

    assert rows() == found
    if len(found) > 100:
        for off in (["aligned", "periodic", "uneven"], ["periodic"], ["uneven"], ["symbols"], ["capitals"], ["common"], [x for x in quality.SIGNALS if x != "common"]):
            assert rows(*off) != found, off
