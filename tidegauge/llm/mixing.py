"""One collection from several sources, each with its target share of tokens.

A source's documents all get the same expected number of copies, its target
tokens over its tokens, at most ``max_repeats``.  The whole part is given to
each document; which documents get one more is drawn by the cube method: the
vector of fractional inclusion probabilities walks within the null space of the
balancing constraints (documents and tokens), so both totals stay as they are,
until every coordinate is 0 or 1 but for as many as there are constraints.

Blocks of a source walk in parallel.  What they leave undecided, two documents a
block and a share of a bounded reserve, is put into blocks again and walks once
more, until a source's rest is one block (a level divides it by about a third of
``BLOCK``, so three levels do for any corpus); large documents walk first and the
reserve last, so what is left there are small ones.  They land keeping the number of
documents, with the token constraint dropped, the last one by its probability alone:
every document is drawn with its own probability, and a source's tokens are off
by about one of its last small documents, or where one document outweighs all others'
freedom, by that document.

The total T is that of the documents of all target sources, each once.  Where
``max_repeats`` keeps a source below its weight of T, shares come out uneven and the
report calls it short; ``reachable`` takes the largest total at which every source
that has documents keeps its weight.

Cases: documents of no target source are left out; null texts have no tokens;
a target without documents (or tokens) contributes nothing and is short if it has
a weight; null weights count as 0; targets of short sources are not given to
others, the report shows the shares reached; repeated rows are separate documents;
an empty corpus gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import tokens as tok
from tidegauge.session import durable

BLOCK = 20_000
#: Documents of a source (about) that wait for its last walk, a tenth of a block.
RESERVE = 10
MAX_SOURCES = 10_000
EPS = 1e-9


def flight(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Walk of the probabilities ``p`` with sum(p) and sum(p*t) kept; at most two
    coordinates stay fractional (more only where sizes coincide by rounding)."""
    p = p.astype(float).copy()
    t = t.astype(float)
    live: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8))
    queue = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    while True:
        while len(live) < 3:
            if (k := next(queue, None)) is None:
                break
            live.append(k)
        if len(live) < 2:
            return p
        if len(live) == 3:
            a, b, c = live
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if u[0] == u[1] == u[2] == 0:
                u = (1.0, -1.0, 0.0)
        else:
            a, b = live
            if t[a] != t[b]:
                return p
            u = (1.0, -1.0)
        up = down = np.inf
        for k, s in zip(live, u):
            if s > 0:
                up, down = min(up, (1 - p[k]) / s), min(down, p[k] / s)
            elif s < 0:
                up, down = min(up, -p[k] / s), min(down, (p[k] - 1) / s)
        step = up if next(draws) * (up + down) < down else -down
        for k, s in zip(live, u):
            p[k] += step * s
            if p[k] < EPS:
                p[k] = 0.0
            elif p[k] > 1 - EPS:
                p[k] = 1.0
        live = [k for k in live if 0.0 < p[k] < 1.0]


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the rest keeping the number of documents, then by one draw."""
    p = flight(p, np.zeros(len(p)), rng)
    for k in np.flatnonzero((p > 0) & (p < 1)):
        p[k] = float(rng.random() < p[k])
    return p


def plan(counted: DataFrame, targets: DataFrame, reachable: bool = False) -> DataFrame:
    """One row per target source: weight, max_repeats, docs, tokens, wanted, and
    copies (expected per document).

    The total is that of all sources, or with ``reachable`` no more than lets every
    source with documents have its weight; it is a window over the target table's rows."""
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    zero = F.lit(0).cast("bigint")
    every = Window.partitionBy()
    t = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
        .join(have, "source", "left")
        .withColumns({"tokens": F.coalesce("tokens", zero), "docs": F.coalesce("docs", zero)})
        .withColumn("total", F.sum("tokens").over(every).cast("double"))
    )
    wanted = F.col("weight") * F.col("total")
    if reachable:
        bound = F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.col("max_repeats") * F.col("tokens") / F.col("weight"))
        t = t.withColumn("total", F.least("total", F.min(bound).over(every)))
        # No more than there is, however the product is rounded.
        wanted = F.when(bound.isNotNull(), F.least(wanted, F.col("max_repeats") * F.col("tokens"))).otherwise(wanted)
    copies = F.least(F.col("wanted") / F.nullif(F.col("tokens"), zero), F.col("max_repeats").cast("double"))
    return t.withColumn("wanted", wanted).withColumn("copies", F.coalesce(copies, F.lit(0.0)))


def counted(documents: DataFrame, targets: DataFrame, folder: str = tok.TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of target sources, kept in the
    shared folder: encoding is dear and the counts are read more than once."""
    wanted = documents.join(targets.select("source").distinct(), "source", "left_semi")
    return durable(tok.count(wanted.select("doc_id", "source", "text"), ["doc_id", "source"], folder=folder))


def _walk(seed: int, level: int, block: int, last: bool):
    """One walk over a block's documents; the ``last`` one lands them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, level, *[abs(int(x)) for x in pdf[["_s", "shard"]].iloc[0]]])
        wait = np.zeros(len(pdf), bool)
        if not last:
            wait = (pdf["_h"].rank(method="first") <= -(-(block // RESERVE) // int(pdf["shards"].iloc[0]))).to_numpy()
        order = np.lexsort((pdf["doc_id"], pdf["_h"], -pdf["n_tokens"].to_numpy(), wait))
        pdf, n = pdf.iloc[order].reset_index(drop=True), int((~wait).sum())
        p, t = pdf["p"].to_numpy(float), pdf["n_tokens"].to_numpy(float)
        flown = flight(p[:n], t[:n], rng)
        pdf["p"] = landing(flown, rng) if last else np.concatenate((flown, p[n:]))
        return pdf

    return run


def mix(counted_docs: DataFrame, sources: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used at least once.

    ``sources`` is ``plan``'s result, a row per target; it is broadcast only if
    it has no more than ``MAX_SOURCES`` rows."""
    if block < 20:
        raise ValueError("a block must hold 20 documents at least")
    s = durable(sources.select("source", F.col("copies").alias("_c"), F.ceil(F.greatest("docs", F.lit(1)) / block).cast("int").alias("_shards")))
    size = s.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_shards"), F.lit(1)).alias("most")).first()
    if size.n <= MAX_SOURCES:
        s = F.broadcast(s)
    units = counted_docs.join(s, "source").select(
        "doc_id",
        "source",
        "n_tokens",
        F.floor("_c").cast("int").alias("whole"),
        (F.col("_c") - F.floor("_c")).alias("p"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_h"),
        F.xxhash64("source").alias("_s"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("_shards")).cast("int").alias("shard"),
        F.col("_shards").alias("shards"),
    )
    schema = "doc_id bigint, source string, n_tokens bigint, whole int, p double, _h bigint, _s bigint, shard int, shards int"
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest, most, level = units.filter(~undecided), units.filter(undecided), size.most, 0
    while most > 1:
        flown = durable(rest.groupBy("source", "shard").applyInPandas(_walk(seed, level, block, False), schema))
        done = done.unionByName(flown.filter(~undecided))
        # At most two undecided documents a block, one more for the reserve's rounding, and the reserve.
        fewer = F.ceil((3 * F.col("shards") + block // RESERVE) / block).cast("int")
        rest = flown.filter(undecided).withColumn("shards", fewer)
        rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 2 + level)), F.col("shards")).cast("int"))
        most, level = -(-(3 * most + block // RESERVE) // block), level + 1
    landed = rest.groupBy("source").applyInPandas(_walk(seed, level, block, True), schema)
    drawn = done.unionByName(landed)
    return drawn.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).filter(F.col("copies") > 0)


def report(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per target source: wanted and reached tokens and shares, documents used, and
    ``short``: the mix holds every token ``max_repeats`` times and still lacks some."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"),
        F.sum("copies").alias("used"),
        F.max("copies").alias("most_copies"),
    )
    zero = F.lit(0).cast("bigint")
    t = sources.join(used, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("reached", "used")})
    return t.select(
        "source", "weight", "max_repeats", "docs", "tokens", "wanted", "reached", "used",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("reached") / F.nullif(F.sum("reached").over(Window.partitionBy()), F.lit(0))).alias("share"),
        ((F.col("reached") == F.col("max_repeats") * F.col("tokens")) & (F.col("wanted") > F.col("reached"))).alias("short"),
    )
