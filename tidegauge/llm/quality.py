"""Per-document text statistics that tell running prose from lists, tables and junk.

Each line is judged by evidence from its surroundings, three signals of layout and
five ratios, each between 0 and 1:

* ``aligned``: *vertical delimiter alignment*, the share of the two neighbouring lines
  with as many column delimiters or one at the same position, for lines of short
  cells (columns of running text have long ones);
* ``periodic``: *indentation periodicity*, how steadily lines follow that start like
  an entry (dash, number) or are indented further than the one before (leading blanks
  count as they stand);
* ``uneven``: what the *line-length autocorrelation* over the surrounding lines lacks to
  1, up to ``UNEVEN`` (set prose repeats its line length, entries and adverts do not);
* ``symbols``, ``commas`` (and the like, per word), ``capitals`` (words with an initial
  one), ``common`` (words, up to ``KNOWN``) of a line and its neighbours, and
  ``ends``, punctuation at its end.

The verdict of a line is the sign of a weighted sum of these (``WEIGHTS``).  Without
evidence a line counts as prose: layout, symbols and capitals speak against it, common
words for it, none of them decides alone.  ``prose_share`` weighs lines by their
characters.  The weights are a ridge-regularised logistic fit on lines of the test
pages with the constant held, rounded; nothing is fitted when the operator runs.

Lines longer than ``WRAP`` characters are judged in pieces of about that size,
so a page that was joined to one line is treated like any other.  All text is
read; the time is linear in it.

Cases: null and blank texts have null ratios and no verdict; a text without a
word or digit has a prose share of 0; repeated rows are measured each; an empty
input gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COMMON = 10_000
WRAP = 90
#: Words of a table's cell, at most.
CELL_WORDS = 3
#: Lines on each side over which line lengths are compared, and the lack that counts in full.
AROUND, UNEVEN = 3, 0.3
#: Share of common words that counts in full.
KNOWN = 0.5
#: A line of more symbols than this is unreadable.
UNREADABLE = 0.9
WEIGHTS = {
    "constant": 0.5, "aligned": -3.0, "periodic": -2.5, "uneven": -3.5,
    "symbols": -8.0, "commas": -2.0, "capitals": -3.5, "ends": -1.5, "common": 6.5,
}
SIGNALS = [k for k in WEIGHTS if k != "constant"]

_BREAK = re.compile("\r\n|[\n\r\v\f\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+")
_CELL = re.compile(r"\t+|\s*\|\s*|\s*\.{3,}\s*| {2,}")
_ENTRY = re.compile(r"^\s*(?:[—–•*\-]\s|\(?\d{1,4}[.)]\s|[Nn][or]\.\s*\d+)")
_PIECE = re.compile(r".{1,%d}(?:\s+|$)|\S{%d,}?(?:\s+|$)" % (WRAP, WRAP), re.S)
_DIGITS = "0123456789"
_NONE: list[int] = []
#: What an entry may start with.
_MARKS = frozenset("—–•*-(Nn" + _DIGITS)
_ENDS = ".!?:;,)]»”\"'’"

FIELDS = [
    ("n_words", "bigint"), ("n_lines", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("digit_ratio", "double"), ("upper_ratio", "double"), ("punct_end_share", "double"), ("common_share", "double"),
    ("aligned_share", "double"), ("entry_share", "double"), ("entry_period", "double"), ("indent_period", "double"),
    ("length_autocorr", "double"),
    ("prose_share", "double"),
]


def lines_of(text: str) -> list[str]:
    """Non-blank lines, long ones cut at spaces into pieces of about ``WRAP`` characters."""
    out = []
    for line in _BREAK.split(text):
        if not line or line.isspace():
            continue
        if len(line) <= 2 * WRAP:
            out.append(line)
        else:
            out.extend(p for p in _PIECE.findall(line) if p and not p.isspace())
    return out


def _near(v: np.ndarray) -> np.ndarray:
    """Sums over each line and its neighbours."""
    out = v.copy()
    out[1:] += v[:-1]
    out[:-1] += v[1:]
    return out


def _meet(a: list[int], b: list[int]) -> bool:
    """Whether a position of both is the same, give or take one."""
    return any(abs(x - y) < 2 for x in a for y in b)


def _period(marks: np.ndarray) -> float:
    """How steadily marked lines follow each other: share of the commonest distance."""
    at = np.flatnonzero(marks)
    if len(at) < 3:
        return 0.0
    return float(np.bincount(np.diff(at)).max() / (len(at) - 1))


def _aligned(stops: list[list[int]]) -> np.ndarray:
    """Share of each line's neighbours whose delimiters go with its own."""
    n = len(stops)
    if n < 2:
        return np.zeros(n)
    pair = np.array([bool(a and b) and (len(a) == len(b) or _meet(a, b)) for a, b in zip(stops, stops[1:])], float)
    both = np.zeros(n)
    both[1:] += pair
    both[:-1] += pair
    both[1:-1] /= 2
    return both


def _periodic(marks: np.ndarray) -> np.ndarray:
    """For each marked line and those up to the next: how many of the nearest
    distances between marks equal their predecessor."""
    out = np.zeros(len(marks))
    at = np.flatnonzero(marks)
    if len(at) < 3:
        return out
    gaps = np.diff(at)
    steady = (gaps[1:] == gaps[:-1]).astype(float)
    ends = np.append(at[1:], min(len(marks), at[-1] + int(np.median(gaps))))
    for k, (a, e) in enumerate(zip(at, ends)):
        near = steady[max(0, k - 2) : k + 1]
        out[a:e] = near.mean() if len(near) else 0.0
    return out


def _uneven(sizes: np.ndarray) -> np.ndarray:
    """1 less the autocorrelation (lag 1, about 0) of the line lengths around each line."""
    n = len(sizes)
    if n < 2:
        return np.zeros(n)
    squares = sizes * sizes
    lack = np.concatenate(([0.0], np.cumsum((sizes[1:] - sizes[:-1]) ** 2)))
    whole = np.concatenate(([0.0], np.cumsum(squares[1:] + squares[:-1])))
    lo, hi = np.maximum(np.arange(n) - AROUND, 0), np.minimum(np.arange(n) + AROUND, n - 1)
    return (lack[hi] - lack[lo]) / np.maximum(whole[hi] - whole[lo], 1.0)


def measure(text: str | None, common: frozenset[str], weights: dict[str, float] = WEIGHTS) -> tuple | None:
    """The values of ``FIELDS`` for one text; None for a null or blank one."""
    if text is None or not text.strip():
        return None
    lines = lines_of(text)
    n = len(lines)
    entry, indent, stops, counts = [], np.zeros(n, int), [], []
    is_common, letters = common.__contains__, 0
    for i, line in enumerate(lines):
        bare = line.strip()
        margin = 0
        if line[0].isspace():
            margin = indent[i] = len(line[: len(line) - len(line.lstrip())].expandtabs())
        found = _WORD.findall(bare)
        plain = len("".join(found))
        letters += plain
        dense = len(bare) - bare.count(" ") - bare.count("\t")
        counts.append((
            len(bare), len(found), dense - plain - sum(map(bare.count, _DIGITS)), dense,
            sum(map(is_common, map(str.lower, found))), bare.count(",") + bare.count(";") + bare.count(":"),
            sum(map(str.isupper, [w[0] for w in found])), bare[-1] in _ENDS,
        ))
        # The patterns run only where one of their marks is.
        cells = "  " in bare or "|" in bare or "..." in bare or "\t" in bare
        stops.append([margin + m.end() for m in _CELL.finditer(bare)] if cells else _NONE)
        entry.append(bare[0] in _MARKS and _ENTRY.match(bare) is not None)
    sizes, words, odd, dense, known, commas, upper, ends = np.array(counts, float).T
    entry = np.array(entry)
    inset = np.zeros(n, bool)
    inset[1:] = indent[1:] > indent[:-1]
    # Means over a line and its neighbours of each line's own ratio.
    each, around = np.maximum(words, 1), _near(np.ones(n))
    evidence = {
        "aligned": _aligned(stops) * (words <= CELL_WORDS * (np.array([len(s) for s in stops]) + 1)),
        "periodic": _periodic(entry | inset),
        "uneven": np.minimum(_uneven(sizes), UNEVEN) / UNEVEN,
        "symbols": _near(odd / np.maximum(dense, 1)) / around,
        "commas": _near(np.minimum(commas / each, 1)) / around,
        "capitals": _near(upper / each) / around,
        "ends": ends,
        "common": np.minimum(_near(known) / np.maximum(_near(words), 1), KNOWN) / KNOWN,
    }
    prose = sum((weights[k] * evidence[k] for k in SIGNALS), np.full(n, weights["constant"])) > 0
    prose &= odd < UNREADABLE * dense
    count, total = float(words.sum()), float(sizes.sum())
    joined = "".join(text.split())
    digits, plain = sum(map(joined.count, "0123456789")), sum(map(str.isalpha, joined))
    return (
        int(count), n,
        _ratio(letters, count),
        (len(joined) - plain - digits) / len(joined), digits / len(joined), sum(map(str.isupper, joined)) / len(joined),
        float(ends.mean()), _ratio(known.sum(), count),
        float(sizes @ evidence["aligned"]) / total, float(entry.mean()), _period(entry), _period(inset),
        1.0 - float(_ratio(((sizes[1:] - sizes[:-1]) ** 2).sum(), (sizes[1:] ** 2 + sizes[:-1] ** 2).sum())),
        float(sizes @ prose) / total,
    )


def _ratio(a: float, b: float) -> float:
    return float(a) / float(b) if b else 0.0


def common_words(table: DataFrame) -> frozenset[str]:
    """The dictionary of common words, a fixed small table (an error beyond ``MAX_COMMON``)."""
    rows = table.select(F.lower("word").alias("w")).filter(F.col("w").isNotNull()).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r.w for r in rows)


def statistics(
    documents: DataFrame, common: frozenset[str], keys: list[str] | None = None, weights: dict[str, float] = WEIGHTS
) -> DataFrame:
    """(keys, statistics) of each document, in one pass without a shuffle."""
    keys = keys or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} {t}" for n, t in FIELDS)])
    arrow = {"bigint": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x, common, weights) for x in batch["text"].to_pylist()]
            columns = [pa.array([r and r[i] for r in rows], arrow[t]) for i, (_, t) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], [*keys, *(n for n, _ in FIELDS)])

    return documents.select(*keys, "text").mapInArrow(run, schema)


def not_prose(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with text of which less than ``least`` runs as prose."""
    return stats.filter(F.col("prose_share") < least)
