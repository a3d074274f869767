"""Irregular readings onto a regular grid, holes filled by singular spectra.

Readings are put into slots of their source's step (one pre-aggregated value a
channel and slot), and each channel of a day becomes a regular series over the
day's slots of its source.  Missing entries are filled by iterative
singular-spectrum imputation: start from interpolation, embed the series in a
Hankel trajectory matrix, keep its leading singular vectors, average the
diagonals, put the result where entries were missing, and repeat until the
change is small.  Filled entries are marked, observed ones never changed; where the
iteration does not converge, or a series has too little for it, entries are
interpolated, each under a state of its own.

A channel-day has at most 86400/step slots after bucketing, whatever share of
the rows its source has; channels are independent tasks.

Cases: rows without key or time are no readings; sources without a known
positive step are left out; several readings in a slot give their mean; NaN and
infinite values count as a reading without a value (the slot is filled but not
marked missing); a channel without any value keeps nulls (``unknown``), one with fewer
values than a window, or none that differ, is interpolated; null array elements are skipped; an empty input gives an empty grid; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.monitoring import DAY_S, bigint_floor

SOURCE = ["host", "plugin_name"]
CHANNEL = [*SOURCE, "plugin_instance", "type_name", "attribute", "pos"]
#: How a hole came by its value.
FILLED, INTERPOLATED, UNCONVERGED, UNKNOWN = range(4)
#: States by number: 0 a reading with a value, then for each of the above a reading
#: without one and a slot without a reading.
STATES = ["observed", *(x for how in ("filled", "interpolated", "unconverged", "unknown") for x in ("no_value" if how == "filled" else f"no_value_{how}", how))]
#: Guard against series that never settle; what it stops is marked.
ROUNDS = 2000
FAR = 1000
RIDGE = 1e-6
#: Holes solved for at once; a window's if those are more.
BLOCK = 64


def _bands(holes: np.ndarray, width: int) -> list[tuple]:
    """Where the blocks of the system over the holes lie in its band: for each block of
    rows its own, the one before and the one after (None at the ends), as places in
    the flat band and which of them are inside."""
    size, n = max(BLOCK, width), len(holes)

    def places(a: int, b: int) -> tuple | None:
        if not 0 <= b < n:
            return None
        i, j = np.arange(a, min(a + size, n)), np.arange(b, min(b + size, n))
        lag = holes[j][None, :] - holes[i][:, None]
        return i[:, None] * (2 * width - 1) + np.clip(lag, 1 - width, width - 1) + width - 1, (np.abs(lag) < width).astype(float)

    return [(slice(a, a + size), places(a, a), places(a, a - size), places(a, a + size)) for a in range(0, n, size)]


def _solve(links: np.ndarray, holes: np.ndarray, right: np.ndarray, width: int, bands: list[tuple] | None = None) -> np.ndarray:
    """``x`` of S x = ``right`` over the holes, S given by its band: ``links[i, j]``
    ties hole i to the slot ``j - width + 1`` after it.  Block elimination, linear
    in the number of holes; ``bands`` is ``_bands`` of the same holes."""
    band = links.ravel()
    ahead, parts = [], []
    for rows, own_at, back_at, after_at in bands or _bands(holes, width):
        own, rest = band[own_at[0]] * own_at[1], right[rows]
        if back_at is not None:
            back = band[back_at[0]] * back_at[1]
            own, rest = own - back @ ahead[-1], rest - back @ parts[-1]
        if after_at is None:
            parts.append(np.linalg.solve(own, rest))
            break
        both = np.linalg.solve(own, np.column_stack((rest, band[after_at[0]] * after_at[1])))
        parts.append(both[:, 0])
        ahead.append(both[:, 1:])
    for k in range(len(parts) - 2, -1, -1):
        parts[k] = parts[k] - ahead[k] @ parts[k + 1]
    return np.concatenate(parts)


def ssa_impute(x: np.ndarray, window: int = 16, rank: int = 3, rounds: int = ROUNDS, tol: float = 1e-3) -> tuple[np.ndarray, int]:
    """``x`` with its NaN entries imputed (all NaN if nothing is known), and how: ``FILLED``
    if the change came under ``tol`` of the series' scale within ``rounds``, else the
    holes are interpolated.

    Replacing the holes by the averaged diagonals is a step down the squared
    distance of the trajectory matrix from its leading subspace; its fixed point
    for a given subspace is where that distance is least, a banded linear system
    in the holes.  Each round solves it, then takes the subspace anew, so the
    fixed points are those of the plain iteration, reached in fewer rounds.  Steps
    that keep their direction are lengthened, and taken back if the distance rose.
    Some series have no fixed point: the distance falls as the holes grow without
    end, and the iteration stops at ``FAR`` times the largest known value.
    """
    n = len(x)
    gap = np.isnan(x)
    known = np.flatnonzero(~gap)
    if not len(known) or len(known) == n:
        return x.copy(), FILLED if n and len(known) else UNKNOWN
    holes = np.flatnonzero(gap)
    centre = x[known].mean()
    y = x - centre
    y[holes] = np.interp(holes, known, y[known])
    scale = np.sqrt(np.mean(y[known] ** 2))
    width = min(window, n // 2)
    if width < 2 or scale == 0 or len(known) < width:
        return y + centre, INTERPOLATED
    rank = min(rank, width - 1)
    rows = n - width + 1
    # What ties a hole to a slot at a lag: the sum of a stretch of the projection's
    # diagonal at that lag, all of it unless fewer windows cover both near the ends.
    offsets = np.arange(1 - width, width)
    lag = np.abs(offsets)[None, :]
    around = holes[:, None] + offsets[None, :]
    earlier = np.minimum(holes[:, None], around)
    upper = np.clip(np.minimum(earlier, width - 1 - lag) + 1, 0, width)
    lower = np.clip(np.minimum(earlier - rows + 1, upper), 0, width)
    outside = (around < 0) | (around >= n)
    around = np.clip(around, 0, n - 1)
    diagonal, at = np.arange(width)[:, None], np.arange(width)[None, :]
    off = diagonal + at >= width
    stretch = np.minimum(diagonal + at, width - 1)
    sums = np.zeros((width, width + 1))
    windows, bands = np.arange(rows)[:, None] + np.arange(width), _bands(holes, width)
    line, far = y[holes], FAR * np.abs(y[known]).max()
    before, least, last, reach, done = y[holes], np.inf, None, 1.0, False
    for _ in range(rounds):
        block = y[windows]
        values, vectors = np.linalg.eigh(block.T @ block)
        distance = values[:-rank].sum()
        if reach > 1 and distance > least:
            y[holes], reach, last = before, 1.0, None
            continue
        least = distance
        rest = vectors[:, :-rank]
        residual = rest @ rest.T
        np.cumsum(np.where(off, 0.0, residual[at, stretch]), axis=1, out=sums[:, 1:])
        links = sums[lag, upper] - sums[lag, lower]
        links[outside] = 0.0
        slope = np.einsum("ij,ij->i", links, y[around])
        # Keeps the system regular where the subspace leaves a hole free; no fixed point moves.
        links[:, width - 1] += RIDGE
        step = _solve(links, holes, slope, width, bands)
        size = np.sqrt(np.mean(step**2))
        if size < tol * scale:
            y[holes] -= step
            done = True
            break
        steady = last is not None and step @ last > 0.9 * np.sqrt((step @ step) * (last @ last))
        reach, last = 2 * reach if steady else 1.0, step
        before = y[holes] - step
        y[holes] -= reach * step
        if np.abs(y[holes]).max() > far:
            break
    if not done:
        y[holes] = line
    return y + centre, FILLED if done else UNCONVERGED


def ssa_fill(x: np.ndarray, window: int = 16, rank: int = 3, rounds: int = ROUNDS, tol: float = 1e-3) -> np.ndarray:
    """``x`` with its NaN entries imputed; all NaN if nothing is known."""
    return ssa_impute(x, window, rank, rounds, tol)[0]


def _filler(window: int, rank: int, rounds: int, tol: float, holes_only: bool):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lo, hi = batch["lo"].to_numpy(), batch["hi"].to_numpy()
            cells = batch["cells"]
            flat = cells.flatten()
            bounds = np.concatenate(([0], np.cumsum(cells.value_lengths().to_numpy())))
            slots = flat.field("slot").to_numpy(zero_copy_only=False)
            values = flat.field("v").to_numpy(zero_copy_only=False).astype(float)
            out_slot, out_value, out_state, sizes = [], [], [], []
            for i in range(n):
                a, b = bounds[i], bounds[i + 1]
                size = int(hi[i] - lo[i] + 1)
                x = np.full(size, np.nan)
                at = slots[a:b] - lo[i]
                x[at] = values[a:b]
                state = np.full(size, 2, np.int8)  # 2: no reading, 1: no value, 0: observed
                state[at] = np.where(np.isnan(values[a:b]), 1, 0)
                y, how = ssa_impute(x, window, rank, rounds, tol)
                show = np.flatnonzero(state == 2) if holes_only else np.arange(size)
                state[state > 0] += 2 * how
                sizes.append(len(show))
                out_slot.append(show + lo[i])
                out_value.append(y[show])
                out_state.append(state[show])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            items = pa.StructArray.from_arrays(
                [join(out_slot, pa.int64()), join(out_value, pa.float64()), join(out_state, pa.int8())], ["slot", "v", "state"]
            )
            columns = [batch[c] for c in (*CHANNEL, "step_s", "utc_day", "channels")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(offsets, items)], [*CHANNEL, "step_s", "utc_day", "channels", "grid"]
            )

    return fill


def regular(
    readings: DataFrame,
    host_info: DataFrame,
    window: int = 16,
    rank: int = 3,
    rounds: int = ROUNDS,
    tol: float = 1e-3,
    holes_only: bool = False,
) -> DataFrame:
    """(channel, utc_day, slot_start, value, state, channels), one row per channel
    and slot between the first and last of its source's day.

    ``state`` is observed, no_value (a reading, filled value) or filled; interpolated,
    unconverged and unknown (and these with no_value_ before them) tell where the
    value is no fixed point of the imputation, or null;
    ``channels`` counts the channels of the source that day.  ``holes_only``
    leaves out slots in which the channel has a reading.
    """
    steps = (
        host_info.filter((F.col("step_s") > 0) & F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.min("step_s").cast("bigint").alias("step_s"))
    )
    v = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    cells = (
        readings.select("host", "plugin_name", "plugin_instance", "type_name", "attribute", "time", F.posexplode("values").alias("pos", "_v"))
        .join(steps, "host")
        .select(
            *CHANNEL,
            "step_s",
            bigint_floor(F.col("time"), DAY_S).alias("utc_day"),
            F.floor(F.col("time") / F.col("step_s")).cast("bigint").alias("slot"),
            v.alias("_v"),
        )
        .groupBy(*CHANNEL, "step_s", "utc_day", "slot")
        .agg(F.avg("_v").alias("v"))
    )
    channels = cells.groupBy(*CHANNEL, "step_s", "utc_day").agg(
        F.collect_list(F.struct("slot", "v")).alias("cells"), F.min("slot").alias("_lo"), F.max("slot").alias("_hi")
    )
    extents = channels.groupBy(*SOURCE, "utc_day").agg(
        F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.count(F.lit(1)).alias("channels")
    )
    kinds = {f.name: f.dataType.simpleString() for f in channels.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*CHANNEL, "step_s", "utc_day"))
    filled = (
        channels.drop("_lo", "_hi")
        .join(extents, [*SOURCE, "utc_day"])
        .select(*CHANNEL, "step_s", "utc_day", "channels", "lo", "hi", "cells")
        .mapInArrow(
            _filler(window, rank, rounds, tol, holes_only),
            schema + ", channels bigint, grid array<struct<slot:bigint,v:double,state:tinyint>>",
        )
    )
    state = F.get(F.array(*map(F.lit, STATES)), F.col("g.state").cast("int"))
    return filled.withColumn("g", F.explode("grid")).select(
        *CHANNEL,
        "utc_day",
        (F.col("g.slot") * F.col("step_s")).alias("slot_start"),
        F.when(~F.isnan("g.v"), F.col("g.v")).alias("value"),
        state.alias("state"),
        "channels",
    )


def missing_slots(grid: DataFrame) -> DataFrame:
    """(host, plugin_name, utc_day, slot_start) without a reading in any channel of their source."""
    return (
        grid.filter(F.col("state").isin(*STATES[2::2]))
        .groupBy(*SOURCE, "utc_day", "slot_start")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("channels").alias("_all"))
        .filter(F.col("_n") == F.col("_all"))
        .select(*SOURCE, "utc_day", "slot_start")
    )
