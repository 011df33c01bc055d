"""Openings of whole profiles (a line's samples, all in the walking band), one line at a time over numpy arrays.

The same steps as operators.lines and operators.openings take over rows, in the same order of operations, so that the same
doubles come out; a profile has some hundreds of samples, whose rows would be dealt out and sorted once for each step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bins of runs, and their shortest; width of an opening; shortest run beside it; reach of the samples.
WIDTH, SHORTEST, NARROW, WIDE, BIN, FLANK, REACH = 0.05, 0.45 - 1e-9, 0.68, 1.20, 0.05, 0.35, 0.80


def gathered(batches: Iterator[pa.RecordBatch], value: str, items: str, count: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of equal keys (the other columns) as one: their values that are not null, and how many rows they were."""
    for b in batches:
        keys = [n for n in b.schema.names if n != value]
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            col = b.column(k)
            try:
                new[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
            except pa.ArrowNotImplementedError:
                new[:] = True
        at = np.flatnonzero(new)
        x = b.column(value)
        there = np.concatenate([[0], np.cumsum(x.is_valid().to_numpy(zero_copy_only=False))])
        ends = np.append(at, b.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(there[ends].astype("int32")), x.drop_null())
        first = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(first) for k in keys), lists, pa.array(np.diff(ends))], names=[*keys, items, count])


def _runs(bins: np.ndarray, reach: int, lo: float) -> list[tuple[float, float]]:
    """Ends of the stretches of bins (ascending) of which none is more than `reach` after the one before, that are long enough."""
    if not len(bins):
        return []
    cut = np.flatnonzero(np.diff(bins) > reach)
    first, last = bins[np.append(0, cut + 1)].tolist(), bins[np.append(cut, len(bins) - 1)].tolist()
    spans = ((lo + f * WIDTH, lo + (e + 1) * WIDTH) for f, e in zip(first, last, strict=True))
    return [(a, b) for a, b in spans if b - a >= SHORTEST]


def runs(x: np.ndarray) -> tuple[list, list]:
    """support_runs() and sparse_runs() of sorted samples."""
    lo = float(x[0])
    with np.errstate(invalid="ignore", over="ignore"):
        # A sample that is no number falls into bin 0, as a cast of it does.
        at = np.nan_to_num(np.floor((x - lo) / WIDTH), nan=0.0, posinf=9.2e18, neginf=-9.2e18)
    bins, c = np.unique(at, return_counts=True)
    by_one = np.diff(bins) == 1
    beside = np.append(False, by_one) | np.append(by_one, False)
    return _runs(bins[c >= 3], 6, lo), _runs(bins[(c >= 2) | beside], 1, lo)


def _quantile(a: np.ndarray, share: float) -> float:
    place = (len(a) - 1) * share
    low = int(place)
    v = float(a[low])
    return v + (float(a[min(low + 1, len(a) - 1)]) - v) * (place - low)


def stations(a: np.ndarray) -> np.ndarray:
    """functions.arrays.stations()."""
    if len(a) < 3:
        return a
    gaps = np.diff(a)
    p = np.sort(gaps[gaps > 1e-4])
    if len(p) < 3:
        return np.array([_quantile(a, 0.5)])
    upper = _quantile(p, 0.95)
    if not upper > max(0.02, 4 * _quantile(p, 0.5)):
        return a
    return np.array([_quantile(part, 0.5) for part in np.split(a, np.flatnonzero(gaps >= 0.5 * upper) + 1)])


def unobserved(on: np.ndarray) -> tuple[float, float] | None:
    """functions.arrays.unobserved(): edge and pitch."""
    c = stations(on)
    if len(c) < 3:
        return None
    s = stations(c)
    gaps = np.diff(s)
    near = np.sort(gaps[(gaps > 1e-4) & (gaps < 0.15)])
    pitch = _quantile(near, 0.5) if len(s) >= 3 and len(near) else 0.02
    limit, n = max(1.5 * pitch, 0.03), len(c)
    for _ in range(3):
        if n >= 2 and c[n - 1] - c[n - 2] > limit:
            n -= 1
    return float(c[n - 1]) + 0.5 * pitch, pitch


def _edges(x: np.ndarray, gap0: float, gap1: float) -> tuple[float, float, float]:
    """left, right and edge_sigma of a gap, as operators.openings.jambs() has them where no depth steps are given."""
    mid = 0.5 * (gap0 + gap1)
    left = x[np.searchsorted(x, gap0 - REACH, "right") : np.searchsorted(x, mid, "left")]
    right = x[np.searchsorted(x, mid, "right") : np.searchsorted(x, gap1 + REACH, "left")]
    if len(left) >= 3 and len(right) >= 3 and (l := unobserved(left)) and (r := unobserved(-right[::-1])):
        a = l[0] if abs(l[0] - gap0) <= 0.15 else gap0
        b = -r[0] if abs(-r[0] - gap1) <= 0.15 else gap1
        if b - a >= 0.2:
            return a, b, 0.5 * max(l[1], r[1])
    return gap0, gap1, 0.025


def candidates(x: np.ndarray) -> list[tuple[bool, float, float, float, float, float, float]]:
    """opening_candidates() of sorted samples of a line, dense ones first, each along the line: sparse, a, gap0, gap1, left, right,
    edge_sigma. All samples are of middle height, so each opening is a door."""
    out = []
    for sparse, spans in zip((False, True), runs(x), strict=True):
        for (a, gap0), (gap1, d) in zip(spans, spans[1:]):
            if not (gap0 - a >= FLANK and d - gap1 >= FLANK and NARROW - BIN <= gap1 - gap0 <= WIDE + BIN):
                continue
            within = lambda u, v: int(np.searchsorted(x, v, "right") - np.searchsorted(x, u, "left"))
            flank, inside = within(a, gap0), within(gap0, gap1)
            hits = max(0, int(np.searchsorted(x, gap1 - 0.02, "left") - np.searchsorted(x, gap0 + 0.02, "right")))
            if flank > 20 and (inside if inside >= 5 else 0) > 0.25 * flank or sparse and hits >= 3 and hits > 0.25 * max(flank, 1):
                continue
            left, right, sigma = _edges(x, gap0, gap1)
            coarse, width = gap1 - gap0, right - left
            if NARROW <= width <= WIDE or not sparse and NARROW <= coarse <= WIDE and abs(width - coarse) <= max(2 * sigma, 0.05):
                out.append((sparse, a, gap0, gap1, left, right, sigma))
    return out


def taken(found: list, a0: float, a1: float) -> list:
    """Of candidates inside the span those that no one taken before overlaps by over 0.20 m."""
    kept: list = []
    for g in found:
        if g[2] >= a0 - 0.05 and g[3] <= a1 + 0.05 and not any(min(g[3], o[5]) - max(g[2], o[4]) > 0.20 for o in kept):
            kept.append(g)
    return kept


def single_doors(batches: Iterator[pa.RecordBatch], items: str, span: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Lines with exactly one door: their keys, left, right, sigma, sparse. items: the column of their samples."""
    for b in batches:
        col = b.column(items)
        ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        at, rows = [], []
        for i in range(b.num_rows):
            if ends[i + 1] > ends[i]:
                kept = taken(candidates(np.sort(flat[ends[i] : ends[i + 1]])), *span)
                if len(kept) == 1:
                    at.append(i)
                    rows.append(kept[0])
        keys = [n for n in b.schema.names if n != items]
        place = pa.array(at, "int64")
        found = [pa.array([r[k] for r in rows], t) for k, t in ((4, "double"), (5, "double"), (6, "double"), (0, "bool"))]
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in keys), *found], names=[*keys, "left", "right", "sigma", "sparse"])
