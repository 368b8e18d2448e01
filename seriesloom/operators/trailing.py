"""Means, deviations and quantiles of trailing windows at a cost per row that does not grow with the width.

A Spark frame that slides is recomputed for every row. Here a series is cut into blocks as long as the
window, so every window is the end of one block and the start of the next. Starts and ends of all blocks
are summed once, and a window's moments are merged from the two. Nothing is ever subtracted, so no digits
are lost: a window of equal values has deviation 0 whatever came before it. Quantiles keep the window
sorted, one value in and one out per row.

Rows come from a window of Spark's own, partitioned by series and sorted by day (a panel that already lies
so is neither shuffled nor sorted again), and pass in Arrow batches; between batches only the last rows of
the open series are held, so series may be of any length.

Null values do not count; a window with fewer values than asked for gives null. NaN makes moments NaN and
counts as missing in quantiles. The deviation of one value is null.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .align import by_day


@dataclass(frozen=True)
class Trailing:
    """A statistic over the last ``width`` rows: ``mean``, ``std``, or quantiles in [0, 1] (linear)."""

    kind: str
    width: int
    need: int | None = None
    column: str = "value"
    at: tuple[float, ...] = ()

    @property
    def least(self) -> int:
        return max(1, self.width // 2) if self.need is None else self.need


def mean(width: int, need: int | None = None, column: str = "value") -> Trailing:
    return Trailing("mean", width, need, column)


def std(width: int, need: int | None = None, column: str = "value") -> Trailing:
    return Trailing("std", width, need, column)


def quantiles(width: int, at: Sequence[float], need: int | None = None, column: str = "value") -> Trailing:
    return Trailing("quantile", width, need, column, tuple(at))


def _blocks(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of every row when each series starts a block of its own, whether its block is a series'
    first, and the number of blocks. ``first``: whether a row starts a series."""
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(first)))
    blocks = -(-sizes // width)
    series = np.cumsum(first) - 1
    inside = np.arange(len(first)) - starts[series]
    base = (np.cumsum(blocks) - blocks) * width
    return base[series] + inside, inside < width, int(blocks.sum())


def _running(x: np.ndarray, valid: np.ndarray, deviations: bool):
    """Down the rows of ``x`` (place in block, block): counts, sums and, by the running mean, summed
    squares around it."""
    count = np.cumsum(valid, axis=0)
    total = np.cumsum(np.where(valid, x, 0.0), axis=0)
    if not deviations:
        return count, total, None, None
    level, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    levels, squares = np.empty_like(x), np.empty_like(x)
    for i in range(len(x)):
        off = np.where(valid[i], x[i] - level, 0.0)
        level = level + off / np.maximum(count[i], 1)
        square = square + off * np.where(valid[i], x[i] - level, 0.0)
        levels[i], squares[i] = level, square
    return count, total, levels, squares


def moments(x: np.ndarray, valid: np.ndarray, first: np.ndarray, width: int, deviations: bool):
    """Count, sum and (asked for) summed squares around the mean of every row's window."""
    place, alone, blocks = _blocks(first, width)
    laid, there = np.zeros(blocks * width), np.zeros(blocks * width, bool)
    laid[place], there[place] = np.where(valid, x, 0.0), valid
    laid, there = np.ascontiguousarray(laid.reshape(blocks, width).T), np.ascontiguousarray(there.reshape(blocks, width).T)
    block, row = place // width, place % width
    n1, s1, m1, q1 = (None if a is None else a[row, block] for a in _running(laid, there, deviations))
    ends = _running(laid[::-1], there[::-1], deviations)
    more = ~alone & (row < width - 1)
    at = np.where(more, width - 2 - row, 0), np.where(more, block - 1, 0)
    n2, s2, m2, q2 = (None if a is None else np.where(more, a[at], 0) for a in ends)
    n, s = n1 + n2, s1 + s2
    if not deviations:
        return n, s, None
    both = (n1 > 0) & (n2 > 0)
    apart = np.where(both, m1 - m2, 0.0)
    return n, s, q1 + q2 + apart * apart * n1 * n2 / np.maximum(n, 1)


def window_quantiles(x: np.ndarray, valid: np.ndarray, first: np.ndarray, width: int, least: int, at: Sequence[float]) -> np.ndarray:
    """A row per row and a column per quantile; NaN where there are too few values."""
    out = np.full((len(x), len(at)), np.nan)
    order: list[float] = []
    rows: deque = deque()
    for i, (value, ok, new) in enumerate(zip(x.tolist(), (valid & ~np.isnan(x)).tolist(), first.tolist())):
        if new:
            order.clear()
            rows.clear()
        if len(rows) == width:
            gone = rows.popleft()
            if gone is not None:
                del order[bisect_left(order, gone)]
        rows.append(value if ok else None)
        if ok:
            insort(order, value)
        n = len(order)
        if n >= least:
            for j, q in enumerate(at):
                spot = (n - 1) * q
                k = int(spot)
                out[i, j] = order[k] if k + 1 >= n else order[k] + (order[k + 1] - order[k]) * (spot - k)
    return out


def _columns(wanted: dict[str, Trailing], table: pa.Table, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per column to make: its values, and whether they are there."""
    read, known, out = {}, {}, []
    for column in {w.column for w in wanted.values()}:
        array = table.column(column).combine_chunks().cast(pa.float64())
        read[column] = _values(array)
    for w in wanted.values():
        x, valid = read[w.column]
        if w.kind == "quantile":
            found = window_quantiles(x, valid, first, w.width, w.least, w.at)
            out += [(found[:, j], ~np.isnan(found[:, j])) for j in range(len(w.at))]
            continue
        spot = w.column, w.width
        deviations = any(o.kind == "std" and (o.column, o.width) == spot for o in wanted.values())
        if spot not in known:
            with np.errstate(invalid="ignore", over="ignore"):
                known[spot] = moments(x, valid, first, w.width, deviations)
        n, s, q = known[spot]
        if w.kind == "mean":
            out.append((s / np.maximum(n, 1), n >= max(1, w.least)))
        else:
            out.append((np.sqrt(q / np.maximum(n - 1, 1)), n >= max(2, w.least)))
    return out


def _values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Doubles, 0 where null, and whether they are there."""
    valid = ~np.asarray(array.is_null())
    return np.asarray(array.fill_null(0.0)), valid


def trailing_features(panel: DataFrame, wanted: dict[str, Trailing], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The panel with a column per statistic; quantiles give one for each of theirs, ``name_0``, ``name_1``, ..."""
    names = [n for name, w in wanted.items() for n in ([f"{name}_{j}" for j in range(len(w.at))] if w.kind == "quantile" else [name])]
    clash = set(names) & set(panel.columns)
    if clash:
        raise ValueError(f"the panel has columns {sorted(clash)} already")
    number = "_row"
    while number in panel.columns:
        number += "_"
    placed = panel.withColumn(number, F.row_number().over(by_day(*keys)))
    reach = max(w.width for w in wanted.values()) - 1
    schema = StructType([*panel.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    kept = panel.columns

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            before = 0 if held is None else held.num_rows
            if before:
                table = pa.concat_tables([held, table])
            first = table.column(number).to_numpy() == 1
            first[0] = True
            found = [pa.array(np.ascontiguousarray(x[before:]), mask=~ok[before:]) for x, ok in _columns(wanted, table, first)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, *names])
            start = int(np.flatnonzero(first)[-1])
            held = table.slice(max(start, table.num_rows - reach)).combine_chunks() if reach else None

    return placed.mapInArrow(run, schema)
