"""Vectors over an axis, filled in Arrow batches from rows that say a place and its numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a column's vectors that are made at a time: 256 KB.
NUMBERS = 1 << 15
ALL = pa.scalar("all")


def codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Equal values as equal numbers, and the value of each number; NULL is a value."""
    d = pc.dictionary_encode(column, null_encoding="encode")
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows, where equal keys are next to each other, in batches that hold all rows of each of their keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(np.diff(codes(batch.column(key))[0])) + 1
        if held and not held[-1].column(key)[-1].equals(batch.column(key)[0]):
            new = np.r_[0, new]
        if not len(new):
            held.append(batch)
            continue
        if rows := [*held, batch.slice(0, new[-1])]:
            yield pa.concat_batches(rows)
        held = [batch.slice(new[-1])]
    if held:
        yield pa.concat_batches(held)


def vectors(batches: Iterator[pa.RecordBatch], keys: list[str], every: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of (keys, long, at, columns), where those of a card are next to each other, as a row for each of ``keys`` with a vector of
    ``long`` numbers a column: the sums of the rows of each place. Each key of ``every`` is taken as it is and as 'all'. Keys whose sums are
    all zero have no row."""
    for batch in whole(batches, "card_id"):
        code, values = map(dict, zip(*[((k, x), (k, v)) for k in keys for x, v in [codes(batch.column(k))]], strict=True))
        row = np.arange(batch.num_rows)
        for key in every:
            at = pc.index(values[key], ALL).as_py()
            if at < 0:
                at, values[key] = len(values[key]), pa.concat_arrays([values[key], pa.array(["all"], values[key].type)])
            code = {k: np.r_[x, np.full_like(x, at) if k == key else x] for k, x in code.items()}
            row = np.r_[row, row]
        group = np.zeros(len(row), np.int64)
        for key in keys:
            group = group * len(values[key]) + code[key]
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        group, row, long = group[order], row[order], batch.column("long").to_numpy()[row[first]].astype(np.int64)
        at, numbers = batch.column("at").to_numpy()[row], [batch.column(c).to_numpy()[row] for c in columns]
        step = max(1, NUMBERS // int(long.max()))
        for a in range(0, len(first), step):
            offsets = np.r_[0, np.cumsum(long[a : a + step])]
            rows = slice(*np.searchsorted(group, [a, a + step]))
            of = group[rows] - a
            place = offsets[of] + at[rows]
            some = np.zeros(len(offsets) - 1, bool)
            lists = []
            for x in numbers:
                out = np.zeros(offsets[-1], x.dtype)
                np.add.at(out, place, x[rows])
                some[of[out[place] != 0]] = True
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out)))
            made = pa.RecordBatch.from_arrays([values[k].take(pa.array(code[k][first[a : a + step]])) for k in keys] + lists, [*keys, *columns])
            yield made if some.all() else made.filter(pa.array(some))
