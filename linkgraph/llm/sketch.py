"""Most frequent values in bounded memory: a majority-vote sketch and an exact check of its candidates.

The sketch has ROWS rows of 2**BITS cells. A value falls into one cell of each row, given by bits of
its 64-bit hash. A cell keeps the total of its values, a candidate and the candidate's surplus of
votes over all others. Two cells merge by adding totals and by adding or cancelling votes. For a
candidate with surplus c in a cell of total t its count lies in [c, (t + c) / 2]; any other value
of the cell counts at most (t - c) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, BITS = 4, 12
CELLS = 1 << BITS
#: Values that a task counts at once before they go into its sketch; bounds its memory.
CHUNK = 1_000_000
#: Sketches of so many groups of tasks are merged first, then those of the groups.
FAN = 64


def cell_of(h: np.ndarray, row: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(row * BITS)).astype(np.int64) & (CELLS - 1)


def merge(t1, k1, c1, t2, k2, c2):
    """Cells of two sketches merged by vote cancellation."""
    same = k1 == k2
    return t1 + t2, np.where(same | (c1 >= c2), k1, k2), np.where(same, c1 + c2, np.abs(c1 - c2))


def empty() -> list[np.ndarray]:
    return [np.zeros((ROWS, CELLS), np.int64) for _ in range(3)]


def add(state: list[np.ndarray], h: np.ndarray) -> list[np.ndarray]:
    """Adds hashes to a sketch: the hashes of a cell are first a sketch of their own."""
    names, counts = np.unique(h, return_counts=True)
    fresh = empty()
    order = np.argsort(counts, kind="stable")  # of the values of a cell the most frequent is written last
    for r in range(ROWS):
        cell = cell_of(names, r)
        fresh[0][r] = np.bincount(cell, weights=counts, minlength=CELLS).astype(np.int64)
        most = np.zeros(CELLS, np.int64)
        fresh[1][r][cell[order]], most[cell[order]] = names[order], counts[order]
        fresh[2][r] = np.maximum(2 * most - fresh[0][r], 0)
    return list(merge(*state, *fresh))


def build(df: DataFrame, value: Column) -> list[np.ndarray]:
    """The sketch of a column: totals, candidates (hashes) and surpluses, each ROWS x CELLS.

    Null values take no part. Tasks build sketches of fixed size, which are merged in two rounds;
    what reaches the driver has a fixed size.
    """
    fields = "part int, row int, totals array<bigint>, candidates array<bigint>, votes array<bigint>"

    def rows_of(state: list[np.ndarray], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part] * ROWS, pa.int32()), "row": pa.array(range(ROWS), pa.int32()),
            **{n: pa.array([x.tolist() for x in state[i]], pa.list_(pa.int64())) for i, n in enumerate(("totals", "candidates", "votes"))},
        })

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, held, n = empty(), [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += b.num_rows
            if n >= CHUNK:
                state, held, n = add(state, np.concatenate(held)), [], 0
        if n:
            state = add(state, np.concatenate(held))
        yield rows_of(state, TaskContext.get().partitionId() % FAN)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for x in b.to_pylist():
                new = [np.array(x[n], np.int64) for n in ("totals", "candidates", "votes")]
                states[x["row"]] = list(merge(*states[x["row"]], *new)) if x["row"] in states else new
        if states:
            rows = sorted(states)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([0] * len(rows), pa.int32()), "row": pa.array(rows, pa.int32()),
                **{n: pa.array([states[r][i].tolist() for r in rows], pa.list_(pa.int64())) for i, n in enumerate(("totals", "candidates", "votes"))},
            })

    partial = df.where(value.isNotNull()).select(F.xxhash64(value).alias("h")).mapInArrow(sketch, fields)
    merged = partial.repartition(FAN // 4, "part", "row").mapInArrow(union, fields).repartition(ROWS, "row").mapInArrow(union, fields)
    state = empty()
    for x in merged.collect():  # ROWS rows of CELLS cells
        for i, n in enumerate(("totals", "candidates", "votes")):
            state[i][x["row"]] = x[n]
    return state


def candidates(state: list[np.ndarray], least: float) -> tuple[dict[int, tuple[int, int]], list[set[int]]]:
    """Hashes that may count least or more, with their bounds; and per row the cells in which a
    value that is not the candidate may count that much.

    The totals of a row add up to n, so a row has at most n / least such candidates.
    """
    t, k, c = state
    bounds: dict[int, tuple[int, int]] = {}
    for h in {int(x) for r in range(ROWS) for x in k[r][(t[r] > 0) & ((t[r] + c[r]) / 2 >= least)]}:
        low, high = 0, None
        for r in range(ROWS):
            i = cell_of(np.array([h], np.int64), r)[0]
            mine = k[r][i] == h
            low = max(low, int(c[r][i]) if mine else 0)
            up = int(t[r][i] + (c[r][i] if mine else -c[r][i])) // 2
            high = up if high is None else min(high, up)
        if high >= least:
            bounds[h] = (low, high)
    hidden = [set(np.flatnonzero((t[r] > 0) & ((t[r] - c[r]) / 2 >= least)).tolist()) for r in range(ROWS)]
    return bounds, hidden


def frequent(df: DataFrame, column: str, share: float) -> DataFrame:
    """item STRING, lower, upper and n (exact count) of the values with at least share of the
    non-null rows, and n_total.

    The sketch names the candidates; a second scan counts only them, together with the (usually
    no) values all of whose cells could hide a frequent one, so nothing frequent is missed and
    nothing else returned. Ties all come out; an empty column gives no rows; the bounds are those of the value's hash.
    """
    spark = df.sparkSession
    value = F.col(column)
    state = build(df, value)
    total = int(state[0][0].sum())
    least = max(1.0, total * share)
    bounds, hidden = candidates(state, least)
    h = F.xxhash64(value)
    wanted = h.isin(*bounds) if bounds else F.lit(False)
    if all(hidden):
        unsure = F.lit(True)
        for r in range(ROWS):
            unsure = unsure & F.shiftrightunsigned(h, r * BITS).bitwiseAND(CELLS - 1).isin(*hidden[r])
        wanted = wanted | unsure
    table = spark.createDataFrame([(h, *b) for h, b in bounds.items()], "h bigint, lower bigint, upper bigint")
    counted = df.where(value.isNotNull() & wanted).groupBy(value.alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return (
        counted.withColumn("h", F.xxhash64("value"))
        .join(F.broadcast(table), "h", "left")
        .select(F.col("value").cast("string").alias("item"), F.coalesce("lower", F.lit(0)).alias("lower"), F.coalesce("upper", "n").alias("upper"), "n", F.lit(total).cast("long").alias("n_total"))
    )
