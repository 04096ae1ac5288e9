"""Per-key results where a few keys hold most rows.

Rows are never gathered by key. Every equal split of the input encodes its keys by a dictionary of
its own and counts into a dense array (numpy bincount); the arrays are cut into blocks of the key
space and the blocks are summed by a distributed reduction, which again encodes the keys of its
blocks and scatter-adds. A key with a third of all rows thus costs one entry a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.plans.session import shuffle_width

#: Rows that one dense accumulator takes in before its counts are sent on; bounds a task's memory.
SPLIT_ROWS = 1_000_000
#: Blocks of the key space for each task of the reduction.
BLOCKS_PER_TASK = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a key by multiplicative hashing, so that neighbouring ids spread."""
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % blocks


def _dense(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dictionary of the keys and, per weight, the dense array of its sums."""
    names, codes = np.unique(keys, return_inverse=True)
    return names, [np.bincount(codes, weights=w, minlength=len(names)).astype(np.int64) for w in weights]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


def dense_sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """which INT, key and the sums of the BIGINT columns ``sums`` for each value of each BIGINT column
    of keys (which: its place in keys), all in one pass over df.

    A null key counts nowhere, a null summand counts 0; an empty input gives no rows. Sums must
    stay below 2**53, where the dense double accumulators are exact.
    """
    blocks = shuffle_width(df.sparkSession) * BLOCKS_PER_TASK
    fields = pa.schema([("which", pa.int32()), ("block", pa.int64()), ("keys", pa.list_(pa.int64())), *((f"s{i}", pa.list_(pa.int64())) for i in range(len(sums)))])
    out = pa.schema([("which", pa.int32()), ("key", pa.int64()), *((f"s{i}", pa.int64()) for i in range(len(sums)))])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, SPLIT_ROWS):
            weights = [_numpy(t.column(len(keys) + i)) for i in range(len(sums))]
            for which in range(len(keys)):
                column = t.column(which)
                here = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else slice(None)
                names, arrays = _dense(_numpy(column.drop_null()), [w[here] for w in weights])
                at = _block_of(names, blocks)
                order = np.argsort(at, kind="stable")
                present, starts = np.unique(at[order], return_index=True)
                offsets = pa.array(np.append(starts, len(order)), pa.int32())
                columns = [pa.array(np.full(len(present), which, np.int32)), pa.array(present), *(pa.ListArray.from_arrays(offsets, pa.array(a[order])) for a in (names, *arrays))]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per column the dictionary of the task's blocks, which grows to its share of the distinct
        # keys; array blocks are scattered onto it in portions of at least its own size.
        none = [np.empty(0, np.int64) for _ in range(len(sums) + 1)]
        state = {which: none for which in range(len(keys))}
        held: dict[int, list] = {which: [] for which in state}
        size = dict.fromkeys(state, 0)

        def settle(which: int) -> None:
            parts = [state[which], *held[which]]
            names, arrays = _dense(np.concatenate([p[0] for p in parts]), [np.concatenate([p[i + 1] for p in parts]) for i in range(len(sums))])
            state[which], held[which], size[which] = [names, *arrays], [], 0

        for b in batches:
            tags = b.column(0).to_numpy()
            for which in np.unique(tags).tolist():
                mine = b.filter(pa.array(tags == which))
                part = [np.asarray(mine.column(i).flatten(), dtype=np.int64) for i in range(2, 3 + len(sums))]
                held[which].append(part)
                size[which] += len(part[0])
                if size[which] >= max(SPLIT_ROWS, len(state[which][0])):
                    settle(which)
        for which in state:
            settle(which)
            for i in range(0, len(state[which][0]), 100_000):
                part = [pa.array(a[i : i + 100_000]) for a in state[which]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), which, np.int32)), *part], schema=out)

    clean = df.select(*(F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.col(s).cast("long"), F.lit(0).cast("long")).alias(f"s{i}") for i, s in enumerate(sums)))
    lists = ", ".join(f"s{i} array<bigint>" for i in range(len(sums)))
    longs = ", ".join(f"s{i} bigint" for i in range(len(sums)))
    told = clean.mapInArrow(accumulate, f"which int, block bigint, keys array<bigint>, {lists}").repartition("which", "block").mapInArrow(reduce, f"which int, key bigint, {longs}")
    return told.select("which", "key", *(F.col(f"s{i}").alias(s) for i, s in enumerate(sums)))


def key_profile(df: DataFrame, left: str, right: str) -> DataFrame:
    """column_name, key_id, n_rows, n_distinct: per value of each of two BIGINT columns, the rows
    that hold it and the distinct values beside it in the other column.

    Nulls: a row with a null in one column counts among the rows of its other key but adds no
    distinct value; a row with two nulls counts nowhere. Repeated rows count each time. The pairs
    are first counted (partial counts before the shuffle, hashed by pair, so no key gathers), then
    both columns go through dense_sums at once.
    """
    pairs = (
        df.where(F.col(left).isNotNull() | F.col(right).isNotNull())
        .groupBy(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("n_distinct", (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long"))
    )
    name = F.when(F.col("which") == 0, left).otherwise(right)
    return dense_sums(pairs, ["a", "b"], ["n_rows", "n_distinct"]).select(name.alias("column_name"), F.col("key").alias("key_id"), "n_rows", "n_distinct")
