"""Groups of records that pairs link directly or indirectly: union-find on a two-dimensional grid.

Vertices are hashed into k row and column blocks, so the edges fall into k * k cells of about
CELL_EDGES edges. Each round runs a union-find of its own on every cell; a vertex then exchanges
the representatives that its row and column cells gave it: it points to the best of them, and the
others become the edges of the next, smaller round. The order of preference is a hash that differs
from round to round, so even one long chain shrinks by a constant factor a round. The last round
has a single cell of bounded size; afterwards the pointers are followed back round by round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed

#: Edges of an average cell of the grid; bounds the memory of one union-find.
CELL_EDGES = 65_536


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(29)


def local_roots(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the root of each, the vertex of its component first in preference."""
    names = np.unique(np.concatenate([a, b]))
    names = names[np.argsort(_mixed(names, seed), kind="stable")]
    by_id = np.argsort(names)
    u, v = (by_id[np.searchsorted(names, x, sorter=by_id)] for x in (a, b))
    parent = np.arange(len(names))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return names, names[parent]


def _round(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """vertex, roots: the distinct representatives that its cells give to each vertex."""
    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(k))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        vertices, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)), seed)
        for i in range(0, len(vertices), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(vertices[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["vertex", "root"])

    # Cells that share a partition are solved together; any partition of the edges is right.
    cells = edges.repartition(k * k, block("a"), block("b"))
    return cells.mapInArrow(solve, "vertex bigint, root bigint").groupBy("vertex").agg(F.collect_set("root").alias("roots"))


def connected_groups(pairs: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """vertex, group_id of every vertex linked to another one; group_id is the least of its group.

    pairs: a, b BIGINT. Nulls, self-links and repeated or reversed pairs add nothing; an empty
    table gives no rows. Only counts and no edges, labels or groups reach the driver.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = checkpointed(pairs.where(a < b).select(a.alias("a"), b.alias("b")).unionByName(pairs.where(a > b).select(b.alias("a"), a.alias("b"))).distinct())
    pointers: list[DataFrame] = []
    while n := edges.count():
        seed = len(pointers) + 1
        told = checkpointed(_round(edges, max(1, math.ceil(math.sqrt(n / cell_edges))), seed))
        # A vertex that is a root somewhere stays in the graph; the others leave it with a pointer.
        best = F.array_sort("roots", lambda x, y: F.when(_rank(x, seed) < _rank(y, seed), -1).when(_rank(x, seed) > _rank(y, seed), 1).otherwise(0))[0]
        told = told.withColumn("best", F.when(F.size("roots") == 1, F.col("roots")[0]).otherwise(best))
        pointers.append(told.where(~F.array_contains("roots", F.col("vertex"))).select("vertex", F.col("best").alias("root")))
        rest = told.where(F.size("roots") > 1).select("best", F.explode("roots").alias("other")).where("best <> other")
        edges = checkpointed(rest.select(F.least("best", "other").alias("a"), F.greatest("best", "other").alias("b")).distinct())
    if not pointers:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("group_id"))
    resolved = checkpointed(pointers.pop())
    while pointers:
        earlier = checkpointed(pointers.pop())
        onward = join_unique(earlier, resolved.select(F.col("vertex").alias("root"), F.col("root").alias("further")), "root", "left")
        resolved = checkpointed(resolved.unionByName(onward.select("vertex", F.coalesce("further", "root").alias("root"))))
    least = resolved.groupBy("root").agg(F.least(F.min("vertex"), F.first("root")).alias("group_id"))
    members = resolved.unionByName(resolved.select("root").distinct().select(F.col("root").alias("vertex"), "root"))
    return join_unique(checkpointed(members), checkpointed(least), "root").select("vertex", "group_id")


def _rank(c: Column, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed))
