"""Samples whose two-way category shares match given targets.

Fractional quotas of a two-way table become integers by controlled rounding: a maximum flow from
rows to columns in which every cell, every row margin, every column margin and the total may only
take the integer below or above its fractional value. Each cell then takes exactly its quota of
rows with the least random keys.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.plans.session import checkpointed, small_or_shuffled

#: Bits of the random key that form the histogram in which the cut of a cell is found.
KEY_BITS = 16
SEED = 42
_NEAR = 1e-9


def _floor(x: float) -> int:
    return math.floor(x + _NEAR)


def _ceil(x: float) -> int:
    return math.ceil(x - _NEAR)


class _Flow:
    """Feasible flow under lower and upper bounds, by shortest augmenting paths."""

    def __init__(self, n: int):
        self.n = n + 2
        self.to: list[list[list[int]]] = [[] for _ in range(self.n)]
        self.due = [0] * n

    def edge(self, a: int, b: int, low: int, high: int) -> list[int]:
        """An edge; what flows through it is its lower bound plus what the residual took."""
        x, y = [b, high - low, len(self.to[b])], [a, 0, len(self.to[a])]
        self.to[a].append(x)
        self.to[b].append(y)
        self.due[b] += low
        self.due[a] -= low
        return y

    def solve(self) -> bool:
        source, sink = self.n - 2, self.n - 1
        want = 0
        for v, d in enumerate(list(self.due)):
            a, b, c = (source, v, d) if d > 0 else (v, sink, -d)
            want += max(d, 0)
            self.to[a].append([b, c, len(self.to[b])])
            self.to[b].append([a, 0, len(self.to[a]) - 1])
        while True:
            came, queue = {source: None}, deque([source])
            while queue and sink not in came:
                v = queue.popleft()
                for i, (w, c, _) in enumerate(self.to[v]):
                    if c > 0 and w not in came:
                        came[w] = (v, i)
                        queue.append(w)
            if sink not in came:
                return want == 0
            path, w = [], sink
            while came[w]:
                v, i = came[w]
                path.append(self.to[v][i])
                w = v
            push = min(e[1] for e in path)
            want -= push
            w = sink
            for e in path:
                e[1] -= push
                self.to[e[0]][e[2]][1] += push


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers next to the values of a two-way table, such that each row sum, each column sum and
    the total are next to theirs too. Keys are (row, column)."""
    rows, columns = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    at = {("r", x): i + 2 for i, x in enumerate(rows)} | {("c", x): i + 2 + len(rows) for i, x in enumerate(columns)}
    flow = _Flow(2 + len(at))
    for x in rows:
        s = sum(v for (r, _), v in cells.items() if r == x)
        flow.edge(0, at["r", x], _floor(s), _ceil(s))
    for x in columns:
        s = sum(v for (_, c), v in cells.items() if c == x)
        flow.edge(at["c", x], 1, _floor(s), _ceil(s))
    taken = {k: flow.edge(at["r", k[0]], at["c", k[1]], _floor(v), _ceil(v)) for k, v in cells.items()}
    total = sum(cells.values())
    flow.edge(1, 0, round(total), round(total))
    if not flow.solve():  # can't be: the fractional table is itself a flow
        raise ArithmeticError("no controlled rounding")
    return {k: _floor(v) + taken[k][1] for k, v in cells.items()}


def fitted(share: list[float], low: list[int], high: list[int], size: float) -> list[float]:
    """Quotas in the proportions of share within [low, high] that add up to size, as far as
    the bounds allow: the bounded quotas are fixed and the rest is shared out anew."""
    low = [min(a, b) for a, b in zip(low, high, strict=True)]
    size = min(max(size, sum(low)), sum(high))
    lo, hi = 0.0, 1.0
    at = lambda f: [min(max(f * s, a), b) for s, a, b in zip(share, low, high, strict=True)]
    if sum(b for s, b in zip(share, high, strict=True) if s > 0) + sum(a for s, a in zip(share, low, strict=True) if s <= 0) <= size:
        return [float(b) if s > 0 else float(a) for s, a, b in zip(share, low, high, strict=True)]
    while sum(at(hi)) < size:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < size else (lo, mid)
    out = at(hi)
    # What bisection leaves goes to the free quotas, so that the total is the size exactly.
    free = [i for i, (x, a, b) in enumerate(zip(out, low, high, strict=True)) if a < x < b]
    if free:
        gap = (size - sum(out)) / len(free)
        out = [x + gap if i in free else x for i, x in enumerate(out)]
    return out


def usable(rows: DataFrame, item: str, category: tuple[Column, Column]) -> DataFrame:
    """item, cat_a, cat_b: the distinct items of usable categories. Null items are not usable; an
    item under two categories counts in each."""
    return rows.select(F.col(item).alias("item"), category[0].alias("cat_a"), category[1].alias("cat_b")).where("item is not null and cat_a is not null and cat_b is not null").distinct()


def quotas(items: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target_set, cat_a, cat_b, share_permille, sample_permille, min_rows: BIGINT) with
    available, need, quota and reach.

    need is the larger of min_rows and the target share of the sample rounded up. The quotas of a
    set add up to the rounded size of its sample unless the bounds (at least min_rows, at most what
    is available) forbid. reach is the quota that a category gets where each asks for its need: less
    than need tells that the target can't be met. One group is one target set.
    """
    targets = targets.select("target_set", "cat_a", "cat_b", "share_permille", "sample_permille", "min_rows")
    counts = items.groupBy("cat_a", "cat_b").agg(F.count("*").alias("available"))
    total = items.agg(F.count("*").alias("n_usable"))
    told = (
        targets.join(counts, ["cat_a", "cat_b"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
        .withColumn("n_usable", total.scalar())
        .withColumn("need", F.greatest("min_rows", F.expr("(n_usable * sample_permille * share_permille + 999999) div 1000000")))
    )

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        size = math.floor(int(group["n_usable"].iloc[0]) * int(group["sample_permille"].iloc[0]) / 1000 + 0.5)
        keys = list(zip(group["cat_a"], group["cat_b"], strict=True))

        def rounded(low: list[int], n: float) -> list[int]:
            whole = controlled_rounding(dict(zip(keys, fitted(group["share_permille"].tolist(), low, group["available"].tolist(), n), strict=True)))
            return [whole[k] for k in keys]

        need = group["need"].tolist()
        # The size asked for is what all needs come to, so shares play no part.
        return group.assign(quota=rounded(group["min_rows"].tolist(), size), reach=rounded(need, sum(map(min, need, group["available"].tolist()))))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields)
    return told.groupBy("target_set").applyInPandas(plan, f"{kinds}, quota bigint, reach bigint")


def take(items: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """target_set, item, cat_a, cat_b: of each cell exactly quota items, those of least random key.

    No cell is gathered: a histogram of the leading bits of the keys finds the bucket in which the
    quota is reached; buckets below are taken whole and only that one is ranked. plan has one row
    for each category of a target set; it is broadcast if the counted number is small.
    """
    cell = ["target_set", "cat_a", "cat_b"]
    plan = checkpointed(plan.where("quota > 0").select(*cell, "quota"))
    n_cells = plan.count()
    keyed = (
        items.select("item", "cat_a", "cat_b").join(small_or_shuffled(plan, n_cells), ["cat_a", "cat_b"])
        .withColumn("key", F.xxhash64(F.lit(seed), "target_set", "item"))
        .withColumn("bucket", F.shiftrightunsigned("key", 64 - KEY_BITS))
    )
    upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("bucket"))
    cut = (
        keyed.groupBy(*cell, "quota", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", upto - F.col("n"))
        .where("before < quota")
        .groupBy(*cell).agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    )
    told = keyed.join(small_or_shuffled(cut, n_cells), cell).where("bucket <= last")
    ranked = told.where("bucket = last").withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "item"))).where("before + rank <= quota")
    return told.where("bucket < last").select("target_set", "item", "cat_a", "cat_b").unionByName(ranked.select("target_set", "item", "cat_a", "cat_b"))
