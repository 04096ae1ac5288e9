import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import groups, sketch


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 4))
def test_sketch_bounds_hold_however_it_is_merged(values, parts):
    old = sketch.BITS, sketch.CELLS
    sketch.BITS, sketch.CELLS = 3, 8  # crowded cells
    try:
        h = np.array([hash((v, "x")) for v in values], np.int64)
        state = sketch.empty()
        for p in range(parts):
            state = list(sketch.merge(*state, *sketch.add(sketch.empty(), h[p::parts])))
        counts = Counter(h.tolist())
        assert state[0][0].sum() == len(values)
        bounds, hidden = sketch.candidates(state, 1)
        for x, (low, high) in bounds.items():
            assert low <= counts[x] <= high
        for x, n in counts.items():
            if n >= 20:
                found, unsure = sketch.candidates(state, 20)
                cells = [int(sketch.cell_of(np.array([x]), r)[0]) for r in range(sketch.ROWS)]
                assert x in found or all(c in unsure[r] for r, c in enumerate(cells))
    finally:
        sketch.BITS, sketch.CELLS = old


@pytest.mark.parametrize("bits", [12, 2])
def test_frequent(spark, monkeypatch, bits):
    """With four cells a row nearly every value is unsure, and the exact check still finds all."""
    monkeypatch.setattr(sketch, "BITS", bits)
    monkeypatch.setattr(sketch, "CELLS", 1 << bits)
    r = random.Random(1)
    values = [r.choice(["a", "a", "b", f"v{r.randrange(300)}", None, ""]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n int").repartition(3)
    got = {x["item"]: x for x in sketch.frequent(df, "v", 0.01).collect()}
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    assert {k: x["n"] for k, x in got.items()} == {k: n for k, n in counts.items() if n >= 0.01 * total}
    assert all(x["lower"] <= x["n"] <= x["upper"] and x["n_total"] == total for x in got.values())


def test_frequent_of_empty_null_and_ties(spark):
    df = spark.createDataFrame([(None,), (None,)], "v bigint")
    assert sketch.frequent(df, "v", 0.1).count() == 0 and sketch.frequent(df.where("false"), "v", 0.1).count() == 0
    ties = spark.createDataFrame([(i % 4,) for i in range(40)], "v bigint")
    assert sorted(x["item"] for x in sketch.frequent(ties, "v", 0.25).collect()) == ["0", "1", "2", "3"]
    assert sketch.frequent(ties, "v", 0.2501).count() == 0


def brute_groups(pairs):
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def check(spark, pairs, cell_edges):
    df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a bigint, b bigint, vertex int")
    got = {r["vertex"]: r["group_id"] for r in groups.connected_groups(df, cell_edges).collect()}
    assert got == brute_groups(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_groups_on_a_grid(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(None, 3), (4, None), (5, 5), (7, 8), (8, 7), (7, 8)]
    check(spark, pairs, 20)


def test_long_chain_and_star(spark):
    check(spark, [(i, i + 1) for i in range(700)], 40)
    check(spark, [(0, i) for i in range(1, 400)] + [(-7, 399), (1000, 1001)], 30)


def test_no_pairs(spark):
    check(spark, [], 10)
    check(spark, [(1, 1)], 10)


def test_local_roots_agree():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 300, 500), r.integers(0, 300, 500)
    names, roots = groups.local_roots(a, b, 3)
    root = dict(zip(names.tolist(), roots.tolist(), strict=True))
    want = brute_groups(list(zip(a.tolist(), b.tolist(), strict=True)))
    assert len({(root[x], want[x]) for x in want}) == len(set(want.values())) == len({root[x] for x in want})
