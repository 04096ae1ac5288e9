import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.llm import mixing, quota

TARGET = "target_set string, cat_a string, cat_b int, share_permille bigint, sample_permille bigint, min_rows bigint, available string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 5)), st.floats(0, 40).map(lambda x: round(x, 3)), min_size=1))
def test_controlled_rounding(cells):
    got = quota.controlled_rounding(cells)
    def near(a, b):
        return abs(a - b) < 1 + 1e-6
    assert got.keys() == cells.keys() and all(near(got[k], v) for k, v in cells.items())
    for i in (0, 1):
        for x in {k[i] for k in cells}:
            assert near(sum(v for k, v in got.items() if k[i] == x), sum(v for k, v in cells.items() if k[i] == x))
    assert sum(got.values()) == round(sum(cells.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 8), st.integers(0, 60)), min_size=1, max_size=9), st.integers(0, 300))
def test_fitted(rows, size):
    share, low, high = (list(x) for x in zip(*rows, strict=True))
    got = quota.fitted(share, low, high, size)
    assert all(min(a, b) - 1e-6 <= x <= b + 1e-6 for x, a, b in zip(got, low, high, strict=True))
    reach = sum(b for s, b in zip(share, high, strict=True) if s > 0) + sum(min(a, b) for s, a, b in rows if s <= 0)
    floor = sum(min(a, b) for a, b in zip(low, high, strict=True))
    assert abs(sum(got) - max(floor, min(size, reach))) < 1e-6


def episodes(spark):
    r = random.Random(5)
    data = [(f"e{i}", r.choice(["easy", " Easy", "hard", None, ""]), r.choice([2, 3, 4, -1, None, 3, 3]), "x") for i in range(900)]
    data += data[:100] + [(None, "easy", 2, "y")]
    return data, spark.createDataFrame(data, "id string, level string, n int, item string")


def test_sample(spark):
    data, df = episodes(spark)
    level = F.lower(F.trim("level"))
    items = quota.usable(df, "id", (F.when(level != "", level), F.when(F.col("n") > 0, F.col("n")))).cache()
    usable = {(i, d.strip().lower(), n) for i, d, n, _ in data if i and d and d.strip() and n and n > 0}
    assert {tuple(r) for r in items.collect()} == usable
    targets = [("s", "easy", 2, 100, 500, 5), ("s", "easy", 3, 500, 500, 5), ("s", "hard", 3, 390, 500, 5), ("s", "hard", 9, 10, 500, 5), ("t", "easy", 2, 1000, 30, 1)]
    plan = quota.quotas(items, spark.createDataFrame([(*t, "clash") for t in targets], TARGET)).cache()
    told = {(r["target_set"], r["cat_a"], r["cat_b"]): r for r in plan.collect()}
    for s, d, n, share, sample, least in targets:
        have = sum(x[1:] == (d, n) for x in usable)
        need = max(least, -(-len(usable) * sample * share // 1_000_000))
        r = told[s, d, n]
        assert (r["available"], r["need"], r["reach"]) == (have, need, min(have, need)) and r["quota"] <= have
    assert told["s", "hard", 9]["quota"] == 0 and told["s", "hard", 9]["reach"] < told["s", "hard", 9]["need"]
    s_size = int(len(usable) * 0.5 + 0.5)
    cap = sum(told[k]["available"] for k in told if k[0] == "s")
    assert sum(told[k]["quota"] for k in told if k[0] == "s") == min(s_size, cap)
    drawn = quota.take(items, plan).collect()
    assert len({tuple(r) for r in drawn}) == len(drawn) and {(r["item"], r["cat_a"], r["cat_b"]) for r in drawn} <= usable
    keys = items.withColumn("k", F.xxhash64(F.lit(quota.SEED), F.lit("s"), "item")).collect()
    for k, r in told.items():
        mine = {x["item"] for x in drawn if (x["target_set"], x["cat_a"], x["cat_b"]) == k}
        assert len(mine) == r["quota"]
        if k[0] == "s":
            order = sorted((x["k"] & (2**64 - 1), x["item"]) for x in keys if (x["cat_a"], x["cat_b"]) == k[1:])
            assert mine == {i for _, i in order[: r["quota"]]}


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], "item string, cat_a string, cat_b int")
    targets = spark.createDataFrame([("s", "easy", 2, 1000, 500, 3, "")], TARGET)
    plan = quota.quotas(none, targets)
    assert [(r["available"], r["need"], r["quota"], r["reach"]) for r in plan.collect()] == [(0, 3, 0, 0)]
    assert quota.take(none, plan).count() == 0 and quota.quotas(none, targets.where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1))
def test_pfair_deviation(blocks):
    got = mixing.pfair(blocks)
    total = sum(blocks.values())
    assert sorted(got) == sorted((s, j) for s, m in blocks.items() for j in range(m))
    done = dict.fromkeys(blocks, 0)
    for slot, (s, j) in enumerate(got, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - slot * m / total) < 1 for x, m in blocks.items())


def test_water_fill():
    got = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 10, "b": 1000, "c": 1000, "d": 9}, 100)
    assert got == pytest.approx({"a": 10, "b": 54, "c": 36, "d": 0})
    assert mixing.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5.0}


def test_mix(spark):
    r = random.Random(3)
    data = [(i, r.choice(["a", "a", "a", "b", "c", None, "other"]), r.choice([0, 1, 5, 20, 40]), -1) for i in range(600)]
    sizes = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint, slot int").cache()
    weights = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.15, 4), ("empty", 0.05, 2)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(sizes, weights)
    small = {"slots": 64, "block_tokens": 40}
    mixed = mixing.mix(sizes, planned, **small)
    got = mixed.collect()
    total = sum(d[2] for d in data)
    by = {s: [d for d in data if d[1] == s and d[2] > 0] for s in "abc"}
    tokens = {s: sum(x["n_tokens"] for x in got if x["source"] == s) for s in "abc"}
    for p in planned:
        if p["source"] in by:
            assert abs(tokens[p["source"]] - p["wanted"]) <= 40
            copies = [x["doc_id"] for x in got if x["source"] == p["source"]]
            assert all(copies.count(d[0]) <= {"a": 2, "b": 3, "c": 4}[p["source"]] for d in by[p["source"]])
            starts = sorted((x["place"], x["n_tokens"]) for x in got if x["source"] == p["source"])
            assert len({x for x, _ in starts}) == len(starts) and all(a + n <= b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert abs(sum(tokens.values()) - total) <= 120
    assert next(p for p in planned if p["source"] == "b")["capped"] == (0.5 * total > 3 * sum(d[2] for d in by["b"]))
    # Up to any slot each source is less than one block, and what straddles its end, from its share.
    n_periods = mixing.periods(planned, **small)
    whole = sum(p["wanted"] for p in planned)
    far = {r["source"]: r["max_deviation"] for r in mixing.deviations(mixed, planned, **small).collect()}
    assert n_periods > 1 and set(far) == set("abc")
    for p in planned:
        if p["source"] not in by:
            continue
        block = p["wanted"] / (round(p["wanted"] / whole * 64) * n_periods)
        s, share, most = p["source"], p["wanted"] / whole, 0.0
        for slot in range(max(x["slot"] for x in got) + 1):
            part = sum(x["n_tokens"] for x in got if x["source"] == s and x["slot"] <= slot)
            most = max(most, abs(part - share * sum(x["n_tokens"] for x in got if x["slot"] <= slot)) / block)
        assert block <= 2 * 40 and most == pytest.approx(far[s], rel=1e-6) and most < 1 + 40 * max(1, 3 * share) / block
    assert sorted(map(tuple, mixing.mix(sizes.repartition(7), planned, **small).collect())) == sorted(map(tuple, got))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    weights = spark.createDataFrame([("a", 0.6, 2), (None, 0.4, 1)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(none, weights)
    assert [(p["source"], p["wanted"]) for p in planned] == [("a", 0.0)] and mixing.mix(none, planned).count() == 0
    assert mixing.deviations(mixing.mix(none, planned), planned).count() == 0
