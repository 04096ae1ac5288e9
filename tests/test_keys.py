import random
from collections import Counter
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from linkgraph.operators import heavy_keys, orphans, skew


def month_end(t):
    return datetime(t.year + t.month // 12, t.month % 12 + 1, 1)


@pytest.fixture(scope="module")
def world():
    r = random.Random(4)
    def when():
        return datetime(2025, r.randrange(1, 13), r.choice([1, 1, 15, 28]), r.choice([0, 23]))
    parents = []
    for k in [*range(1000, 1100), *r.sample(range(2000, 9000), 200), -5, -4, 1023, 1024, 1025]:
        for _ in range(r.choice([1, 1, 1, 2])):
            a = when()
            d = when() if r.random() < 0.4 else None
            parents.append((k, a, None if d is not None and d < a else d))
    parents += [(None, datetime(2025, 1, 1), None), (1001, None, None)]
    keys = [p[0] for p in parents if p[0]] + list(range(990, 1110)) + [5, 10_000, -6]
    refs = [(i, r.choice(keys), when()) for i in range(3000)] + [(i, 1050, when()) for i in range(1500)] + [(1, None, when())]
    return parents, refs


def brute_orphans(parents, refs):
    out = set()
    for f, k, t in refs:
        end = month_end(t)
        if k is not None and not any(p == k and a is not None and a < end and (d is None or d >= end) for p, a, d in parents):
            out.add((f, str(k), f"{t:%Y-%m}"))
    return out


@pytest.mark.parametrize("text", [False, True])
def test_orphans(spark, world, text):
    parents, refs = world
    kind = "string" if text else "bigint"
    up = spark.createDataFrame(parents, "key bigint, a timestamp, d timestamp").select(F.col("key").cast(kind).alias("key"), orphans.lifetimes(F.col("a"), F.col("d")).alias("life"))
    down = spark.createDataFrame(refs, "from_id bigint, key bigint, t timestamp").where("key is not null").select("from_id", F.col("key").cast(kind).alias("key"), orphans.month_number(F.col("t")).alias("period"))
    counted = down.groupBy("key", "period").agg(F.count("*").alias("n"))
    judged = orphans.orphans_by_text(up, counted, 7) if text else orphans.orphans_by_integer(up, counted)
    got = orphans.rows_of_orphans(down, judged, down.count()).select("from_id", F.col("key").cast("string"), orphans.month_label(F.col("period")))
    assert {tuple(r) for r in got.collect()} == brute_orphans(parents, refs)


def test_orphans_of_empty_tables(spark, world):
    _, refs = world
    none = spark.createDataFrame([], "key bigint, life struct<since:int,until:int>")
    down = spark.createDataFrame([(1, 24300, 2), (2, 24300, 1)], "key bigint, period int, n bigint")
    assert rows(orphans.orphans_by_integer(none, down).select("key", "orphan")) == [(1, True), (2, True)]
    assert orphans.orphans_by_integer(none, down.where("false")).count() == 0
    assert orphans.orphans_by_text(none.withColumn("key", F.col("key").cast("string")), down.withColumn("key", F.col("key").cast("string")).where("false"), 3).count() == 0


@pytest.mark.parametrize("split", [1_000_000, 50])
def test_key_profile(spark, monkeypatch, split):
    monkeypatch.setattr(heavy_keys, "SPLIT_ROWS", split)
    r = random.Random(8)
    data = [(r.choice([7, 7, 7, r.randrange(-50, 50), None]), r.choice([1, r.randrange(100), None]), "x") for _ in range(2000)] + [(2**62, -(2**62), "x")] * 3
    df = spark.createDataFrame(data, "a bigint, b bigint, n_rows string")
    got = {(x[0], x[1]): (x[2], x[3]) for x in rows(heavy_keys.key_profile(df.select("a", "b"), "a", "b"))}
    want = {}
    for i, name in ((0, "a"), (1, "b")):
        for k, n in Counter(d[i] for d in data if d[i] is not None).items():
            want[name, k] = (n, len({d[1 - i] for d in data if d[i] == k and d[1 - i] is not None}))
    assert got == want


def test_key_profile_of_empty_and_null(spark):
    assert heavy_keys.key_profile(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    assert rows(heavy_keys.key_profile(spark.createDataFrame([(None, None), (1, None)], "a bigint, b bigint"), "a", "b")) == [("a", 1, 1, 0)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_with_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows_ = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)] + [(None, -1)], "k int, v int")
    dim = spark.createDataFrame([(0, "zero"), (3, "three"), (99, "none")], "k int, name string")
    got = skew.join_unique(rows_, dim, "k", how, share=0.1)
    assert rows(got.select("k", "v", "name")) == rows(rows_.join(dim, "k", how).select("k", "v", "name"))
