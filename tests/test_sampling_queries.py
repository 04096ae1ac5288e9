import inspect
import random

import pytest
from conftest import rows

from linkgraph.operators import graph, sampling
from linkgraph.plans import graph_queries as Q


@pytest.mark.parametrize("query, sampler, want", [("episode_sample", "sample_episodes", {"n_total": 100, "n_hard_bonus": 3}), ("quick_sample", "quick_sample", {"attempts": 5000})])
def test_samples_of_full_size(monkeypatch, query, sampler, want):
    """The queries sample as many episodes, from as many attempts, as the samplers do by default."""
    signature, used = inspect.signature(getattr(sampling, sampler)), {}

    def caught(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        used.update(bound.arguments)

    monkeypatch.setattr(sampling, sampler, caught)
    monkeypatch.setattr(Q.tables, "edges", lambda *_: (None, None))
    monkeypatch.setattr(Q, "_pages_with_degree", lambda *_: None)
    Q.QUERIES[query](None, "")
    assert {k: used[k] for k in want} == want


def test_rounds_of_a_quick_sample(spark, monkeypatch):
    r = random.Random(2)
    edges = spark.createDataFrame(sorted({(i, (i + 1) % 60) for i in range(60)} | {(i, (i * 7 + r.randrange(3)) % 60) for i in range(0, 60, 4)}), "src int, dst int").where("src <> dst")
    nodes = spark.range(60).selectExpr("id + 1000 page_id", "concat('P', id) page_title", "cast(id as int) node_idx")
    pages = nodes.join(graph.degrees(nodes, edges).select("node_idx", "out_degree"), "node_idx").cache()
    whole = rows(sampling.quick_sample(edges, pages, {"easy": 3, "medium": 2, "hard": 1}, attempts=150))
    monkeypatch.setattr(sampling, "QUICK_ROUND", 40)
    assert len(whole) == 6 and rows(sampling.quick_sample(edges, pages, {"easy": 3, "medium": 2, "hard": 1}, attempts=150)) == whole


def test_a_pool_is_numbered_once(spark, monkeypatch):
    """However many rounds a sample takes."""
    from linkgraph.operators import canonical

    calls, number = [], canonical.dense_index
    monkeypatch.setattr(canonical, "dense_index", lambda *args: calls.append(1) or number(*args))
    monkeypatch.setattr(sampling, "QUICK_ROUND", 10)
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    pages = spark.range(6).selectExpr("id page_id", "concat('P', id) page_title", "cast(id as int) node_idx", "1L out_degree").cache()
    assert {r["difficulty"] for r in sampling.quick_sample(edges, pages, {"hard": 1, "easy": 9}, attempts=30).collect()} == {"easy"}
    assert len(calls) == 1
    sampling.sample_bucket(edges, pages, 2, {9}, 5, 1, edges.where("src < 0"), per_round=400)
    assert len(calls) == 2
