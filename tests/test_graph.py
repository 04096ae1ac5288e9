import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.operators import canonical, graph, sampling, sessions

PAGE = "page_id bigint, page_ns int, page_title string, is_redirect int, page_len bigint"


@pytest.fixture(scope="module")
def small(spark):
    """Seven pages: A to E articles, F a redirect to A, G a disambiguation."""
    page = spark.createDataFrame([(1, 0, "A", 0, 100), (2, 0, "B", 0, 200), (3, 0, "C", 0, 150), (4, 0, "D", 0, 300), (5, 0, "E", 0, 250), (6, 0, "F", 1, 50), (7, 0, "G", 0, 100)], PAGE)
    redirect = spark.createDataFrame([(6, 0, "A")], "rd_from bigint, rd_ns int, rd_title string")
    props = spark.createDataFrame([(7, "disambiguation", "")], "pp_page bigint, pp_propname string, pp_value string")
    targets = spark.createDataFrame([(101, 0, "B"), (102, 0, "C"), (103, 0, "D"), (104, 0, "E"), (105, 0, "A"), (106, 0, "F"), (107, 0, "G")], "lt_id bigint, lt_ns int, lt_title string")
    links = spark.createDataFrame([(1, 101), (1, 102), (2, 102), (2, 103), (3, 103), (4, 104), (1, 106), (1, 107), (1, 101), (None, 101), (9, 101)], "pl_from bigint, pl_target_id bigint")
    nodes = canonical.canonical_pages(page, props).cache()
    ends = canonical.redirect_map(redirect, page)
    edges = graph.link_edges(links, targets, canonical.title_index(page), ends, nodes).cache()
    return page, nodes, ends, edges


def test_small_graph(small):
    _, nodes, ends, edges = small
    assert rows(nodes.select("page_title", "node_idx")) == [("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4)]
    assert rows(ends) == [(1, 1), (6, 1)]
    assert rows(edges) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)]
    assert rows(graph.degrees(nodes, edges)) == [(0, 2, 0), (1, 2, 1), (2, 1, 2), (3, 1, 2), (4, 0, 1)]
    assert rows(graph.csr_offsets(nodes, edges)) == [(0, 0, 2), (1, 2, 4), (2, 4, 5), (3, 5, 6), (4, 6, 6)]


def test_distances_and_search(small, spark):
    _, _, _, edges = small
    pairs = spark.createDataFrame([(0, 4), (0, 1), (4, 0), (2, 2), (None, 1)], "src int, dst int")
    assert rows(graph.shortest_paths(edges, pairs)) == [(0, 1, 1), (0, 4, 3), (2, 2, 0), (4, 0, None)]
    assert rows(graph.shortest_paths(edges, pairs, 2)) == [(0, 1, 1), (0, 4, None), (2, 2, 0), (4, 0, None)]
    start = spark.createDataFrame([(0,), (0,), (None,)], "src int")
    assert rows(graph.bounded_bfs(edges, start, 2)) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (0, 3, 2)]
    end = spark.createDataFrame([(3,)], "src int")
    assert rows(graph.bounded_bfs(edges, end, 9, "bwd")) == [(3, 0, 2), (3, 1, 1), (3, 2, 1), (3, 3, 0)]
    assert rows(graph.neighbors(edges, end.withColumnRenamed("src", "node_idx"), "bwd")) == [(3, 1), (3, 2)]


def test_adjacency_in_blocks(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 10)] + [(1, 0)], "src int, dst int")
    got = rows(graph.adjacency(edges, block=4))
    assert got == [(0, 0, [1, 2, 3, 4]), (0, 1, [5, 6, 7, 8]), (0, 2, [9]), (1, 0, [0])]


def test_save_and_load(small, spark, tmp_path):
    _, nodes, _, edges = small
    graph.save_graph(edges, nodes.select("node_idx"), str(tmp_path / "g"))
    e, n = graph.load_graph(spark, str(tmp_path / "g"))
    assert e.count() == 6 and n.count() == 5


def naive_ends(redirects, titles):
    told = {}
    for start in redirects:
        seen, cur = set(), start
        while cur is not None and cur in redirects and cur not in seen:
            seen.add(cur)
            ns, title = redirects[cur]
            cur = titles.get(title) if ns == 0 else None
        told[start] = None if cur is None or cur in seen else cur
    return told | {v: v for v in told.values() if v is not None}


@pytest.mark.parametrize("seed", range(4))
def test_redirects_against_naive_walk(spark, seed):
    r = random.Random(seed)
    n = 60
    page = [(i, 0, f"T{i}", 0, 0) for i in range(n)]
    redirects = {i: (0 if r.random() < 0.95 else 4, f"T{r.randrange(n + 3)}") for i in r.sample(range(n), 45)}
    redirects |= {50: (0, "T50"), 51: (0, "T52"), 52: (0, "T53"), 53: (0, "T51")}
    got = canonical.redirect_map(spark.createDataFrame([(k, *v) for k, v in redirects.items()], "rd_from bigint, rd_ns int, rd_title string"), spark.createDataFrame(page, PAGE))
    assert dict(rows(got)) == naive_ends(redirects, {p[2]: p[0] for p in page})


def test_long_redirect_chain(spark):
    n = 300
    page = spark.range(n).selectExpr("id page_id", "0 page_ns", "concat('T', id) page_title", "0 is_redirect", "0 page_len")
    chain = spark.range(n - 1).selectExpr("id rd_from", "0 rd_ns", "concat('T', id + 1) rd_title")
    assert set(dict(rows(canonical.redirect_map(chain, page))).values()) == {n - 1}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=45))
def test_distances_against_naive_search(spark, links):
    links = {(a, b) for a, b in links if a != b} or {(0, 1)}
    def dist(a):
        seen, level = {a: 0}, [a]
        while level:
            level = [y for x in level for (p, y) in links if p == x and y not in seen and not seen.update({y: seen[x] + 1})]
        return seen
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    pairs = [(a, b) for a in range(0, 15, 3) for b in range(0, 15, 2)]
    got = {(a, b): d for a, b, d in rows(graph.shortest_paths(edges, spark.createDataFrame(pairs, "src int, dst int"), 6))}
    assert got == {(a, b): d if (d := dist(a).get(b)) is not None and d <= 6 else None for a, b in pairs}


def jobs(spark, run):
    """How many Spark jobs run starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    try:
        before = len(sc.statusTracker().getJobIdsForGroup("counted"))
        run()
        return len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_long_paths(spark):
    """Distances take as many jobs in a long chain as in a short one."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int").cache()
    few, many = (spark.createDataFrame([(0, n), (n, 0), (5, 5), (n, n + 1)], "src int, dst int") for n in (2, 28))
    graph.shortest_paths(edges, few).collect()
    told = []
    counts = [jobs(spark, lambda p=p: told.append(rows(graph.shortest_paths(edges, p)))) for p in (few, many)]
    assert told == [[(0, 2, 2), (2, 0, None), (2, 3, 1), (5, 5, 0)], [(0, 28, 28), (28, 0, None), (28, 29, 1), (5, 5, 0)]]
    assert counts[1] == counts[0] < 15


@pytest.mark.parametrize("kind, move", [("int", 0), ("long", 0), ("long", 2**40), ("int", 2**30), ("int", -100)])
def test_distances_in_tasks_and_by_joins(spark, monkeypatch, kind, move):
    """Both ways give the same, for any ids, repeated links, links without an end, and tasks without pairs."""
    r = random.Random(11)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(110)] + [(0, i) for i in range(40)]
    edges = spark.createDataFrame([(a + move, b + move) for a, b in links + links[:9]] + [(None, move)], f"src {kind}, dst {kind}")
    pairs = spark.createDataFrame([(r.randrange(84) + move, r.randrange(84) + move) for _ in range(120)], f"src {kind}, dst {kind}")
    monkeypatch.setattr(graph, "TASK_PAIRS", 40)
    got = graph.shortest_paths(edges, pairs, 5)
    fast, few = rows(got), rows(graph.shortest_paths(edges, pairs.limit(1), 5))
    assert got.dtypes == [("src", pairs.dtypes[0][1]), ("dst", pairs.dtypes[0][1]), ("dist", "int")] and few[0] in fast
    assert graph.shortest_paths(edges, pairs.where(F.lit(False))).count() == 0
    monkeypatch.setattr(graph, "TASK_LINKS", -1)
    assert fast == rows(graph.shortest_paths(edges, pairs, 5)) and len({x[2] for x in fast}) > 4


def test_walks(spark):
    r = random.Random(5)
    links = {(a, b) for a in range(40) for b in r.sample(range(40), 5) if a != b}
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    starts = spark.createDataFrame([(i, i % 40) for i in range(60)], "walk_id bigint, src int")
    walks = graph.random_walks(edges, starts, 4, 7).collect()
    assert len(walks) == 60
    for w in walks:
        assert len(set(w["path"])) == len(w["path"]) and all(p in links for p in zip(w["path"], w["path"][1:], strict=False))
        assert w["end"] is None or len(w["path"]) == 5
    assert {w["walk_id"]: w["end"] for w in graph.random_walks(edges.repartition(3), starts, 4, 7).collect()} == {w["walk_id"]: w["end"] for w in walks}
    few = graph.random_walks(edges, starts, 3, 7, max_out_degree=0)
    assert all(x is None or x in {b for _, b in links} - {a for a, _ in links} for x in [w["end"] for w in few.collect()])


def test_sampling(spark):
    r = random.Random(9)
    n = 120
    links = {(i, (i + 1) % n) for i in range(n)} | {(i, r.randrange(n)) for i in range(n)}
    edges = spark.createDataFrame(sorted((a, b) for a, b in links if a != b), "src int, dst int")
    nodes = spark.range(n).selectExpr("id + 1000 page_id", "concat('P', id) page_title", "cast(id as int) node_idx")
    pages = nodes.join(graph.degrees(nodes, edges).select("node_idx", "out_degree"), "node_idx").cache()
    got = sampling.sample_episodes(edges, pages, n_total=10, n_hard_bonus=1, seed=1).collect()
    bench = [e for e in got if e["split"] == "benchmark"]
    assert sorted(e["seed"] for e in bench) == list(range(10))
    assert sorted(e["shortest_path_len"] for e in bench)[-6:] == [5] * 6 and all(e["shortest_path_len"] in (3, 4) for e in bench if e["difficulty"] == "easy")
    assert len({(e["start_page_id"], e["target_page_id"]) for e in got}) == len(got)
    hard = [e for e in got if e["split"] == "hard_bonus"]
    assert all(e["shortest_path_len"] in (6, 7) and e["step_limit"] == max(3 * e["shortest_path_len"] + 4, 20) for e in hard)
    pairs = spark.createDataFrame([(e["start_page_id"] - 1000, e["target_page_id"] - 1000) for e in got], "src int, dst int")
    exact = {(a, b): d for a, b, d in rows(graph.shortest_paths(edges, pairs))}
    assert all(exact[e["start_page_id"] - 1000, e["target_page_id"] - 1000] == e["shortest_path_len"] for e in got)
    with pytest.raises(ValueError):
        sampling.sample_episodes(edges, pages, max_depth=5)
    with pytest.raises(ValueError):
        sampling.sample_episodes(edges, pages.where(F.lit(False)))
    quick = sampling.quick_sample(edges, pages, {"easy": 3, "medium": 2, "hard": 1}, attempts=80).collect()
    assert sorted(e["difficulty"] for e in quick) == ["easy"] * 3 + ["hard"] + ["medium"] * 2


def test_ids_and_rules(spark):
    import uuid

    df = spark.createDataFrame([("test", 1, 2, 3), ("dev", 10**9, 7, 0)], "split string, a bigint, b bigint, seed int")
    got = df.select(sampling.episode_id(F.col("split"), F.col("a"), F.col("b"), F.col("seed"), "x")).collect()
    assert [r[0] for r in got] == [uuid.uuid5(uuid.NAMESPACE_DNS, f"x.{s}.{a}.{b}.{k}").hex for s, a, b, k in [("test", 1, 2, 3), ("dev", 10**9, 7, 0)]]
    assert sampling.bucket_targets(100) == {"easy": 40, "medium": 60} and sampling.bucket_targets(5) == {"easy": 2, "medium": 3}
    d = spark.createDataFrame([(3,), (4,), (5,), (6,)], "d int")
    c = F.col("d")
    assert rows(d.select("d", sessions.difficulty(c), sessions.step_limit(c), sessions.bonus_step_limit(c))) == [(3, "easy", 12, 20), (4, "easy", 12, 20), (5, "medium", 14, 20), (6, "hard", 16, 22)]


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src int, dst int")
    pairs = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert rows(graph.shortest_paths(edges, pairs)) == [(1, 2, None)]
    assert graph.adjacency(edges).count() == 0
    none = spark.createDataFrame([], PAGE)
    assert canonical.redirect_map(spark.createDataFrame([], "rd_from bigint, rd_ns int, rd_title string"), none).count() == 0
