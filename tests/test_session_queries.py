from datetime import datetime

import pytest
from conftest import rows

from linkgraph.plans import session_queries as Q
from linkgraph.plans.session import saved

T = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Pages P1 to P20: the graph is the chain P1 > P2 > P3 > P4, and each page shows links to all others in order."""
    d = str(tmp_path_factory.mktemp("world"))
    tables = {
        "page": ([(i, 0, f"P{i}", 0, 1, T, None) for i in range(1, 21)], "page_id long, page_ns int, page_title string, is_redirect int, page_len long, loaded_at timestamp, deleted_at timestamp"),
        "linktarget": ([(i, 0, f"P{i}", T, None) for i in range(1, 21)], "lt_id long, lt_ns int, lt_title string, loaded_at timestamp, deleted_at timestamp"),
        "redirect_raw": ([], "rd_from long, rd_ns int, rd_title string, loaded_at timestamp"),
        "pagelinks_raw": ([(i, i + 1, T) for i in (1, 2, 3)], "pl_from long, pl_target_id long, loaded_at timestamp"),
        "page_links": ([(i, f"P{j}", j) for i in range(1, 21) for j in range(1, 21) if i != j], "page_id long, link_title string, ordinal int"),
        "episode": (
            [("e1", "s", 1, 1, 3, "P1", "P3", None, "easy", 12), ("e2", "s", 3, 1, 4, "P1", "P4", -1, "easy", 12), ("e3", "s", 1, 3, 1, "P3", "P1", 5, "easy", 12), ("e4", "s", 2, 1, 99, "P1", "?", 9, "easy", 12), ("e5", "s", 1, 1, 2, "P1", "P2", 4, "easy", None)],
            "episode_id string, split string, seed int, start_page_id long, target_page_id long, start_title string, target_title string, shortest_path_len int, difficulty string, step_limit int",
        ),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_scores_by_exact_distance(spark, world):
    """The sampled length counts only where no path or no page is: e3, e4."""
    got = Q.episode_scores(spark, world).select("episode_id", "success", "clicks", "shortest_path_len", "optimality_gap")
    assert rows(got) == [("e1", True, 1, 2, -1), ("e2", True, 0, 3, -3), ("e3", True, 6, 5, 1), ("e4", False, 12, 9, None), ("e5", True, 5, 1, 4)]
    assert Q.eval_metrics(spark, world).first()["avg_optimality_gap"] == 0.25


def test_click_replay_of_all_links(spark, world):
    """The eleventh link and those after it are clicked as well: e4 ends by its step limit of 12."""
    got = {r[0]: tuple(r[1:]) for r in rows(Q.click_replay(spark, world))}
    assert got["e4"] == (13, 12, 0, "step_limit") and got["e1"] == (3, 2, 0, "success") and got["e5"] == (2, 1, 0, "success")


def test_large_tables_are_kept_as_files(spark, world):
    """The graph and the episodes are read by columns from compressed files, once made; an empty table as well."""
    edges, nodes = Q.tables.edges(spark, world)
    assert edges.inputFiles() and nodes.inputFiles() and rows(edges) == [(0, 1), (1, 2), (2, 3)]
    assert rows(nodes.where("page_id < 3")) == [(1, "P1", 0), (2, "P2", 1)]
    kept = Q._saved_episodes(spark, world)
    assert kept.inputFiles() and rows(kept) == rows(Q._episodes(spark, world)) and Q._saved_episodes(spark, world) is kept
    none = saved(edges.where("src < 0"), "none")
    assert none.count() == 0 and none.dtypes == edges.dtypes


def test_metrics_make_nothing_again(spark, world, monkeypatch):
    """After the scores the metrics need neither the canonical pages nor the episodes anew."""
    want = rows(Q.eval_metrics(spark, world))
    monkeypatch.setattr(Q.tables, "canonical", None)
    monkeypatch.setattr(Q, "_episodes", None)
    assert rows(Q.eval_metrics(spark, world)) == want and want[0][:5] == (5, 1, 4, 4, 0)
