import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from linkgraph.operators import sessions


def brute(actions, limit, most_invalid=3):
    clicks = bad = 0
    for a in actions:
        if a == "invalid":
            bad += 1
            if bad >= most_invalid:
                return clicks, bad, "invalid_action_limit"
        else:
            clicks += 1
            if a == "target":
                return clicks, bad, "success"
            if clicks >= limit:
                return clicks, bad, "step_limit"
    return clicks, bad, None


def test_replay_outcomes(spark):
    r = random.Random(3)
    logs = {s: [r.choice(["click", "click", "invalid", "target"][: r.choice([3, 4])]) for _ in range(r.randrange(1, 9))] for s in range(80)}
    logs[200] = ["click", "click", "target"]  # success exactly at the step limit
    data = [(s, i, a, 3 if s == 200 else 4) for s, log in logs.items() for i, a in enumerate(log)] + [(None, 0, "click", 4)]
    got = sessions.replay_outcomes(spark.createDataFrame(data, "session int, seq int, action string, step_limit int"))
    assert {x["session"]: (x["clicks"], x["invalid_actions"], x["terminated_reason"]) for x in got.collect()} == {s: brute(log, 3 if s == 200 else 4) for s, log in logs.items()}


def test_idle(spark):
    t = datetime(2025, 1, 1)
    data = [("a", 1, t), ("a", 2, t + timedelta(minutes=30)), ("a", 3, t + timedelta(minutes=60, seconds=1)), ("b", 1, t)]
    got = sessions.idle_sessions(spark.createDataFrame(data, "session string, seq int, ts timestamp"))
    assert rows(got.select("session", "seq", "visit")) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0)]


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(1)
    legal = {(p, f"T{q}"): q for p in range(12) for q in r.sample(range(12), 4) if p != q}
    episodes = [(f"e{i}", i % 12, (i * 5 + 3) % 12, 5, f"T{(i * 5 + 3) % 12}") for i in range(15)]
    return legal, episodes, spark.createDataFrame([(p, t, q) for (p, t), q in legal.items()], "page_id bigint, title string, dst bigint"), spark.createDataFrame(episodes, "episode_id string, start_page_id bigint, target_page_id bigint, step_limit int, target_title string")


def test_replay_clicks(spark, world):
    legal, episodes, legal_df, episode_df = world
    r = random.Random(2)
    log = {e[0]: [f" t{r.randrange(12)}" for _ in range(12)] for e in episodes}
    want = {}
    for e, start, target, limit, _ in episodes:
        at, path, clicks, bad, reason = start, [start], 0, 0, None
        for t in log[e]:
            if reason:
                break
            to = legal.get((at, t.strip().upper()))
            if to is None:
                bad += 1
                reason = "invalid_action_limit" if bad >= 3 else None
            else:
                at, clicks = to, clicks + 1
                path.append(to)
                reason = "success" if to == target else "step_limit" if clicks >= limit else None
        want[e] = (at, path, clicks, bad, reason)
    log_df = spark.createDataFrame([(e, i + 1, t) for e, ts in log.items() for i, t in enumerate(ts)], "episode_id string, seq int, title string")
    got = {x["episode_id"]: (x["current_page_id"], x["path"], x["clicks"], x["invalid_actions"], x["terminated_reason"]) for x in sessions.replay_clicks(episode_df, log_df, legal_df).collect()}
    assert got == want


def test_greedy_and_score(spark, world):
    legal, episodes, legal_df, episode_df = world
    links = legal_df.withColumn("place", F.col("dst").cast("int"))
    state = sessions.run_greedy(episode_df, links).cache()
    got = {x["episode_id"]: (x["current_page_id"], x["clicks"], x["terminated_reason"]) for x in state.collect()}
    for e, start, target, limit, title in episodes:
        at, clicks, reason = start, 0, None
        while reason is None:
            options = sorted((q, t) for (p, t), q in legal.items() if p == at)
            pick = next((q for q, t in options if t == title), options[0][0])
            at, clicks = pick, clicks + 1
            reason = "success" if at == target else "step_limit" if clicks >= limit else None
        assert got[e] == (at, clicks, reason)
    with_length = episode_df.withColumn("shortest_path_len", F.lit(2))
    distances = spark.createDataFrame([(s, t, 1) for _, s, t, _, _ in episodes[:3]], "start_page_id bigint, target_page_id bigint, dist int").distinct()
    titles = spark.range(11).selectExpr("id page_id", "concat('T', id) page_title")
    score = {x["episode_id"]: x for x in sessions.score(state, with_length, distances, titles).collect()}
    for e, (at, clicks, reason) in got.items():
        s = score[e]
        target = next(x[2] for x in episodes if x[0] == e)
        assert s["success"] == (at == target) and s["optimality_gap"] == (clicks - s["shortest_path_len"] if s["success"] else None)
        assert len(s["path"]) == clicks + 1 and ("?11" in s["path"]) == (11 in next(r["path"] for r in state.collect() if r["episode_id"] == e))
    assert sum(s["shortest_path_len"] == 1 for s in score.values()) >= 3


def test_score_of_the_small_path(spark):
    titles = spark.createDataFrame([(1, "A"), (3, "C"), (4, "D"), (5, "E")], "page_id bigint, page_title string")
    state = spark.createDataFrame([("x", 5, 5, [1, 3, 4, 5], 3, 0, "success")], "episode_id string, current_page_id bigint, target_page_id bigint, path array<bigint>, clicks int, invalid_actions int, terminated_reason string")
    episode = spark.createDataFrame([("x", 1, 3)], "episode_id string, start_page_id bigint, shortest_path_len int")
    none = spark.createDataFrame([], "start_page_id bigint, target_page_id bigint, dist int")
    got = sessions.score(state, episode, none, titles).first()
    assert (got["success"], got["clicks"], got["shortest_path_len"], got["optimality_gap"], got["path"]) == (True, 3, 3, 0, ["A", "C", "D", "E"])


def trace_metrics(spark, traces):
    return sessions.metrics(spark.createDataFrame(traces, "error string, scored boolean, success boolean, clicks int, optimality_gap int")).first()


@pytest.mark.parametrize("wins, median", [([3, 5], 5), ([4, 1, 9], 4), ([7], 7), ([2, 2, 3, 3], 3)])
def test_metrics(spark, wins, median):
    traces = [(None, True, True, c, c - 1) for c in wins] + [(None, True, False, 12, None), ("lost", False, None, None, None)]
    m = trace_metrics(spark, traces)
    assert (m["n_total"], m["n_errors"], m["n_scored"], m["n_success"], m["n_failure"]) == (len(wins) + 2, 1, len(wins) + 1, len(wins), 1)
    assert m["median_clicks_success"] == median and m["avg_clicks_success"] == pytest.approx(sum(wins) / len(wins))
    assert m["avg_clicks_all"] == pytest.approx((sum(wins) + 12) / (len(wins) + 1)) and m["avg_optimality_gap"] == pytest.approx(sum(wins) / len(wins) - 1)


def test_metrics_without_success_or_score(spark):
    m = trace_metrics(spark, [(None, True, False, 4, None)])
    assert (m["n_success"], m["avg_clicks_success"], m["avg_optimality_gap"], m["median_clicks_success"], m["success_rate"]) == (0, 0.0, None, None, 0.0)
    m = trace_metrics(spark, [("e", False, None, None, None)])
    assert (m["n_total"], m["n_errors"], m["n_scored"], m["n_success"], m["success_rate"]) == (1, 1, 0, None, None)


def test_heuristic(spark):
    data = [(1, 0, "River_bank", "old river town"), (1, 1, "Old_River", "old river town"), (1, 2, "Town_old", "old river town"), (2, 0, "X", "t"), (2, 1, "T", "t"), (3, 0, "P", "q"), (3, 1, "R", "q")]
    got = sessions.heuristic_pick(spark.createDataFrame(data, "id int, place int, title string, target string"))
    assert rows(got) == [(1, "Old_River"), (2, "T"), (3, "P")]
