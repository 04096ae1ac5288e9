"""Queries over sessions, scores and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgraph.operators import sampling, sessions
from linkgraph.plans import tables
from linkgraph.plans.graph_queries import DISTANCES, shortest_paths
from linkgraph.plans.session import once, saved, scratch, table
from linkgraph.plans.tables import BASE
from linkgraph.plans.text_queries import LEGAL, TITLE, _legal
from linkgraph.sources.episodes import difficulty_counts, read_episodes, write_episodes
from linkgraph.streaming.sessions import final_table, stream_counts, stream_visits

#: Limits of the sessions that the events stand for.
STEP_LIMIT, IDLE = 2, 30 * 60


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions of one session a user: a click, an error for an invalid one, a purchase for the target."""
    action = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "purchase", "target")
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), "ts", action.alias("action"), F.lit(STEP_LIMIT).alias("step_limit"))


def session_replay(spark: SparkSession, d: str) -> DataFrame:
    return sessions.replay_outcomes(_log(spark, d))


def idle_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each user and how many events they hold."""
    return sessions.idle_sessions(_log(spark, d), IDLE).groupBy("session", "visit").agg(F.count("*").alias("n"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per episode id, the least."""
    rows = table(spark, d, "episode").where("episode_id is not null")
    return rows.groupBy("episode_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "episode_id"])).alias("r")).select("episode_id", "r.*")


def _saved_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The same, made once a session for the same file."""
    return once(spark, [f"{d}/episode.parquet"], "episodes", lambda: saved(_episodes(spark, d), "episodes"))


def _states(episodes: DataFrame) -> DataFrame:
    """Final states made up from the episodes: odd seeds reach the target after one click more than the
    sampled length, even ones end at the start."""
    won = F.col("seed") % 2 == 1
    return episodes.select(
        "episode_id", "target_page_id", F.when(won, F.col("target_page_id")).otherwise(F.col("start_page_id")).alias("current_page_id"),
        F.when(won, F.array("start_page_id", "target_page_id")).otherwise(F.array("start_page_id")).alias("path"), F.when(won, F.coalesce("shortest_path_len", F.lit(0)) + 1).otherwise(F.col("step_limit")).alias("clicks"),
        F.lit(0).alias("invalid_actions"), F.when(won, "success").when(F.col("seed") % 4 == 0, "step_limit").alias("terminated_reason"),
    )


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The exact distance counts; where there is none, the sampled length."""
    episodes = _saved_episodes(spark, d)
    nodes = tables.edges(spark, d)[1]
    key = nodes.select("page_id", "node_idx")
    dist = shortest_paths(spark, d).join(key.toDF("start_page_id", "src"), "src").join(key.toDF("target_page_id", "dst"), "dst")
    return sessions.score(_states(episodes), episodes, dist.select("start_page_id", "target_page_id", "dist"), nodes)


def episode_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("path", F.array_join("path", " > "))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all episodes; those whose start or target is no canonical page are errors and not scored."""
    pages = tables.edges(spark, d)[1].select("page_id")
    known = _saved_episodes(spark, d).join(pages.toDF("start_page_id"), "start_page_id", "left_semi").join(pages.toDF("target_page_id"), "target_page_id", "left_semi")
    scored = _scores(spark, d).join(known.select("episode_id", F.lit(True).alias("known")), "episode_id", "left").withColumn("scored", F.coalesce("known", F.lit(False)))
    traces = scored.select(F.when(~F.col("scored"), "no such page").alias("error"), "scored", "success", "clicks", "optimality_gap")
    return sessions.metrics(traces).select(*(F.round(c, 6).alias(c) if "avg" in c or "rate" in c else F.col(c) for c in ("n_total", "n_errors", "n_scored", "n_success", "n_failure", "success_rate", "avg_clicks_all", "avg_clicks_success", "avg_optimality_gap", "median_clicks_success")))


def difficulty_histogram(spark: SparkSession, d: str) -> DataFrame:
    return difficulty_counts(table(spark, d, "episode"))


def difficulty_rules(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty and step limits by the rules, for each episode."""
    n = F.col("shortest_path_len")
    return table(spark, d, "episode").select("episode_id", n, sessions.difficulty(n).alias("bucket"), sessions.step_limit(n).alias("limit_by_rule"), sessions.bonus_step_limit(n).alias("bonus_limit"))


def derived_episode_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episode").select("episode_id", sampling.episode_id(F.col("split"), F.col("start_page_id"), F.col("target_page_id"), F.col("seed")).alias("derived_id"))


def click_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every episode as a player who clicks all links of its start page in order."""
    episodes = _episodes(spark, d)
    links = table(spark, d, "page_links").where("link_title is not null").groupBy(F.col("page_id").alias("start_page_id")).agg(F.array_sort(F.collect_set(F.struct("ordinal", "link_title"))).alias("l"))
    log = episodes.join(links, "start_page_id").select("episode_id", F.posexplode("l.link_title").alias("i", "title")).select("episode_id", (F.col("i") + 1).alias("seq"), "title")
    return sessions.replay_clicks(episodes, log, _legal(spark, d)).select("episode_id", "current_page_id", "clicks", "invalid_actions", "terminated_reason")


def greedy_run(spark: SparkSession, d: str) -> DataFrame:
    """Every episode played by the heuristic, and how far it came."""
    legal = _legal(spark, d)
    places = table(spark, d, "page_links").groupBy("page_id", F.col("link_title").alias("title")).agg(F.min("ordinal").alias("place"))
    state = sessions.run_greedy(_episodes(spark, d), legal.join(places, ["page_id", "title"]))
    return state.select("episode_id", "current_page_id", "clicks", "terminated_reason", "stuck")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream and counted per hour and kind of action."""
    stream = stream_counts(_event_stream(spark, d).select("ts", F.col("event_type").alias("action")))
    return final_table(stream, scratch(spark, "counts")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "action", "n")


def stream_visit_counts(spark: SparkSession, d: str) -> DataFrame:
    """The visits of each user, read as a stream: first and last event and how many there are."""
    stream = stream_visits(_event_stream(spark, d).select("ts", F.col("user_id").alias("session")))
    return final_table(stream, scratch(spark, "visits")).select("session", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


def episode_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Episodes written as JSON lines and read back."""
    path = scratch(spark, "episodes")
    write_episodes(_episodes(spark, d), path)
    return read_episodes(spark, path)


def bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes wanted of each bucket, for totals from 0 to 500."""
    return spark.createDataFrame([(n, *sampling.bucket_targets(n).values()) for n in range(501)], "n_total int, easy int, medium int")


def first_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes in the order of their seeds: place of each in its split."""
    place = F.row_number().over(Window.partitionBy("split").orderBy("seed", "episode_id"))
    return _episodes(spark, d).where("seed is not null and split is not null").select("split", "seed", "episode_id", place.alias("place"))


QUERIES = {f.__name__: f for f in (session_replay, idle_expiry, episode_scores, eval_metrics, difficulty_histogram, difficulty_rules, derived_episode_ids, click_replay, greedy_run, stream_hourly_counts, stream_visit_counts, episode_file_roundtrip, bucket_sizes, first_episodes)}


def _words(title: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(replace({title}, '_', ' ')), '[\\s\\p{{Z}}]+'), lambda w: w <> ''))"


_LOG = "log AS (SELECT user_id AS session, ts, event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'invalid' WHEN 'purchase' THEN 'target' END AS action FROM events)"
_EPISODES = """eps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY split NULLS FIRST, seed NULLS FIRST, start_page_id NULLS FIRST, target_page_id NULLS FIRST,
    start_title NULLS FIRST, target_title NULLS FIRST, shortest_path_len NULLS FIRST, difficulty NULLS FIRST, step_limit NULLS FIRST) AS rn FROM episode) WHERE rn = 1)"""
_SCORES = f"""{DISTANCES}, scored AS (SELECT episode_id, (seed % 2 = 1) OR start_page_id = target_page_id AS success, CASE WHEN seed % 2 = 1 THEN coalesce(shortest_path_len, 0) + 1 ELSE step_limit END AS clicks,
    coalesce(x.page_title, '?' || start_page_id) || CASE WHEN seed % 2 = 1 THEN ' > ' || coalesce(y.page_title, '?' || target_page_id) ELSE '' END AS path, coalesce(dist, shortest_path_len) AS shortest_path_len, 0 AS invalid_actions, x.page_id IS NOT NULL AND y.page_id IS NOT NULL AS known,
    CASE WHEN seed % 2 = 1 THEN 'success' WHEN seed % 4 = 0 THEN 'step_limit' ELSE 'unknown' END AS terminated_reason
    FROM eps LEFT JOIN canon x ON x.page_id = start_page_id LEFT JOIN canon y ON y.page_id = target_page_id LEFT JOIN dists ON dists.src = x.node_idx AND dists.dst = y.node_idx),
  scores AS (SELECT *, CASE WHEN success THEN clicks - shortest_path_len END AS optimality_gap FROM scored)"""
ORACLE = {
    "session_replay": f"""WITH {_LOG}, a AS (SELECT *, sum(CASE WHEN action IN ('click', 'target') THEN 1 ELSE 0 END) OVER w AS clicks, sum(CASE WHEN action = 'invalid' THEN 1 ELSE 0 END) OVER w AS bad, row_number() OVER w AS i
          FROM log WHERE action IS NOT NULL AND session IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, CASE WHEN action = 'target' THEN 'success' WHEN action = 'click' AND clicks >= {STEP_LIMIT} THEN 'step_limit' WHEN action = 'invalid' AND bad >= 3 THEN 'invalid_action_limit' END AS reason FROM a),
        c AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN i END) OVER (PARTITION BY session) AS e FROM b)
        SELECT session, CAST(max(clicks) AS INTEGER) AS clicks, CAST(max(bad) AS INTEGER) AS invalid_actions, max(reason) AS terminated_reason, max(reason) IS NOT NULL AS terminated FROM c WHERE e IS NULL OR i <= e GROUP BY session""",
    "idle_expiry": f"""WITH {_LOG}, a AS (SELECT session, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id)) > {IDLE} * 1000000 THEN 1 ELSE 0 END AS brk FROM log),
        b AS (SELECT session, CAST(sum(brk) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM a) SELECT session, visit, count(*) AS n FROM b GROUP BY 1, 2""",
    "episode_scores": f"{BASE}, {_EPISODES}, {_SCORES} SELECT episode_id, success, clicks, path, shortest_path_len, optimality_gap, invalid_actions, terminated_reason FROM scores",
    "eval_metrics": f"""{BASE}, {_EPISODES}, {_SCORES} SELECT count(*) AS n_total, count(*) FILTER (WHERE NOT known) AS n_errors, count(*) FILTER (WHERE known) AS n_scored, count(*) FILTER (WHERE known AND success) AS n_success, count(*) FILTER (WHERE known AND NOT success) AS n_failure,
        round(avg(success::INT) FILTER (WHERE known), 6) AS success_rate, round(avg(clicks) FILTER (WHERE known), 6) AS avg_clicks_all, round(avg(clicks) FILTER (WHERE known AND success), 6) AS avg_clicks_success,
        round(avg(optimality_gap) FILTER (WHERE known), 6) AS avg_optimality_gap, list_sort(list(clicks) FILTER (WHERE known AND success))[(count(*) FILTER (WHERE known AND success)) // 2 + 1] AS median_clicks_success FROM scores""",
    "derived_episode_ids": """WITH h AS (SELECT episode_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('linkgraph.' || split || '.' || start_page_id || '.' || target_page_id || '.' || seed)) AS x FROM episode)
        SELECT episode_id, x[1:12] || '5' || x[14:16] || substr('89ab', 1 + (strpos('0123456789abcdef', x[17]) - 1) % 4, 1) || x[18:32] AS derived_id FROM h""",
    "difficulty_histogram": "SELECT difficulty, count(*) AS n_episodes FROM episode GROUP BY 1",
    "difficulty_rules": """SELECT episode_id, shortest_path_len, CASE WHEN shortest_path_len <= 4 THEN 'easy' WHEN shortest_path_len = 5 THEN 'medium' ELSE 'hard' END AS bucket,
        greatest(2 * shortest_path_len + 4, 12) AS limit_by_rule, greatest(3 * shortest_path_len + 4, 20) AS bonus_limit FROM episode""",
    "stream_hourly_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_visit_counts": """WITH a AS (SELECT user_id AS session, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS brk FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM a) SELECT session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM b GROUP BY session, visit""",
    "episode_file_roundtrip": f"WITH {_EPISODES} SELECT * EXCLUDE (rn) FROM eps",
    "bucket_sizes": "SELECT CAST(n AS INTEGER) AS n_total, CAST(round_even(n * 0.4, 0) AS INTEGER) AS easy, CAST(n - round_even(n * 0.4, 0) AS INTEGER) AS medium FROM range(501) t(n)",
    "first_episodes": f"WITH {_EPISODES} SELECT split, seed, episode_id, CAST(row_number() OVER (PARTITION BY split ORDER BY seed, episode_id) AS INTEGER) AS place FROM eps WHERE seed IS NOT NULL AND split IS NOT NULL",
    "click_replay": f"""{BASE}, {LEGAL}, {_EPISODES}, clicked AS (SELECT DISTINCT page_id, ordinal, link_title FROM page_links WHERE page_id IS NOT NULL AND link_title IS NOT NULL),
        log AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ordinal NULLS FIRST, link_title) AS seq, {TITLE} AS title FROM clicked),
        play(episode_id, start, target, step_limit, seq, cur, clicks, bad, reason) AS (
          SELECT episode_id, start_page_id, target_page_id, step_limit, CAST(0 AS BIGINT), start_page_id, 0, 0, CAST(NULL AS VARCHAR) FROM eps WHERE episode_id IS NOT NULL
          UNION ALL SELECT p.episode_id, p.start, p.target, p.step_limit, l.seq, coalesce(g.dst, p.cur), p.clicks + CASE WHEN g.dst IS NULL THEN 0 ELSE 1 END, p.bad + CASE WHEN g.dst IS NULL THEN 1 ELSE 0 END,
            CASE WHEN g.dst = p.target THEN 'success' WHEN g.dst IS NOT NULL AND p.clicks + 1 >= p.step_limit THEN 'step_limit' WHEN g.dst IS NULL AND p.bad + 1 >= 3 THEN 'invalid_action_limit' END
          FROM play p JOIN log l ON l.page_id = p.start AND l.seq = p.seq + 1 LEFT JOIN legal g ON g.page_id = p.cur AND g.title = l.title WHERE p.reason IS NULL)
        SELECT episode_id, arg_max(cur, seq) AS current_page_id, arg_max(clicks, seq) AS clicks, arg_max(bad, seq) AS invalid_actions, arg_max(struct_pack(r := reason), seq).r AS terminated_reason FROM play GROUP BY 1""",
    "greedy_run": f"""{BASE}, {LEGAL}, {_EPISODES}, option AS (SELECT g.page_id, g.title, g.dst, -min(p.ordinal) AS first, lower(replace(g.title, '_', ' ')) AS low, {_words("g.title")} AS words
          FROM legal g JOIN page_links p ON p.page_id = g.page_id AND p.link_title = g.title GROUP BY g.page_id, g.title, g.dst),
        wish AS (SELECT *, lower(replace(target_title, '_', ' ')) AS low, {_words("target_title")} AS words FROM eps WHERE episode_id IS NOT NULL),
        play(episode_id, target, step_limit, low, words, rnd, cur, path, clicks, reason, stuck) AS (
          SELECT episode_id, target_page_id, step_limit, low, words, 0, start_page_id, [start_page_id], 0, CAST(NULL AS VARCHAR), FALSE FROM wish
          UNION ALL SELECT episode_id, target, step_limit, low, words, rnd + 1, CASE WHEN goes THEN dst ELSE cur END, CASE WHEN goes THEN list_append(path, dst) ELSE path END, clicks + CASE WHEN goes THEN 1 ELSE 0 END,
            CASE WHEN goes AND dst = target THEN 'success' WHEN goes AND clicks + 1 >= step_limit THEN 'step_limit' END, NOT goes
          FROM (SELECT *, dst IS NOT NULL AND NOT (step_limit IS NULL AND list_contains(path, dst) AND dst IS DISTINCT FROM target) AS goes FROM (
            SELECT p.episode_id, p.target, p.step_limit, p.low, p.words, p.rnd, p.cur, p.path, p.clicks,
              arg_max(o.dst, struct_pack(same := coalesce(o.low = p.low, FALSE), score := CASE WHEN len(p.words) > 0 THEN len(list_intersect(p.words, o.words)) / len(p.words) ELSE 0.0 END, first := o.first, title := o.title)) AS dst
            FROM play p LEFT JOIN option o ON o.page_id = p.cur WHERE p.reason IS NULL AND NOT p.stuck GROUP BY ALL)))
        SELECT episode_id, arg_max(cur, rnd) AS current_page_id, arg_max(clicks, rnd) AS clicks, arg_max(struct_pack(r := reason), rnd).r AS terminated_reason, arg_max(stuck, rnd) AS stuck FROM play GROUP BY 1""",
}
