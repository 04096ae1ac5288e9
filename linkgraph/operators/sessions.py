"""Navigation sessions: replay of actions, expiry, scores, metrics and a greedy agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions.wikitext import normalize_title
from linkgraph.operators.articles import path_titles
from linkgraph.plans.session import checkpointed, small_or_shuffled

INVALID_LIMIT, IDLE_SECONDS = 3, 1800


def difficulty(distance: Column) -> Column:
    return F.when(distance <= 4, "easy").when(distance == 5, "medium").otherwise("hard")


def step_limit(distance: Column) -> Column:
    return F.greatest(2 * distance + 4, F.lit(12))


def bonus_step_limit(distance: Column) -> Column:
    return F.greatest(3 * distance + 4, F.lit(20))


def replay_outcomes(log: DataFrame, invalid_limit: int = INVALID_LIMIT) -> DataFrame:
    """session, clicks, invalid_actions, terminated, terminated_reason of a log of judged actions.

    log: session, seq (unique in it), action (click, invalid or target: a click that reaches the
    target), step_limit. Actions after the end of a session don't count; reaching the target comes
    before the step limit. The window is by session, whose length its limits bound.
    """
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    move = F.col("action").isin("click", "target").cast("int")
    told = log.where("session is not null and action is not null").withColumn("clicks", F.sum(move).over(order)).withColumn("bad", F.sum((F.col("action") == "invalid").cast("int")).over(order))
    reason = F.when(F.col("action") == "target", "success").when((F.col("action") == "click") & (F.col("clicks") >= F.col("step_limit")), "step_limit").when((F.col("action") == "invalid") & (F.col("bad") >= invalid_limit), "invalid_action_limit")
    told = told.withColumn("reason", reason)
    ended = F.min(F.when(F.col("reason").isNotNull(), F.col("seq"))).over(Window.partitionBy("session"))
    live = told.withColumn("end", ended).where("end is null or seq <= end")
    return live.groupBy("session").agg(F.max("clicks").cast("int").alias("clicks"), F.max("bad").cast("int").alias("invalid_actions"), F.max("reason").alias("terminated_reason")).withColumn(
        "terminated", F.col("terminated_reason").isNotNull()
    )


def idle_sessions(log: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """log (session, seq, ts) with visit: number of the stretch of a session without a longer pause."""
    order = Window.partitionBy("session").orderBy("ts", "seq")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    return log.withColumn("visit", F.sum(F.coalesce(pause > idle_seconds * 1_000_000, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def replay_clicks(episodes: DataFrame, log: DataFrame, legal: DataFrame, invalid_limit: int = INVALID_LIMIT) -> DataFrame:
    """Final state of each episode after its clicks: current_page_id, path, clicks, invalid_actions, terminated_reason.

    episodes: episode_id, start_page_id, target_page_id, step_limit; log: episode_id, seq (1, 2, ...
    without gaps), title as typed; legal: page_id, title, dst. One round a click for all episodes at
    once: the legality of a click depends on where the one before has led.
    """
    state = checkpointed(episodes.select(
        "episode_id", "target_page_id", "step_limit", F.col("start_page_id").alias("current_page_id"), F.array("start_page_id").alias("path"),
        F.lit(0).alias("clicks"), F.lit(0).alias("invalid_actions"), F.lit(None).cast("string").alias("terminated_reason"),
    ))
    legal, log = checkpointed(legal.select("page_id", "title", "dst")), checkpointed(log)
    state = checkpointed(state.join(log.groupBy("episode_id").agg(F.max("seq").alias("last_seq")), "episode_id", "left"))
    n, seq = state.count(), 0
    while state.where(F.col("terminated_reason").isNull() & (F.col("last_seq") > seq)).take(1):
        seq += 1
        now = log.where(F.col("seq") == seq).select("episode_id", normalize_title(F.col("title")).alias("title"), F.lit(True).alias("acts"))
        told = state.join(now, "episode_id", "left").withColumn("acts", F.coalesce("acts", F.lit(False)) & F.col("terminated_reason").isNull())
        key = told.where("acts").select("episode_id", F.col("current_page_id").alias("page_id"), "title")
        hits = legal.join(small_or_shuffled(key, n), ["page_id", "title"]).select("episode_id", "dst")
        state = checkpointed(_moved(told.join(hits, "episode_id", "left"), invalid_limit, F.col("last_seq")))
    return state.drop("last_seq")


def _moved(told: DataFrame, invalid_limit: int = INVALID_LIMIT, *more: Column) -> DataFrame:
    """State after an action: acts tells whether there is one, dst where it leads (null: it is invalid)."""
    go, bad = F.col("acts") & F.col("dst").isNotNull(), F.col("acts") & F.col("dst").isNull()
    clicks, invalid = F.col("clicks") + go.cast("int"), F.col("invalid_actions") + bad.cast("int")
    reason = (
        F.when(~F.col("acts"), F.col("terminated_reason"))
        .when(go & (F.col("dst") == F.col("target_page_id")), "success")
        .when(go & (clicks >= F.col("step_limit")), "step_limit")
        .when(bad & (invalid >= invalid_limit), "invalid_action_limit")
    )
    return told.select(
        "episode_id", "target_page_id", "step_limit", F.when(go, F.col("dst")).otherwise(F.col("current_page_id")).alias("current_page_id"),
        F.when(go, F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"), clicks.alias("clicks"), invalid.alias("invalid_actions"), reason.alias("terminated_reason"), *more,
    )


def word_overlap(link: Column, target: Column) -> Column:
    """Share of the target's words that are among the link's; null-safe, 0 for a target without words."""
    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), r"(?U)\s+"), lambda w: w != ""))

    n = F.size(words(target))
    return F.when(n > 0, F.size(F.array_intersect(words(target), words(link))) / n).otherwise(0.0)


def heuristic_pick(options: DataFrame) -> DataFrame:
    """id, pick: of the links (id, place, title) to a target the one that equals it, else the one that
    shares most words with it, else the first; ties go to the first place."""
    same = F.lower(F.replace("title", F.lit("_"), F.lit(" "))) == F.lower(F.replace("target", F.lit("_"), F.lit(" ")))
    return options.groupBy("id").agg(F.max_by("title", F.struct(same.alias("same"), word_overlap(F.col("title"), F.col("target")).alias("score"), (-F.col("place")).alias("first"), "title")).alias("pick"))


def run_greedy(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Final states of episodes played by the heuristic: each round every open episode follows its pick.

    episodes as in replay_clicks, with target_title; links: page_id, place, title, dst (legal
    links in page order). An episode without links is left open (stuck). There are as many rounds as the
    largest step limit asks for; an episode without a step limit goes on while it sees a new page.
    """
    titles = checkpointed(episodes.select("episode_id", "target_title"))
    links = checkpointed(links.select("page_id", "place", "title", "dst"))
    state = checkpointed(episodes.select(
        "episode_id", "target_page_id", "step_limit", F.col("start_page_id").alias("current_page_id"), F.array("start_page_id").alias("path"),
        F.lit(0).alias("clicks"), F.lit(0).alias("invalid_actions"), F.lit(None).cast("string").alias("terminated_reason"), F.lit(False).alias("stuck"),
    ))
    while True:
        open_ = state.where("terminated_reason is null and not stuck")
        n = open_.count()
        if not n:
            break
        asked = small_or_shuffled(open_.join(titles, "episode_id").select(F.col("episode_id").alias("id"), F.col("current_page_id").alias("page_id"), F.col("target_title").alias("target")), n)
        options = links.join(asked, "page_id")
        same = F.lower(F.replace("title", F.lit("_"), F.lit(" "))) == F.lower(F.replace("target", F.lit("_"), F.lit(" ")))
        best = options.groupBy("id").agg(F.max_by("dst", F.struct(same.alias("same"), word_overlap(F.col("title"), F.col("target")).alias("score"), (-F.col("place")).alias("first"), "title")).alias("dst"))
        told = state.join(best.withColumnRenamed("id", "episode_id"), "episode_id", "left").withColumn("acts", F.col("dst").isNotNull())
        # Without a limit a reader that comes to a page again goes round for ever.
        round_ = F.col("step_limit").isNull() & F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False)) & ~F.coalesce(F.col("dst") == F.col("target_page_id"), F.lit(False))
        told = told.withColumn("acts", F.col("acts") & ~round_)
        stuck = (F.col("stuck") | (F.col("terminated_reason").isNull() & ~F.col("acts"))).alias("stuck")
        state = checkpointed(_moved(told, INVALID_LIMIT, stuck))
    return state


def score(states: DataFrame, episodes: DataFrame, distances: DataFrame, titles: DataFrame) -> DataFrame:
    """Score of each state: success, clicks, path of titles, shortest_path_len, optimality_gap, ...

    distances: start_page_id, target_page_id, dist; where it is null the sampled length counts.
    """
    s = states.join(episodes.select("episode_id", "start_page_id", F.col("shortest_path_len").alias("sampled")), "episode_id").join(distances, ["start_page_id", "target_page_id"], "left")
    named = path_titles(states.select(F.col("episode_id").alias("id"), "path"), titles).select(F.col("id").alias("episode_id"), F.col("path").alias("titles"))
    success = F.coalesce((F.col("terminated_reason") == "success"), F.lit(False)) | F.coalesce(F.col("current_page_id") == F.col("target_page_id"), F.lit(False))
    length = F.coalesce("dist", "sampled")
    return s.join(named, "episode_id").select(
        "episode_id", success.alias("success"), "clicks", F.col("titles").alias("path"), length.alias("shortest_path_len"),
        F.when(success, F.col("clicks") - length).alias("optimality_gap"), "invalid_actions", F.coalesce("terminated_reason", F.lit("unknown")).alias("terminated_reason"),
    )


def metrics(traces: DataFrame) -> DataFrame:
    """One row of aggregate metrics of traces (error STRING, scored BOOLEAN, success, clicks, optimality_gap).

    The median of the clicks of successes is the upper one. Counts of clicks are few, so the
    median is taken from their histogram and no list of traces is gathered.
    """
    won = F.col("scored") & F.col("success")
    base = traces.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("error").isNotNull() & ~F.col("scored")).alias("n_errors"), F.count_if("scored").alias("n_scored"),
        F.count_if(won).alias("n_success"), F.count_if(F.col("scored") & ~F.col("success")).alias("n_failure"),
        F.avg(F.when(F.col("scored"), F.col("clicks"))).alias("all"), F.avg(F.when(won, F.col("clicks"))).alias("wins"), F.avg(F.when(won, F.col("optimality_gap"))).alias("avg_optimality_gap"),
    )
    counts = traces.where(won).groupBy("clicks").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("clicks"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    median = counts.select("clicks", upto.alias("upto"), total.alias("total")).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("clicks").cast("int").alias("median_clicks_success"))
    some = F.col("n_scored") > 0
    told = base.withColumn("median_clicks_success", median.scalar())
    return told.select(
        "n_total", "n_errors", "n_scored", F.when(some, F.col("n_success")).alias("n_success"), F.when(some, F.col("n_failure")).alias("n_failure"),
        F.when(some, F.col("n_success") / F.col("n_scored")).alias("success_rate"), F.when(some, F.coalesce("all", F.lit(0.0))).alias("avg_clicks_all"),
        F.when(some, F.coalesce("wins", F.lit(0.0))).alias("avg_clicks_success"), "avg_optimality_gap", "median_clicks_success",
    )
