"""Sampling of start and target pages at wanted distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.graph import random_walks, shortest_paths
from linkgraph.operators.sessions import bonus_step_limit, difficulty, step_limit
from linkgraph.plans.session import checkpointed

#: Name under which episode ids are derived; a parameter of the functions below.
ID_PREFIX = "linkgraph"
#: Links of a page that may start a hard episode at most.
HARD_SOURCE_OUT_DEGREE = 20
#: Pairs that a round of a sample proposes at least; and those that a quick sample verifies in one round. Neither changes the result.
ROUND = 1000
QUICK_ROUND = 2500
# Fixed value: the DNS namespace of name-based UUIDs (RFC 4122).
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def name_uuid(name: Column) -> Column:
    """Hex of the version-5 UUID of a name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(name, "utf-8")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def episode_id(split: Column, start: Column, target: Column, seed: Column, prefix: str = ID_PREFIX) -> Column:
    return name_uuid(F.concat_ws(".", F.lit(prefix), split, start.cast("string"), target.cast("string"), seed.cast("string")))


def random_id() -> Column:
    """Hex of a random UUID, another one each time it is evaluated."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def bucket_targets(n_total: int) -> dict[str, int]:
    """Episodes wanted of each bucket; halves round to even."""
    easy = round(n_total * 0.4)
    return {"easy": easy, "medium": n_total - easy}


def _numbered(pool: DataFrame) -> tuple[DataFrame, int]:
    """The nodes of a pool with dense numbers i, and how many they are; made once for all rounds of a sample."""
    from linkgraph.operators.canonical import dense_index

    numbered = checkpointed(dense_index(pool.select("node_idx"), "node_idx", "i"))
    return numbered, numbered.count()


def _proposals(numbered: DataFrame, size: int, n: int, seed: int, first: int) -> DataFrame:
    """ordinal, src, other: n draws of two nodes each, uniform with replacement from a numbered pool.

    A draw is a hash of (seed, ordinal) onto the dense numbers.
    """
    draws = numbered.sparkSession.range(first, first + n).select(
        F.col("id").alias("ordinal"), F.pmod(F.xxhash64(F.lit(seed), F.lit("s"), "id"), F.lit(size)).cast("int").alias("i"), F.pmod(F.xxhash64(F.lit(seed), F.lit("t"), "id"), F.lit(size)).cast("int").alias("j")
    )
    a = numbered.select("i", F.col("node_idx").alias("src"))
    b = numbered.select(F.col("i").alias("j"), F.col("node_idx").alias("other"))
    return draws.join(a, "i").join(b, "j").select("ordinal", "src", "other")


def sample_bucket(
    edges: DataFrame, pool: DataFrame, count: int, distances: set[int], depth: int, seed: int, seen: DataFrame, walk_lengths: tuple[int, ...] = (), max_out_degree: int | None = None, per_round: int | None = None
) -> DataFrame:
    """ordinal, src, dst, dist: the first count proposed pairs at one of the distances.

    Proposals are random pairs, or ends of walks if walk_lengths are given. A round proposes several
    pairs for each that is still wanted and verifies them in one batch; repeated pairs and those of
    seen (src, dst) don't count. At most max(200 * count, 1000) pairs are proposed, so fewer may come out.
    """
    spark: SparkSession = edges.sparkSession
    cap, tried, got = max(200 * count, 1000), 0, 0
    taken = spark.createDataFrame([], "ordinal long, src int, dst int, dist int")
    pool, size = _numbered(pool)
    while got < count and tried < cap:
        n = min(per_round or max(20 * (count - got), ROUND), cap - tried)
        draws = checkpointed(_proposals(pool, size, n, seed, tried))
        if walk_lengths:
            ends = [
                random_walks(edges, draws.where(F.col("ordinal") % len(walk_lengths) == i).select(F.col("ordinal").alias("walk_id"), "src"), length, seed, max_out_degree)
                for i, length in enumerate(walk_lengths)
            ]
            walked = ends[0]
            for e in ends[1:]:
                walked = walked.unionByName(e)
            pairs = walked.select(F.col("walk_id").alias("ordinal"), "src", F.col("end").alias("dst"))
        else:
            pairs = draws.select("ordinal", "src", F.col("other").alias("dst"))
        fresh = pairs.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal"))
        fresh = checkpointed(fresh.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").join(taken.select("src", "dst"), ["src", "dst"], "left_anti"))
        good = shortest_paths(edges, fresh, depth).where(F.col("dist").isin(*distances)).join(fresh, ["src", "dst"])
        taken = checkpointed(taken.unionByName(good.select("ordinal", "src", "dst", "dist")).orderBy("ordinal").limit(count))
        got, tried = taken.count(), tried + n
    return taken


def _episodes(pairs: DataFrame, split: str, first_seed: int, pages: DataFrame, prefix: str) -> DataFrame:
    """Episodes of sampled pairs, numbered in the order of their proposals. A sample is at most the wanted count, so one window orders it."""
    from pyspark.sql import Window

    seeded = pairs.withColumn("seed", (F.row_number().over(Window.orderBy("ordinal")) - 1 + first_seed).cast("int"))
    a = pages.select(F.col("node_idx").alias("src"), F.col("page_id").alias("start_page_id"), F.col("page_title").alias("start_title"))
    b = pages.select(F.col("node_idx").alias("dst"), F.col("page_id").alias("target_page_id"), F.col("page_title").alias("target_title"))
    told = seeded.join(a, "src").join(b, "dst").withColumn("split", F.lit(split))
    limit = bonus_step_limit(F.col("dist")) if split == "hard_bonus" else step_limit(F.col("dist"))
    return told.select(
        episode_id(F.col("split"), F.col("start_page_id"), F.col("target_page_id"), F.col("seed"), prefix).alias("episode_id"), "split", "seed", "start_page_id", "target_page_id",
        "start_title", "target_title", F.col("dist").alias("shortest_path_len"), difficulty(F.col("dist")).alias("difficulty"), limit.alias("step_limit"),
    )


def pools(pages: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pages with links, and those of them with at most so many."""
    active = pages.where("out_degree > 0")
    return active, active.where(F.col("out_degree") <= most)


def sample_episodes(
    edges: DataFrame, pages: DataFrame, n_total: int = 100, n_hard_bonus: int = 3, seed: int = 42, max_depth: int = 7, hard_source_out_degree: int = HARD_SOURCE_OUT_DEGREE, hard_walk_out_degree: int = 50, prefix: str = ID_PREFIX
) -> DataFrame:
    """A benchmark set: medium pairs (distance 5, random), easy ones (3 or 4, by walks), then the bonus of hard ones (6 or 7).

    pages: page_id, page_title, node_idx, out_degree. Raises ValueError if no page has links, or if
    max_depth is too small for a bonus.
    """
    if max_depth < 7 and n_hard_bonus > 0:
        raise ValueError("a hard bonus needs a depth of at least 7")
    active, low = pools(pages, hard_source_out_degree)
    if not active.take(1):
        raise ValueError("no page has links")
    low = low if low.take(1) else active
    none = edges.sparkSession.createDataFrame([], "src int, dst int")
    want = bucket_targets(n_total)
    medium = sample_bucket(edges, active, want["medium"], {5}, min(5, max_depth), seed, none)
    easy = sample_bucket(edges, active, want["easy"], {3, 4}, min(4, max_depth), seed + 1, medium, (4, 3, 4))
    out = _episodes(medium, "benchmark", 0, pages, prefix).unionByName(_episodes(easy, "benchmark", medium.count(), pages, prefix))
    if n_hard_bonus:
        hard = sample_bucket(edges, low, n_hard_bonus, {6, 7}, min(7, max_depth), seed + 2, medium.unionByName(easy), (7, 6, 7), hard_walk_out_degree)
        out = out.unionByName(_episodes(hard, "hard_bonus", 0, pages, prefix))
    return out


def quick_sample(edges: DataFrame, pages: DataFrame, want: dict[str, int] | None = None, attempts: int = 5000, seed: int = 42, prefix: str = ID_PREFIX, split: str = "dev") -> DataFrame:
    """Episodes from random pairs of all pages, the first of each difficulty up to the wanted number, verified to depth 7.

    Pages without links take part and a pair may come twice, as proposals are independent. Pairs are
    verified in rounds until every difficulty is filled or all attempts are made; the rounds don't change the result.
    """
    from pyspark.sql import Window

    want = want or {"easy": 10, "medium": 10, "hard": 2}
    least = F.create_map(*(x for k, v in want.items() for x in (F.lit(k), F.lit(v))))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("ordinal"))
    ranked = edges.sparkSession.createDataFrame([], "ordinal long, src int, dst int, dist int, level string")
    got, tried = 0, 0
    pool, size = _numbered(pages)
    while got < sum(want.values()) and tried < attempts:
        n = min(QUICK_ROUND, attempts - tried)
        draws = checkpointed(_proposals(pool, size, n, seed, tried).where("src <> other").select("ordinal", "src", F.col("other").alias("dst")))
        told = draws.join(shortest_paths(edges, draws, 7), ["src", "dst"]).where("dist is not null and dist >= 1").withColumn("level", difficulty(F.col("dist")))
        ranked = checkpointed(ranked.unionByName(told.select(*ranked.columns)).withColumn("rank", rank).where(F.col("rank") <= least[F.col("level")]).drop("rank"))
        got, tried = ranked.count(), tried + n
    return _episodes(ranked.select("ordinal", "src", "dst", "dist"), split, 0, pages, prefix)
