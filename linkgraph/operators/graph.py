"""The link graph: edges, degrees, adjacency, distances and walks.

Nodes are dense ids, edges are rows (src, dst). Traversals run level by level for all sources at
once; a level joins its frontier to the edges, broadcasting the frontier only while its counted size
is within the bound, and ends in a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed, saved, small_or_shuffled

#: Links of a node that one task takes at a time; nodes with more are cut into parts.
HUB_LINKS = 20_000
#: Links that a task of a search for distances may hold (about 24 bytes each while it sorts them), and pairs that are worth a task with a copy of its own.
TASK_LINKS, TASK_PAIRS = 20_000_000, 4000
#: Links that a walk draws at once.
DRAWS = 8


def link_edges(pagelinks: DataFrame, linktarget: DataFrame, page_titles: DataFrame, redirects: DataFrame, canonical: DataFrame) -> DataFrame:
    """src, dst INT: distinct links between canonical pages, redirects followed, no self-links.

    The targets are resolved on the side of the small tables first (link target, title, redirect,
    canonical page), so that the links are joined twice only, both times with a table that holds
    each key once and with hot keys kept apart. A target under a redirect without an end drops out.
    pagelinks: pl_from, pl_target_id; linktarget: lt_id (unique), lt_ns, lt_title;
    page_titles: title, page_id; redirects: rd_from_id, canonical_id; canonical: page_id, node_idx.
    """
    named = linktarget.where("lt_ns = 0").select("lt_id", F.col("lt_title").alias("title")).join(page_titles, "title")
    followed = named.join(redirects.withColumnRenamed("rd_from_id", "page_id").withColumn("hit", F.lit(True)), "page_id", "left")
    ends = followed.select("lt_id", F.when(F.col("hit"), F.col("canonical_id")).otherwise(F.col("page_id")).alias("page_id"))
    targets = saved(ends.join(canonical.select("page_id", F.col("node_idx").alias("dst")), "page_id").select(F.col("lt_id").alias("pl_target_id"), "dst"), "targets")
    sources = canonical.select(F.col("page_id").alias("pl_from"), F.col("node_idx").alias("src"))
    links = saved(join_unique(pagelinks.select("pl_from", "pl_target_id").where("pl_from is not null"), targets, "pl_target_id").select("pl_from", "dst").distinct(), "links")
    return join_unique(links, sources, "pl_from").where("src <> dst").select("src", "dst").distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, out_degree, in_degree of every node, zero where it has no links."""
    counts = edges.select(F.col("src").alias("node_idx"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node_idx"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    seen = counts.groupBy("node_idx").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("node_idx").join(seen, "node_idx", "left").fillna(0, ["out_degree", "in_degree"])


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "fwd") -> DataFrame:
    """node_idx, neighbor of the given nodes (node_idx); backward for any direction but fwd."""
    e = edges if direction == "fwd" else transpose(edges)
    return e.join(small_or_shuffled(nodes.select(F.col("node_idx").alias("src")).distinct(), nodes.count()), "src", "left_semi").select(F.col("src").alias("node_idx"), F.col("dst").alias("neighbor"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """src, i BIGINT, dst: the links of each node numbered from 0 in the order of dst.

    Ranks come from counts of node and target range, not from one sort of a hub.
    """
    ranged = edges.withColumn("r", F.floor(F.col("dst") / 4096))
    before = ranged.groupBy("src", "r").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("r")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("src", "r").orderBy("dst")) - 1
    return ranged.withColumn("j", inside).join(before, ["src", "r"]).select("src", (F.col("before") + F.col("j")).alias("i"), "dst")


def adjacency(edges: DataFrame, block: int = 10_000) -> DataFrame:
    """node_idx, block_no, neighbors ARRAY<INT> sorted: the lists of a node in blocks of so many links, so no row grows with the largest hub."""
    blocks = ranked_edges(edges).withColumn("block_no", F.floor(F.col("i") / block).cast("int"))
    return blocks.groupBy("src", "block_no").agg(F.sort_array(F.collect_list("dst")).alias("neighbors")).withColumnRenamed("src", "node_idx")


def csr_offsets(nodes: DataFrame, edges: DataFrame, range_nodes: int = 4096) -> DataFrame:
    """node_idx, row_start, row_end: the slice of each node in the edges sorted by (src, dst)."""
    counts = nodes.select("node_idx").join(edges.groupBy(F.col("src").alias("node_idx")).agg(F.count("*").alias("n")), "node_idx", "left").fillna(0, ["n"])
    ranged = counts.withColumn("r", F.floor(F.col("node_idx") / range_nodes))
    before = ranged.groupBy("r").agg(F.sum("n").alias("s")).select("r", (F.sum("s").over(Window.orderBy("r")) - F.col("s")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("upto", upto).join(before, "r").select("node_idx", (F.col("before") + F.col("upto") - F.col("n")).alias("row_start"), (F.col("before") + F.col("upto")).alias("row_end"))


@dataclass
class _Links:
    """The links of one direction, those of hubs (more than HUB_LINKS of them) in parts by the target."""

    edges: DataFrame
    hubs: DataFrame | None  # src, parts

    @classmethod
    def of(cls, edges: DataFrame) -> _Links:
        parts = F.ceil(F.col("n") / HUB_LINKS).cast("int")
        hubs = checkpointed(edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB_LINKS).select("src", parts.alias("parts")))
        n = hubs.count()  # at most the number of links / HUB_LINKS
        if not n:
            return cls(edges, None)
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(0).cast("int")
        small = small_or_shuffled(hubs, n)
        return cls(checkpointed(edges.join(small, "src", "left").select("src", "dst", part.alias("part"))), small)

    def step(self, frontier: DataFrame, n: int, carry: str) -> DataFrame:
        """carry, node one link on from the n rows of the frontier (carry, node); a hub is met part by part, in as many tasks."""
        f = frontier.select(carry, F.col("node").alias("src"))
        keys = ["src"]
        if self.hubs is not None:
            f = f.join(self.hubs, "src", "left").select(carry, "src", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            keys = ["src", "part"]
        return self.edges.join(small_or_shuffled(f, n), keys).select(carry, F.col("dst").alias("node")).distinct()


_PREPARED: WeakKeyDictionary[DataFrame, dict[str, object]] = WeakKeyDictionary()


def _prepared(edges: DataFrame, what: str, build: Callable[[], object]):
    """What is derived once from a table of edges and used by every search over it."""
    told = _PREPARED.setdefault(edges, {})
    if what not in told:
        told[what] = build()
    return told[what]


def _links(edges: DataFrame, direction: str) -> _Links:
    return _prepared(edges, direction, lambda: _Links.of(edges if direction == "fwd" else transpose(edges)))


def bounded_bfs(edges: DataFrame, sources: DataFrame, max_depth: int, direction: str = "fwd") -> DataFrame:
    """src, node, dist of every node within max_depth links of each source, the source itself at 0.

    sources: src; nulls and repeats count once or not at all. Backward for any direction but fwd.
    """
    links = _links(edges, "fwd" if direction == "fwd" else "bwd")
    seen = checkpointed(sources.where("src is not null").select("src", F.col("src").alias("node"), F.lit(0).alias("dist")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        n = frontier.count()
        if not n:
            break
        step = links.step(frontier.select(F.col("src").alias("start"), "node"), n, "start").withColumnRenamed("start", "src")
        frontier = checkpointed(step.join(seen, ["src", "node"], "left_anti").withColumn("dist", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 30) -> DataFrame:
    """src, dst, dist of each distinct pair: exact number of links if at most max_depth, else null.

    While one task can hold the links (TASK_LINKS, counted), the pairs are dealt to the cores and each
    core searches its own pairs; beyond that the searches of all pairs go link by link as joins.
    """
    wanted = checkpointed(pairs.where("src is not null and dst is not null").select("src", "dst").distinct())
    if _prepared(edges, "n", edges.count) <= TASK_LINKS:
        return _paths_in_tasks(edges, wanted, max_depth)
    return _paths_by_joins(edges, wanted, max_depth)


def _paths_in_tasks(edges: DataFrame, wanted: DataFrame, max_depth: int) -> DataFrame:
    """Every task gets the links, packed in a row a batch, and its share of the pairs; so the links are shuffled once for each core at most."""
    spark = edges.sparkSession
    n = wanted.count()
    if not n:
        return wanted.withColumn("dist", F.lit(None).cast("int"))
    tasks = min(max(spark.sparkContext.defaultParallelism, 1), -(-n // TASK_PAIRS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({k: [b[k].to_numpy().tobytes()] for k in ("src", "dst")}, schema=pa.schema([("src", pa.binary()), ("dst", pa.binary())]))

    longs = lambda df: df.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst")))
    narrow = all(kind != "bigint" for _, kind in edges.select("src", "dst").dtypes)
    links = edges.where("src is not null and dst is not null").select("src", "dst")
    packed = (links if narrow else longs(links)).mapInArrow(pack, "src binary, dst binary")
    copies = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.col("src").alias("srcs"), F.col("dst").alias("dsts"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    dealt = longs(wanted).select(F.pmod(F.xxhash64("src", "dst"), F.lit(tasks)).cast("int").alias("task"), F.lit(None).cast("binary").alias("srcs"), F.lit(None).cast("binary").alias("dsts"), "src", "dst")
    kind = np.int32 if narrow else np.int64

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, pairs = {"srcs": [], "dsts": []}, {"src": [], "dst": []}
        for b in batches:
            for k, found in links.items():
                found += [np.frombuffer(x.as_buffer(), kind) for x in b[k].drop_null()]
            for k, found in pairs.items():
                found.append(b[k].drop_null().to_numpy())
        if not any(map(len, pairs["src"])):
            return
        src, dst = (np.concatenate(x) for x in pairs.values())
        dist = _distances([np.concatenate([np.empty(0, kind), *links.pop(k)]) for k in ("srcs", "dsts")], src, dst, max_depth)
        yield pa.RecordBatch.from_pydict({"src": src, "dst": dst, "dist": pa.array(dist, pa.int32(), mask=dist < 0)})

    found = copies.unionByName(dealt).repartitionById(tasks, F.col("task")).drop("task").mapInArrow(search, "src long, dst long, dist int")
    return found.select(*(F.col(c).cast(kind).alias(c) for c, kind in wanted.dtypes), "dist")


def _distances(ends: list[np.ndarray], src: np.ndarray, dst: np.ndarray, max_depth: int) -> np.ndarray:
    """Number of links from each src to its dst, -1 if there are more than max_depth or there is no way.

    ends: sources and targets of the links; taken out of the list, so that they go once they are sorted. Each pair has two searches, from src forward and from dst backward; the one that meets fewer links goes
    one link on. A pair that is open when they have gone i and j links is more than i + j apart, so it
    is at i + j + 1 when the next link leads to a node that the other search has seen.
    """
    b, a = ends.pop(), ends.pop()
    every = (a, b, src, dst)
    low, high = min(x.min(initial=0) for x in every), max(x.max(initial=0) for x in every)
    if low < 0 or high > 4 * (len(a) + len(src)) + 1000:  # not dense
        nodes = np.unique(np.concatenate(every))
        a, b, src, dst = (np.searchsorted(nodes, x) for x in every)
        high = len(nodes)
    size = int(high) + 1

    def listed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the links of each node begin, and the nodes that they lead to."""
        both = a.astype(np.int64)
        both <<= 32
        both |= b
        both.sort()
        return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=size))]), both.astype(np.int32)  # the lower half

    links = (listed(a, b), listed(b, a))
    del a, b, every
    seen, slot = (np.full(size, -1, np.int32), np.full(size, -1, np.int32)), np.zeros(size, np.int32)
    dist = np.full(len(src), -1, np.int32)
    for p, ends in enumerate(zip(src.tolist(), dst.tolist(), strict=True)):
        if ends[0] == ends[1]:
            dist[p] = 0
            continue
        frontier = [np.array([x]) for x in ends]
        cost = [at[x + 1] - at[x] for (at, _), x in zip(links, ends, strict=True)]
        for side, x in zip(seen, ends, strict=True):
            side[x] = p
        for depth in range(1, max_depth + 1):
            if not cost[0] or not cost[1]:
                break
            i = int(cost[1] < cost[0])
            at, to = links[i]
            begin = at[frontier[i]]
            n = at[frontier[i] + 1] - begin
            upto = np.cumsum(n)
            step = to[np.repeat(begin - upto + n, n) + np.arange(upto[-1])]
            if (seen[1 - i][step] == p).any():
                dist[p] = depth
                break
            new = step[seen[i][step] != p]
            places = np.arange(len(new), dtype=np.int32)
            slot[new] = places
            new = new[slot[new] == places]  # each once
            seen[i][new] = p
            frontier[i], cost[i] = new, (at[new + 1] - at[new]).sum()
    return dist


def _paths_by_joins(edges: DataFrame, wanted: DataFrame, max_depth: int) -> DataFrame:
    """The same for any number of links.

    Two searches meet, from the sources forward and from the targets backward; each round the one with
    the smaller frontier goes one link on. A pair that is still open when they have gone a and b links
    is at least a + b apart, and just so far if the two last frontiers share a node. Sources and
    targets of pairs that are closed (met, or one of the ends has no frontier left) go no further.
    """
    solved = wanted.where("src = dst").withColumn("dist", F.lit(0))
    open_ = wanted.where("src <> dst")
    sides = {}
    for name, key in (("fwd", "src"), ("bwd", "dst")):
        start = checkpointed(open_.select(F.col(key).alias("start"), F.col(key).alias("node")).distinct())
        sides[name] = {"key": key, "seen": start, "frontier": start, "n": start.count()}
    n_open = open_.count()
    for s in sides.values():
        s["kept"] = n_open
    for depth in range(1, max_depth + 1):
        if not n_open or not all(s["n"] for s in sides.values()):
            break
        name = min(sides, key=lambda x: sides[x]["n"])
        s, other = sides[name], sides["bwd" if name == "fwd" else "fwd"]
        live = small_or_shuffled(open_.select(F.col(s["key"]).alias("start")).distinct(), n_open)
        going, seen = (s[x].join(live, "start", "left_semi") for x in ("frontier", "seen"))
        if 2 * n_open < s["kept"]:  # what belongs to closed pairs is left behind for good
            s["kept"], s["seen"] = n_open, checkpointed(seen)
            seen = s["seen"]
        s["frontier"] = checkpointed(_links(edges, name).step(going, s["n"], "start").join(seen, ["start", "node"], "left_anti"))
        s["n"] = s["frontier"].count()
        s["seen"] = s["seen"].unionByName(s["frontier"])
        here = s["frontier"].withColumnRenamed("start", s["key"])
        there = other["frontier"].withColumnRenamed("start", other["key"])
        met = small_or_shuffled(open_, n_open).join(here, s["key"]).join(there, [other["key"], "node"]).select("src", "dst", F.lit(depth).alias("dist")).distinct()
        alive = here.select(s["key"], F.lit(True).alias("alive")).distinct()
        told = checkpointed(open_.join(met, ["src", "dst"], "left").join(alive, s["key"], "left"))
        solved = solved.unionByName(told.where("dist is not null").select("src", "dst", "dist"))
        open_ = told.where("dist is null and alive").select("src", "dst")
        n_open = open_.count()
    return wanted.join(solved, ["src", "dst"], "left")


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int, max_out_degree: int | None = None) -> DataFrame:
    """walk_id, src, end: the last node of a self-avoiding walk of so many steps, null at a dead end.

    starts: walk_id, src. Each step takes one of the links to nodes not yet visited (and with at most
    max_out_degree links, if given), all with equal chance. DRAWS places among the numbered links of
    the node are drawn by hashes of (seed, walk, step, draw) and only these links are joined, so a
    hub costs no more than any other node; the first that leads to a new node is taken. Where all
    lead back, which only a node with few links makes likely, the least hash among all its links decides.
    The choice does not depend on the partitioning.
    """
    def allowed() -> tuple[DataFrame, DataFrame]:
        e = edges
        if max_out_degree is not None:
            big = edges.groupBy("src").count().where(F.col("count") > max_out_degree).select(F.col("src").alias("dst"))
            e = edges.join(big, "dst", "left_anti").select("src", "dst")
        ranked = checkpointed(ranked_edges(e))
        return ranked, checkpointed(ranked.groupBy("src").agg(F.count("*").alias("degree")))

    ranked, degree = _prepared(edges, f"ranked {max_out_degree}", allowed)
    n = starts.count()
    walks = checkpointed(starts.select("walk_id", "src", F.col("src").alias("node"), F.array("src").alias("path")))
    new = lambda: ~F.array_contains("path", F.col("dst"))
    links = ranked.withColumnRenamed("src", "node")
    for step in range(steps):
        here = walks.join(degree.withColumnRenamed("src", "node"), "node")
        drawn = here.select("walk_id", "node", "path", "degree", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("k"))
        drawn = drawn.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "walk_id", F.lit(step), "k"), F.col("degree")))
        lucky = links.join(small_or_shuffled(drawn.select("walk_id", "node", "i", "k", "path"), n * DRAWS), ["node", "i"]).where(new()).groupBy("walk_id").agg(F.min_by("dst", "k").alias("dst"))
        told = checkpointed(walks.join(lucky, "walk_id", "left"))
        left = told.where("dst is null and node is not null").select("walk_id", "node", "path")
        n_left = left.count()
        if n_left:
            choice = F.struct(F.xxhash64(F.lit(seed), "walk_id", F.lit(step), F.col("dst").cast("long")).alias("h"), "dst")
            rest = links.join(small_or_shuffled(left, n_left), "node").where(new()).groupBy("walk_id").agg(F.min(choice)["dst"].alias("other"))
            told = told.join(rest, "walk_id", "left").withColumn("dst", F.coalesce("dst", "other"))
        walks = checkpointed(told.select("walk_id", "src", F.col("dst").alias("node"), F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path")))
    return walks.select("walk_id", "src", F.col("node").alias("end"), "path")


def save_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Edges sorted within ranges of the source, nodes, and one row of counts, as Parquet."""
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark = edges.sparkSession
    n = spark.read.parquet(f"{path}/edges").count()
    spark.createDataFrame([(nodes.count(), n, n)], "n_nodes bigint, n_fwd_edges bigint, n_bwd_edges bigint").write.mode("overwrite").json(f"{path}/meta")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")
