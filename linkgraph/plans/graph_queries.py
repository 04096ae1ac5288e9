"""Queries over pages, redirects and the link graph."""

from __future__ import annotations

import bz2
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators import graph, sampling, sessions
from linkgraph.operators.skew import join_unique
from linkgraph.plans import tables
from linkgraph.plans.session import checkpointed, once, scratch, table
from linkgraph.plans.tables import BASE, LT1, PAGE1, RD1
from linkgraph.sources import articles_dump, dumps

#: Pages of the report of the most linked ones, and depth of the bounded search.
TOP, DEPTH = 10, 2
#: Characters that XML can't hold, and the carriage return, which its readers change.
_NO_XML = "".join(chr(i) for i in range(32) if chr(i) not in "\t\n")


def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.canonical(spark, d)


def first_wins_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d)


def first_wins_targets(spark: SparkSession, d: str) -> DataFrame:
    return tables.link_targets(spark, d)


def first_wins_redirects(spark: SparkSession, d: str) -> DataFrame:
    return tables.redirects(spark, d)


def redirect_resolution(spark: SparkSession, d: str) -> DataFrame:
    return tables.redirect_ends(spark, d)


def link_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return tables.edges(spark, d)[0]


def transposed_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.transpose(tables.edges(spark, d)[0])


def degrees(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables.edges(spark, d)
    return graph.degrees(nodes, edges)


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(tables.edges(spark, d)[0]).select("node_idx", "block_no", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables.edges(spark, d)
    return graph.csr_offsets(nodes, edges)


def _listed(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    return nodes.join(table(spark, d, "title_list").select("page_id"), "page_id", "left_semi").select("node_idx")


def in_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link to each page of title_list."""
    edges, nodes = tables.edges(spark, d)
    return graph.neighbors(edges, _listed(spark, d, nodes), "bwd")


def top_pages_by_in_degree(spark: SparkSession, d: str) -> DataFrame:
    """The pages with most incoming links."""
    edges, nodes = tables.edges(spark, d)
    counts = graph.degrees(nodes, edges).join(nodes, "node_idx")
    return counts.orderBy(F.desc("in_degree"), "node_idx").limit(TOP).select("node_idx", "page_title", "in_degree")


def bounded_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within DEPTH links of each page of title_list."""
    edges, nodes = tables.edges(spark, d)
    return graph.bounded_bfs(edges, _listed(spark, d, nodes).withColumnRenamed("node_idx", "src"), DEPTH)


def bounded_bfs_backward(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables.edges(spark, d)
    return graph.bounded_bfs(edges, _listed(spark, d, nodes).withColumnRenamed("node_idx", "src"), 1, "bwd")


def _episode_pairs(episodes: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = episodes.select("start_page_id", "target_page_id").distinct()
    key = nodes.select("page_id", "node_idx")
    return ends.join(key.toDF("start_page_id", "src"), "start_page_id").join(key.toDF("target_page_id", "dst"), "target_page_id").select("src", "dst")


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distance between start and target of every episode; made once a session for the same files."""
    edges, nodes = tables.edges(spark, d)
    files = [f"{d}/{name}.parquet" for name in ("page", "linktarget", "redirect_raw", "pagelinks_raw", "episode")]
    return once(spark, files, "distances", lambda: checkpointed(graph.shortest_paths(edges, _episode_pairs(table(spark, d, "episode"), nodes))))


def random_walks(spark: SparkSession, d: str) -> DataFrame:
    """Walks of four links from each page of title_list that has links."""
    edges, nodes = tables.edges(spark, d)
    starts = _listed(spark, d, nodes).select(F.col("node_idx").cast("long").alias("walk_id"), F.col("node_idx").alias("src"))
    return graph.random_walks(edges, starts, 4, 42).select("walk_id", "src", "end")


def _pages_with_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(graph.degrees(nodes, edges).select("node_idx", "out_degree"), "node_idx")


def episode_sample(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables.edges(spark, d)
    return sampling.sample_episodes(edges, _pages_with_degree(edges, nodes))


def quick_sample(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables.edges(spark, d)
    return sampling.quick_sample(edges, _pages_with_degree(edges, nodes))


def dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages rendered as INSERT statements and read back."""
    columns = ["page_id", "page_ns", "page_title", "is_redirect", "rand", "f5", "f6", "f7", "f8", "page_len"]
    rows = tables.pages(spark, d).select("page_id", "page_ns", "page_title", "is_redirect", F.lit(0.5).alias("rand"), *(F.lit(None).cast("string").alias(f"f{i}") for i in range(5, 9)), "page_len")
    return dumps.load_table(dumps.render_inserts(rows, "page", columns), "page")


def pagelinks_fast_extract(spark: SparkSession, d: str) -> DataFrame:
    """Link pairs rendered as INSERT statements and cut out by pattern."""
    rows = tables.links(spark, d).select("pl_from", F.lit(0).alias("ns"), "pl_target_id")
    return dumps.link_pairs_fast(dumps.render_inserts(rows, "pagelinks", ["pl_from", "ns", "pl_target_id"]))


def _dump(spark: SparkSession, rows: DataFrame, name: str, columns: list[str], compressed: bool = False) -> DataFrame:
    """rows written as a file of INSERT statements and read by the dump reader."""
    path = scratch(spark, name)
    dumps.render_inserts(rows, name, columns).write.option("compression", "gzip" if compressed else "none").text(path)
    return dumps.read_dump(spark, path, name)


def redirect_dump(spark: SparkSession, d: str) -> DataFrame:
    """Redirects through a dump file; those that lead to another wiki fall away."""
    rows = tables.redirects(spark, d).withColumn("interwiki", F.when(F.col("rd_from") % 7 == 0, "other").when(F.col("rd_from") % 2 == 0, "")).withColumn("fragment", F.lit("it's"))
    return _dump(spark, rows, "redirect", ["rd_from", "rd_ns", "rd_title", "interwiki", "fragment"], True)


def linktarget_dump(spark: SparkSession, d: str) -> DataFrame:
    return _dump(spark, tables.link_targets(spark, d), "linktarget", ["lt_id", "lt_ns", "lt_title"])


def props_dump(spark: SparkSession, d: str) -> DataFrame:
    """Page properties through a dump file; only those that mark a disambiguation count."""
    marked = tables.props(spark, d)
    others = tables.pages(spark, d).select(F.col("page_id").alias("pp_page"), F.lit("displaytitle").alias("pp_propname"), F.col("page_title").alias("pp_value"))
    return _dump(spark, marked.unionByName(others), "page_props", ["pp_page", "pp_propname", "pp_value"], True)


def pagelinks_dump(spark: SparkSession, d: str) -> DataFrame:
    """Links through a dump file by the general reader; those from other namespaces fall away."""
    rows = tables.links(spark, d).select("pl_from", (F.col("pl_from") % 3).cast("int").alias("ns"), "pl_target_id")
    return _dump(spark, rows, "pagelinks", ["pl_from", "ns", "pl_target_id"], True)


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Pages as an index file, a hundred ids to a block, read back."""
    path = scratch(spark, "index")
    rows = tables.pages(spark, d).where("page_title is not null")
    rows.select(F.concat_ws(":", F.col("page_id") - F.col("page_id") % 100, "page_id", "page_title")).write.text(path)
    return articles_dump.read_index(spark, path)


def dump_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


def saved_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of the canonical pages, saved and read back."""
    path = scratch(spark, "offsets")
    articles_dump.write_index(articles_dump.offset_index(_index(spark, d), tables.canonical(spark, d)), path)
    return spark.read.parquet(path)


def dump_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Which pages are wanted from which block."""
    found = articles_dump.blocks(articles_dump.offset_index(_index(spark, d), tables.canonical(spark, d)))
    return found.select("block_offset", F.array_join(F.transform("page_ids", lambda x: x.cast("string")), ",").alias("page_ids"))


def block_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lead texts as pages of compressed blocks with an older revision before each, read by the block reader."""
    rows = table(spark, d, "lead_text").where("page_id is not null and lead_text is not null").groupBy("page_id").agg(F.max("lead_text").alias("t"))
    clean = F.translate("t", _NO_XML, "")
    page = F.concat(F.lit("<page><title>x</title><id>"), F.col("page_id").cast("string"), F.lit("</id><revision><text>old</text></revision><revision><text>"), F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</text></revision></page>"))
    packed = rows.select(F.floor(F.col("page_id") / 1000).alias("b"), page.alias("page")).groupBy("b").agg(F.array_join(F.collect_list("page"), "\n").alias("xml"))

    def read(frames):
        for f in frames:
            found = [p for xml in f["xml"] for p in articles_dump.pages_in_block(articles_dump.one_stream(io.BytesIO(b"--" + bz2.compress(xml.encode())), 2))]
            yield pd.DataFrame(found, columns=["page_id", "wikitext"])

    return packed.select("xml").mapInPandas(read, "page_id bigint, wikitext string")


def saved_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges, saved and loaded."""
    edges, nodes = tables.edges(spark, d)
    path = scratch(spark, "graph")
    graph.save_graph(edges, nodes.select("node_idx"), path)
    return graph.load_graph(spark, path)[0]


def walk_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every walk the steps that are no links and the nodes visited twice: none."""
    edges, nodes = tables.edges(spark, d)
    starts = _listed(spark, d, nodes).select(F.col("node_idx").cast("long").alias("walk_id"), F.col("node_idx").alias("src"))
    walks = checkpointed(graph.random_walks(edges, starts, 4, 42))
    steps = walks.select("walk_id", F.explode(F.transform(F.slice("path", 2, 99), lambda x, i: F.struct(F.get("path", i).alias("src"), x.alias("dst")))).alias("s")).select("walk_id", "s.*")
    bad = steps.join(edges, ["src", "dst"], "left_anti").groupBy("walk_id").agg(F.count("*").alias("n_bad"))
    told = walks.join(bad, "walk_id", "left")
    return told.select("walk_id", F.coalesce("n_bad", F.lit(0)).cast("int").alias("n_bad_steps"), (F.size("path") - F.size(F.array_distinct("path"))).alias("n_repeats"))


def sampling_pools(spark: SparkSession, d: str) -> DataFrame:
    """How many pages may start an episode, and how many a hard one."""
    edges, nodes = tables.edges(spark, d)
    active, low = sampling.pools(_pages_with_degree(edges, nodes), sampling.HARD_SOURCE_OUT_DEGREE)
    return active.agg(F.count("*").alias("n_active"), F.sum("out_degree").alias("n_links")).withColumn("n_low", low.agg(F.count("*")).scalar())


def sample_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of a quick sample the episodes that break a rule, by rule: none."""
    edges, nodes = tables.edges(spark, d)
    drawn = checkpointed(sampling.quick_sample(edges, _pages_with_degree(edges, nodes)))
    key = nodes.select("page_id", "node_idx")
    ends = drawn.join(key.toDF("start_page_id", "src"), "start_page_id").join(key.toDF("target_page_id", "dst"), "target_page_id")
    told = ends.join(graph.shortest_paths(edges, ends.select("src", "dst")), ["src", "dst"])
    n = F.col("shortest_path_len")
    named = sampling.episode_id(F.col("split"), F.col("start_page_id"), F.col("target_page_id"), F.col("seed"))
    return told.agg(
        F.count_if(F.col("dist") != n).alias("n_wrong_distance"), F.count_if(F.col("difficulty") != sessions.difficulty(n)).alias("n_wrong_difficulty"), F.count_if(F.col("step_limit") != sessions.step_limit(n)).alias("n_wrong_limit"),
        F.count_if(F.col("episode_id") != named).alias("n_wrong_id"), (F.count("*") - F.countDistinct("seed")).alias("n_repeated_seeds"),
    )


def hot_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Links with the title of their target, keys above half a percent kept apart from any number of rows on."""
    links = tables.links(spark, d)
    return join_unique(links, tables.link_targets(spark, d).withColumnRenamed("lt_id", "pl_target_id"), "pl_target_id", "left", 0.005, 0)


def canonical_with_degree(spark: SparkSession, d: str) -> DataFrame:
    """Canonical pages with their number of outgoing links."""
    edges, nodes = tables.edges(spark, d)
    return nodes.join(graph.degrees(nodes, edges).select("node_idx", "out_degree"), "node_idx").select("page_id", "page_title", "node_idx", "out_degree")


def table_maxima(spark: SparkSession, d: str) -> DataFrame:
    """Number of canonical pages, greatest page id and node, greatest redirect; 0 for empty tables."""
    a = tables.canonical(spark, d).agg(F.count("*").alias("n_canonical"), F.coalesce(F.max("page_id"), F.lit(0)).alias("max_page_id"), F.coalesce(F.max("node_idx"), F.lit(0)).alias("max_node"))
    b = tables.redirects(spark, d).agg(F.coalesce(F.max("rd_from"), F.lit(0)).alias("max_redirect"))
    return a.withColumn("max_redirect", b.scalar())


def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Canonical pages without a lead text."""
    return articles_dump.pending(tables.canonical(spark, d), table(spark, d, "lead_text"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_pages, first_wins_pages, first_wins_targets, first_wins_redirects, redirect_resolution, link_graph_edges, transposed_edges, degrees, adjacency, csr_offsets,
        in_neighbors, top_pages_by_in_degree, bounded_bfs, bounded_bfs_backward, shortest_paths, random_walks, episode_sample, quick_sample, dump_roundtrip, pagelinks_fast_extract, pending_work, canonical_with_degree, table_maxima,
        redirect_dump, linktarget_dump, props_dump, pagelinks_dump, dump_index, saved_offsets, dump_blocks, block_texts, saved_graph, walk_checks, sampling_pools, sample_checks, hot_key_join,
    )
}
_DEGREES = """deg AS (SELECT c.node_idx, c.page_title, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM canon c
    LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = c.node_idx LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = c.node_idx)"""
_LISTED = "listed AS (SELECT DISTINCT node_idx FROM canon WHERE page_id IN (SELECT page_id FROM title_list))"
DISTANCES = """pairs AS (SELECT DISTINCT a.node_idx AS src, b.node_idx AS dst FROM episode e JOIN canon a ON a.page_id = e.start_page_id JOIN canon b ON b.page_id = e.target_page_id),
    bfs(src, node, d) USING KEY (src, node) AS (SELECT DISTINCT src, src, 0 FROM pairs
      UNION SELECT b.src, e.dst, min(b.d + 1) FROM bfs b JOIN edges e ON e.src = b.node LEFT JOIN recurring.bfs r ON r.src = b.src AND r.node = e.dst WHERE r.node IS NULL AND b.d < 30 GROUP BY 1, 2),
    dists AS (SELECT p.src, p.dst, b.d AS dist FROM pairs p LEFT JOIN bfs b ON b.src = p.src AND b.node = p.dst)"""
ORACLE = {
    "canonical_pages": f"{BASE} SELECT * FROM canon",
    "first_wins_pages": f"WITH {PAGE1} SELECT * FROM page1",
    "first_wins_targets": f"WITH {LT1} SELECT * FROM lt1",
    "first_wins_redirects": f"WITH {RD1} SELECT * FROM rd1",
    "redirect_resolution": f"{BASE} SELECT * FROM ends",
    "link_graph_edges": f"{BASE} SELECT * FROM edges",
    "transposed_edges": f"{BASE} SELECT dst AS src, src AS dst FROM edges",
    "degrees": f"{BASE}, {_DEGREES} SELECT node_idx, out_degree, in_degree FROM deg",
    "adjacency": f"{BASE}, ranked AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 10000 AS block_no FROM edges) SELECT src AS node_idx, CAST(block_no AS INTEGER) AS block_no, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM ranked GROUP BY src, block_no",
    "csr_offsets": f"{BASE}, {_DEGREES} SELECT node_idx, CAST(sum(out_degree) OVER (ORDER BY node_idx) - out_degree AS BIGINT) AS row_start, CAST(sum(out_degree) OVER (ORDER BY node_idx) AS BIGINT) AS row_end FROM deg",
    "in_neighbors": f"{BASE}, {_LISTED} SELECT dst AS node_idx, src AS neighbor FROM edges WHERE dst IN (SELECT node_idx FROM listed)",
    "top_pages_by_in_degree": f"{BASE}, {_DEGREES} SELECT node_idx, page_title, in_degree FROM deg ORDER BY in_degree DESC, node_idx LIMIT {TOP}",
    "bounded_bfs": f"""{BASE}, {_LISTED}, reach AS (SELECT node_idx AS src, node_idx AS node, 0 AS dist FROM listed
        UNION ALL SELECT l.node_idx, e.dst, 1 FROM listed l JOIN edges e ON e.src = l.node_idx
        UNION ALL SELECT l.node_idx, f.dst, 2 FROM listed l JOIN edges e ON e.src = l.node_idx JOIN edges f ON f.src = e.dst)
        SELECT src, node, min(dist) AS dist FROM reach GROUP BY src, node""",
    "bounded_bfs_backward": f"""{BASE}, {_LISTED}, reach AS (SELECT node_idx AS src, node_idx AS node, 0 AS dist FROM listed
        UNION ALL SELECT l.node_idx, e.src, 1 FROM listed l JOIN edges e ON e.dst = l.node_idx) SELECT src, node, min(dist) AS dist FROM reach GROUP BY src, node""",
    "shortest_paths": f"{BASE}, {DISTANCES} SELECT * FROM dists",
    "redirect_dump": f"WITH {RD1} SELECT * FROM rd1 WHERE rd_from % 7 <> 0 AND rd_ns IS NOT NULL",
    "linktarget_dump": f"WITH {LT1} SELECT * FROM lt1 WHERE lt_ns IS NOT NULL AND lt_title IS NOT NULL",
    "props_dump": f"WITH {PAGE1} SELECT page_id AS pp_page, 'disambiguation' AS pp_propname, '' AS pp_value FROM page1 WHERE ends_with(page_title, '_(disambiguation)')",
    "pagelinks_dump": "SELECT pl_from, pl_target_id FROM pagelinks_raw WHERE pl_from % 3 = 0 AND pl_target_id IS NOT NULL",
    "dump_index": f"WITH {PAGE1} SELECT page_id - page_id % 100 AS block_offset, page_id, page_title AS title FROM page1 WHERE page_title IS NOT NULL",
    "saved_offsets": f"{BASE} SELECT page_id, page_id - page_id % 100 AS block_offset FROM canon WHERE page_title IS NOT NULL",
    "dump_blocks": f"{BASE} SELECT page_id - page_id % 100 AS block_offset, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS page_ids FROM canon WHERE page_title IS NOT NULL GROUP BY 1",
    "block_texts": r"""WITH t AS (SELECT page_id, max(lead_text) AS t FROM lead_text WHERE page_id IS NOT NULL AND lead_text IS NOT NULL GROUP BY 1), c AS (SELECT page_id, regexp_replace(t, '[\x00-\x08\x0b-\x1f]', '', 'g') AS wikitext FROM t)
        SELECT * FROM c WHERE wikitext <> ''""",
    "saved_graph": f"{BASE} SELECT * FROM edges",
    "walk_checks": f"{BASE}, {_LISTED} SELECT CAST(node_idx AS BIGINT) AS walk_id, 0 AS n_bad_steps, 0 AS n_repeats FROM listed",
    "sampling_pools": f"{BASE}, {_DEGREES} SELECT count(*) FILTER (WHERE out_degree > 0) AS n_active, CAST(sum(out_degree) AS BIGINT) AS n_links, count(*) FILTER (WHERE out_degree BETWEEN 1 AND 20) AS n_low FROM deg",
    "sample_checks": "SELECT 0::BIGINT AS n_wrong_distance, 0::BIGINT AS n_wrong_difficulty, 0::BIGINT AS n_wrong_limit, 0::BIGINT AS n_wrong_id, 0::BIGINT AS n_repeated_seeds",
    "hot_key_join": f"WITH {LT1} SELECT pl_from, pl_target_id, lt_ns, lt_title FROM pagelinks_raw LEFT JOIN lt1 ON lt_id = pl_target_id WHERE pl_from IS NOT NULL AND pl_target_id IS NOT NULL",
    "canonical_with_degree": f"{BASE}, {_DEGREES} SELECT canon.page_id, canon.page_title, node_idx, out_degree FROM deg JOIN canon USING (node_idx)",
    "table_maxima": f"{BASE} SELECT count(*) AS n_canonical, coalesce(max(page_id), 0) AS max_page_id, coalesce(max(node_idx), 0) AS max_node, coalesce((SELECT max(rd_from) FROM rd1), 0) AS max_redirect FROM canon",
    "dump_roundtrip": f"WITH {PAGE1} SELECT page_id, page_ns, page_title, is_redirect, coalesce(page_len, 0) AS page_len FROM page1 WHERE page_title IS NOT NULL",
    "pagelinks_fast_extract": "SELECT pl_from, pl_target_id FROM pagelinks_raw WHERE pl_from >= 0 AND pl_target_id >= 0",
    "pending_work": f"{BASE} SELECT page_id FROM canon WHERE page_id NOT IN (SELECT page_id FROM lead_text WHERE page_id IS NOT NULL)",
}
