"""The test tables as the operators want them: living rows, one per key, the first loaded first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.canonical import canonical_pages, redirect_map, title_index
from linkgraph.operators.graph import link_edges
from linkgraph.plans.session import once, saved, table
from linkgraph.sources.dumps import first_wins


def pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page").where("deleted_at is null").withColumn("len", F.coalesce("page_len", F.lit(-1)))
    return first_wins(rows, ["page_id"], ["loaded_at", "page_title", "page_ns", "is_redirect", "len"]).select("page_id", "page_ns", "page_title", "is_redirect", "page_len")


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(table(spark, d, "linktarget").where("deleted_at is null"), ["lt_id"], ["loaded_at", "lt_title", "lt_ns"]).select("lt_id", "lt_ns", "lt_title")


def redirects(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(table(spark, d, "redirect_raw").where("rd_title is not null"), ["rd_from"], ["loaded_at", "rd_title", "rd_ns"]).select("rd_from", "rd_ns", "rd_title")


def props(spark: SparkSession, d: str) -> DataFrame:
    """Pages marked as disambiguation; here the title tells."""
    return _marked(pages(spark, d))


def _marked(page: DataFrame) -> DataFrame:
    marked = page.where(F.endswith("page_title", F.lit("_(disambiguation)")))
    return marked.select(F.col("page_id").alias("pp_page"), F.lit("disambiguation").alias("pp_propname"), F.lit("").alias("pp_value"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pagelinks_raw").where("pl_from is not null and pl_target_id is not null").select("pl_from", "pl_target_id")


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_pages(pages(spark, d), props(spark, d))


def redirect_ends(spark: SparkSession, d: str) -> DataFrame:
    return redirect_map(redirects(spark, d), pages(spark, d))


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """edges and canonical pages; made once a session for the same files."""

    def build() -> tuple[DataFrame, DataFrame]:
        page = saved(pages(spark, d), "pages")
        nodes = saved(canonical_pages(page, _marked(page)), "nodes")
        return saved(link_edges(links(spark, d), link_targets(spark, d), title_index(page), redirect_map(redirects(spark, d), page), nodes), "edges"), nodes

    return once(spark, [f"{d}/{name}.parquet" for name in ("page", "linktarget", "redirect_raw", "pagelinks_raw")], "edges", build)


# The same in SQL, as common table expressions.
PAGE1 = """page1 AS (SELECT page_id, page_ns, page_title, is_redirect, page_len FROM (SELECT *, row_number() OVER (PARTITION BY page_id
    ORDER BY loaded_at, page_title, page_ns, is_redirect, coalesce(page_len, -1)) AS rn FROM page WHERE deleted_at IS NULL AND page_id IS NOT NULL) WHERE rn = 1)"""
LT1 = """lt1 AS (SELECT lt_id, lt_ns, lt_title FROM (SELECT *, row_number() OVER (PARTITION BY lt_id ORDER BY loaded_at, lt_title, lt_ns) AS rn
    FROM linktarget WHERE deleted_at IS NULL AND lt_id IS NOT NULL) WHERE rn = 1)"""
RD1 = """rd1 AS (SELECT rd_from, rd_ns, rd_title FROM (SELECT *, row_number() OVER (PARTITION BY rd_from ORDER BY loaded_at, rd_title, rd_ns) AS rn
    FROM redirect_raw WHERE rd_title IS NOT NULL AND rd_from IS NOT NULL) WHERE rn = 1)"""
CANON = """canon AS (SELECT page_id, page_title, CAST(row_number() OVER (ORDER BY page_id) - 1 AS INTEGER) AS node_idx FROM page1
    WHERE page_ns = 0 AND is_redirect = 0 AND NOT (page_title IS NOT NULL AND ends_with(page_title, '_(disambiguation)')))"""
TITLES = "titles AS (SELECT page_title AS title, max(page_id) AS page_id FROM page1 WHERE page_ns = 0 AND page_title IS NOT NULL GROUP BY 1)"
ENDS = """nxt AS (SELECT rd_from, CASE WHEN rd_ns = 0 THEN t.page_id END AS nxt FROM rd1 LEFT JOIN titles t ON t.title = rd_title),
  walk(start, cur, depth) AS (SELECT rd_from, rd_from, 0 FROM nxt UNION ALL SELECT w.start, n.nxt, w.depth + 1 FROM walk w JOIN nxt n ON n.rd_from = w.cur WHERE n.nxt IS NOT NULL AND w.depth < 100),
  stop AS (SELECT DISTINCT start, cur FROM walk WHERE cur NOT IN (SELECT rd_from FROM rd1)),
  ends AS (SELECT rd_from AS rd_from_id, s.cur AS canonical_id FROM rd1 LEFT JOIN stop s ON s.start = rd_from UNION SELECT cur, cur FROM stop)"""
EDGES = """target AS (SELECT lt_id, CASE WHEN e.rd_from_id IS NOT NULL THEN e.canonical_id ELSE t.page_id END AS page_id
    FROM lt1 JOIN titles t ON t.title = lt_title LEFT JOIN ends e ON e.rd_from_id = t.page_id WHERE lt_ns = 0),
  edges AS MATERIALIZED (SELECT DISTINCT s.node_idx AS src, c.node_idx AS dst FROM pagelinks_raw p JOIN target t ON t.lt_id = p.pl_target_id
    JOIN canon c ON c.page_id = t.page_id JOIN canon s ON s.page_id = p.pl_from WHERE s.node_idx <> c.node_idx)"""
BASE = f"WITH RECURSIVE {PAGE1}, {LT1}, {RD1}, {CANON}, {TITLES}, {ENDS}, {EDGES}"
