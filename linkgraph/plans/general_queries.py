"""Queries of the general data-quality operators: orphan references and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.wikitext import normalize_title, strip_blanks
from linkgraph.operators.heavy_keys import dense_sums, key_profile
from linkgraph.operators.orphans import lifetimes, month_label, month_number, orphans_by_integer, orphans_by_text, rows_of_orphans
from linkgraph.plans.session import shuffle_width, table


def _link_rows(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "pagelinks_raw")
        .where("pl_from is not null and pl_target_id is not null and loaded_at is not null")
        .select(F.col("pl_target_id").alias("key"), month_number(F.col("loaded_at")).alias("period"), F.col("pl_from").alias("from_id"))
    )


def _redirect_rows(spark: SparkSession, d: str) -> DataFrame:
    title = F.col("rd_title")
    return (
        table(spark, d, "redirect_raw")
        .where(F.col("rd_from").isNotNull() & F.col("loaded_at").isNotNull() & (F.col("rd_ns") == 0) & (strip_blanks(title) != ""))
        .select(normalize_title(title).alias("key"), month_number(F.col("loaded_at")).alias("period"), F.col("rd_from").alias("from_id"), title.alias("ref_key"))
    )


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "period").agg(F.count("*").alias("n"))


def _judged_links(spark: SparkSession, d: str) -> DataFrame:
    life = lifetimes(F.col("loaded_at"), F.col("deleted_at")).alias("life")
    parents = table(spark, d, "linktarget").select(F.col("lt_id").alias("key"), life)
    return orphans_by_integer(parents, _counted(_link_rows(spark, d)))


def _judged_redirects(spark: SparkSession, d: str) -> DataFrame:
    life = lifetimes(F.col("loaded_at"), F.col("deleted_at")).alias("life")
    parents = table(spark, d, "page").where("page_ns = 0").select(F.col("page_title").alias("key"), life)
    return orphans_by_text(parents, _counted(_redirect_rows(spark, d)), shuffle_width(spark) * 16)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references without a living target at the end of their month."""
    links, redirects = _link_rows(spark, d), _redirect_rows(spark, d)
    a = rows_of_orphans(links, _judged_links(spark, d), links.count()).select(
        F.lit("pagelinks_raw").alias("src_table"), "from_id", F.col("key").cast("string").alias("ref_key"), "period"
    )
    b = rows_of_orphans(redirects, _judged_redirects(spark, d), redirects.count()).select(F.lit("redirect_raw").alias("src_table"), "from_id", "ref_key", "period")
    return a.unionByName(b).distinct().withColumn("period", month_label(F.col("period")))


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table and month: rows that are references, and rows without a living target."""
    a = _judged_links(spark, d).select(F.lit("pagelinks_raw").alias("src_table"), "period", "n", "orphan")
    b = _judged_redirects(spark, d).select(F.lit("redirect_raw").alias("src_table"), "period", "n", "orphan")
    return (
        a.unionByName(b)
        .groupBy("src_table", "period")
        .agg(F.sum("n").alias("n_refs"), F.sum(F.when(F.col("orphan"), F.col("n")).otherwise(0)).alias("n_orphans"))
        .withColumn("period", month_label(F.col("period")))
    )


def p6_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct partners of every pl_target_id and every pl_from."""
    return key_profile(table(spark, d, "pagelinks_raw"), "pl_target_id", "pl_from")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys held by at least 1 % of the rows with a non-null value in their column: dense sums over the raw rows."""
    raw = table(spark, d, "pagelinks_raw").select("pl_target_id", "pl_from", F.lit(1).alias("n_rows"))
    totals = raw.agg(F.count("pl_target_id").alias("n0"), F.count("pl_from").alias("n1"))
    total = F.when(F.col("which") == 0, totals.select("n0").scalar()).otherwise(totals.select("n1").scalar())
    sums = dense_sums(raw, ["pl_target_id", "pl_from"], ["n_rows"])
    name = F.when(F.col("which") == 0, "pl_target_id").otherwise("pl_from")
    return sums.where(F.col("n_rows") * 100 >= total).select(name.alias("column_name"), F.col("key").alias("key_id"))


_LINK_JUDGED = """
links AS (SELECT 'pagelinks_raw' AS src_table, pl_from AS from_id, CAST(pl_target_id AS VARCHAR) AS ref_key,
    strftime(loaded_at, '%Y-%m') AS period,
    EXISTS (SELECT 1 FROM linktarget t WHERE t.lt_id = pl_target_id AND t.loaded_at < date_trunc('month', p.loaded_at) + INTERVAL 1 MONTH
        AND (t.deleted_at IS NULL OR t.deleted_at >= date_trunc('month', p.loaded_at) + INTERVAL 1 MONTH)) AS alive
  FROM pagelinks_raw p WHERE pl_from IS NOT NULL AND pl_target_id IS NOT NULL AND loaded_at IS NOT NULL),
named AS (SELECT *, replace(regexp_replace(rd_title, '^\\s+|\\s+$', '', 'g'), ' ', '_') AS t FROM redirect_raw WHERE rd_ns = 0 AND rd_from IS NOT NULL AND loaded_at IS NOT NULL),
redirects AS (SELECT 'redirect_raw' AS src_table, rd_from AS from_id, rd_title AS ref_key, strftime(loaded_at, '%Y-%m') AS period,
    EXISTS (SELECT 1 FROM page g WHERE g.page_ns = 0 AND g.page_title = upper(t[1:1]) || t[2:] AND g.loaded_at < date_trunc('month', p.loaded_at) + INTERVAL 1 MONTH
        AND (g.deleted_at IS NULL OR g.deleted_at >= date_trunc('month', p.loaded_at) + INTERVAL 1 MONTH)) AS alive
  FROM named p WHERE t <> ''),
refs AS (SELECT * FROM links UNION ALL SELECT * FROM redirects)
"""
_PROFILE = """
profile AS (
  SELECT 'pl_target_id' AS column_name, pl_target_id AS key_id, count(*) AS n_rows, count(DISTINCT pl_from) AS n_distinct
  FROM pagelinks_raw WHERE pl_target_id IS NOT NULL GROUP BY pl_target_id
  UNION ALL
  SELECT 'pl_from', pl_from, count(*), count(DISTINCT pl_target_id) FROM pagelinks_raw WHERE pl_from IS NOT NULL GROUP BY pl_from)
"""

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p6_found": p6_found, "p6_key_counts": p6_key_counts}
ORACLE = {
    "p1_found": f"WITH {_LINK_JUDGED} SELECT DISTINCT src_table, from_id, ref_key, period FROM refs WHERE NOT alive",
    "p1_orphan_report": f"""WITH {_LINK_JUDGED} SELECT src_table, period, count(*) AS n_refs,
        CAST(sum(CASE WHEN alive THEN 0 ELSE 1 END) AS BIGINT) AS n_orphans FROM refs GROUP BY src_table, period""",
    "p6_key_counts": f"WITH {_PROFILE} SELECT * FROM profile",
    "p6_found": f"""WITH {_PROFILE} SELECT column_name, key_id FROM profile
        JOIN (SELECT count(pl_target_id) AS nt, count(pl_from) AS nf FROM pagelinks_raw) ON TRUE
        WHERE n_rows * 100 >= CASE WHEN column_name = 'pl_from' THEN nf ELSE nt END""",
}
