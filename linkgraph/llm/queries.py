"""Queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.wikitext import normalize_title, strip_blanks
from linkgraph.llm import groups, markup, matching, mixing, quota, sketch, tokenizer, truncation
from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed, table

#: Least share of the non-null rows of a frequent value.
FREQUENT = 0.005


def _category() -> tuple[Column, Column]:
    level = F.lower(strip_blanks(F.col("difficulty")))
    return F.when(level != "", level), F.when(F.col("shortest_path_len") > 0, F.col("shortest_path_len"))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = quota.usable(table(spark, d, "episode"), "episode_id", _category())
    targets = table(spark, d, "episode_target").select(
        "target_set", F.col("difficulty").alias("cat_a"), F.col("shortest_path_len").alias("cat_b"),
        *(F.col(c).cast("long").alias(c) for c in ("share_permille", "sample_permille", "min_rows")),
    )
    return items, quota.quotas(items, targets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of episode_target for which too few usable episodes exist."""
    return _plan(spark, d)[1].where("reach < need").select("target_set", F.col("cat_a").alias("difficulty"), F.col("cat_b").alias("shortest_path_len"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The episodes drawn for each target set."""
    items, plan = _plan(spark, d)
    return quota.take(items, plan).select("target_set", F.col("item").alias("episode_id"), F.col("cat_a").alias("difficulty"), F.col("cat_b").alias("shortest_path_len"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Quota, need and supply of each category, what the flow can give it of its need, and whether the target is met."""
    plan = _plan(spark, d)[1]
    return plan.select("target_set", F.col("cat_a").alias("difficulty"), F.col("cat_b").alias("shortest_path_len"), "available", "need", "quota", "reach", (F.col("reach") >= F.col("need")).alias("met"))


def p2_needs(spark: SparkSession, d: str) -> DataFrame:
    """What each category needs and has, and whether the flow meets it."""
    return p2_report(spark, d).drop("quota", "reach")


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    a = sketch.frequent(table(spark, d, "pagelinks_raw"), "pl_target_id", FREQUENT).withColumn("column_name", F.lit("pl_target_id"))
    return a.unionByName(sketch.frequent(table(spark, d, "page_links"), "link_title", FREQUENT).withColumn("column_name", F.lit("link_title")))


def _spellings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """value, entry, score of the distinct link titles that are no title of another page; and those that are."""
    entries = table(spark, d, "title_list").select(F.col("page_title").alias("entry"))
    values = table(spark, d, "page_links").where("link_title is not null").select(F.col("link_title").alias("value")).distinct()
    others = table(spark, d, "page").select(F.col("page_title").alias("value")).where("value is not null").distinct()
    others = others.join(entries.select(F.col("entry").alias("value")), "value", "left_anti")
    return checkpointed(matching.match_values(values.join(others, "value", "left_anti"), entries)), values.join(others, "value", "left_semi")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Links whose title is a free spelling of an entry of title_list, with that entry."""
    told, _ = _spellings(spark, d)
    links = table(spark, d, "page_links").select("page_id", "link_title")
    return matching.map_rows(links, "link_title", told.where("value <> entry")).select("page_id", "link_title", F.col("entry").alias("page_title")).distinct()


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct link title: mapped to which entry, of another page, or unmatched."""
    told, others = _spellings(spark, d)
    kind = F.when(F.col("entry").isNull(), "unmatched").when(F.col("value") == F.col("entry"), "entry").otherwise("mapped")
    return told.select(F.col("value").alias("link_title"), F.col("entry").alias("page_title"), "score", kind.alias("kind")).unionByName(
        others.select(F.col("value").alias("link_title"), F.lit(None).cast("string").alias("page_title"), F.lit(0.0).alias("score"), F.lit("other page").alias("kind"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values held by at least 0.5 % of the non-null rows."""
    return _frequent(spark, d).select("column_name", "item")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same values with their exact count and the sketch's bounds for it."""
    return _frequent(spark, d).select("column_name", "item", "n", "lower", "upper")


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """The frequent values with their exact count."""
    return p4_counts(spark, d).drop("lower", "upper")


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null text of the four fields, cleaned, with its field.

    The tables name no site. Pages with one type of infobox are made from one template, so field and
    type together stand for the host; leads and pages without a type have their field alone.
    """
    articles = table(spark, d, "parsed_article").withColumn("type", F.regexp_extract(F.coalesce("infobox", F.lit("")), r"^\s*\[Infobox:\s*([^\]\n]*)\]", 1))
    host = lambda field: F.concat_ws(":", F.lit(field), "type").alias("host")
    section = articles.select("page_id", "type", F.explode("sections").alias("s")).select(host("section_text"), "page_id", F.col("s.section_no").cast("int").alias("section_no"), F.col("s.text").alias("text"))
    whole = [articles.select(host(c), "page_id", F.lit(-1).alias("section_no"), F.col(c).alias("text")) for c in ("full_text", "infobox")]
    leads = table(spark, d, "lead_text").select(F.lit("lead_text:").alias("host"), "page_id", F.lit(-1).alias("section_no"), F.col("lead_text").alias("text"))
    told = markup.clean_fields(section.unionByName(whole[0]).unionByName(whole[1]).unionByName(leads))
    return told.withColumn("field", F.substring_index("host", ":", 1)).drop("host")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values whose tree of elements has a node: markup, whole or broken."""
    return _cleaned(spark, d).where("n_kinds > 0").select("field", "page_id", "section_no").distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every value as clean text."""
    return _cleaned(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of pages that redirects join, one row a page.

    A title takes part through the least of the living pages that bear it, so that many redirects
    to a title of many pages don't multiply.
    """
    title = F.col("rd_title")
    rows = (
        table(spark, d, "redirect_raw")
        .where(F.col("rd_from").isNotNull() & (F.col("rd_ns") == 0) & (strip_blanks(title) != ""))
        .select(normalize_title(title).alias("title"), F.col("rd_from").alias("a"))
    )
    pages = table(spark, d, "page").where("page_ns = 0 and deleted_at is null and page_title is not null and page_id is not null").select(F.col("page_title").alias("title"), F.col("page_id").alias("a"))
    named = checkpointed(pages.groupBy("title").agg(F.min("a").alias("b")).join(rows.select("title").distinct(), "title", "left_semi"))
    pairs = join_unique(rows, named, "title").unionByName(join_unique(pages, named, "title")).select("a", "b")
    return groups.connected_groups(pairs).select("group_id", F.col("vertex").alias("page_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text")


def plain_source() -> Column:
    """The source in the spelling of source_weight: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(strip_blanks(F.col("source"))), r"[\s-]+", "_")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("source", plain_source())
    return checkpointed(tokenizer.count_column(documents, "text", ["doc_id", "source"]))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: which copy of which document lies in which slot of the schedule."""
    sizes = _sizes(spark, d)
    return mixing.mix(sizes, mixing.plan(sizes, table(spark, d, "source_weight")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target share and share reached of each source, whether its repeats are used up, and how far it ever is from its share, in blocks."""
    sizes = _sizes(spark, d)
    planned = mixing.plan(sizes, table(spark, d, "source_weight"))
    mixed = checkpointed(mixing.mix(sizes, planned))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"))
    want = spark.createDataFrame([(p["source"], p["share"], p["available"], p["capped"]) for p in planned], "source string, target_share double, available_tokens bigint, capped boolean")
    total = got.agg(F.sum("mix_tokens").alias("total")).scalar()
    told = want.join(got, "source", "left").join(mixing.deviations(mixed, planned), "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0).cast("long")))
    return told.select("source", "target_share", "available_tokens", "mix_tokens", (F.col("mix_tokens") / total).alias("share_reached"), "capped", "max_deviation")


def _cut_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents").withColumn("source", plain_source())
    leads = table(spark, d, "lead_text").select(F.col("lead_text").alias("text"))
    return documents, leads.unionByName(table(spark, d, "parsed_article").select(F.col("full_text").alias("text")))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(*_cut_inputs(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _cut(spark, d).where("reason is not null").select("doc_id")


def p10_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Documents all of whose text is a strict prefix of another text, complete sentences included."""
    return truncation.prefix_documents(*_cut_inputs(spark, d))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts, by the value that told it."""
    by = _cut(spark, d).groupBy("source")
    counts = (F.count_if(F.col("reason") == r).alias("n_" + r.replace(" ", "_")) for r in truncation.REASONS)
    return by.agg(F.count("*").alias("n_texts"), F.count("reason").alias("n_cut"), *counts).withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))


_USABLE = """
usable AS (SELECT DISTINCT episode_id, lower(trim(difficulty)) AS difficulty, shortest_path_len FROM episode
  WHERE episode_id IS NOT NULL AND trim(difficulty) <> '' AND shortest_path_len > 0),
supply AS (SELECT difficulty, shortest_path_len, count(*) AS available FROM usable GROUP BY ALL)
"""

QUERIES = {
    "p2_found": p2_found, "p2_sample": p2_sample, "p2_report": p2_report, "p2_needs": p2_needs,
    "p3_found": p3_found, "p3_values": p3_values,
    "p4_found": p4_found, "p4_counts": p4_counts, "p4_exact": p4_exact,
    "p5_found": p5_found, "p5_clean": p5_clean,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_prefixes": p10_prefixes, "p10_sources": p10_sources,
}
ORACLE = {
    "p2_found": f"""WITH {_USABLE} SELECT target_set, t.difficulty, t.shortest_path_len FROM episode_target t LEFT JOIN supply USING (difficulty, shortest_path_len)
        WHERE coalesce(available, 0) < greatest(min_rows, (SELECT count(*) FROM usable) * sample_permille * share_permille / 1000000.0)""",
    "p2_needs": f"""WITH {_USABLE}, n AS (SELECT target_set, t.difficulty, t.shortest_path_len, coalesce(available, 0) AS available,
          CAST(greatest(min_rows, ceil(CAST((SELECT count(*) FROM usable) * sample_permille * share_permille AS DOUBLE) / 1000000)) AS BIGINT) AS need FROM episode_target t LEFT JOIN supply USING (difficulty, shortest_path_len))
        SELECT *, available >= need AS met FROM n""",
    "p4_exact": """SELECT 'pl_target_id' AS column_name, CAST(pl_target_id AS VARCHAR) AS item, count(*) AS n FROM pagelinks_raw WHERE pl_target_id IS NOT NULL
          GROUP BY 2 HAVING count(*) >= 0.005 * (SELECT count(pl_target_id) FROM pagelinks_raw)
        UNION ALL SELECT 'link_title', link_title, count(*) FROM page_links WHERE link_title IS NOT NULL
          GROUP BY 2 HAVING count(*) >= 0.005 * (SELECT count(link_title) FROM page_links)""",
    "p4_found": """SELECT 'pl_target_id' AS column_name, CAST(pl_target_id AS VARCHAR) AS item FROM pagelinks_raw WHERE pl_target_id IS NOT NULL
          GROUP BY 2 HAVING count(*) >= 0.005 * (SELECT count(pl_target_id) FROM pagelinks_raw)
        UNION ALL SELECT 'link_title', link_title FROM page_links WHERE link_title IS NOT NULL
          GROUP BY 2 HAVING count(*) >= 0.005 * (SELECT count(link_title) FROM page_links)""",
    "p10_prefixes": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x85]+$', '') AS text FROM documents),
        every AS (SELECT DISTINCT text FROM (SELECT text FROM t UNION ALL SELECT lead_text FROM lead_text UNION ALL SELECT full_text FROM parsed_article) WHERE text <> ''),
        n AS (SELECT text, lead(text) OVER (ORDER BY text) AS following FROM every)
        SELECT doc_id FROM t WHERE text IN (SELECT text FROM n WHERE starts_with(following, text))""",
    "p7_found": r"""WITH RECURSIVE named AS (SELECT rd_from, replace(regexp_replace(rd_title, '^\s+|\s+$', '', 'g'), ' ', '_') AS t FROM redirect_raw WHERE rd_ns = 0),
        pairs AS (SELECT DISTINCT rd_from AS a, page_id AS b FROM named JOIN page ON page_ns = 0 AND deleted_at IS NULL AND page_title = upper(t[1:1]) || t[2:] WHERE t <> '' AND rd_from <> page_id),
        both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach(v, g) AS (SELECT a, a FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.g = e.a)
        SELECT min(g) AS group_id, v AS page_id FROM reach GROUP BY v""",
}
