"""What a page shows: legal links, sections with their links, the link budget, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions.arrow_text import link_contexts
from linkgraph.functions.wikitext import article_parts, article_sections, lead_view
from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed

#: Links shown of a section and of a page.
SECTION_LINKS, PAGE_LINKS = 50, 200


def title_resolution(canonical: DataFrame, page: DataFrame, redirects: DataFrame) -> DataFrame:
    """title, page_id that a clicked title leads to: a canonical page of that title, else the end of
    the redirect page of that title (which need not be canonical); of several the one with the smallest id."""
    direct = canonical.select(F.col("page_title").alias("title"), "page_id", F.lit(0).alias("rank"))
    pages = page.where("page_ns = 0 and is_redirect = 1 and page_title is not null").select(F.col("page_title").alias("title"), F.col("page_id").alias("rd_from_id"))
    indirect = pages.join(redirects.where("canonical_id is not null"), "rd_from_id").select("title", F.col("canonical_id").alias("page_id"), F.lit(1).alias("rank"))
    best = direct.unionByName(indirect).groupBy("title").agg(F.min(F.struct("rank", "page_id")).alias("b"))
    return best.select("title", "b.page_id")


def legal_links(page_links: DataFrame, resolution: DataFrame) -> DataFrame:
    """page_id, title, dst: distinct links of each page whose title leads somewhere; title as linked."""
    links = checkpointed(page_links.where("page_id is not null and link_title is not null").select("page_id", F.col("link_title").alias("title")).distinct())
    return join_unique(links, resolution.withColumnRenamed("page_id", "dst"), "title")


def path_titles(paths: DataFrame, titles: DataFrame) -> DataFrame:
    """id, path ARRAY<STRING>: page ids replaced by titles in order, ``?id`` where there is none.
    paths: id, path ARRAY<BIGINT>; titles: page_id, page_title."""
    steps = checkpointed(paths.select("id", F.posexplode("path").alias("i", "page_id")))
    named = join_unique(steps, titles.select("page_id", "page_title"), "page_id", "left")
    title = F.coalesce("page_title", F.concat(F.lit("?"), F.col("page_id").cast("string")))
    got = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", title.alias("t")))).alias("s")).select("id", F.col("s.t").alias("path"))
    return paths.select("id").join(got, "id", "left").withColumn("path", F.coalesce("path", F.expr("cast(array() as array<string>)")))


def link_budget(sections: DataFrame, per_section: int = SECTION_LINKS, total: int = PAGE_LINKS) -> DataFrame:
    """sections (page_id, section_no, n_links) with shown: links shown of each section when every
    section may show per_section and the page total, in order."""
    before = Window.partitionBy("page_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    wish = F.least("n_links", F.lit(per_section))
    return sections.withColumn("shown", F.greatest(F.lit(0), F.least(wish, F.lit(total) - F.coalesce(F.sum(wish).over(before), F.lit(0)))))


def sections_of(articles: DataFrame) -> DataFrame:
    """page_id, section_no, name, level, text, links of articles (page_id, text)."""
    parts = articles.select("page_id", F.posexplode(article_sections(F.col("text"))).alias("section_no", "s"))
    return parts.select("page_id", "section_no", "s.name", "s.level", "s.text").withColumn("links", link_contexts(F.col("text")))


def legal_sections(sections: DataFrame, legal: DataFrame) -> DataFrame:
    """sections with links filtered to the legal titles of their page, order kept."""
    each = sections.select("page_id", "section_no", F.posexplode("links").alias("i", "link")).withColumn("title", F.col("link.title"))
    kept = each.join(legal.select("page_id", "title").distinct(), ["page_id", "title"], "left_semi")
    lists = kept.groupBy("page_id", "section_no").agg(F.sort_array(F.collect_list(F.struct("i", "link"))).alias("l")).select("page_id", "section_no", F.col("l.link").alias("links"))
    empty = F.expr("cast(array() as array<struct<title:string,context:string>>)")
    return sections.drop("links").join(lists, ["page_id", "section_no"], "left").withColumn("links", F.coalesce("links", empty))


def page_texts(articles: DataFrame, lead_texts: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, page_title, text of pages: the article text, else the lead text, else nothing."""
    text = pages.join(articles.select("page_id", F.col("text").alias("article")), "page_id", "left").join(lead_texts.select("page_id", "lead_text"), "page_id", "left")
    return text.select("page_id", "page_title", F.coalesce("article", "lead_text", F.lit("")).alias("text"))


def shown_sections(texts: DataFrame, legal: DataFrame) -> DataFrame:
    """Sections of texts (page_id, text) with their legal links, n_links and shown."""
    return link_budget(legal_sections(sections_of(texts), legal).withColumn("n_links", F.size("links")))


def observations(articles: DataFrame, lead_texts: DataFrame, pages: DataFrame, legal: DataFrame) -> DataFrame:
    """What each page of pages (page_id, page_title) shows.

    The article text, else the lead text, else nothing. Of several sections of one name the last
    shown counts in links_by_section; sections after the budget is spent have no entry there.
    """
    texts = page_texts(articles, lead_texts, pages)
    shown = shown_sections(texts, legal)
    cut = F.slice("links", F.lit(1), F.col("shown"))
    entry = F.transform(cut, lambda x: F.struct(x["title"].alias("title"), x["context"].alias("context"), F.lit(None).cast("string").alias("note")))
    note = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("context"), F.format_string("...and %d more links (use get_section to see all)", F.col("n_links") - F.col("shown")).alias("note")))
    listed = F.when(F.col("n_links") > F.col("shown"), F.concat(entry, note)).otherwise(entry)
    lead = F.when(F.col("name") == "Lead", F.struct("section_no", lead_view(F.col("text")).alias("v")))
    by_page = shown.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("section_no", "name", "level", F.col("n_links").alias("link_count")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("shown") > 0, F.struct("section_no", "name", listed.alias("links"))))).alias("l"),
        F.min(lead).alias("lead"), F.sum("n_links").alias("total"),
    )
    last_of_name = F.filter("l", lambda x, i: ~F.exists(F.slice(F.col("l"), i + 2, F.greatest(F.size("l"), F.lit(1))), lambda y: y["name"] == x["name"]))
    return texts.join(by_page, "page_id", "left").select(
        "page_id", F.coalesce("page_title", F.lit("")).alias("current_title"), article_parts(F.col("text"))["infobox"].alias("infobox"),
        F.coalesce("lead.v.text", F.lit("")).alias("lead_paragraph"), F.coalesce("lead.v.truncated", F.lit(False)).alias("lead_truncated"),
        F.coalesce(F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["level"].alias("level"), x["link_count"].alias("link_count"))), F.expr("cast(array() as array<struct<name:string,level:int,link_count:int>>)")).alias("sections"),
        F.map_from_entries(F.transform(last_of_name, lambda x: F.struct(x["name"], x["links"]))).alias("links_by_section"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total_link_count"),
    )


def get_section(sections: DataFrame, name: str) -> DataFrame:
    """page_id, name, text, links of the first section of that name, whatever its case."""
    same = sections.where(F.lower("name") == name.lower())
    first = same.groupBy("page_id").agg(F.min_by(F.struct("name", "text", "links"), "section_no").alias("s"))
    return first.select("page_id", "s.*")


def search(texts: DataFrame, query: Column, max_results: int = 10) -> DataFrame:
    """page_id, total_matches, line_number, context: the first lines that hold the query, whatever its
    case, with the line before and after; at least one, at most max_results. An empty query is in every line.
    texts: page_id, text."""
    lines = F.split("text", "\n")
    hit = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(F.lower(x), F.lower(query)), i + 1)), lambda x: x.isNotNull())
    told = texts.where("text is not null").select("page_id", lines.alias("lines"), hit.alias("hits"))
    each = told.select("page_id", F.size("hits").alias("total_matches"), "lines", F.explode(F.slice("hits", 1, max(1, max_results))).alias("line_number"))
    start = F.greatest(F.col("line_number") - 1, F.lit(1))
    return each.select("page_id", "total_matches", "line_number", F.array_join(F.slice("lines", start, F.col("line_number") + 2 - start), "\n").alias("context"))
