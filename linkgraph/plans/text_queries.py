"""Queries over titles, wiki text, articles and what pages show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions import wikitext as W
from linkgraph.functions.arrow_text import infobox, link_contexts
from linkgraph.operators import articles, sessions
from linkgraph.plans import tables
from linkgraph.plans.session import checkpointed, once, table
from linkgraph.plans.tables import BASE

SEARCH = "museum"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))


def _on_documents(expression):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _texts(spark, d).select("doc_id", expression(F.col("t")).alias("text"))

    return query


def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "page_links").select(F.col("link_title").alias("title"))
    return links.unionByName(table(spark, d, "redirect_raw").select(F.col("rd_title").alias("title"))).select("title", W.normalize_title(F.col("title")).alias("normal"))


def outlinks(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(W.outlinks(F.col("t"))).alias("ordinal", "link_title"))


def infoboxes(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", infobox(F.col("t")).alias("infobox"))


def article_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", W.article_text(F.col("t"), infobox(F.col("t"))).alias("text"))


def article_sections(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(W.article_sections(F.col("t"))).alias("section_no", "s")).select("doc_id", "section_no", "s.*")


def linked_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.explode(link_contexts(F.col("t"))).alias("link")).select("doc_id", "link.*")


def lead_views(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", W.lead_view(F.col("text")).alias("v")).select("doc_id", "v.text", "v.truncated")


def _full_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per page; of repeated rows the greatest."""
    return table(spark, d, "parsed_article").where("page_id is not null").groupBy("page_id").agg(F.max("full_text").alias("text"))


def page_search(spark: SparkSession, d: str) -> DataFrame:
    return articles.search(_full_texts(spark, d), F.lit(SEARCH))


def link_budget(spark: SparkSession, d: str) -> DataFrame:
    """Budget over the outgoing links of each page, taken ten to a section."""
    counts = table(spark, d, "page_links").where("page_id is not null and ordinal is not null").groupBy("page_id", F.floor(F.col("ordinal") / 10).cast("int").alias("section_no")).agg(F.count("*").alias("n_links"))
    return articles.link_budget(counts, 12, 40)


def _legal(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        resolution = articles.title_resolution(tables.canonical(spark, d), tables.pages(spark, d), tables.redirect_ends(spark, d))
        return checkpointed(articles.legal_links(table(spark, d, "page_links"), resolution))

    return once(spark, [f"{d}/{name}.parquet" for name in ("page", "redirect_raw", "page_links")], "legal", build)


def legal_links(spark: SparkSession, d: str) -> DataFrame:
    return _legal(spark, d)


def path_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of start and target of each episode."""
    paths = table(spark, d, "episode").where("episode_id is not null").groupBy(F.col("episode_id").alias("id")).agg(F.min(F.struct("start_page_id", "target_page_id")).alias("p")).select("id", F.array("p.start_page_id", "p.target_page_id").alias("path"))
    return articles.path_titles(paths, tables.canonical(spark, d)).select("id", F.array_join("path", " > ").alias("path"))


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Article texts, lead texts and pages with either."""
    texts = _full_texts(spark, d)
    leads = table(spark, d, "lead_text").where("page_id is not null").groupBy("page_id").agg(F.max("lead_text").alias("lead_text"))
    return texts, leads, checkpointed(texts.select("page_id").unionByName(leads.select("page_id")).distinct().join(tables.canonical(spark, d).select("page_id", "page_title"), "page_id", "left"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """What every page with an article or a lead text shows."""
    told = articles.observations(*_observed(spark, d), _legal(spark, d))
    return told.withColumn("sections", F.to_json("sections")).withColumn("links_by_section", F.to_json("links_by_section"))


def observation_heads(spark: SparkSession, d: str) -> DataFrame:
    """Title, infobox, lead and number of links that every page shows."""
    return articles.observations(*_observed(spark, d), _legal(spark, d)).drop("sections", "links_by_section")


def observation_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every page with an article or a lead text, their legal links and how many of them are shown."""
    shown = articles.shown_sections(articles.page_texts(*_observed(spark, d)), _legal(spark, d))
    return shown.select("page_id", "section_no", "name", "level", F.col("n_links").cast("long").alias("link_count"), F.col("shown").cast("long").alias("shown"))


def observation_links(spark: SparkSession, d: str) -> DataFrame:
    """Legal links of the sections of every such page, with their context."""
    shown = articles.shown_sections(articles.page_texts(*_observed(spark, d)), _legal(spark, d))
    return shown.select("page_id", "section_no", F.posexplode("links").alias("i", "link")).select("page_id", "section_no", "i", "link.title", "link.context")


def section_titles(spark: SparkSession, d: str) -> DataFrame:
    """Link targets of each text, articles' texts included, in order."""
    texts = _texts(spark, d).unionByName(_full_texts(spark, d).select(F.col("page_id").alias("doc_id"), F.col("text").alias("t")))
    return texts.select("doc_id", F.posexplode(W.section_links(F.col("t"))).alias("ordinal", "title"))


_BOX_SIGNS = "|{}[]<>*="


def infobox_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The infobox of every article written as a template, with a date, a picture and a nested template added, and read back."""
    boxes = table(spark, d, "parsed_article").select("page_id", F.split(F.col("infobox"), "\n").alias("l"))
    plain = lambda c: F.translate(c, _BOX_SIGNS, "")
    fields = F.transform(F.filter("l", lambda x: F.contains(x, F.lit(":"))), lambda x: F.concat(F.lit("\n| "), plain(F.substring_index(x, ":", 1)), F.lit(" = "), plain(F.substring(x, F.locate(":", x) + 1, F.length(x)))))
    n = F.col("page_id")
    date = F.format_string("\n| born = {{Birth date and age|%d|%d|%02d|df=y}}<ref name=a />\n| Image = x.png\n| note = {{nowrap|a|b}} * one<br>\n* two\n| rest", (1800 + n % 200).cast("int"), (1 + n % 12).cast("int"), (1 + n % 28).cast("int"))
    text = F.concat(F.lit("Text {{x}} {{Infobox kind"), F.array_join(fields, ""), date, F.lit("\n}} more"))
    return boxes.where("l is not null and page_id is not null").select("page_id", infobox(text).alias("infobox"))


def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first section named History of each article, whatever its case."""
    parts = table(spark, d, "parsed_article").where("page_id is not null").select("page_id", F.explode("sections").alias("s")).select("page_id", "s.section_no", "s.name", "s.text", "s.links")
    return articles.get_section(parts, "history").select("page_id", "name", "text")


def heuristic_picks(spark: SparkSession, d: str) -> DataFrame:
    """The link of each page that a greedy reader on the way to the page of its first link's title would follow."""
    links = table(spark, d, "page_links").where("page_id is not null and link_title is not null")
    last = links.groupBy("page_id").agg(F.max(F.struct("ordinal", "link_title"))["link_title"].alias("target"))
    return sessions.heuristic_pick(links.join(last, "page_id").select(F.col("page_id").alias("id"), F.col("ordinal").alias("place"), F.col("link_title").alias("title"), "target"))


QUERIES = {
    "normalize_titles": normalize_titles,
    "tag_strip": _on_documents(W.strip_hidden_regions),
    "template_strip": _on_documents(W.strip_templates),
    "tail_strip": _on_documents(lambda c: W.strip_tail(c, W.LINK_TAIL)),
    "plain_text": _on_documents(W.plain_text),
    "lead_text": _on_documents(W.lead_text),
} | {
    f.__name__: f
    for f in (outlinks, infoboxes, article_texts, article_sections, linked_contexts, lead_views, page_search, link_budget, legal_links, path_titles, observations, observation_heads, observation_sections, observation_links, section_titles, infobox_roundtrip, section_lookup, heuristic_picks)
}
_WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _nest(text: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


# Written out here, so that the SQL doesn't follow the functions it checks.
_HIDDEN = [(f"(?s){p}", "") for p in (r"<ref[^>]*/>", r"<ref[^>]*>.*?</ref>", r"<!--.*?-->", r"<gallery[^>]*>.*?</gallery>", r"<math[^>]*>.*?</math>", r"<nowiki[^>]*>.*?</nowiki>")]
_TEMPLATES = [(r"\{\{[^{}]*\}\}", "")] * 10
_SHORT_TAIL = "navbox|authority control|taxonbar|portal bar|portal|commons category|wikiquote|wikisource|wiktionary|reflist|notelist|refbegin|refend"
_LINK_TAIL = f"{_SHORT_TAIL}|cite|citation|sfn|efn|cnote"
_READER_TAIL = f"{_SHORT_TAIL}|defaultsort|short description|use dmy|use mdy"


def _plain(text: str) -> str:
    t = _nest(_nest(text, _TEMPLATES), [(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1")])
    return _nest(f"replace(replace({t}, '''''''', ''), '''''', '')", [(r"<[^>]+>", "")])


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_LEAD = f"""WITH a AS (SELECT doc_id, {_nest(_plain(_nest(r"regexp_replace(text, '(?s)\n==[^=].*$', '')", _HIDDEN)), [(rf"\({_WS}*\)", ""), (rf"\[{_WS}*\]", ""), (" {2,}", " "), ("\\n{3,}", "\n\n")])} AS t FROM documents),
    b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_strip("t")}, chr(10) || chr(10)), lambda p: {_strip("p")}), lambda p: p <> '')[1:3], chr(10) || chr(10)) AS t FROM a)
    SELECT doc_id, CASE WHEN length(t) > 4000 THEN regexp_replace(t[1:4000], '(?s) [^ ]*$', '') || '...' ELSE t END AS text FROM b"""
_OVERLAP = """len(list_intersect(list_distinct(list_filter(string_split_regex(lower(replace(target, '_', ' ')), '[\\s\\p{Z}]+'), lambda w: w <> '')),
    list_distinct(list_filter(string_split_regex(lower(replace(link_title, '_', ' ')), '[\\s\\p{Z}]+'), lambda w: w <> ''))))"""
_LINE = _strip("l[i]")


def _tail_cut(names: str) -> str:
    return f"""array_to_string(l[1:list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(lower({_LINE}), '^\\{{\\{{{_WS}*(?:{names})')
    OR lower({_LINE}) = '' OR starts_with(lower({_LINE}), '[[category:') THEN 0 ELSE i END))], chr(10))"""


_EXCLUDED = "'File', 'Image', 'Category', 'Template', 'Talk', 'Portal', 'Wikipedia', 'Help', 'Draft', 'Module'"
_LINK = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"


def _titles(text: str) -> str:
    """List of the link targets of a text, each at its first place."""
    t = f"list_transform(regexp_extract_all({text}, '{_LINK}', 1), lambda x: replace({_strip('x')}, ' ', '_'))"
    return f"list_filter(list_transform({t}, lambda x: upper(x[1:1]) || x[2:]), lambda x: x <> '')"


def _sections(source: str) -> str:
    """CTEs that end in sec(id, section_no, name, level, text) of the texts of source(id, text)."""
    level = " ".join(f"WHEN regexp_matches(line, '^={{{n}}}{_WS}*.+?{_WS}*={{{n}}}{_WS}*$') THEN {n}" for n in range(6, 1, -1))
    name = " ".join(f"WHEN {n} THEN regexp_extract(line, '^={{{n}}}{_WS}*(.+?){_WS}*={{{n}}}{_WS}*$', 1)" for n in range(6, 1, -1))
    gap = "strpos(text, chr(10) || chr(10))"
    return f"""halves AS (SELECT id, CASE WHEN NOT starts_with(text, '[Infobox:') THEN '' WHEN {gap} > 0 THEN {_strip(f"text[1:{gap} - 1]")} ELSE text END AS box,
        CASE WHEN NOT starts_with(text, '[Infobox:') THEN text WHEN {gap} > 0 THEN {_strip(f"text[{gap}:]")} ELSE '' END AS body FROM {source} WHERE text <> ''),
      ln AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM halves),
      lv AS (SELECT *, CASE {level} END AS level FROM ln),
      pt AS (SELECT *, count(level) OVER (PARTITION BY id ORDER BY i) AS part, CASE level {name} END AS name FROM lv),
      tx AS (SELECT id, part, max(level) AS level, max(name) AS name, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level IS NULL), '') AS text FROM pt GROUP BY id, part),
      n_of AS (SELECT id, max(part) AS n FROM tx GROUP BY id),
      parts AS (SELECT id, -1 AS part, 'Infobox' AS name, 0 AS level, box AS text FROM halves WHERE len({_titles("box")}) > 0
        UNION ALL SELECT id, 0, 'Lead', 0, CASE WHEN n = 0 THEN text ELSE {_strip("text")} END FROM tx JOIN n_of USING (id) WHERE part = 0 AND (n = 0 OR {_strip("text")} <> '')
        UNION ALL SELECT id, part, {_strip("name")}, level, {_strip("text")} FROM tx WHERE part > 0),
      sec AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY part) - 1 AS INTEGER) AS section_no, name, CAST(level AS INTEGER) AS level, text FROM parts)"""


def _contexts(source: str) -> str:
    """CTEs that end in ctx(id, title, i, context) of the links of source(id, text), each title at its first place."""
    return f"""pc AS (SELECT id, text, string_split_regex(text, '{_LINK.replace("([^", "(?:[^", 1)}') AS p, regexp_extract_all(text, '{_LINK}', 0) AS k, regexp_extract_all(text, '{_LINK}', 1) AS raw FROM {source} WHERE text <> ''),
      at0 AS (SELECT id, text, unnest(range(1, len(k) + 1)) AS i, p, k, raw FROM pc),
      at1 AS (SELECT id, text, i, replace({_strip("raw[i]")}, ' ', '_') AS t, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(k[1:i - 1], lambda x: length(x))), 0) AS s, length(k[i]) AS n FROM at0),
      at2 AS (SELECT id, text, i, upper(t[1:1]) || t[2:] AS title, CAST(greatest(0, s - 80) AS BIGINT) AS a0, CAST(least(length(text), s + n + 80) AS BIGINT) AS b0 FROM at1 WHERE t <> ''),
      at3 AS (SELECT *, strpos(reverse(text[a0 - 19:a0 + 10]), ' ') AS left_, strpos(text[b0 - 9:b0 + 20], ' ') AS right_, length(text[a0 - 19:a0 + 10]) AS wide, row_number() OVER (PARTITION BY id, title ORDER BY i) AS rn FROM at2),
      at4 AS (SELECT id, title, i, text, CASE WHEN a0 >= 20 AND left_ > 0 THEN a0 - 20 + wide - left_ + 1 ELSE a0 END AS a, CASE WHEN b0 < length(text) AND right_ > 0 THEN b0 - 11 + right_ ELSE b0 END AS b FROM at3 WHERE rn = 1),
      ctx AS (SELECT id, title, i, CASE WHEN a > 0 THEN '...' ELSE '' END || {_strip(r"regexp_replace(text[a + 1:b], '\[\[(?:[^\[\]|]+\|(?:[^\[\]]*\|)?)?([^\[\]|]*)\]\]', '\1', 'g')")} || CASE WHEN b < length(text) THEN '...' ELSE '' END AS context FROM at4)"""


LEGAL = """lead_of AS (SELECT page_title AS title, min(page_id) AS dst FROM canon GROUP BY 1),
    red AS (SELECT page_title AS title, min(e.canonical_id) AS dst FROM page1 JOIN ends e ON e.rd_from_id = page1.page_id WHERE page_ns = 0 AND is_redirect = 1 AND e.canonical_id IS NOT NULL GROUP BY 1),
    legal AS (SELECT DISTINCT p.page_id, p.link_title AS title, coalesce(lead_of.dst, red.dst) AS dst FROM page_links p LEFT JOIN lead_of ON lead_of.title = p.link_title LEFT JOIN red ON red.title = p.link_title
      WHERE p.page_id IS NOT NULL AND p.link_title IS NOT NULL AND coalesce(lead_of.dst, red.dst) IS NOT NULL)"""
_OBSERVED = """full_of AS (SELECT page_id, max(full_text) AS text FROM parsed_article WHERE page_id IS NOT NULL GROUP BY 1), leads AS (SELECT page_id, max(lead_text) AS text FROM lead_text WHERE page_id IS NOT NULL GROUP BY 1),
    seen AS (SELECT id, coalesce(f.text, l.text, '') AS text FROM (SELECT page_id AS id FROM full_of UNION SELECT page_id FROM leads) LEFT JOIN full_of f ON f.page_id = id LEFT JOIN leads l ON l.page_id = id)"""
_SECTION_LINKS = f"""{BASE}, {LEGAL}, {_OBSERVED}, {_sections("seen")}, per_section AS (SELECT id AS page, section_no, text, CAST(id AS VARCHAR) || '/' || section_no AS id FROM sec), {_contexts("per_section")},
    kept AS (SELECT s.page AS page_id, s.section_no, c.title, c.context, c.i FROM ctx c JOIN per_section s USING (id) JOIN legal g ON g.page_id = s.page AND g.title = c.title),
    counted AS (SELECT s.id AS page_id, s.section_no, s.name, s.level, s.text, coalesce(n, 0) AS link_count FROM sec s LEFT JOIN (SELECT page_id, section_no, count(*) AS n FROM kept GROUP BY 1, 2) k ON k.page_id = s.id AND k.section_no = s.section_no)"""
# A link title in the form for look-ups.
TITLE = f"upper(replace({_strip('link_title')}, ' ', '_')[1:1]) || replace({_strip('link_title')}, ' ', '_')[2:]"
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_LEAD_VIEW = "CASE WHEN length(text) > 5000 THEN CASE WHEN strpos(reverse(text[1:5000]), ' .') > 0 AND 5000 - strpos(reverse(text[1:5000]), ' .') - 1 > 2000 THEN text[1:5000 - strpos(reverse(text[1:5000]), ' .')] ELSE text[1:5000] END ELSE text END"
ORACLE = {
    "tail_strip": f"WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, {_tail_cut(_LINK_TAIL)} AS text FROM s",
    "outlinks": f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, {_tail_cut(_LINK_TAIL)} AS body FROM s),
        r AS (SELECT doc_id, list_transform(regexp_extract_all(body, '\\[\\[([^\\]\\|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda t: {_strip("t")}) AS raw FROM b),
        k AS (SELECT doc_id, list_transform(list_filter(raw, lambda t: NOT (contains(t, ':') AND split_part(t, ':', 1) IN ({_EXCLUDED}))), lambda t: replace({_strip("split_part(t, '#', 1)")}, ' ', '_')) AS t FROM r),
        n AS (SELECT doc_id, list_filter(list_transform(t, lambda x: upper(x[1:1]) || x[2:]), lambda x: x <> '') AS t FROM k),
        d AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM n)
        SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ordinal, unnest(t) AS link_title FROM d""",
    "lead_views": """WITH h AS (SELECT doc_id, text, text[1:5000] AS head, coalesce(length(text) > 5000, FALSE) AS truncated FROM documents), c AS (SELECT *, length(head) - strpos(reverse(head), ' .') - 1 AS stop, strpos(reverse(head), ' .') > 0 AS has FROM h)
        SELECT doc_id, CASE WHEN truncated THEN CASE WHEN has AND stop > 2000 THEN head[1:stop + 1] ELSE head END ELSE text END AS text, truncated FROM c""",
    "normalize_titles": f"""WITH x AS (SELECT link_title AS title FROM page_links UNION ALL SELECT rd_title FROM redirect_raw),
        y AS (SELECT title, replace({_strip("title")}, ' ', '_') AS t FROM x) SELECT title, upper(t[1:1]) || t[2:] AS normal FROM y""",
    "tag_strip": f"SELECT doc_id, {_nest('text', _HIDDEN)} AS text FROM documents",
    "template_strip": f"SELECT doc_id, {_nest('text', _TEMPLATES)} AS text FROM documents",
    "plain_text": f"SELECT doc_id, {_plain('text')} AS text FROM documents",
    "lead_text": _LEAD,
    "page_search": f"""WITH t AS (SELECT page_id, max(full_text) AS text FROM parsed_article WHERE page_id IS NOT NULL GROUP BY 1), s AS (SELECT page_id, string_split(text, chr(10)) AS l FROM t WHERE text IS NOT NULL),
        h AS (SELECT page_id, l, list_filter(range(1, len(l) + 1), lambda i: contains(lower(l[i]), '{SEARCH}')) AS hits FROM s),
        e AS (SELECT page_id, CAST(len(hits) AS INTEGER) AS total_matches, l, unnest(hits[1:10]) AS n FROM h)
        SELECT page_id, total_matches, CAST(n AS INTEGER) AS line_number, array_to_string(l[greatest(n - 1, 1):n + 1], chr(10)) AS context FROM e""",
    "link_budget": """WITH c AS (SELECT page_id, CAST(ordinal // 10 AS INTEGER) AS section_no, count(*) AS n_links FROM page_links WHERE page_id IS NOT NULL AND ordinal IS NOT NULL GROUP BY 1, 2)
        SELECT *, CAST(greatest(0, least(n_links, 12, 40 - coalesce(sum(least(n_links, 12)) OVER (PARTITION BY page_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS shown FROM c""",
    "legal_links": f"{BASE}, {LEGAL} SELECT * FROM legal",
    "article_sections": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_sections('src')} SELECT id AS doc_id, section_no, name, level, text FROM sec",
    "linked_contexts": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_contexts('src')} SELECT id AS doc_id, title, context FROM ctx",
    "section_titles": f"""WITH src AS (SELECT doc_id, text FROM documents UNION ALL SELECT page_id, max(full_text) FROM parsed_article WHERE page_id IS NOT NULL GROUP BY 1), l AS (SELECT doc_id, {_titles("text")} AS t FROM src),
        u AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM l) SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ordinal, unnest(t) AS title FROM u""",
    "infobox_roundtrip": f"""WITH b AS (SELECT page_id, list_filter(string_split(infobox, chr(10)), lambda x: contains(x, ':')) AS l FROM parsed_article WHERE infobox IS NOT NULL AND page_id IS NOT NULL),
        f AS (SELECT page_id, list_transform(l, lambda x: struct_pack(k := {_strip("translate(split_part(x, ':', 1), '|{}[]<>*=', '')")}, v := trim({_strip("regexp_replace(translate(x[strpos(x, ':') + 1:], '|{}[]<>*=', ''), ' {2,}', ' ', 'g')")}, ',') )) AS f FROM b),
        g AS (SELECT page_id, list_transform(list_filter(list_transform(f, lambda y: struct_pack(k := y.k, v := {_strip("y.v")})), lambda y: y.v <> '' AND y.k <> ''), lambda y: chr(10) || '  ' || y.k || ': ' || y.v) AS g FROM f)
        SELECT page_id, '[Infobox: kind]' || array_to_string(g, '') || chr(10) || '  born: ' || (1 + page_id % 28) || ' ' || ({_MONTHS})[1 + page_id % 12] || ' ' || (1800 + page_id % 200) || chr(10) || '  note: one , two' AS infobox FROM g""",
    "infoboxes": r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '\{\{[Ii]nfobox\s+[^|{}]') THEN '(a template)' ELSE '' END AS infobox FROM documents",
    "article_texts": f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, {_nest(_tail_cut(_READER_TAIL), _HIDDEN)} AS t FROM s),
        c AS (SELECT doc_id, {_nest(_nest(_nest("t", [(r"(?i)\[\[(?:File|Image):[^\]]*\]\]", ""), (r"(?i)\[\[Category:[^\]]*\]\]", "")]), _TEMPLATES), [])} AS t FROM b),
        e AS (SELECT doc_id, {_nest("replace(replace(t, chr(39) || chr(39) || chr(39), ''), chr(39) || chr(39), '')", [("<[^>]+>", ""), (" {2,}", " ")])} AS t FROM c)
        SELECT doc_id, {_strip(f"regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), chr(10)), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM e""",
    "observation_sections": f"""{_SECTION_LINKS} SELECT page_id, section_no, name, level, link_count,
        CAST(greatest(0, least(link_count, 50, 200 - coalesce(sum(least(link_count, 50)) OVER (PARTITION BY page_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS shown FROM counted""",
    "observation_links": f"{_SECTION_LINKS} SELECT page_id, section_no, CAST(row_number() OVER (PARTITION BY page_id, section_no ORDER BY i) - 1 AS INTEGER) AS i, title, context FROM kept",
    "observation_heads": f"""{_SECTION_LINKS}, first_lead AS (SELECT page_id, arg_min({_LEAD_VIEW}, section_no) AS lead_paragraph, arg_min(length(text) > 5000, section_no) AS lead_truncated FROM counted WHERE name = 'Lead' GROUP BY 1)
        SELECT h.id AS page_id, coalesce(canon.page_title, '') AS current_title, coalesce(v.box, '') AS infobox, coalesce(lead_paragraph, '') AS lead_paragraph, coalesce(lead_truncated, FALSE) AS lead_truncated,
          CAST(coalesce((SELECT sum(link_count) FROM counted WHERE counted.page_id = h.id), 0) AS BIGINT) AS total_link_count
        FROM seen h LEFT JOIN halves v ON v.id = h.id LEFT JOIN canon ON canon.page_id = h.id LEFT JOIN first_lead l ON l.page_id = h.id""",
    "path_titles": f"""{BASE}, e AS (SELECT DISTINCT episode_id AS id, start_page_id AS a, target_page_id AS b FROM episode)
        SELECT id, coalesce(x.page_title, '?' || a) || ' > ' || coalesce(y.page_title, '?' || b) AS path FROM e LEFT JOIN canon x ON x.page_id = a LEFT JOIN canon y ON y.page_id = b""",
    "section_lookup": """WITH s AS (SELECT page_id, unnest(sections) AS s FROM parsed_article WHERE page_id IS NOT NULL), r AS (SELECT DISTINCT page_id, s.section_no AS n, s.name AS name, s.text AS text FROM s WHERE lower(s.name) = 'history')
        SELECT page_id, arg_min(name, n) AS name, arg_min(struct_pack(t := text), n).t AS text FROM r GROUP BY 1""",
    "heuristic_picks": f"""WITH l AS (SELECT page_id, ordinal, link_title FROM page_links WHERE page_id IS NOT NULL AND link_title IS NOT NULL),
        t AS (SELECT page_id, link_title AS target FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ordinal DESC, link_title DESC) AS rn FROM l) WHERE rn = 1),
        r AS (SELECT page_id, link_title, row_number() OVER (PARTITION BY page_id ORDER BY lower(replace(link_title, '_', ' ')) = lower(replace(target, '_', ' ')) DESC, {_OVERLAP} DESC, ordinal, link_title DESC) AS rn FROM l JOIN t USING (page_id))
        SELECT page_id AS id, link_title AS pick FROM r WHERE rn = 1""",
}
