"""Column expressions over titles and wiki markup.

All work on whole strings with Java regular expressions, so they stay inside whole-stage codegen.
White space means Unicode white space and the separators U+001C to U+001F. A null gives a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x{1C}-\x{1F}]"

# Regions that are no visible text, in the order of their removal.
HIDDEN_REGIONS = (
    r"(?s)<ref[^>]*/>",
    r"(?s)<ref[^>]*>.*?</ref>",
    r"(?s)<!--.*?-->",
    r"(?s)<gallery[^>]*>.*?</gallery>",
    r"(?s)<math[^>]*>.*?</math>",
    r"(?s)<nowiki[^>]*>.*?</nowiki>",
)
INNERMOST_TEMPLATE = r"\{\{[^{}]*\}\}"
# Names with which templates at the end of a page begin; common to both lists, then one by one.
_TAIL = (
    "navbox", "authority control", "taxonbar", "portal bar", "portal", "commons category", "wikiquote", "wikisource", "wiktionary",
    "reflist", "notelist", "refbegin", "refend",
)
LINK_TAIL = (*_TAIL, "cite", "citation", "sfn", "efn", "cnote")
READER_TAIL = (*_TAIL, "defaultsort", "short description", "use dmy", "use mdy")
# Namespaces whose links are no article links.
EXCLUDED_NAMESPACES = ("File", "Image", "Category", "Template", "Talk", "Portal", "Wikipedia", "Help", "Draft", "Module")
LEAD_CHARS, LEAD_PARAGRAPHS = 4000, 3
LEAD_VIEW_CHARS, LEAD_VIEW_LEAST = 5000, 2000


def strip_blanks(c: Column) -> Column:
    """Removes white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def normalize_title(c: Column) -> Column:
    """Title form used for look-ups: stripped, blanks as underscores, first character upper case."""
    t = F.replace(strip_blanks(c), F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647))


def strip_hidden_regions(c: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), HIDDEN_REGIONS, c)


def strip_templates(c: Column, passes: int = 10) -> Column:
    """Innermost templates removed, pass after pass; what nests deeper than passes stays."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), c, lambda t, _: F.regexp_replace(t, INNERMOST_TEMPLATE, ""))


def strip_tail(c: Column, names: tuple[str, ...]) -> Column:
    """Cuts the lines after the last one that is not blank, a category or a template of names."""
    lines = F.split(c, "\n")

    def is_tail(line: Column) -> Column:
        s = F.lower(strip_blanks(line))
        name = strip_blanks(F.substring_index(F.substring_index(F.substring(s, 3, 2147483647), "|", 1), "}", 1))
        template = F.startswith(s, F.lit("{{")) & reduce(lambda a, b: a | b, (F.startswith(name, F.lit(n)) for n in names))
        return template | (s == "") | F.startswith(s, F.lit("[[category:"))

    last = F.array_max(F.transform(lines, lambda x, i: F.when(is_tail(x), 0).otherwise(i + 1)))
    return F.array_join(F.slice(lines, F.lit(1), last), "\n")


def plain_text(c: Column) -> Column:
    """Templates out, links as their display text, quotes and tags out."""
    t = F.regexp_replace(strip_templates(c), r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.replace(F.replace(t, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    return F.regexp_replace(t, r"<[^>]+>", "")


def lead_text(c: Column) -> Column:
    """The first paragraphs before the first heading as plain text, cut at a blank if too long."""
    before = F.regexp_replace(c, r"(?s)\n==[^=].*$", "")
    t = plain_text(strip_hidden_regions(before))
    for pattern, by in ((r"(?U)\(\s*\)", ""), (r"(?U)\[\s*\]", ""), (r" {2,}", " "), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    paragraphs = F.filter(F.transform(F.split(strip_blanks(t), "\n\n"), strip_blanks), lambda p: p != "")
    t = F.array_join(F.slice(paragraphs, 1, LEAD_PARAGRAPHS), "\n\n")
    head = F.substring(t, 1, LEAD_CHARS)
    return F.when(F.length(t) > LEAD_CHARS, F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(t)


def outlinks(c: Column) -> Column:
    """Titles of the article links of a page in order, each once."""
    body = strip_tail(c, LINK_TAIL)
    raw = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), 1), strip_blanks)
    kept = F.filter(raw, lambda t: ~(F.contains(t, F.lit(":")) & F.substring_index(t, ":", 1).isin(*EXCLUDED_NAMESPACES)))
    titles = F.transform(kept, lambda t: normalize_title(F.substring_index(t, "#", 1)))
    return F.array_distinct(F.filter(titles, lambda t: t != ""))


def section_links(c: Column) -> Column:
    """Titles of all links of a section in order, each once; fragments and namespaces stay."""
    raw = F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(raw, normalize_title), lambda t: t != ""))


def article_text(c: Column, infobox: Column) -> Column:
    """Page text with sections and links kept; infobox (already rendered) in front if there is one."""
    t = strip_hidden_regions(strip_tail(c, READER_TAIL))
    t = F.regexp_replace(t, r"(?iu)\[\[(?:File|Image):[^\]]*\]\]", "")
    t = strip_templates(F.regexp_replace(t, r"(?iu)\[\[Category:[^\]]*\]\]", ""))
    t = F.replace(F.replace(t, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r" {2,}", " ")
    t = F.array_join(F.transform(F.split(t, "\n"), strip_blanks), "\n")
    t = strip_blanks(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return F.when(F.coalesce(infobox, F.lit("")) != "", F.concat(infobox, F.lit("\n\n"), t)).otherwise(t)


_HEADING = r"(?md)^(={2,6})(?U:\s*)(.+?)(?U:\s*)\1(?U:\s*)$"


def article_parts(c: Column) -> Column:
    """STRUCT<infobox, body> of an article text: a leading infobox block ends at the first blank line."""
    has = F.startswith(c, F.lit("[Infobox:"))
    at = F.locate("\n\n", c)
    return F.struct(
        F.when(has & (at > 0), strip_blanks(F.substring_index(c, "\n\n", 1))).when(has, c).otherwise("").alias("infobox"),
        F.when(has & (at > 0), strip_blanks(F.substring(c, at, F.lit(2147483647)))).when(has, "").otherwise(c).alias("body"),
    )


def article_sections(c: Column) -> Column:
    """ARRAY<STRUCT<name, level, text>> of an article text: Infobox if it has links, Lead, sections.

    An empty text has no sections; a body without headings is the Lead, even if empty.
    """
    parts = article_parts(c)
    body, infobox = parts["body"], parts["infobox"]
    marks = F.regexp_extract_all(body, F.lit(_HEADING), 1)
    names = F.regexp_extract_all(body, F.lit(_HEADING), 2)
    texts = F.transform(F.split(body, _HEADING), strip_blanks)

    def section(name: Column, level: Column, text: Column) -> Column:
        return F.struct(name.alias("name"), level.cast("int").alias("level"), text.alias("text"))

    lead_if = F.when((F.size(marks) == 0), F.array(section(F.lit("Lead"), F.lit(0), body))).when(
        texts[0] != "", F.array(section(F.lit("Lead"), F.lit(0), texts[0]))
    ).otherwise(F.expr("cast(array() as array<struct<name:string,level:int,text:string>>)"))
    headed = F.transform(names, lambda n, i: section(strip_blanks(n), F.length(F.get(marks, i)), F.get(texts, i + 1)))
    box = F.when(F.size(section_links(infobox)) > 0, F.array(section(F.lit("Infobox"), F.lit(0), infobox))).otherwise(
        F.expr("cast(array() as array<struct<name:string,level:int,text:string>>)")
    )
    return F.when(c == "", F.expr("cast(array() as array<struct<name:string,level:int,text:string>>)")).otherwise(F.concat(box, lead_if, headed))


def lead_view(c: Column) -> Column:
    """STRUCT<text, truncated>: a lead as it is shown, cut after a sentence if too long."""
    head = F.substring(c, 1, LEAD_VIEW_CHARS)
    stop = F.length(head) - F.locate(" .", F.reverse(head)) - 1  # place of the last ". " counted from 0
    has = F.locate(" .", F.reverse(head)) > 0
    long = F.length(c) > LEAD_VIEW_CHARS
    cut = F.when(has & (stop > LEAD_VIEW_LEAST), F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    return F.struct(F.when(long, cut).otherwise(c).alias("text"), F.coalesce(long, F.lit(False)).alias("truncated"))
