import pytest
from pyspark.sql import functions as F

from linkgraph.functions import arrow_text as A
from linkgraph.functions import wikitext as W


def on(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("title, normal", [("  main page ", "Main_page"), ("", ""), ("élan", "Élan"), (" x ", "X"), ("a\tb", "A\tb"), (None, None), ("ßa", "SSa")])
def test_normalize_title(spark, title, normal):
    assert on(spark, W.normalize_title, title) == normal


def test_hidden_regions(spark):
    text = "a<ref name=x/>b<ref>c\nd</ref>e<!-- f\n -->g<gallery mode=y>h</gallery>i<math>j</math>k<nowiki>l</nowiki>m<references/>n"
    assert on(spark, W.strip_hidden_regions, text) == "abegikmn"


def test_templates(spark):
    assert on(spark, W.strip_templates, "a{{b|{{c}}}}d{{{e}}}f") == "ad{}f"
    deep = "{{" * 12 + "}}" * 12
    assert on(spark, W.strip_templates, deep) == "{{" * 2 + "}}" * 2


def test_tail(spark):
    text = "body\n{{not tail}}\n\n{{Reflist|2}}\n{{Navbox x}}\n[[Category:A]]\n"
    assert on(spark, lambda c: W.strip_tail(c, W.LINK_TAIL), text) == "body\n{{not tail}}"
    assert on(spark, lambda c: W.strip_tail(c, W.LINK_TAIL), "\n{{reflist}}") == ""
    assert on(spark, lambda c: W.strip_tail(c, W.READER_TAIL), "x\n{{cite}}") == "x\n{{cite}}"


def test_lead(spark):
    text = "{{Infobox x|a={{b}}}}\n'''Foo''' () is a [[bar|baz]] [[qux]].<ref>no</ref>\n\nTwo  words.\n\nThree.\n\nFour.\n== Head ==\nBody"
    assert on(spark, W.lead_text, text) == "Foo is a baz qux.\n\nTwo words.\n\nThree."
    long = "word " * 1000
    got = on(spark, W.lead_text, long)
    assert got == long[:4000].rsplit(" ", 1)[0] + "..."
    assert on(spark, W.lead_text, "") == "" and on(spark, W.lead_text, None) is None


def test_outlinks(spark):
    text = "[[a]] [[b|x]] [[a#frag]] [[File:z.png]] [[:Category:k]] [[User:u]] [[#only]] [[c|]] [[ d e ]]\n{{Reflist}}\n[[Category:q]]"
    assert on(spark, W.outlinks, text) == ["A", "B", ":Category:k", "User:u", "D_e"]


def test_sections(spark):
    text = "[Infobox: x]\n  a: [[Link]]\n\nLead text.\n== One ==\nBody 1\n=== Two ===\n\nBody 2\n"
    got = [tuple(s) for s in on(spark, W.article_sections, text)]
    assert got == [("Infobox", 0, "[Infobox: x]\n  a: [[Link]]"), ("Lead", 0, "Lead text."), ("One", 2, "Body 1"), ("Two", 3, "Body 2")]
    assert [tuple(s) for s in on(spark, W.article_sections, "== A ==\nx")] == [("A", 2, "x")]
    assert [tuple(s) for s in on(spark, W.article_sections, "plain")] == [("Lead", 0, "plain")]
    assert on(spark, W.article_sections, "") == []
    assert [tuple(s) for s in on(spark, W.article_sections, "[Infobox: x]\n  a: b")] == [("Lead", 0, "")]


def test_lead_view(spark):
    assert tuple(on(spark, W.lead_view, "short. ")) == ("short. ", False)
    text = "a" * 3000 + ". " + "b" * 3000
    assert tuple(on(spark, W.lead_view, text)) == ("a" * 3000 + ".", True)
    text = "a" * 1500 + ". " + "b" * 5000
    assert tuple(on(spark, W.lead_view, text)) == (text[:5000], True)


BOX = """{{Infobox person
| name = [[Ada|Ada L]]
| image = x.png
| birth_date = {{birth date and age|1815|12|10}}
| died = {{Death date and age|1852|11|27|1815|12|10}}
| month = {{start date|2001|03|4}}
| empty =
| known for = {{nowrap|x}} * one
* two <ref>r</ref>
}} Text {{x}}"""


RENDERED = "\n".join(["[Infobox: person]", "  name: [[Ada", "  birth_date: 10 December 1815", "  died: 10 December 1815", "  month: 4 03 2001", "  known for: one , two"])


@pytest.mark.parametrize("text, box", [
    (BOX, RENDERED), ("no box", ""), (None, None), ("", ""), ("{{Infobox x}}", ""), ("{{infobox y|a=b", "[Infobox: y]\n  a: b"), ("{{infobox y|a=b}} {{Infobox z|c=d}}", "[Infobox: y]\n  a: b"),
    ("{{Infobox x|a = {{t|b=c|{{u|d}}}} e|Image=f|g}}", "[Infobox: x]\n  a: e"), ("{{Infobox x\n|a={{{1|}}}\n|b=, y ,\n}}", "[Infobox: x]\n  a: {}\n  b: y"), ("{{Infobox x|a={{open|b=c}} ", "[Infobox: x]\n  a: {{open|b=c"),
])
def test_infobox(spark, text, box):
    assert on(spark, A.infobox, text) == box


def test_article_text(spark):
    text = BOX + "\n'''Bold''' [[File:a.png|thumb]] [[category:B]] <b>x</b>\n\n\n\n  next  line \n{{Navbox}}"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(W.article_text(F.col("t"), A.infobox(F.col("t"))).alias("x")).collect()
    assert got[0]["x"] == RENDERED + "\n\nText\nBold x\n\nnext line" and got[1]["x"] is None and got[2]["x"] == ""


def test_link_contexts(spark):
    text = "x " * 100 + "[[target one|shown]] and [[b]] " + "y " * 100
    got = A.links_with_context(text)
    assert [g["title"] for g in got] == ["Target_one", "B"]
    assert got[0]["context"].startswith("...x x") and "shown and b y" in got[0]["context"] and got[0]["context"].endswith("y...")
    assert A.links_with_context("[[a]] end") == [{"title": "A", "context": "a end"}]
    assert A.links_with_context(None) == []
    assert spark.createDataFrame([(None,)], "t string").select(A.link_contexts(F.col("t"))).first()[0] == []


def slow_context(text, start, end):
    """By counting blanks one by one."""
    a, b = max(0, start - 80), min(len(text), end + 80)
    if a >= 20:
        a = max((i + 1 for i in range(a - 20, min(a + 10, len(text))) if text[i] == " "), default=a)
    if b < len(text):
        b = min((i for i in range(b - 10, min(b + 20, len(text))) if text[i] == " "), default=b)
    return a, b


def test_contexts_against_counting():
    import random

    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["x", "yz", " ", "  ", "long" * 9]) for _ in range(r.randrange(60)))
        at = r.randrange(len(text) + 1)
        text = text[:at] + "[[T|shown]]" + text[at:]
        a, b = slow_context(text, at, at + 11)
        want = "..." * (a > 0) + text[a:b].replace("[[T|shown]]", "shown").strip() + "..." * (b < len(text))
        assert A.links_with_context(text) == [{"title": "T", "context": want}]
    assert A.links_with_context("[[a|b|c]] [[A]] [[d") == [{"title": "A", "context": "c A [[d"}]


def test_very_long_text(spark):
    text = "{{t|" + "word [[Link]] '''b''' " * 50_000 + "}}\n== H ==\n" + "x" * 200_000
    assert on(spark, W.article_sections, text)[-1]["text"] == "x" * 200_000
    assert on(spark, W.outlinks, text) == ["Link"]
    assert on(spark, W.lead_text, text) == ""
