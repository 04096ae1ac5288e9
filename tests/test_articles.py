from conftest import rows
from pyspark.sql import functions as F

from linkgraph.operators import articles


def frames(spark):
    canon = spark.createDataFrame([(1, "A", 0), (2, "B", 1), (3, "C", 2)], "page_id bigint, page_title string, node_idx int")
    page = spark.createDataFrame([(1, 0, "A", 0, 1), (2, 0, "B", 0, 1), (3, 0, "C", 0, 1), (6, 0, "R", 1, 1), (7, 0, "Dead", 1, 1), (8, 4, "R", 1, 1)], "page_id bigint, page_ns int, page_title string, is_redirect int, page_len bigint")
    ends = spark.createDataFrame([(6, 2), (2, 2), (7, None), (8, 3)], "rd_from_id bigint, canonical_id bigint")
    links = spark.createDataFrame([(1, "B", 0), (1, "R", 1), (1, "Dead", 2), (1, "Nowhere", 3), (1, "B", 4), (2, None, 0), (None, "A", 1)], "page_id bigint, link_title string, ordinal int")
    return canon, page, ends, links


def test_legal_links(spark):
    canon, page, ends, links = frames(spark)
    legal = articles.legal_links(links, articles.title_resolution(canon, page, ends))
    assert rows(legal.select("page_id", "title", "dst")) == [(1, "B", 2), (1, "R", 2)]


def test_path_titles(spark):
    canon = frames(spark)[0]
    paths = spark.createDataFrame([("x", [1, 9, 2, 1]), ("y", []), ("z", [3])], "id string, path array<bigint>")
    assert dict(rows(articles.path_titles(paths, canon))) == {"x": ["A", "?9", "B", "A"], "y": [], "z": ["C"]}


def test_link_budget(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([60, 30, 0, 80, 70, 90])], "page_id bigint, section_no int, n_links int")
    left, want = 200, []
    for n in [60, 30, 0, 80, 70, 90]:
        want.append(min(n, 50, left))
        left -= want[-1]
    assert [r["shown"] for r in articles.link_budget(df).orderBy("section_no").collect()] == want


def brute_search(text, query, most):
    lines = text.split("\n")
    hits = [i for i, x in enumerate(lines) if query.lower() in x.lower()]
    return [(len(hits), i + 1, "\n".join(lines[max(0, i - 1) : i + 2])) for i in hits[: max(1, most)]]


def test_search(spark):
    text = "Alpha (x)\nbeta\nALPHA\n\n.*gamma\nalpha"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "")], "page_id bigint, text string")
    for query, most in [("alpha", 10), ("alpha", 1), ("alpha", 0), (".*", 10), ("(x)", 10), ("", 3)]:
        got = [tuple(r)[1:] for r in articles.search(df.where("page_id = 1"), F.lit(query), most).orderBy("line_number").collect()]
        assert got == brute_search(text, query, most)
    assert {r["page_id"] for r in articles.search(df, F.lit("alpha")).collect()} == {1}


def test_observation(spark):
    canon, page, ends, links = frames(spark)
    legal = articles.legal_links(links, articles.title_resolution(canon, page, ends))
    many = " ".join(f"[[T{i}]]" for i in range(70))
    legal = legal.unionByName(spark.range(70).selectExpr("2L page_id", "concat('T', id) title", "3L dst")).unionByName(spark.range(2).selectExpr("2L page_id", "concat('S', id) title", "3L dst"))
    text = spark.createDataFrame([(1, "[Infobox: x]\n  k: [[R]]\n\nSee [[B|bee]], [[Nowhere]] and [[R]].\n== Twice ==\n[[Dead]]\n== Twice ==\n[[B]]"), (2, f"{many}\n== S ==\n[[S0]] [[S1]]")], "page_id bigint, text string")
    leads = spark.createDataFrame([(3, "Only a lead"), (1, "unused")], "page_id bigint, lead_text string")
    got = {r["page_id"]: r for r in articles.observations(text, leads, spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (9, None)], "page_id bigint, page_title string"), legal).collect()}
    one = got[1]
    assert [tuple(s) for s in one["sections"]] == [("Infobox", 0, 1), ("Lead", 0, 2), ("Twice", 2, 0), ("Twice", 2, 1)]
    assert [x["title"] for x in one["links_by_section"]["Lead"]] == ["B", "R"] and set(one["links_by_section"]) == {"Infobox", "Lead", "Twice"}
    assert one["infobox"] == "[Infobox: x]\n  k: [[R]]" and one["total_link_count"] == 4 and one["lead_paragraph"].startswith("See ")
    two = got[2]
    assert len(two["links_by_section"]["Lead"]) == 51 and two["links_by_section"]["Lead"][-1]["note"] == "...and 20 more links (use get_section to see all)"
    assert two["total_link_count"] == 72 and got[3]["lead_paragraph"] == "Only a lead" and got[9]["current_title"] == "" and got[9]["lead_paragraph"] == ""
    section = articles.get_section(articles.legal_sections(articles.sections_of(text), legal), "TWICE").first()
    assert section["name"] == "Twice" and section["text"] == "[[Dead]]" and section["links"] == []
