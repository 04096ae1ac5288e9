import bz2
import gzip
import json

import pytest
from conftest import rows

from linkgraph.plans.pipeline import Build, Manifest, Tools, find_file, run_steps
from linkgraph.sources import articles_dump, episodes

FIELDS = ("e1", "dev", 0, 1, 5, "A", "E", 3, "easy", 12)


def xml_page(page_id, title, texts):
    revisions = "".join(f"<revision><id>9{page_id}</id><text>{t}</text></revision>" for t in texts)
    return f"<page><title>{title}</title><ns>0</ns><id>{page_id}</id>{revisions}</page>"


@pytest.fixture
def dump(tmp_path):
    blocks = [
        "<mediawiki xmlns='http://example.invalid/x'><siteinfo></siteinfo>",
        xml_page(1, "A", [" lead [[B]] '''x'''\n== H ==\nmore [[R]] "]) + xml_page(2, "B: two", ["old", "new [[C]] text"]),
        xml_page(3, "C", [""]) + xml_page(4, "D", ["fourth"]),
        "</mediawiki>",
    ]
    offsets, out = [], b""
    for b in blocks:
        offsets.append(len(out))
        out += bz2.compress(b.encode())
    (tmp_path / "x-pages-articles-multistream.xml.bz2").write_bytes(out)
    index = f"{offsets[1]}:1:A\n{offsets[1]}:2:B: two\n{offsets[2]}:3:C\n{offsets[2]}:4:D\nbad line\nx:5:Y\n"
    (tmp_path / "index.txt.bz2").write_bytes(bz2.compress(index.encode()))
    return tmp_path, offsets


def test_articles(spark, dump):
    path, offsets = dump
    got = dict(rows(articles_dump.read_articles(spark, str(path / "x-pages-articles-multistream.xml.bz2"))))
    assert set(got) == {1, 2, 4} and got[2] == "new [[C]] text" and got[1].startswith(" lead")
    index = articles_dump.read_index(spark, str(path / "index.txt.bz2")).cache()
    assert set(rows(index)) == {(offsets[1], 1, "A"), (offsets[1], 2, "B: two"), (offsets[2], 3, "C"), (offsets[2], 4, "D")} and index.count() == 4
    wanted = spark.createDataFrame([(2,), (4,), (77,)], "page_id bigint")
    blocks = articles_dump.blocks(articles_dump.offset_index(index, wanted))
    assert dict(rows(blocks)) == {offsets[1]: [2], offsets[2]: [4]}
    articles_dump.write_index(articles_dump.offset_index(index), str(path / "offsets"))
    assert rows(spark.read.parquet(str(path / "offsets")).where("page_id = 4")) == [(4, offsets[2])]
    assert rows(articles_dump.read_blocks(blocks, str(path / "x-pages-articles-multistream.xml.bz2"))) == [(2, "new [[C]] text"), (4, "fourth")]


def test_broken_block():
    good = xml_page(1, "A", ["x"])
    assert articles_dump.pages_in_block(f"{good}<page><id>2</id>".encode()) == [(1, "x")]
    assert articles_dump.pages_in_block(b"") == []


def test_episode_files(spark, tmp_path):
    df = spark.createDataFrame([FIELDS], episodes.EPISODE_SCHEMA)
    episodes.write_episodes(df, str(tmp_path / "e"))
    assert rows(episodes.read_episodes(spark, str(tmp_path / "e"))) == [FIELDS]
    episodes.write_review_sheet(df, str(tmp_path / "c"))
    text = max((f.read_text() for f in (tmp_path / "c").glob("*.csv")), key=len).splitlines()
    assert text[0].endswith("review_status,review_notes,replacement_for_episode_id") and text[1].endswith(",,,") and text[1].startswith("e1,dev,0")
    meta = json.loads(episodes.dataset_metadata(df, "x.jsonl", seed=42))
    assert meta["episode_count"] == 1 and meta["difficulty_counts"] == {"easy": 1} and meta["seed"] == 42
    (tmp_path / "bad.jsonl").write_text('{"episode_id": "a", "seed": "x"\n')
    with pytest.raises(Exception):
        episodes.read_episodes(spark, str(tmp_path / "bad.jsonl")).collect()


def test_steps(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    ran = []
    steps = {"a": lambda: ran.append("a") or 3, "b": lambda: None, "c": lambda: ran.append("c") or 0}
    assert run_steps(m, steps) == ["a", "c"] and m.get("n_a_rows") == "3" and m.get("step_b_done") is None and float(m.get("a_rows_per_second")) > 0 and m.get("b_seconds") is None
    assert run_steps(m, steps) == [] and run_steps(m, steps, "a", force=True) == ["a"] and ran == ["a", "c", "a"]
    with pytest.raises(KeyError):
        run_steps(m, steps, "z")
    assert find_file(spark, str(tmp_path), "nothing*") is None


def test_build_and_tools(spark, dump):
    path, _ = dump
    def put(name, table, values):
        with gzip.open(path / f"x-{name}.sql.gz", "wt") as f:
            f.write(f"INSERT INTO `{table}` VALUES {values};\n")
    def page(i, title, redirect=0):
        return f"({i},0,'{title}',{redirect},0,0.5,'x',NULL,1,100,'w',NULL)"
    put("page", "page", ",".join([page(1, "A"), page(2, "B"), page(3, "C"), page(4, "D"), page(6, "R", 1), page(7, "G")]))
    put("redirect", "redirect", "(6,0,'D','',NULL)")
    put("linktarget", "linktarget", "(101,0,'B'),(102,0,'C'),(103,0,'R'),(104,0,'G')")
    put("page_props", "page_props", "(7,'disambiguation','')")
    put("pagelinks", "pagelinks", "(1,0,101),(1,0,103),(2,0,102),(3,0,103),(1,0,104),(1,3,102)")
    build = Build(spark, str(path), str(path / "out"))
    assert build.run() == ["page", "redirect", "linktarget", "page_props", "pagelinks", "canonical", "redirects", "resolution", "graph", "offsets", "texts"]
    assert build.run() == []
    assert build.run("texts", force=True) == ["texts"] and build.table("texts").count() == 3  # replaced, not doubled
    build.table("texts").where("page_id <> 2").write.parquet(str(path / "some"))
    spark.read.parquet(str(path / "some")).write.mode("overwrite").parquet(str(path / "out" / "texts"))
    assert build.texts() == 3 and [len(x) for x in rows(build.page_links())] == [3] * 3  # only what is missing is added
    tools = Tools(build)
    assert rows(tools.edges) == [(0, 1), (0, 3), (1, 2), (2, 3)]
    assert rows(build.lead_texts()) == [(1, "lead B x"), (2, "new C text"), (4, "fourth")]
    seen = tools.get_page(spark.createDataFrame([(1,)], "page_id bigint")).first()
    assert [tuple(s) for s in seen["sections"]] == [("Lead", 0, 1), ("H", 2, 1)]
    assert tools.search_page(spark.createDataFrame([(1,)], "page_id bigint"), "MORE").first()["line_number"] == 3
    assert tools.get_section(spark.createDataFrame([(1,)], "page_id bigint"), "h").first()["links"][0]["title"] == "R"
    assert rows(tools.raw_pages([4, 99])) == [(4, "fourth")] and rows(tools.raw_pages([])) == []
    catalog = spark.createDataFrame([("e1", "dev", 0, 1, 3, "A", "C", 2, "easy", 12)], episodes.EPISODE_SCHEMA)
    assert tools.start_episode(catalog, 0).first()["current_title"] == "A"
    with pytest.raises(ValueError):
        tools.start_episode(catalog, 5)
    log = spark.createDataFrame([("e1", 1, "b"), ("e1", 2, "nope"), ("e1", 3, "C")], "episode_id string, seq int, title string")
    state = tools.click_links(catalog, log)
    score = tools.score_episodes(state, catalog).first()
    assert (score["success"], score["clicks"], score["invalid_actions"], score["shortest_path_len"], score["optimality_gap"]) == (True, 2, 1, 2, 0)
    m, traces = tools.evaluate(catalog)
    assert m.first()["n_scored"] == 1 and traces.first()["terminated_reason"] in ("success", "unknown", "step_limit")
    report = [json.loads(r["value"]) for r in episodes.report_json(spark.range(1), spark.range(2)).orderBy("part").collect()]
    assert report[0] == {"id": 0} and len(report) == 3
    from linkgraph.__main__ import main

    catalog_file, where = str(path / "catalog"), ["--raw", str(path), "--out", str(path / "out")]
    episodes.write_episodes(catalog, catalog_file)
    main([*where, "build"])
    main([*where, "build", "--step", "canonical", "--force"])
    main([*where, "evaluate", catalog_file, str(path / "report")])
    assert spark.read.text(str(path / "report")).count() == 2
    main([*where, "sample", str(path / "drawn"), "--n-total", "0", "--n-hard-bonus", "0"])
    assert episodes.read_episodes(spark, str(path / "drawn")).count() == 0
