import os
import random

import pytest
from pyspark.sql import functions as F

from linkgraph.llm import markup as M
from linkgraph.llm import matching as N
from linkgraph.llm import truncation as C

PLAIN = [
    "[Infobox: river]\n  name: Old Port\n  founded: 1792", "• One, 1799\n• Two, 1885", "See note 3 | note 4.", "About ~50 people (= half the crew).", "It cost $40 in May and $65 in June.",
    "Here a < b and b > 0 hold.", "It lay under C:\\scans\\maps for years.", "It ranked #4 on the R&D list.", "reads “anno [sic] domini”.", "fell by 3% -- more than 2^10 units", "the set {1, 2}", "M. & Co.", "5 * 3 plots",
    "The file old_map_v2 was lost.", "", "plain",
]
MARKED = {
    "a <b>x</b> c": "a x c", "a<br />b": "a\nb", "x&nbsp;y &amp; z": "x y & z", "a<!-- c -->b": "ab", "a<ref name=\"x\" />b<ref>p. 3</ref>c": "abc", "cut <span": "cut",
    "'''bold''' and ''it''": "bold and it", "[[A]] and [[b|c]]": "A and c", "[[broken\n  next: x": "broken\n  next: x", "{{nowrap|54 m}} x": "54 m x", "x {{sfn|A|3}} y": "x y", "{{ubl|a|b}}": "a, b", "{{formatnum:75}}": "75", "{{convert|3|km|mi}}": "3 km",
    "== Head ==\ntext": "Head\ntext", "### Head\ntext": "Head\ntext", "<h3>Head</h3>\ntext": "Head\n\ntext", "\\section{Head} text": "Head\n text", "* a\n* b": "• a\n• b", "# a\n# b": "• a\n• b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>": "• a\n\n• b",
    "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}": "• a\n\n• b", "> quoted": "quoted", "**x** ~~y~~ `z` __w__": "x y z w", "[t](http://e.x/1) ![p](i.png)": "t p", "[https://e.x/1 name]": "name",
    "| A | B |\n|---|---:|\n| 1 | 2 |": "A\tB\n\n1\t2", "{| class=\"w\"\n! Year !! N\n|-\n| 1 || 2\n|}": "Year\tN\n\n1\t2", "<table><tr><td>a</td><td>b</td></tr></table>": "a\tb", "\\textbf{x} \\cite{k} \\emph{y}": "x y",
    "let $x^2 + y$ be": "let $x^2 + y$ be", "\\(n = 4\\)": "$n = 4$", "<math>E = k</math>": "$E = k$", "$$\\int g$$": "$\\int g$", "```\nlet a = 1\n```": "    let a = 1", "<pre><code class=\"q\">a := 2;\n</code></pre>": "    a := 2;",
    "x {{a|{{b|{{c}}}}}} y": "x y", "[[File:a.jpg|thumb|View [[b]] c]]x": "x", "[[Category:Z]]": "", "__TOC__ x": " x",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_are_no_markup(text):
    assert M.pieces(text) == []


@pytest.mark.parametrize("text", MARKED)
def test_clean(text):
    assert M.pieces(text) and M.clean(text) == MARKED[text]


def test_clean_leaves_nothing_whatever_is_nested():
    import regex

    r = random.Random(4)
    parts = [x for x in MARKED if "```" not in x and "<pre" not in x] + PLAIN
    for _ in range(400):
        t = " ".join(r.choice(parts)[: r.choice([999, 999, 7])] for _ in range(4))
        left = regex.sub(r"\$[^$\n]*\$", "f", M.clean(t))
        bad = [k for k in M.pieces(left) if not k.startswith("latex formula")]
        assert not bad or r"\scans" in left, (t, left, bad)


def test_subtrees():
    t = "a <div><b>x</b> {{t|{{u}}}}</div> b <div><b>x</b>  {{t|{{u}}}}</div> <i>open"
    spans = M.subtrees(t)
    by_text = {t[a:b]: h for a, b, _, h in spans}
    assert by_text["<div><b>x</b> {{t|{{u}}}}</div>"] == by_text["<div><b>x</b>  {{t|{{u}}}}</div>"] and "{{u}}" in by_text
    assert len(set(by_text.values())) == 4 and M.without(t, [(a, b) for a, b, _, _ in spans]) == "a  b  <i>open"
    deep = "{{" * 20_000 + "}}" * 20_000
    assert len(M.subtrees(deep)) == 20_000
    assert M.subtrees("}} ]] </b> <!--") == [] and len(M.parse("}} ]] </b> <!--")) == 4
    assert M.parse(None) == M.parse("") == []
    open_inside = "<div>" + "<b>" * 300 + "</div>"  # however many are left open inside
    assert [n[:3] for n in M.subtrees(open_inside)] == [(0, len(open_inside), "html tag")] and len(M.parse(open_inside)) == 301


def test_tree_of_the_other_languages():
    t = "> quote\n> goes on\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n\\begin{center}x \\textbf{y}\\end{center} [[a]] {| b |} \\end{x}"
    whole = {(t[a:b], k) for a, b, k, _ in M.subtrees(t)}
    assert {("> quote\n> goes on", "markdown quote"), ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown table"), ("\\begin{center}x \\textbf{y}\\end{center}", "latex block"), ("[[a]]", "wiki link"), ("{| b |}", "wiki table")} <= whole
    assert [t[a:b] for a, b, _, h in M.parse(t) if h is None] == ["\\end{x}"]
    twice = "<div>a \\emph{b} ''c''</div> <div>a  \\emph{b} ''c''</div> <div>a \\emph{b} ''d''</div>"
    tags = [h for a, b, k, h in M.subtrees(twice) if k == "html tag"]
    assert len(tags) == 3 and tags[0] == tags[1] != tags[2]


def test_clean_fields(spark, monkeypatch):
    monkeypatch.setattr(M, "RECUR_PAGES", 5)
    data = [("h", i, -1, f"Page {i} <div>menu <b>home</b></div> {{{{own|{i}}}}} end", "x") for i in range(30)] + [("g", 1, 2, "<div>menu <b>home</b></div> stays", "x"), ("h", 99, -1, None, "x"), ("h", 98, -1, "", "x"), ("h", None, None, "''a''", "x")]
    df = spark.createDataFrame(data, "host string, page_id bigint, section_no int, text string, clean string")
    got = {(r["host"], r["page_id"]): r for r in M.clean_fields(df).collect()}
    assert got["h", 3]["clean"] == "Page 3 end" and got["h", 3]["n_removed"] == 2 and got["g", 1]["clean"].split() == ["menu", "home", "stays"]
    assert ("h", 99) not in got and got["h", 98]["n_kinds"] == 0 and got["h", None]["clean"] == "a"
    assert M.clean_fields(df.where("false")).count() == 0


def test_recurring_content_is_kept(spark, monkeypatch):
    monkeypatch.setattr(M, "RECUR_PAGES", 5)
    keep = {
        "location: A<br/>B": "location: A\nB", "<h2>History</h2>\nx": "History\n\nx", "see [[Country]] x": "see Country x", "is <math>E = k</math> x": "is $E = k$ x", "\\begin{equation}a_k\\end{equation}x": "$a_k$x",
        "<ul>\n<li>one</li>\n</ul>x": "• one\n\nx", "<pre>a := 2;</pre>x": "    a := 2;\nx", "{{nowrap|54 m}} x": "54 m x", "<div><h2>History</h2></div>x": "History\n\nx",
        "x <nav><h2>Menu</h2>Home</nav>{{stub}} y": "x y", "<div>menu</div>x": "x", "> This page is a stub.\n\nx": "x", "\\begin{center}Menu\\end{center}x": "x",
    }
    texts = list(keep)
    data = [(f"h{i}", p, -1, t) for i, t in enumerate(texts) for p in range(30)]
    got = {(r["host"], r["clean"]) for r in M.clean_fields(spark.createDataFrame(data, "host string, page_id bigint, section_no int, text string")).collect()}
    assert got == {(f"h{i}", keep[t]) for i, t in enumerate(texts)}


def test_clean_of_long_text():
    t = "word <b>x</b> [[a|b]] {{t|u}} $y$ \n" * 20_000
    assert M.pieces(M.clean(t).replace("$", "")) == []


TITLES = ["Mount_Vymhårvår", "Treaty_of_Xiszötxon", "Wutwoswas's_Law", "Wirvörzim_&_Sons", "County_of_Vérkurzel", "Qitwylvyn_University", "Zimzuszim", "Saint_Vérzinjun_Abbey"]
FREE = {
    "mount vymharvar": 0, "MOUNT__VYMHÅRVÅR": 0, "Mt. Vymhaarvaar": 0, "Xiszötxon, Treaty of": 1, "TreatyofXiszoetxon": 1, "“Wutwoswas’s Law”": 2, "Wirv%C3%B6rzim &amp; Sons": 3, "Wirvorzim and Sons?": 3, "Co._of_Verkurzel#History": 4,
    "Qitwylvyn Univ.": 5, "the Qiwtylvyn-Universiry": 5, " :zimzuszim\t": 6, "Zimzzuszim (page)": 6, "Zomzusim": 6, "St._Vérzinjun_Abbey.": 7,
}


def test_matching(spark):
    values = [*FREE, *TITLES, "the river", "?", "", " ", "Republic of imanim", "Ertostost_University", None, "x" * 50_000, "Zimzuszim"]
    df = spark.createDataFrame([(v, "clash") for v in values], "value string, entry string")
    more = [f"{x}_University" for x in ("Hanzwulov", "Morkzanter", "Kvelborun", "Jandrusk", "Pelgomat", "Bracholm", "Sunderwik", "Gaffelen", "Norvakin", "Dolmarek")]  # grams of usual words weigh little
    got = {r["value"]: r["entry"] for r in N.match_values(df, spark.createDataFrame([(t,) for t in [*TITLES, *more, TITLES[0], None]], "entry string")).collect()}
    assert got == {v: TITLES[i] for v, i in FREE.items()} | {t: t for t in TITLES} | dict.fromkeys(["the river", "?", "", " ", "Republic of imanim", "Ertostost_University", "x" * 50_000])
    rows = spark.createDataFrame([(1, "zimzuszim", "e"), (2, "nope", "e"), (3, None, "e")], "id int, title string, entry string")
    mapping = spark.createDataFrame([("zimzuszim", "Zimzuszim"), ("nope", None)], "value string, entry string")
    assert [tuple(r) for r in N.map_rows(rows, "title", mapping).select("id", "entry").collect()] == [(1, "Zimzuszim")]


def test_matching_in_blocks_and_of_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in [*FREE, *TITLES]], "value string")
    entries = spark.createDataFrame([(t,) for t in TITLES], "entry string")
    told = lambda: sorted(map(tuple, N.match_values(df, entries).select("value", "entry", F.round("score", 6)).collect()))
    whole = told()
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 2)
    monkeypatch.setattr(N, "TASK_VALUES", 5)
    assert told() == whole
    assert {r["entry"] for r in N.match_values(df, entries.where("false")).collect()} == {None}
    assert N.match_values(df.where("false"), entries).count() == 0


def test_candidates_hold_all_entries_that_matter(spark):
    """The index against all cosines, on the values of pages whose id is divisible by 100."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    entries = spark.read.parquet(f"{folder}/title_list.parquet").select(F.col("page_title").alias("entry")).distinct()
    names = [r[0] for r in entries.collect()]
    weight = N.gram_weights(entries, len(names))
    index = N.Index(names, weight)
    values = [r[0] for r in spark.read.parquet(f"{folder}/page_links.parquet").where("page_id % 100 = 0 and link_title is not null").select("link_title").distinct().collect()]
    assert len(values) > 300
    n_near = 0
    for s in filter(None, map(N.normalise, values)):
        g, w, head = N.weighted(s, weight)
        mine = dict(zip(g.tolist(), w.tolist(), strict=True))
        scores = [sum(mine.get(x, 0.0) * y for x, y in zip(v[0].tolist(), v[1].tolist(), strict=True)) for v in index.vectors]
        near = {i for i, c in enumerate(scores) if c >= N.FLOOR}
        n_near += len(near)
        assert near <= set(index.candidates(g, head).tolist())
        top = sorted(scores, reverse=True)
        _, first, second = index.best(s)
        for got, want in ((first, top[0]), (second, top[1])):
            assert got == pytest.approx(want, abs=1e-6) or (want < N.FLOOR and got <= want + 1e-6)
    assert n_near > 300


@pytest.mark.parametrize("seed", range(3))
def test_strict_prefixes(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(120)] + ["", None, "ab", "ab", "é", "éa"]
    got = {x["key"] for x in C.strict_prefixes(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()}
    keys = {x["key"]: x["text"] for x in spark.createDataFrame([(t,) for t in set(texts) if t], "text string").select(C.text_key("text").alias("key"), "text").collect()}
    assert {keys[k] for k in got} == {t for t in texts if t and any(u and u != t and u.startswith(t) for u in texts)}
    assert C.strict_prefixes(spark.createDataFrame([], "text string")).count() == 0


@pytest.mark.parametrize("text, how", [
    ("It ends.", "closed"), ("It ends.”", "closed"), ("It ends. 🙂", "closed"), ("It ends.</p>", "closed"), ("It ends. {{nowrap|54 m}}", "closed"), ("Ends.\n-- Ann Lee, 19 May", "closed"), ("Ends.\nhttps://a.example/page/1", "open"), ("Ends. {{box|" + "x" * 5000 + "}}", "closed"), ("Ends." + " [[Category:X]]" * 40, "closed"), ("It wa\ufffd", "marked"),
    ("Last page reads: “so it went on...”", "closed"), ("It was…", "marked"), ("It was [...]", "marked"), ("the...", "marked"), ("It was the", "open"), ("two of<ref name=\"ve", "open"), ("", "blank"), (" \n", "blank"), ("終わる。", "closed"), ("1893年の人", "open"),
])
def test_endings(text, how):
    assert C.ending(text)[0] == how


def documents_of(spark, texts):
    return spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in enumerate(texts)], "doc_id bigint, source string, text string, reason string")


def test_find_cut(spark):
    r = random.Random(6)
    words = ["castle", "river", "bridge", "tower", "garden", "market", "valley", "museum"]
    def sentence():
        return "The " + " ".join(r.choice(words) for _ in range(6)) + " stands here."
    data, cut = [], {}
    def add(source, text, why=None):
        data.append((source, text))
        if why:
            cut[len(data) - 1] = why
    for i in range(200):
        add("s", " ".join(sentence() for _ in range(r.randrange(2, 6))))
        add("l", "List\n" + "\n".join(f"Name{i} {r.choice(words)}, built {r.randrange(1500, 1999)}" for _ in range(r.randrange(3, 7))))
    add("s", sentence() + " The castle riv", "word")
    add("s", sentence() + " The castle river bridge", "sentence")
    add("s", sentence() + " The", "sentence")
    add("s", sentence() + " The castle…", "mark")
    add("s", sentence() + " The castle. River [...]", "mark")
    add("l", "List\nName1 castle, built 1700\nName2 tower, built 16", "sentence")
    add("s", "Castle. Gate", "longer copy")
    add("s", "Castle. Gate of the hall.")
    add("s", None)
    add("s", "")
    add("s", "  ")
    add("s", "w" * 300_000)
    add(None, "A full sentence.")
    documents = documents_of(spark, data)
    others = spark.createDataFrame([(sentence() + " and more.",), (None,)], "text string")
    got = {x["doc_id"]: x["reason"] for x in C.find_cut(documents, others).collect()}
    assert {k: v for k, v in got.items() if v} == cut and len(got) == sum(t is not None for _, t in data)
    assert C.find_cut(documents.where("false"), others.where("false")).count() == 0


def test_limit_with_a_longer_copy(spark):
    """A text closed by a full stop is cut if its length is a limit of its source and a longer copy exists."""
    long = [f"The hall of house {1000 + i} stands. It was sold {1000 + i} times and more." for i in range(40)]
    texts = [("f", t[:31]) for t in long[:20]] + [("f", t[:29] + " b") for t in long[20:]] + [("g", t) for t in long]
    got = {x["doc_id"]: x["reason"] for x in C.find_cut(documents_of(spark, texts), spark.createDataFrame([], "text string")).collect()}
    assert [got[i] for i in range(20)] == ["longer copy"] * 20 and not any(got[i] for i in range(40, 80))


def test_cuts_are_no_evidence_of_whole_lines(spark):
    """However often a cut ending recurs, it stays a cut; a usual last field stays whole."""
    whole = [f"Why the hall was sold is not known: the records of the guild were lost in {1500 + i}." for i in range(100)]
    fields = [f"The hall stands.\nCategory: {a} in Brundish" for a in ("Works", "Halls") for _ in range(50)]
    cut = [f"Why the {x} was sold is not known: the records of the" for x in ("mill", "inn", "barn", "dam", "well")] + ["Hall of the town.\nlabel: the records of"] * 2
    texts = [("s", t) for t in whole + fields + cut]
    got = {x["doc_id"] for x in C.find_cut(documents_of(spark, texts), spark.createDataFrame([], "text string")).where("reason is not null").collect()}
    assert got == set(range(len(whole) + len(fields), len(texts)))


def test_a_line_break_within_a_sentence_is_no_evidence(spark):
    """A sentence that once stands before a line break is still cut where its last words go on nearly always."""
    texts = [("s", f"Adults of kind {i} are found only near the river.") for i in range(300)] + [("s", "Adults of kind 77 are found\nonly near the river."), ("s", "It stands. Adults of kind 12 are found")]
    got = {x["doc_id"]: x["reason"] for x in C.find_cut(documents_of(spark, texts), spark.createDataFrame([], "text string")).where("reason is not null").collect()}
    assert got == {301: "pair"}


def test_prefix_documents(spark):
    texts = ["Ends here.", "Ends here. And more.", "Ends here. ", "Other.", "Oth", None, "", "Lead of a page"]
    got = [r["doc_id"] for r in C.prefix_documents(documents_of(spark, [("s", t) for t in texts]), spark.createDataFrame([("Lead of a page that goes on.",)], "text string")).collect()]
    assert sorted(got) == [0, 2, 4, 7]


def test_ending_of_long_text():
    assert C.ending("word " * 200_000 + "end")[0] == "open" and C.ending("<b>x</b> " * 50_000)[0] == "open"


@pytest.mark.parametrize("piece", ["\\( ", "$$ ", "<ref>x ", "<!-- ", "<math> ", "<pre>", "[[a|", "{{a|", "\n", "* ", "\\begin{equation}", "```\n", "== ", "| ", "''", "[x](", "<b ", "\t "])
def test_long_broken_markup_takes_linear_time(piece):
    import time

    t = "start " + piece * 30_000 + " end"
    began = time.time()
    M.pieces(t), M.clean(t), M.subtrees(t), C.ending(t)
    assert time.time() - began < 20
