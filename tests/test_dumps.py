import gzip

from conftest import rows
from pyspark.sql import functions as F

from linkgraph.sources import dumps


def fields(spark, *lines, table="t", keep=None):
    df = dumps.dump_rows(spark.createDataFrame([(x,) for x in lines], "value string"), table, keep)
    return [r["fields"] for r in df.orderBy("line", "part", "place").collect()]


def insert(values, table="t"):
    return f"INSERT INTO `{table}` VALUES {values};"


def test_basic_rows_between_other_lines(spark):
    got = fields(spark, "-- comment", "DROP TABLE x;", "CREATE TABLE `t` (a int);", insert("(1,'hello'),(2,'world')"))
    assert got == [["1", "hello"], ["2", "world"]]


def test_null_and_empty(spark):
    assert fields(spark, insert("(1,NULL,'foo',NULL)")) == [["1", None, "foo", None]]
    assert fields(spark, insert("(1,'')")) == [["1", ""]]
    assert fields(spark, insert("(1,,2)")) == [["1", None, "2"]]


def test_escapes(spark):
    assert fields(spark, insert(r"(1,'it\'s a test'),(2,'back\\slash')")) == [["1", "it's a test"], ["2", "back\\slash"]]
    assert fields(spark, insert("(1,'it''s doubled')")) == [["1", "it's doubled"]]
    assert fields(spark, insert(r"(1,'a\nb\tc\\nd\Z\b')")) == [["1", "a\nb\tc\\nd\x1ab"]]


def test_a_statement_quoted_in_a_value(spark):
    quoted = "INSERT INTO `t` VALUES (9,''z'');"
    assert fields(spark, insert(f"(1,'{quoted}'),(2,'b')") + insert("(3,'c')")) == [["1", quoted.replace("''", "'")], ["2", "b"], ["3", "c"]]


def test_several_inserts_and_other_tables(spark):
    assert fields(spark, insert("(1,'a'),(2,'b')"), insert("(3,'c')")) == [["1", "a"], ["2", "b"], ["3", "c"]]
    assert fields(spark, insert("(1,'skip')", "other"), insert("(2,'keep')")) == [["2", "keep"]]
    assert fields(spark, insert("(1,'skip')", "other") + insert("(2,'keep')")) == [["2", "keep"]]


def test_delimiters_inside_strings(spark):
    assert fields(spark, insert("(1,'hello (world), test; x')")) == [["1", "hello (world), test; x"]]


def test_chosen_places(spark):
    line = insert("(1,0,'Main_Page',0,0,0.778582,'20231201120000',NULL,12345,6789,'wikitext',NULL)")
    assert fields(spark, line, keep=[2, 0, 9, 40]) == [["Main_Page", "1", "6789", None]]


def test_very_long_fields_and_tuples(spark):
    long = "x" * 120_000
    assert fields(spark, insert(f"(1,'{long}')")) == [["1", long]]
    many = ",".join(["7"] * 20_000)
    assert fields(spark, insert(f"({many})")) == [["7"] * 20_000]


def test_load_table_types_filters_and_first_wins(spark):
    page = "(1,0,'A',0,0,0.5,'x',NULL,1,100,'w',NULL),(1,0,'B',0,0,0.5,'x',NULL,1,200,'w',NULL),(2,0,'C',1,0,0.5,'x',NULL,1,NULL,'w',NULL),(NULL,0,'D',1,0,0.5,'x',NULL,1,NULL,'w',NULL),('bad',0,'E',0,0,0,'',NULL,1,1,'w',NULL)"
    lines = spark.createDataFrame([(insert(page, "page"),)], "value string")
    assert rows(dumps.load_table(lines, "page")) == [(1, 0, "A", 0, 100), (2, 0, "C", 1, 0)]
    redirect = "(1,0,'A',NULL,NULL),(2,0,'B','',NULL),(3,0,'C','fr',NULL),(4,0,'D','NULL',NULL)"
    lines = spark.createDataFrame([(insert(redirect, "redirect"),)], "value string")
    assert rows(dumps.load_table(lines, "redirect")) == [(1, 0, "A"), (2, 0, "B"), (4, 0, "D")]
    lines = spark.createDataFrame([(insert("(1,0,5),(1,0,5),(2,1,6)", "pagelinks"),)], "value string")
    assert rows(dumps.load_table(lines, "pagelinks")) == [(1, 5), (1, 5)]
    lines = spark.createDataFrame([(insert("(1,'disambiguation',''),(2,'other','x')", "page_props"),)], "value string")
    assert rows(dumps.load_table(lines, "page_props")) == [(1, "disambiguation", "")]


def test_plain_and_gzip_files(spark, tmp_path):
    text = insert("(1,0,'plain'),(2,0,'b')", "linktarget") + "\n"
    (tmp_path / "a.sql").write_text(text)
    with gzip.open(tmp_path / "b.sql.gz", "wt") as f:
        f.write(text)
    for name in ("a.sql", "b.sql.gz"):
        assert rows(dumps.read_dump(spark, str(tmp_path / name), "linktarget")) == [(1, 0, "plain"), (2, 0, "b")]


def test_fast_pairs(spark):
    lines = spark.createDataFrame([("INSERT INTO `pagelinks` VALUES (1,0,10),(2,4,11),(3,0,12),(-4,0,13);",), ("",), (None,)], "value string")
    assert rows(dumps.link_pairs_fast(lines)) == [(1, 10), (3, 12)]


def test_round_trip_of_odd_strings(spark):
    texts = ["it's", "a\\b", "x\ny", "tab\t", "(1,'2')", "", "ünï", None, "''", "\\'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    lines = dumps.render_inserts(df, "t", ["id", "t"], per_line=3)
    got = {int(r["fields"][0]): r["fields"][1] for r in dumps.dump_rows(lines, "t").collect()}
    assert got == dict(enumerate(texts))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "value string")
    for name in dumps.TABLES:
        assert dumps.load_table(empty, name).count() == 0
    assert dumps.link_pairs_fast(empty).count() == 0


def test_first_wins_keeps_extra_columns(spark):
    df = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", "y"), (None, 0, "c", "z")], "k int, o int, v string, line string")
    assert rows(dumps.first_wins(df, ["k"], ["o"]).select("k", "v", "line")) == [(1, "a", "y")]
    assert dumps.first_wins(df.where(F.lit(False)), ["k"], ["o"]).count() == 0
