"""SQL dump text as typed DataFrames.

A dump is read as lines; each line that begins an INSERT of the table is cut into tuples, the
tuples into raw fields, and the fields the table needs are unescaped and cast. All of it is column
expressions with possessive patterns, which neither backtrack nor overflow on very long fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_STRING = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_TUPLE = rf"(?s)\(((?:{_STRING}|[^')]++)*+)\)"
_STATEMENT = rf"(?s)INSERT INTO `\w+` VALUES (?:[\s,]*+\((?:{_STRING}|[^')]++)*+\))*+"
_FIELD = rf"(?s)(?:^|,)((?:{_STRING}|[^',]++)*+)"
# What an escaped character stands for; any other stands for itself.
_ESCAPES = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\0": "\x00", "\\Z": "\x1a", "''": "'"}


@dataclass(frozen=True)
class TableSpec:
    """Which fields of a dump table are kept, as which typed columns, and which rows."""

    table: str
    fields: tuple[tuple[str, int, str], ...]  # column, place in the tuple, type
    key: tuple[str, ...]
    keep: str = "true"
    columns: tuple[str, ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()


# Places of the fields in the tuples of each dump table.
TABLES = {
    "page": TableSpec("page", (("page_id", 0, "bigint"), ("page_ns", 1, "int"), ("page_title", 2, "string"), ("is_redirect", 3, "int"), ("page_len", 9, "bigint")), ("page_id",), defaults=(("page_len", 0),)),
    "redirect": TableSpec("redirect", (("rd_from", 0, "bigint"), ("rd_ns", 1, "int"), ("rd_title", 2, "string"), ("interwiki", 3, "string")), ("rd_from",), "coalesce(interwiki, '') in ('', 'NULL')", ("rd_from", "rd_ns", "rd_title")),
    "linktarget": TableSpec("linktarget", (("lt_id", 0, "bigint"), ("lt_ns", 1, "int"), ("lt_title", 2, "string")), ("lt_id",)),
    "pagelinks": TableSpec("pagelinks", (("pl_from", 0, "bigint"), ("from_ns", 1, "int"), ("pl_target_id", 2, "bigint")), (), "from_ns = 0", ("pl_from", "pl_target_id")),
    "page_props": TableSpec("page_props", (("pp_page", 0, "bigint"), ("pp_propname", 1, "string"), ("pp_value", 2, "string")), ("pp_page", "pp_propname"), "pp_propname = 'disambiguation'"),
}


def raw_tuples(lines: DataFrame, table: str) -> DataFrame:
    """line, part, place, tuple: the text of each tuple that the lines (column value) insert into table.

    line (taken over if the lines have it), part and place rise within a file and tell which row comes first.
    """
    marker = f"INSERT INTO `{table}` VALUES "
    wanted = lines.where(F.contains("value", F.lit(marker)))
    wanted = wanted if "line" in wanted.columns else wanted.withColumn("line", F.monotonically_increasing_id())
    # A line may hold several statements; a statement is taken with its tuples, so what is quoted in them begins no other.
    mine = wanted.select("line", F.posexplode(F.regexp_extract_all("value", F.lit(_STATEMENT), 0)).alias("part", "text")).where(F.startswith("text", F.lit(marker)))
    return mine.select("line", "part", F.posexplode(F.regexp_extract_all(F.substring("text", len(marker) + 1, 2147483647), F.lit(_TUPLE), 1)).alias("place", "tuple"))


def raw_fields(tuple_: Column) -> Column:
    """The fields of a tuple as written, quotes included."""
    return F.regexp_extract_all(tuple_, F.lit(_FIELD), 1)


def unquoted(field: Column) -> Column:
    """The value of a raw field: null for NULL and for an unquoted empty field, strings unescaped.
    Text around the quotes stays."""
    inner = F.regexp_replace(field, r"(?s)^([^']*)'(.*)'([^']*)$", "$1$2$3")
    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)(\\.|''|[^\\'])"), 1)

    def decoded(t: Column) -> Column:
        told = F.when(F.length(t) == 1, t)
        for escape, char in _ESCAPES.items():
            told = told.when(t == escape, char)
        return told.otherwise(F.substring(t, 2, 1))

    quoted = F.contains(field, F.lit("'"))
    escaped = F.contains(inner, F.lit("\\")) | F.contains(inner, F.lit("''"))
    text = F.when(escaped, F.array_join(F.transform(tokens, decoded), "")).otherwise(inner)
    return F.when(quoted, text).when(field.isin("", "NULL"), None).otherwise(field)


def dump_rows(lines: DataFrame, table: str, keep: list[int] | None = None) -> DataFrame:
    """fields ARRAY<STRING> of every tuple of table, all or those at the places keep, in that order.
    A missing place is null."""
    fields = raw_fields(F.col("tuple"))
    chosen = F.transform(fields, unquoted) if keep is None else F.array(*(unquoted(F.get(F.col("raw"), F.lit(i))) for i in keep))
    tuples = raw_tuples(lines, table).withColumn("raw", fields)
    return tuples.select("line", "part", "place", chosen.alias("fields"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order; rows with a null key are dropped. Partial minima are taken before
    the shuffle, so a key with very many repeats gathers nowhere."""
    kept = rows.where(" and ".join(f"`{k}` is not null" for k in key))
    return kept.groupBy(*key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("row")).select(*key, "row.*")


def load_table(lines: DataFrame, name: str) -> DataFrame:
    """A dump table by its spec: parsed, cast, filtered, first row per key kept; rows that cannot be
    cast are dropped. Tables without a key keep repeated rows."""
    spec = TABLES[name]
    rows = dump_rows(lines, spec.table, [place for _, place, _ in spec.fields])
    typed = rows.select("line", "part", "place", *(F.get("fields", F.lit(i)).try_cast(kind).alias(c) for i, (c, _, kind) in enumerate(spec.fields)))
    defaults = dict(spec.defaults)
    for c, v in defaults.items():
        typed = typed.withColumn(c, F.coalesce(c, F.lit(v)))
    required = [c for c, _, _ in spec.fields if c not in defaults and c not in ("interwiki", "pp_value")]
    good = typed.where(" and ".join(f"`{c}` is not null" for c in required)).where(spec.keep)
    columns = list(spec.columns) or [c for c, _, _ in spec.fields]
    if spec.key:
        good = first_wins(good.select("line", "part", "place", *columns), list(spec.key), ["line", "part", "place"])
    return good.select(*columns)


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line (its order) of a .sql or .sql.gz file.

    A .gz file is unpacked in one task, as the format demands; its lines are spread right after, so that all parsing is done by all.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return lines.repartition("line") if any(f.endswith(".gz") for f in lines.inputFiles()) else lines


def read_dump(spark: SparkSession, path: str, name: str) -> DataFrame:
    """load_table over a .sql or .sql.gz file."""
    return load_table(dump_lines(spark, path), name)


def link_pairs_fast(lines: DataFrame) -> DataFrame:
    """pl_from, pl_target_id of all ``(a,0,b)`` triples, whatever statement they stand in."""
    pattern = r"\((\d+),0,(\d+)\)"
    hits = F.explode(F.regexp_extract_all("value", F.lit(rf"(\(\d+,0,\d+\))"), 1))
    return lines.select(hits.alias("hit")).select(
        F.regexp_extract("hit", pattern, 1).try_cast("bigint").alias("pl_from"), F.regexp_extract("hit", pattern, 2).try_cast("bigint").alias("pl_target_id")
    )


def render_inserts(rows: DataFrame, table: str, columns: list[str], per_line: int = 500) -> DataFrame:
    """value: INSERT lines with the rows; the counterpart of dump_rows, used for round trips and exports."""
    def literal(c: str) -> Column:
        v = F.col(c)
        if rows.schema[c].dataType.typeName() != "string":
            return F.coalesce(v.cast("string"), F.lit("NULL"))
        e = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        for escape, char in _ESCAPES.items():
            if escape != "''":
                e = F.replace(e, F.lit(char), F.lit(escape))
        return F.coalesce(F.concat(F.lit("'"), e, F.lit("'")), F.lit("NULL"))

    one = rows.select(F.concat(F.lit("("), F.concat_ws(",", *(literal(c) for c in columns)), F.lit(")")).alias("t"), F.floor(F.monotonically_increasing_id() / per_line).alias("g"))
    return one.groupBy("g").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("t"), ","), F.lit(";")).alias("value")).select("value")
