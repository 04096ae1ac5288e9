"""Canonical pages, dense node numbers and the resolution of redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed

#: Bits of the width of the key ranges within which rows are numbered.
RANGE_BITS = 12


def dense_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name INT = rank of the unique integer key, from 0 on.

    Numbered within ranges of RANGE_BITS bits of the key, each moved on by the number of rows in the
    ranges before it. These counts are summed up in the same way within ranges of ranges, so no
    window sees more than 2 ** RANGE_BITS rows, or 2 ** 16 counts, however sparse the keys are.
    """
    ranged = rows.withColumn("_r0", F.shiftright(F.col(key).cast("long"), RANGE_BITS))
    counts = [ranged.groupBy("_r0").agg(F.count("*").alias("_n")).withColumn("_r1", F.shiftright("_r0", 16))]
    counts.append(counts[0].groupBy("_r1").agg(F.sum("_n").alias("_n")).withColumn("_r2", F.shiftright("_r1", 16)))
    counts.append(counts[1].groupBy("_r2").agg(F.sum("_n").alias("_n")).withColumn("_r3", F.lit(0)))
    before = None
    for level in (2, 1, 0):
        inside = F.sum("_n").over(Window.partitionBy(f"_r{level + 1}").orderBy(f"_r{level}")) - F.col("_n")
        told = counts[level].withColumn("_in", inside).drop("_n")
        told = told.withColumn("_above", F.lit(0)) if before is None else told.join(before.withColumnRenamed("_before", "_above"), f"_r{level + 1}")
        before = told.select(f"_r{level}", (F.col("_in") + F.col("_above")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r0").orderBy(key)) - 1
    return ranged.withColumn("_inside", inside).join(before, "_r0").withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_r0", "_before", "_inside")


def canonical_pages(page: DataFrame, props: DataFrame) -> DataFrame:
    """page_id, page_title, node_idx: articles that are neither redirects nor marked as disambiguation.

    page: page_id (unique), page_ns, page_title, is_redirect; props: pp_page, pp_propname.
    """
    marked = props.where("pp_propname = 'disambiguation' and pp_page is not null").select(F.col("pp_page").alias("page_id")).distinct()
    articles = page.where("page_ns = 0 and is_redirect = 0 and page_id is not null").select("page_id", "page_title")
    return dense_index(articles.join(marked, "page_id", "left_anti"), "page_id", "node_idx")


def title_index(page: DataFrame) -> DataFrame:
    """title, page_id of the ns-0 pages; of several pages with one title the one with the largest id."""
    return page.where("page_ns = 0 and page_title is not null").groupBy(F.col("page_title").alias("title")).agg(F.max("page_id").alias("page_id"))


def redirect_map(redirect: DataFrame, page: DataFrame) -> DataFrame:
    """rd_from_id, canonical_id: where every redirect ends, by pointer jumping.

    A redirect ends at the first page that isn't a redirect itself; null if the way leaves
    namespace 0, meets a missing title or runs in a cycle. The ends themselves map to themselves.
    Every round halves the length of the ways, so a chain of n redirects takes log2(n) rounds; rounds
    stop when no way gets shorter any more, and what is then left are cycles and ways into them.
    redirect: rd_from (unique), rd_ns, rd_title.
    """
    rows = redirect.where("rd_from is not null").select("rd_from", F.when(F.col("rd_ns") == 0, F.col("rd_title")).alias("title"))
    first = checkpointed(join_unique(checkpointed(rows), title_index(page), "title", "left").select("rd_from", F.col("page_id").alias("to")))
    sources = first.select(F.col("rd_from").alias("to"), F.lit(True).alias("onward"))
    told = checkpointed(join_unique(first, sources, "to", "left").select("rd_from", "to", F.coalesce("onward", F.lit(False)).alias("open")))
    done, left = told.where("not open").drop("open"), told.where("open").drop("open")
    n = left.count()
    while n:
        # Of a pointer's own pointer: where it leads and whether that is an end.
        steps = done.select(F.col("rd_from").alias("to"), F.col("to").alias("next"), F.lit(True).alias("end")).unionByName(
            left.select(F.col("rd_from").alias("to"), F.col("to").alias("next"), F.lit(False).alias("end"))
        )
        moved = checkpointed(join_unique(left, steps, "to", "left").select("rd_from", F.col("next").alias("to"), "end"))
        done = checkpointed(done.unionByName(moved.where("end").drop("end")))
        left, before = moved.where("not end").drop("end"), n
        n = left.count()
        if n == before:
            break
    cycles = left.select("rd_from", F.lit(None).cast("long").alias("to"))
    ends = done.where("to is not null").select(F.col("to").alias("rd_from"), "to").distinct()
    return done.unionByName(cycles).unionByName(ends).select(F.col("rd_from").alias("rd_from_id"), F.col("to").alias("canonical_id"))
