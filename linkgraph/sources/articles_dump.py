"""The article dump: XML of concatenated bz2 streams and its index."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "id BIGINT, title STRING, revision ARRAY<STRUCT<text: STRUCT<_VALUE: STRING>>>"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """page_id, wikitext of every page with a text; of several revisions the last counts."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("ignoreNamespace", "true").schema(_PAGE).load(path)
    text = F.element_at(F.col("revision.text._VALUE"), -1)
    return raw.select(F.col("id").alias("page_id"), text.alias("wikitext")).where("page_id is not null and wikitext is not null and wikitext <> ''")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """block_offset, page_id, title of the lines ``offset:page_id:title``; a title may hold colons, other lines are skipped."""
    parts = F.split("value", ":", 3)
    told = spark.read.text(path).where(F.size(parts) == 3).select(
        F.trim(parts[0]).try_cast("bigint").alias("block_offset"), F.trim(parts[1]).try_cast("bigint").alias("page_id"), parts[2].alias("title")
    )
    return told.where("block_offset is not null and page_id is not null")


def offset_index(index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """page_id, block_offset, only of the wanted pages (page_id) if given; of repeats the last offset."""
    kept = index if wanted is None else index.join(wanted.select("page_id"), "page_id", "left_semi")
    return kept.groupBy("page_id").agg(F.max("block_offset").alias("block_offset"))


def write_index(offsets: DataFrame, path: str) -> None:
    """The offset index as Parquet in ranges of page_id, so that a point read touches one row group."""
    offsets.repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").parquet(path)


def blocks(offsets: DataFrame) -> DataFrame:
    """block_offset and the pages wanted from that block; a block of the dump holds about a hundred."""
    return offsets.groupBy("block_offset").agg(F.sort_array(F.collect_list("page_id")).alias("page_ids"))


def read_blocks(wanted: DataFrame, path: str) -> DataFrame:
    """page_id, wikitext of the pages of blocks(), by random access to the dump file (on a path that all executors see)."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as f:
            for frame in frames:
                rows = []
                for offset, ids in zip(frame["block_offset"], frame["page_ids"], strict=True):
                    rows += [(i, t) for i, t in pages_in_block(one_stream(f, int(offset))) if i in set(ids)]
                yield pd.DataFrame(rows, columns=["page_id", "wikitext"])

    return wanted.mapInPandas(read, "page_id bigint, wikitext string")


def pages_of(offsets: DataFrame, path: str, page_ids: list[int]) -> DataFrame:
    """page_id, wikitext of single pages, by point reads in the saved index (a table of write_index) and the dump file."""
    found = offsets.where(F.col("page_id").isin(*page_ids)) if page_ids else offsets.limit(0)
    return read_blocks(blocks(found), path)


def one_stream(f, offset: int, step: int = 256 * 1024) -> bytes:
    """Exactly one bz2 stream that begins at offset."""
    f.seek(offset)
    reader, out = bz2.BZ2Decompressor(), []
    while not reader.eof and (data := f.read(step)):
        out.append(reader.decompress(data))
    return b"".join(out)


def pages_in_block(data: bytes) -> list[tuple[int, str]]:
    """page id and last text of each page of a block; what follows a syntax error is left out."""
    from xml.etree import ElementTree

    parser = ElementTree.XMLPullParser(["end"])
    out = []
    try:
        parser.feed(b"<root>" + data + b"</root>")
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for _, e in parser.read_events():
            if e.tag.rpartition("}")[2] != "page":
                continue
            kids = [(k.tag.rpartition("}")[2], k) for k in e]
            number = next((k.text for t, k in kids if t == "id"), None)
            texts = [x.text for t, k in kids if t == "revision" for x in k if x.tag.rpartition("}")[2] == "text"]
            if number and texts and texts[-1]:
                out.append((int(number), texts[-1]))
    except ElementTree.ParseError:
        pass
    return out


def pending(canonical: DataFrame, cached: DataFrame) -> DataFrame:
    """page_id of the canonical pages whose text isn't cached yet."""
    return canonical.select("page_id").join(cached.select("page_id"), "page_id", "left_anti")
