"""The build: named steps from dumps to graph and text, each done once, and the set of tools over the result."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.arrow_text import infobox
from linkgraph.functions.wikitext import article_text, lead_text, outlinks
from linkgraph.operators import articles, canonical, graph, sessions
from linkgraph.plans.session import path_of, stamp
from linkgraph.sources import articles_dump, dumps


class Manifest:
    """key and value STRING of what has been built, as a small table that is overwritten; on whatever store the path is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> dict[str, str]:
        if not stamp(self.spark, self.path):
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.schema("key string, value string").json(self.path).collect()}

    def get(self, key: str) -> str | None:
        return self.all().get(key)

    def set(self, key: str, value: object) -> None:
        rows = [(k, v) for k, v in (self.all() | {key: str(value)}).items()]
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(self.path)


def find_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The first file of a folder that matches, or None."""
    fs, p = path_of(spark, f"{folder}/{pattern}")
    return min((s.getPath().toString() for s in fs.globStatus(p) or []), default=None)


def run_steps(manifest: Manifest, steps: dict[str, Callable[[], int | None]], only: str | None = None, force: bool = False) -> list[str]:
    """Runs the steps in order, or only the one named; a step that is done is skipped unless forced.

    A step returns its number of rows, or None if its input is missing: then it isn't marked as done.
    Rows, seconds and rows a second of each step are kept in the manifest.
    """
    if only is not None and only not in steps:
        raise KeyError(only)
    ran = []
    for name, step in steps.items():
        if only not in (None, name) or (manifest.get(f"step_{name}_done") and not force):
            continue
        began = time.time()
        n = step()
        if n is None:
            continue
        took = time.time() - began
        manifest.set(f"n_{name}_rows", n)
        manifest.set(f"{name}_seconds", round(took, 3))
        manifest.set(f"{name}_rows_per_second", round(n / max(took, 1e-3), 1))
        manifest.set(f"step_{name}_done", 1)
        ran.append(name)
    return ran


class Build:
    """Parquet tables under root, made from the dump files in raw."""

    FILES = {"page": "*-page.sql*", "redirect": "*-redirect.sql*", "linktarget": "*-linktarget.sql*", "page_props": "*-page_props.sql*", "pagelinks": "*-pagelinks.sql*"}

    def __init__(self, spark: SparkSession, raw: str, root: str):
        self.spark, self.raw, self.root = spark, raw, root
        self.manifest = Manifest(spark, f"{root}/manifest")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str) -> int:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.table(name).count()

    def load(self, name: str) -> int | None:
        path = find_file(self.spark, self.raw, self.FILES[name])
        return None if path is None else self._write(dumps.read_dump(self.spark, path, name), name)

    def canonical(self) -> int:
        return self._write(canonical.canonical_pages(self.table("page"), self.table("page_props")), "canonical")

    def redirects(self) -> int:
        return self._write(canonical.redirect_map(self.table("redirect"), self.table("page")), "redirect_map")

    def graph(self) -> int:
        edges = graph.link_edges(self.table("pagelinks"), self.table("linktarget"), canonical.title_index(self.table("page")), self.table("redirect_map"), self.table("canonical"))
        graph.save_graph(edges, self.table("canonical").select("node_idx"), f"{self.root}/graph")
        return graph.load_graph(self.spark, f"{self.root}/graph")[0].count()

    def resolution(self) -> int:
        """Where each title leads, for the tools."""
        return self._write(articles.title_resolution(self.table("canonical"), self.table("page"), self.table("redirect_map")), "title_resolution")

    def offsets(self) -> int | None:
        """The offset index of the article dump, for point reads; only of canonical pages."""
        path = find_file(self.spark, self.raw, "*index*.txt*")
        if path is None:
            return None
        articles_dump.write_index(articles_dump.offset_index(articles_dump.read_index(self.spark, path), self.table("canonical")), f"{self.root}/offsets")
        return self.table("offsets").count()

    def texts(self, force: bool = False) -> int | None:
        """Lead text, links and article text of the canonical pages, in one table ``texts`` from which the three come.

        Pages that have their texts are not read again, unless forced. A run appends one table of all
        columns, so a page has either all of its texts or none, whenever a run is broken off.
        """
        path = find_file(self.spark, self.raw, "*-pages-articles*.xml*")
        if path is None:
            return None
        pages = articles_dump.read_articles(self.spark, path)
        wanted = self.table("canonical").select("page_id")
        if not force and stamp(self.spark, f"{self.root}/texts/_SUCCESS"):
            wanted = articles_dump.pending(wanted, self.table("texts"))
        c = F.col("wikitext")
        told = pages.join(wanted, "page_id", "left_semi").select("page_id", lead_text(c).alias("lead_text"), outlinks(c).alias("links"), article_text(c, infobox(c)).alias("text"))
        told.write.mode("overwrite" if force else "append").parquet(f"{self.root}/texts")
        return self.table("texts").count()

    def page_links(self) -> DataFrame:
        return self.table("texts").select("page_id", F.posexplode("links").alias("ordinal", "link_title"))

    def lead_texts(self) -> DataFrame:
        return self.table("texts").select("page_id", "lead_text")

    def articles(self) -> DataFrame:
        return self.table("texts").select("page_id", "text")

    def run(self, only: str | None = None, force: bool = False) -> list[str]:
        steps: dict[str, Callable[[], int | None]] = {name: (lambda n=name: self.load(n)) for name in self.FILES}
        steps |= {"canonical": self.canonical, "redirects": self.redirects, "resolution": self.resolution, "graph": self.graph, "offsets": self.offsets, "texts": lambda: self.texts(force)}
        return run_steps(self.manifest, steps, only, force)


class Tools:
    """The tool set over a build; each tool answers for a whole batch of episodes or pages."""

    def __init__(self, build: Build):
        self.build = build
        t = build.table
        self.canonical, self.page, self.redirects = t("canonical"), t("page"), t("redirect_map")
        self.edges, _ = graph.load_graph(build.spark, f"{build.root}/graph")
        self.legal = articles.legal_links(build.page_links(), t("title_resolution"))

    def get_page(self, pages: DataFrame) -> DataFrame:
        """Observations of pages (page_id)."""
        named = pages.select("page_id").join(self.canonical.select("page_id", "page_title"), "page_id", "left")
        return articles.observations(self.build.articles(), self.build.lead_texts(), named, self.legal)

    def raw_pages(self, page_ids: list[int]) -> DataFrame:
        """page_id, wikitext of single pages, read from the article dump by the saved offsets."""
        path = find_file(self.build.spark, self.build.raw, "*-pages-articles-multistream*.xml.bz2")
        return articles_dump.pages_of(self.build.table("offsets"), path.removeprefix("file:"), page_ids)

    def start_episode(self, episodes: DataFrame, seed: int | None = None) -> DataFrame:
        """Episode of a seed (of every seed if None, in their order) with its first observation; a seed out of range is an error."""
        if seed is not None:
            episodes = episodes.where(F.col("seed") == seed)
            if not episodes.take(1):
                raise ValueError(f"seed {seed} out of range")
        seen = self.get_page(episodes.select(F.col("start_page_id").alias("page_id")).distinct())
        return episodes.join(seen.withColumnRenamed("page_id", "start_page_id"), "start_page_id").orderBy("seed")

    def click_links(self, episodes: DataFrame, log: DataFrame) -> DataFrame:
        return sessions.replay_clicks(episodes, log, self.legal)

    def get_section(self, pages: DataFrame, name: str) -> DataFrame:
        text = self.build.articles().join(pages.select("page_id"), "page_id", "left_semi")
        return articles.get_section(articles.legal_sections(articles.sections_of(text), self.legal), name)

    def search_page(self, pages: DataFrame, query: str, max_results: int = 10) -> DataFrame:
        text = self.build.articles().join(pages.select("page_id"), "page_id", "left_semi")
        return articles.search(text, F.lit(query), max_results)

    def evaluate(self, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One row of metrics, and the scored traces, of the greedy reader on all episodes."""
        places = self.build.page_links().groupBy("page_id", F.col("link_title").alias("title")).agg(F.min("ordinal").alias("place"))
        states = sessions.run_greedy(episodes, self.legal.join(places, ["page_id", "title"]))
        traces = self.score_episodes(states, episodes).withColumn("error", F.lit(None).cast("string")).withColumn("scored", F.lit(True))
        return sessions.metrics(traces), traces

    def score_episodes(self, states: DataFrame, episodes: DataFrame) -> DataFrame:
        node = self.canonical.select("page_id", "node_idx")
        ends = episodes.select("start_page_id", "target_page_id").distinct().join(node.toDF("start_page_id", "src"), "start_page_id").join(node.toDF("target_page_id", "dst"), "target_page_id")
        distances = ends.join(graph.shortest_paths(self.edges, ends.select("src", "dst")), ["src", "dst"]).select("start_page_id", "target_page_id", "dist")
        return sessions.score(states, episodes, distances, self.canonical)
