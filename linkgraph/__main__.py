"""python -m linkgraph build|sample|evaluate: the steps of the build, episode files, and a report of the greedy reader."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from linkgraph.operators import graph, sampling
from linkgraph.plans.pipeline import Build, Tools
from linkgraph.sources import episodes


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkgraph", description=__doc__)
    parser.add_argument("--raw", default="data/raw", help="folder of the dump files")
    parser.add_argument("--out", default="data/built", help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("--step")
    build.add_argument("--force", action="store_true")
    sample = commands.add_parser("sample")
    sample.add_argument("file")
    sample.add_argument("--n-total", type=int, default=100)
    sample.add_argument("--n-hard-bonus", type=int, default=3)
    sample.add_argument("--seed", type=int, default=42)
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("file")
    evaluate.add_argument("report")
    asked = parser.parse_args(args)

    spark = SparkSession.builder.appName("linkgraph").getOrCreate()
    made = Build(spark, asked.raw, asked.out)
    if asked.command == "build":
        print("\n".join(made.run(asked.step, asked.force)))
    elif asked.command == "sample":
        edges, nodes = graph.load_graph(spark, f"{asked.out}/graph")
        pages = made.table("canonical").join(graph.degrees(nodes, edges).select("node_idx", "out_degree"), "node_idx")
        drawn = sampling.sample_episodes(edges, pages, asked.n_total, asked.n_hard_bonus, asked.seed).persist()
        episodes.write_episodes(drawn, asked.file)
        episodes.write_review_sheet(drawn, asked.file + ".csv")
        print(episodes.dataset_metadata(drawn, asked.file, seed=asked.seed, n_total=asked.n_total, n_hard_bonus=asked.n_hard_bonus))
    else:
        metrics, traces = Tools(made).evaluate(episodes.read_episodes(spark, asked.file))
        episodes.report_json(metrics, traces).orderBy("part").select("value").write.mode("overwrite").text(asked.report)


if __name__ == "__main__":
    main()
