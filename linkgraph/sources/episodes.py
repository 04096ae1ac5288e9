"""Episode files and small reports."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE_SCHEMA = (
    "episode_id string, split string, seed int, start_page_id bigint, target_page_id bigint, start_title string, target_title string, shortest_path_len int, difficulty string, step_limit int"
)
REVIEW_COLUMNS = ("review_status", "review_notes", "replacement_for_episode_id")


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of a JSON-lines file; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(EPISODE_SCHEMA).option("mode", "FAILFAST").json(path)


def write_episodes(episodes: DataFrame, path: str) -> None:
    episodes.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_review_sheet(episodes: DataFrame, path: str) -> None:
    """CSV with a header and three blank columns for reviewers."""
    sheet = episodes.select("*", *(F.lit("").alias(c) for c in REVIEW_COLUMNS))
    sheet.write.mode("overwrite").csv(path, header=True, emptyValue="")


def difficulty_counts(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("difficulty").agg(F.count("*").alias("n_episodes"))


def dataset_metadata(episodes: DataFrame, data_file: str, **parameters: object) -> str:
    """JSON with the parameters of a sample and its counts by difficulty."""
    counts = {r["difficulty"]: r["n_episodes"] for r in difficulty_counts(episodes).collect()}
    told = {"generated_at": datetime.now(timezone.utc).isoformat(), **parameters, "episode_count": sum(counts.values()), "difficulty_counts": counts, "data_file": data_file}
    return json.dumps(told, indent=2)


def report_json(metrics: DataFrame, traces: DataFrame) -> DataFrame:
    """value: one JSON text per row, first the metrics and then the traces of a report."""
    m = metrics.select(F.lit(0).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    t = traces.select(F.lit(1).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    return m.unionByName(t)
