"""Joins of rows with a unique key table that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.plans.session import checkpointed

#: A key with more than this share of the rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001
#: Up to so many rows of one key are no burden for a task.
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, n_rows: int, share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The at most 1 / share values of key that more than share of the n_rows rows, and more than hot_rows rows, hold."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(n_rows * share, hot_rows)).select(key)


def join_unique(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined on key with dim, where dim holds each key once; how is inner or left.

    Rows of hot keys stay where they are and meet a broadcast of the few dim rows of hot keys; the
    other rows are joined by shuffle, where no key holds more than share of them. Null keys match
    nothing. rows is read three times: pass a table or a checkpoint.
    """
    n = rows.count()
    if n <= hot_rows:  # no key can be hot
        return rows.join(dim, key, how)
    hot = checkpointed(hot_keys(rows, key, n, share, hot_rows))
    hot_dim = dim.join(F.broadcast(hot), key, "left_semi")
    flag = hot.withColumn("_is_hot", F.lit(True))
    told = rows.join(F.broadcast(flag), key, "left")
    a = told.where("_is_hot").drop("_is_hot").join(F.broadcast(hot_dim), key, how)
    b = told.where("_is_hot is null").drop("_is_hot").join(dim, key, how)
    return a.unionByName(b)
