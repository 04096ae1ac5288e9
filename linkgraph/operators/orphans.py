"""References to records that do not exist, judged at the end of the period of the reference.

Parent keys are integers. Inside a bucket of the key space the sorted keys that live through the
same periods are compressed into runs of contiguous integers; a reference is matched as-of to the
run that starts at or before its key and is an orphan if the key lies beyond the end of the run
or the run does not live in the period. One window per bucket does the as-of match, so neither
side is collected or broadcast and no bucket is larger than its key range times the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.plans.session import checkpointed

#: Width of a key bucket: at most so many distinct parent keys and so many keys per period.
BUCKET_KEYS = 1024
#: A key that holds more than this share of the references is joined apart from the others.
HOT_SHARE = 0.001
#: Later than any period.
ENDLESS = 2_000_000


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(m: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"))


def lifetimes(loaded_at: Column, deleted_at: Column) -> Column:
    """Months [since, until) at whose end a row loaded and deleted then is alive; null if never."""
    return F.when(
        loaded_at.isNotNull(),
        F.struct(month_number(loaded_at).alias("since"), F.coalesce(month_number(deleted_at), F.lit(ENDLESS)).alias("until")),
    )


def judged_keys(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with the column orphan: true where no parent of that key lives in the period.

    parents: bucket, key (integer), life STRUCT<since, until>; repeated keys unite their lives.
    refs: bucket, key, period (month number), and any further columns; one row per key and period.
    Rows with a null key on either side, and parents with a null life, take no part.
    An empty parent table makes every reference an orphan; an empty refs gives no rows.
    """
    lives = (
        parents.where(F.col("key").isNotNull() & F.col("life").isNotNull() & (F.col("life.since") < F.col("life.until")))
        .select("bucket", "key", "life")
        .distinct()
        .groupBy("bucket", "key")
        .agg(F.sort_array(F.collect_set("life")).alias("lives"))
    )
    in_order = Window.partitionBy("bucket").orderBy("key")
    before = F.lag("key").over(in_order)
    breaks = before.isNull() | (F.col("key") != before + 1) | (F.col("lives") != F.lag("lives").over(in_order))
    runs = (
        lives.withColumn("run", F.sum(breaks.cast("int")).over(in_order))
        .groupBy("bucket", "run")
        .agg(F.min("key").alias("key"), F.struct(F.max("key").alias("last"), F.first("lives").alias("lives")).alias("run_of"))
        .drop("run")
    )
    extra = [c for c in refs.columns if c not in ("bucket", "key")]
    both = runs.select("bucket", "key", "run_of", F.lit(0).alias("side")).unionByName(
        refs.where(F.col("key").isNotNull()).select("bucket", "key", F.struct(*extra).alias("ref"), F.lit(1).alias("side")),
        allowMissingColumns=True,
    )
    as_of = Window.partitionBy("bucket").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("run_of", ignorenulls=True).over(as_of)
    period = F.col("ref.period")
    alive = F.exists("hit.lives", lambda x: (x["since"] <= period) & (period < x["until"]))
    return (
        both.withColumn("hit", hit)
        .where("side = 1")
        .select("bucket", "key", "ref.*", (F.col("hit").isNull() | (F.col("key") > F.col("hit.last")) | ~alive).alias("orphan"))
    )


def bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    """One shuffle by bucket, which the grouping and both windows then share."""
    return df.withColumn("bucket", bucket).repartition("bucket")


def orphans_by_integer(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """parents: key, life; refs: key, period, n. Buckets are ranges of the key space."""
    bucket = F.floor(F.col("key") / BUCKET_KEYS)
    unique = parents.where("key is not null").distinct()
    return judged_keys(bucketed(unique, bucket), bucketed(refs.where("key is not null"), bucket)).drop("bucket")


def orphans_by_text(parents: DataFrame, refs: DataFrame, buckets: int) -> DataFrame:
    """As orphans_by_integer for text keys: titles are ranked within hash buckets.

    The rank is dense over the titles of both sides, so titles with a parent form runs that only
    an unknown title breaks. The title is kept as ``text``.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    both = parents.where("key is not null").distinct().select("key", "life").unionByName(
        refs.where("key is not null").select("key", F.struct("period", "n").alias("ref")), allowMissingColumns=True
    )
    ranked = bucketed(both, bucket).withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy("key")).cast("long"))
    up = ranked.where("life is not null").select("bucket", F.col("rank").alias("key"), "life")
    down = ranked.where("ref is not null").select("bucket", F.col("rank").alias("key"), "ref.period", "ref.n", F.col("key").alias("text"))
    return judged_keys(up, down).select(F.col("text").alias("key"), "period", "n", "orphan")


def rows_of_orphans(rows: DataFrame, judged: DataFrame, n_rows: int) -> DataFrame:
    """rows (key, period, ...) whose (key, period) is judged an orphan, safe under skew.

    judged: key, period, n, orphan, from orphans_by_integer or orphans_by_text over all rows.
    A (key, period) with more than HOT_SHARE of the n_rows rows is hot, so at most 1 / HOT_SHARE
    are: these are broadcast with their verdict and their rows stay where they are. The others
    are joined by shuffle, where no key holds more than HOT_SHARE.
    """
    bound = n_rows * HOT_SHARE
    kept = checkpointed(judged.where(F.col("orphan") | (F.col("n") > bound)))
    hot = kept.where(F.col("n") > bound).select("key", "period", F.col("orphan").alias("hot_orphan"))
    cold = kept.where(F.col("n") <= bound).select("key", "period")
    told = rows.join(F.broadcast(hot), ["key", "period"], "left")
    return told.where("hot_orphan").drop("hot_orphan").unionByName(
        told.where("hot_orphan is null").drop("hot_orphan").join(cold, ["key", "period"], "left_semi")
    )
