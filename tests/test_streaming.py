from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkgraph.streaming import sessions as S

SCHEMA = "session bigint, seq int, ts timestamp, action string, step_limit int"


def run(spark, tmp_path, batches, transform, mode="append"):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = "out_" + tmp_path.name.replace("-", "_")
    q = transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_sessions(spark, tmp_path):
    t = datetime(2025, 1, 1)
    m = lambda k: t + timedelta(minutes=k)
    batches = [
        [(1, 1, m(0), "click", 3), (2, 1, m(0), "invalid", 3), (3, 1, m(1), "click", 9)],
        [(1, 2, m(2), "target", 3), (1, 3, m(3), "click", 3), (2, 2, m(2), "invalid", 3), (2, 3, m(3), "invalid", 3)],
        [(4, 1, m(300), "click", 1)],
        [(5, 1, m(600), "click", 9)],
    ]
    got = run(spark, tmp_path, batches, lambda s: S.stream_sessions(s.withWatermark("ts", "1 minute")))
    assert {(r["session"], r["clicks"], r["invalid_actions"], r["terminated_reason"]) for r in got} >= {
        (1, 2, 0, "success"), (2, 0, 3, "invalid_action_limit"), (3, 1, 0, "expired"), (4, 1, 0, "step_limit"),
    }
    assert len({r["session"] for r in got}) == len(got)


def test_stream_counts(spark, tmp_path):
    t = datetime(2025, 1, 1)
    batches = [[(1, i, t + timedelta(minutes=i * 20), "click", 1) for i in range(6)]]
    got = run(spark, tmp_path, batches, lambda s: S.stream_counts(s).select(F.col("window.start").alias("w"), "action", "n"), "complete")
    assert sorted((r["w"].hour, r["n"]) for r in got) == [(0, 3), (1, 3)]


def test_stream_visits(spark, tmp_path):
    t = datetime(2025, 1, 1)
    batches = [[(1, i, t + timedelta(minutes=k), "click", 1) for i, k in enumerate([0, 10, 50, 60])]]
    got = run(spark, tmp_path, batches, lambda s: S.stream_visits(s).select("session", "n"), "complete")
    assert sorted(r["n"] for r in got) == [2, 2]
