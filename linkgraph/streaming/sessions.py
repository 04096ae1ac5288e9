"""Sessions as a stream: keyed state, idle expiry, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkgraph.operators.sessions import IDLE_SECONDS, INVALID_LIMIT

_OUT = "session bigint, clicks int, invalid_actions int, terminated_reason string"
_STATE = "clicks int, invalid_actions int, reason string, step_limit int"


def stream_sessions(actions: DataFrame, invalid_limit: int = INVALID_LIMIT, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The sessions that end in a stream of judged actions, one row each when it ends.

    actions: session BIGINT, seq, ts TIMESTAMP with a watermark, action (click, invalid, target),
    step_limit. Within a batch the actions of a session are taken by seq. A session idle for longer
    than idle_seconds of event time ends as expired. Actions after the end are ignored.
    """
    def play(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clicks, bad, reason, limit = state.get if state.exists else (0, 0, None, 0)
        ended = None
        if state.hasTimedOut:
            if reason is None:
                ended = "expired"
            state.remove()
        else:
            frame = pd.concat(list(frames)).sort_values("seq")
            for action, step_limit in zip(frame["action"], frame["step_limit"], strict=True):
                if reason is not None:
                    break
                limit = int(step_limit)
                if action == "invalid":
                    bad += 1
                    reason = "invalid_action_limit" if bad >= invalid_limit else None
                else:
                    clicks += 1
                    reason = "success" if action == "target" else "step_limit" if clicks >= limit else None
                ended = reason
            state.update((clicks, bad, reason, limit))
            late = int(frame["ts"].max().timestamp() * 1000) + idle_seconds * 1000
            state.setTimeoutTimestamp(max(late, state.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame({"session": [key[0]], "clicks": [clicks], "invalid_actions": [bad], "terminated_reason": [ended]})

    return actions.groupBy("session").applyInPandasWithState(play, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def final_table(stream: DataFrame, path: str) -> DataFrame:
    """What a stream of aggregates comes to when all that is there has been read, as a table under path; nothing goes through the driver."""
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/table")


def stream_counts(actions: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Actions per window and kind of a stream with ts."""
    return actions.withWatermark("ts", lateness).groupBy(F.window("ts", width), "action").agg(F.count("*").alias("n"))


def stream_visits(actions: DataFrame, idle: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Visits: stretches of a session's actions without a pause of idle or longer."""
    return actions.withWatermark("ts", lateness).groupBy(F.session_window("ts", idle), "session").agg(F.count("*").alias("n"))
