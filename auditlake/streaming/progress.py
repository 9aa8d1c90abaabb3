"""Progress as a stream: last value per task, monotone events, a terminal event that closes; and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS = "task_id string, ts timestamp, progress double, stage string, status string, error string"
TERMINAL = ["completed", "failed"]
#: After an hour without news a task's state is dropped.
TTL_MS = 3_600_000


def monotone_stream(progress: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(task_id, ts, progress, stage, status, error): an event only when the progress grows, until and with the first terminal one; errors are carried on.

    State per task: the highest progress, the last error, whether it has ended. It is dropped after ``ttl_ms`` without news; with such a
    timer a query always has a next batch, so one that shall end (``availableNow``) takes None.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, error, ended = state.get if state.exists else (-1.0, None, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if ended:
                break
            error = row.error if isinstance(row.error, str) else error
            ended = row.status in TERMINAL
            if ended or row.progress > best:
                best = max(best, row.progress)
                out.append((key[0], row.ts, row.progress, row.stage, row.status, error))
        state.update((best, error, ended))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["task_id", "ts", "progress", "stage", "status", "error"])

    return progress.groupBy("task_id").applyInPandasWithState(step, PROGRESS, "best double, error string, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def last_progress(df: DataFrame, task: str, seq: str, cols: list[str]) -> DataFrame:
    """The last values of each task: what the keyed store would hold."""
    best = F.max_by(F.struct(*cols), seq).alias("_r")
    return df.groupBy(task).agg(best).select(task, *[f"_r.{c}" for c in cols])


def monotone(df: DataFrame, task: str, seq: str, value: str) -> DataFrame:
    """The rows whose value exceeds all before."""
    w = Window.partitionBy(task).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(value).over(w)).where(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def until_terminal(df: DataFrame, task: str, seq: str, terminal) -> DataFrame:
    """The rows up to and with the first terminal one."""
    ends = df.groupBy(task).agg(F.min(F.when(terminal, F.col(seq))).alias("_end"))
    return df.join(ends, task).where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end")


def run_batches(progress: DataFrame, each, checkpoint: str):
    """Reviews on change events: every micro-batch goes through the same batch pipeline; the sink is keyed by review, so a retry is harmless."""
    return progress.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
