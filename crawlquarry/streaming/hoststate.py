"""Per-host state kept by Structured Streaming, with the same fold as the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlquarry.functions.policy import EWMA_ALPHA, HOST_BASE_SECONDS, HOST_MOST_SECONDS
from crawlquarry.session import checkpoint_root

STATE = "samples long, ewma_ms double, last_ms double, streak int, backoff_until double"
OUTPUT = f"host string, {STATE}"


def fold(state: tuple, rows: pd.DataFrame) -> tuple:
    """State after ordered outcomes (at, failed, ms) of one host."""
    samples, ewma, last, streak, backoff = state
    for at, failed, ms in zip(rows["at"], rows["failed"], rows["ms"]):
        if failed:
            streak += 1
            backoff = max(backoff, at + min(HOST_MOST_SECONDS, HOST_BASE_SECONDS * 2.0 ** (min(streak, 40) - 1)))
            continue
        streak, backoff = 0, 0.0
        if ms is not None and ms > 0:
            ewma = ms if ewma <= 0 else (1 - EWMA_ALPHA) * ewma + EWMA_ALPHA * ms
            samples, last = samples + 1, ms
    return samples, ewma, last, streak, backoff


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # The source bounds a micro-batch (maxFilesPerTrigger); a host's outcomes in it are put in order before they count.
    rows = pd.concat(list(batches)).sort_values(["at", "id"])
    now = fold(tuple(state.get) if state.exists else (0, 0.0, 0.0, 0, 0.0), rows)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["host", "samples", "ewma_ms", "last_ms", "streak", "backoff_until"])


def host_states(outcomes: DataFrame) -> DataFrame:
    """Stream of (host, …) updates from a stream of outcomes (host, id, at, failed, ms)."""
    return outcomes.groupBy("host").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Everything a stream has to offer now, as (batch, …) rows of a table in the shared folder.

    Each micro-batch overwrites its own directory, so a repeated batch leaves one copy.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/{number}")

    q = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    # The state is of no use once the run is over; the output goes when the driver ends, as other tables do.
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/state"), True)
    fs.deleteOnExit(root)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")


def latest_states(updates: DataFrame) -> DataFrame:
    """The last state of each host."""
    return updates.groupBy("host").agg(F.max_by(F.struct("samples", "ewma_ms", "last_ms", "streak", "backoff_until"), "batch").alias("s")).select("host", "s.*")


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        until, kind = state.get
        state.remove()
        yield pd.DataFrame([(key[0], kind, until)], columns=["key", "kind", "expired_at"])
        return
    until, kind = state.get if state.exists else (0.0, "")
    for rows in batches:
        top = rows.sort_values("until").iloc[-1]
        if top["until"] > until:
            until, kind = float(top["until"]), str(top["kind"])
    state.update((until, kind))
    watermark = state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(int(until * 1000), watermark + 1))


def expiries(holds: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Stream of (key, kind, expired_at) of holds that ran out: leases, backoffs, robots answers, quarantines.

    ``holds`` (key, kind, at timestamp, until seconds); a later ``until`` of a key extends its hold. A hold
    expires once events say that its time has passed, i.e. when the watermark has.
    """
    marked = holds.withWatermark("at", late)
    return marked.groupBy("key").applyInPandasWithState(_expire, "key string, kind string, expired_at double", "until double, kind string", "append", GroupStateTimeout.EventTimeTimeout)
