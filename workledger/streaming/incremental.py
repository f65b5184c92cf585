"""Incremental ingest: changed sources by fingerprint, exactly-once appends, late tool results as a stream join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from workledger.operators.revisions import classify_append
from workledger.operators.store import Store


def changed_sources(spark: SparkSession, path: str, manifest: DataFrame, adapter: str, policy: str = "metadata", glob: str = "*") -> DataFrame:
    """Files whose size, time or policy differ from the last good run's. A grown file counts as changed."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        .select(F.col("path").alias("source"), F.sha2(F.concat_ws("|", "length", F.col("modificationTime").cast("long"), F.lit(policy)).cast("binary"), 256).alias("fingerprint"))
    )
    known = manifest.where((F.col("adapter") == adapter) & (F.col("status") == "ok")).select("source", "fingerprint")
    return files.join(known, ["source", "fingerprint"], "left_anti")


def append_stream(stream: DataFrame, table: str, quarantine: str, checkpoint: str, watermark: str = "1 day"):
    """Run an ``availableNow`` stream of events into a Parquet table: repeats are dropped, conflicts set apart."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            stored = spark.read.parquet(table)
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = batch.limit(0)
        rows = classify_append(stored, batch, "event_id")
        rows = rows.persist()
        rows.where("verdict = 'insert'").drop("verdict").write.mode("append").parquet(table)
        rows.where("verdict = 'conflict'").drop("verdict").write.mode("append").parquet(quarantine)
        rows.unpersist()

    unique = stream.withWatermark("occurred_at", watermark)
    writer = unique.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return query


def pair_streams(uses: DataFrame, results: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Open tool calls joined to results that arrive within ``wait``: session, call_id, at on both sides."""
    u = uses.withWatermark("at", wait).select(F.col("session"), "call_id", F.col("at").alias("used_at"), "name")
    r = results.withWatermark("at", wait).select(F.col("session").alias("r_session"), F.col("call_id").alias("r_call"), F.col("at").alias("answered_at"), "content")
    same = (F.col("session") == F.col("r_session")) & (F.col("call_id") == F.col("r_call"))
    timely = (F.col("answered_at") >= F.col("used_at")) & (F.col("answered_at") <= F.col("used_at") + F.expr(f"interval {wait}"))
    return u.join(r, same & timely).drop("r_session", "r_call")


def stream_into(stream: DataFrame, store: Store, checkpoint: str, table: str = "events"):
    """Run an ``availableNow`` stream of a table's rows into the store, a batch of the stream as a batch of the store.

    A batch reads only the buckets that its rows belong to. One that is run again after it was committed adds nothing, since
    its rows are replays then; conflicts go to the store's quarantine.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append({table: batch})

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


_OPEN = "used_at timestamp, name string, answered_at timestamp, content string, done boolean"
_CALLS = "session string, call_id string, status string, used_at timestamp, name string, answered_at timestamp, content string"


def _pair(wait_ms: int, key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    used_at, name, answered_at, content, done = state.get if state.exists else (None, None, None, None, False)

    def row(status: str) -> pd.DataFrame:
        times = {"used_at": pd.Timestamp(used_at) if used_at is not None else pd.NaT, "answered_at": pd.Timestamp(answered_at) if answered_at is not None else pd.NaT}
        return pd.DataFrame({"session": [key[0]], "call_id": [key[1]], "status": [status], "used_at": [times["used_at"]], "name": [name], "answered_at": [times["answered_at"]], "content": [content]})

    if state.hasTimedOut:
        if not done:
            yield row("open" if answered_at is None else "orphan-result")
        state.remove()
        return
    latest = None
    for frame in frames:
        for r in frame.sort_values("at").itertuples(index=False):
            at = r.at.to_pydatetime()
            latest = at if latest is None else max(latest, at)
            if r.kind == "use" and used_at is None:
                used_at, name = at, r.text
            elif r.kind == "result" and (answered_at is None or (used_at is not None and answered_at < used_at <= at)):
                answered_at, content = at, r.text
    if not done and used_at is not None and answered_at is not None and answered_at >= used_at:
        done = True
        yield row("paired")
    state.update((used_at, name, answered_at, content, done))
    state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + wait_ms)


def held_calls(uses: DataFrame, results: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Open tool calls, held as keyed state until their result comes or ``wait`` of event time is over.

    ``uses``: session, call_id, at, name; ``results``: session, call_id, at, content. Gives ``paired`` calls as soon as both
    are there, also in different batches or after a restart; ``open`` ones and ``orphan-result`` when their time is over. Of
    repeated uses the first counts, of results the first that is not before the use. State is one small row a call.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    shaped = lambda df, kind, text: df.select("session", "call_id", F.col("at").cast("timestamp").alias("at"), F.lit(kind).alias("kind"), F.col(text).cast("string").alias("text"))
    both = shaped(uses, "use", "name").unionByName(shaped(results, "result", "content")).withWatermark("at", wait)
    return both.groupBy("session", "call_id").applyInPandasWithState(lambda key, frames, state: _pair(wait_ms, key, frames, state), _CALLS, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
