"""Live ingest with Structured Streaming, and the batch pass that repairs it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import event_id
from ..operators.hooks import normalize_hooks, redact_events
from ..operators.rollouts import rollout_events
from ..operators.transcripts import transcript_events
from ..sources.linefiles import tail_lines
from ..sources.logs import HOOK_SCHEMA, accepted_envelopes, log_files, read_jsonl_lines
from ..sources.scratch import scratch, stored
from ..sources.sinks import append_events, last_batch, mark_reconciled, spine_tables

#: Who tells of pauses.
COLLECTOR = "collector"
IDLE_US = 3600 * 1_000_000


def hook_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Frames as they arrive, one JSON text a line of files that are written once."""
    frames = spark.readStream.schema(HOOK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return accepted_envelopes(frames)


def stream_events(envelopes: DataFrame, patterns=()) -> DataFrame:
    return redact_events(normalize_hooks(envelopes), patterns)


def start_stream(
    events: DataFrame,
    sink: str,
    checkpoint: str,
    paused=None,
    available_now: bool = False,
    trigger: str = "1 second",
    repeats_within: str | None = None,
):
    """Appends each micro-batch once: the ledger of the sink knows it by the checkpoint and its number.

    ``paused`` is asked before a batch: while it says yes, batches are dropped. The first batch of a pause and the first one after it add an event,
    collection.paused and collection.resumed; what was so before is read from the ledger, so a restart in between adds none.
    With ``repeats_within`` an event that comes again within that time of its arrival stops before the sink, by keyed state. The time is that of arrival, not the
    event's, so a late event is never dropped; the sink's own look-up stands behind it."""
    if repeats_within:
        arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", repeats_within)
        events = arrived.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        stop = bool(paused is not None and paused())
        name = f"{checkpoint}#{batch_id}"
        before = last_batch(batch.sparkSession, sink)
        rows = batch.limit(0) if stop else batch
        if stop != bool(before is not None and before["paused"]):
            rows = rows.unionByName(_marker(batch, name, stop), allowMissingColumns=True)
        append_events(rows, sink, name, paused=stop)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def _marker(batch: DataFrame, name: str, stop: bool) -> DataFrame:
    """The event of a pause that begins or ends with a batch; its id follows from the batch's name, so doing the batch again gives the same."""
    kind = "collection.paused" if stop else "collection.resumed"
    row = batch.sparkSession.range(1).select(F.lit(COLLECTOR).alias("agent_id"), F.lit(kind).alias("kind"), F.lit("derived").alias("evidence"), F.lit(1.0).alias("confidence"), F.lit("{}").alias("payload"))
    now = F.unix_micros(F.current_timestamp())
    return row.select(event_id("agent_id", F.lit(f"{name}:{kind}")).alias("id"), now.alias("timestamp_us"), "*")


def start_rollup(rollup: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = False, trigger: str = "1 minute"):
    """Keeps the rows of an aggregation on a stream. A batch's rows are written to a folder of its number, so doing it again writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rollup.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def read_rollup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that a rollup has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_last")).select(*keys, "_last.*")


def state_report(run) -> list[dict]:
    """What the stateful operators of a query held after each of its last batches: rows and bytes of state, and rows that came too late for it."""
    out = []
    for progress in run.recentProgress:
        for place, state in enumerate(progress["stateOperators"]):
            out.append({"batch": progress["batchId"], "operator": place, "rows": state["numRowsTotal"], "bytes": state["memoryUsedBytes"], "late": state["numRowsDroppedByWatermark"]})
    return out


def reprocess(spark: SparkSession, transcripts: str | None, rollouts: str | None, sink: str, modified_after: str | None = None, patterns=(), now_us: int | None = None, pattern: str = "*.jsonl") -> None:
    """Reads every log changed since a time again, whole, and appends what is missing, whatever its stored date. The sessions in these logs are noted as tried, and
    as reconciled if they have ended or their log is idle for an hour."""
    now_us = time.time_ns() // 1000 if now_us is None else now_us
    for root, read in ((transcripts, transcript_events), (rollouts, rollout_events)):
        if root:
            files = stored(log_files(spark, root, pattern, modified_after), "files")
            _reread(spark, files, read_jsonl_lines(spark, root, modified_after=modified_after, pattern=pattern, files=files), read, sink, patterns, now_us)


def _reread(spark: SparkSession, files: DataFrame, lines: DataFrame, read, sink: str, patterns, now_us: int) -> None:
    where = scratch(spark, "reread")
    redact_events(read(lines), patterns).write.parquet(where)
    events = spark.read.parquet(where)
    append_events(events, sink, now_us=now_us)
    changed = files.select("file", F.unix_micros("modified").alias("modified_us"))
    last = events.where("session_id is not null").select("file", F.col("session_id").alias("id")).distinct().join(changed, "file").groupBy("id").agg(F.max("modified_us").alias("modified_us"))
    if not last.isEmpty():
        known = spine_tables(spark, sink)["sessions"].select("id", "status")
        done = (F.col("status") == "ended") | (F.lit(now_us) - F.col("modified_us") >= IDLE_US)
        mark_reconciled(last.join(known, "id", "left"), sink, now_us, F.coalesce(done, F.lit(False)))


def follow_logs(spark: SparkSession, root: str, sink: str, checkpoint: str, read=transcript_events, patterns=(), available_now: bool = False, trigger: str = "1 minute", pattern: str = "*.jsonl"):
    """The repairing pass as a stream: as lines are completed anywhere below ``root``, the files that hold them are read again, whole, and what is missing is
    appended. A pass over unchanged logs reads no text."""

    def write(batch: DataFrame, batch_id: int) -> None:
        where = scratch(batch.sparkSession, "changed")
        batch.select("file").distinct().write.parquet(where)
        changed = batch.sparkSession.read.parquet(where)
        if not changed.isEmpty():
            files = stored(log_files(batch.sparkSession, root, pattern).join(changed.withColumnRenamed("file", "path"), "path", "left_semi"), "files")
            lines = read_jsonl_lines(batch.sparkSession, root, pattern=pattern, files=files)
            _reread(batch.sparkSession, files, lines, read, sink, patterns, time.time_ns() // 1000)

    writer = tail_lines(spark, root, pattern, names=True).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def finished_sessions(sessions: DataFrame, files: DataFrame, as_of_us: int) -> DataFrame:
    """Sessions that ended or whose log (transcript_path, modified_us) is idle for an hour."""
    last = files.groupBy("transcript_path").agg(F.max("modified_us").alias("modified_us"))
    idle = F.coalesce(F.lit(as_of_us) - F.col("modified_us") >= IDLE_US, F.lit(False))
    return sessions.join(last, "transcript_path", "left").where((F.col("status") == "ended") | idle)


def windowed_counts(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events a window and kind; on a stream the watermark bounds the state, and late rows still reach the spine."""
    timed = events.withColumn("at", F.timestamp_micros("timestamp_us"))
    timed = timed.withWatermark("at", lateness) if timed.isStreaming else timed
    out = timed.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("events"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "kind", "events")
