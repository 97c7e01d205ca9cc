"""Where results go: JSON lines, idempotent appends to a Parquet spine, and read-only SQL."""

from __future__ import annotations

import threading
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import us_to_rfc3339
from ..operators.folds import fold_sessions, merge_folds, sessions_of
from .scratch import scratch

#: Rows of a batch up to which its ids are looked up by value; more are joined. A scan takes the values as a condition as deep as there are values.
FEW_IDS = 512
#: Ids that come again in a batch up to which their rows are taken out of it; with more, the rows of all ids are sorted for the first of each.
FEW_REPEATS = 100_000
LEDGER = "batch string, seq long, created_at_us long, offered long, added long, paused boolean"
_SQL = threading.Lock()


def export_rows(activity: DataFrame) -> DataFrame:
    """{timestamp, agent, kind, evidence, project, event}, one JSON text a row."""
    project = F.col("project_path") if "project_path" in activity.columns else F.lit(None).cast("string")
    row = F.struct(us_to_rfc3339("timestamp_us").alias("timestamp"), F.col("agent_id").alias("agent"), "kind", "evidence", project.alias("project"), F.try_parse_json("payload").alias("event"))
    return activity.select(F.to_json(row).alias("value"))


def export_jsonl(activity: DataFrame, path: str, single_file: bool = False) -> None:
    """Files are in order of time across their names; one file only where it is asked for."""
    ordered = activity.orderBy("timestamp_us", "id")
    export_rows(ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").text(path)


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _first_of_each(events: DataFrame) -> DataFrame:
    order = "ingest_seq" if "ingest_seq" in events.columns else F.struct("timestamp_us", "evidence")
    return events.groupBy("id").agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")


def _arrived(events: DataFrame, seq: int, now_us: int) -> DataFrame:
    """Adds the place in the order of arrival: the batch, then file and line, then the place among the rows as they came. Nothing is sorted for it."""
    at = lambda c, kind: (F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c)
    place = F.struct(F.lit(seq).cast("long").alias("batch"), at("file", "string"), at("line_no", "long"), F.monotonically_increasing_id().alias("place"))
    own = events.drop("ingest_seq", "created_at_us", "event_date")
    return own.withColumns({"ingest_seq": place, "created_at_us": F.lit(now_us).cast("long"), "event_date": F.to_date(F.timestamp_micros("timestamp_us"))})


def _fresh(rows: DataFrame, path: str) -> DataFrame:
    """The rows of a batch whose ids are not stored, of each id the first. Only the ids are shuffled to find what is stored or comes again; where nothing is, the
    rows are returned as they are, and else what is left of them is written."""
    spark, stored = rows.sparkSession, _stored(rows.sparkSession, f"{path}/events", "id string")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ids = rows.select("id", one.alias("own"), none.alias("old"))
    if stored is not None:
        # A row without an id is never one that is stored.
        ids = ids.unionByName(stored.where("id is not null").select("id", none.alias("own"), one.alias("old")))
    found = ids.groupBy("id").agg(F.sum("own").alias("own"), F.sum("old").alias("old")).where("own > 1 or (own = 1 and old > 0)")
    again = _written(spark, found.select(F.col("id").alias("_id"), (F.col("old") > 0).alias("_stored")), "again")
    known, repeated = again.agg(F.count_if("_stored"), F.count_if(~F.col("_stored"))).first()
    if not known and not repeated:
        return rows
    same = F.col("id").eqNullSafe(F.col("_id"))
    if known:
        rows = rows.join(again.where("_stored").select("_id"), same, "left_anti")
    if repeated > FEW_REPEATS:
        rows = _first_of_each(rows)
    elif repeated:
        repeats = again.where(~F.col("_stored")).select("_id")
        rows = rows.join(repeats, same, "left_anti").unionByName(_first_of_each(rows.join(repeats, same, "left_semi")))
    return _written(spark, rows, "fresh")


def _written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    where = scratch(spark, what)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def _holding(spark: SparkSession, path: str, ids: list[str]) -> list[str]:
    """Which of a few ids are stored, at whatever date. Files were written with a Bloom filter of their ids, and the ids are pushed down to the scan, so of a
    file that holds none of them only its footer and the filter are read."""
    stored, setting = _stored(spark, f"{path}/events", "id string"), "spark.sql.parquet.pushdown.inFilterThreshold"
    if stored is None or not ids:
        return []
    with _SQL:
        before = spark.conf.get(setting)
        spark.conf.set(setting, str(FEW_IDS))
        try:
            return [r[0] for r in stored.where(F.col("id").isin(ids)).collect()]
        finally:
            spark.conf.set(setting, before)


def _append(events: DataFrame, path: str, rows: int) -> None:
    # A date's events go to one file, or to as many as its size asks for.
    dealt = events.coalesce(1) if rows <= FEW_IDS else events.hint("rebalance", "event_date")
    writer = dealt.write.mode("append").partitionBy("event_date").option("parquet.bloom.filter.enabled#id", "true")
    writer.option("parquet.bloom.filter.expected.ndv#id", max(1000, min(rows, 100_000))).parquet(f"{path}/events")


def append_events(events: DataFrame, path: str, batch: str | None = None, now_us: int | None = None, paused: bool = False) -> None:
    """Appends events whose ids are not stored yet, by event date, and what follows from them.

    ``batch`` names the batch. A name that the ledger (``batches``) holds is passed over whole, before any id is read; the ledger is written last, so a batch that
    failed on the way is done again, adds only what is missing and gets the same number. Of few ids, those stored are found by the Bloom filters of the
    stored files; a large batch is joined with the stored ids. Either way all dates count, so a replay from any day adds nothing.

    Every event gets ``ingest_seq``, its place in the order of arrival, and ``created_at_us``. The states of the sessions that a batch adds to are kept in ``folds``, and parents that only a
    repeated event tells in ``repairs``; ``spine_tables`` reads them. One writer at a time: two may append the same id."""
    spark = events.sparkSession
    ledger = _stored(spark, f"{path}/batches", LEDGER)
    known = None if ledger is None else ledger.agg(F.max("seq").alias("last"), F.count_if(F.col("batch") == F.lit(batch)).alias("seen")).first()
    if known is not None and known["seen"]:
        return
    seq = (known["last"] or 0) + 1 if known is not None else 1
    now_us = time.time_ns() // 1000 if now_us is None else now_us
    rows = _written(spark, _arrived(events, seq, now_us), "batch")
    n = rows.count()
    if n <= FEW_IDS:
        fresh = _first_of_each(rows)
        stored = _holding(spark, path, [r[0] for r in fresh.select("id").collect() if r[0] is not None])
        out = _written(spark, fresh.where(~F.coalesce(F.col("id").isin(stored), F.lit(False))) if stored else fresh, "fresh")
    else:
        out = _fresh(rows, path)
    added = out.count()
    if {"session_id", "kind"} <= set(out.columns) and n:
        delta, before = out, f"{path}/folds/batch={seq}"
        if _stored(spark, before) is not None:  # an attempt that failed may have stored some of the batch's events
            part = _stored(spark, f"{path}/events")
            delta = out if part is None else out.unionByName(part.where(F.col("ingest_seq.batch") == seq), allowMissingColumns=True)
        fold_sessions(delta).write.mode("overwrite").parquet(before)
        if "parent_session_id" in rows.columns and added < n:
            told = rows.where("parent_session_id is not null and session_id is not null").select("session_id", "parent_session_id", "ingest_seq", F.col("ingest_seq.place").alias("_place"))
            told = told.join(out.select(F.col("ingest_seq.place").alias("_place")), "_place", "left_anti").drop("_place")
            if not told.isEmpty():
                told.coalesce(1).write.mode("append").parquet(f"{path}/repairs")
    if added:
        _append(out, path, added)
    spark.createDataFrame([(batch, seq, now_us, n, added, paused)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/batches")


def last_batch(spark: SparkSession, path: str):
    """The newest row of the ledger, or None."""
    ledger = _stored(spark, f"{path}/batches", LEDGER)
    return None if ledger is None else ledger.orderBy(F.desc("seq")).first()


def mark_reconciled(sessions: DataFrame, path: str, at_us: int, done=None) -> None:
    """Notes that the logs of sessions (id) were read again at a time, and of those for which ``done`` holds that they are complete."""
    done = F.lit(True) if done is None else done
    rows = sessions.select("id", F.lit(at_us).cast("long").alias("attempted_us"), F.when(done, F.lit(at_us)).cast("long").alias("reconciled_us"))
    rows.write.mode("append").parquet(f"{path}/reconciled")


def spine_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``append_events`` and ``mark_reconciled`` have stored: events, and sessions from their merged states, with parents repaired and the times of reconciling."""
    events, states = _stored(spark, f"{path}/events"), _stored(spark, f"{path}/folds")
    if events is None or states is None:
        raise ValueError(f"nothing is stored in {path}")
    sessions = sessions_of(merge_folds(states))
    if (repairs := _stored(spark, f"{path}/repairs")) is not None:
        told = repairs.groupBy(F.col("session_id").alias("id")).agg(F.min_by("parent_session_id", "ingest_seq").alias("_parent"))
        sessions = sessions.join(told, "id", "left").withColumn("parent_session_id", F.coalesce("parent_session_id", "_parent")).drop("_parent")
    if (marks := _stored(spark, f"{path}/reconciled")) is not None:
        last = marks.groupBy("id").agg(F.max("reconciled_us").alias("reconciled_at_us"), F.max("attempted_us").alias("reconcile_attempted_at_us"))
        sessions = sessions.join(last, "id", "left")
    else:
        never = F.lit(None).cast("long")
        sessions = sessions.withColumns({"reconciled_at_us": never, "reconcile_attempted_at_us": never})
    return {"events": events, "sessions": sessions}


def compact(spark: SparkSession, path: str, first: str, last: str, files: int = 1) -> None:
    """Rewrites the dates from ``first`` to ``last``: the small files of a date become ``files``, and of an id the first event stays. The new
    files are written aside, and then take the place of the dates they belong to; no writer may append to these dates meanwhile, and frames made before are
    made anew. The states of sessions and the ledger become one file each; an attempt that fails between leaves states twice, which changes nothing."""
    stored = _stored(spark, f"{path}/events")
    if stored is None:
        return
    stored = stored.where(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    dates = lambda rows: {r[0] for r in rows.select("event_date").distinct().collect()}
    before = dates(stored)
    chosen = _first_of_each(stored)
    part = F.pmod(F.xxhash64("id"), F.lit(files))
    kept = _written(spark, chosen.repartition("event_date", part), "compacted")
    writer = kept.repartition("event_date", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date")
    writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", 100_000).parquet(f"{path}/events")
    for date in sorted(before - dates(kept)):  # all its events are stored under other dates
        kept.drop("event_date").limit(0).write.mode("overwrite").parquet(f"{path}/events/event_date={date}")
    if (states := _stored(spark, f"{path}/folds")) is not None:
        held = [r[0] for r in states.select("batch").distinct().collect()]
        _written(spark, merge_folds(states), "folds").coalesce(files).write.mode("overwrite").parquet(f"{path}/folds/batch=0")
        _remove(spark, [f"{path}/folds/batch={b}" for b in held if b])
    if (ledger := _stored(spark, f"{path}/batches", LEDGER)) is not None:
        _written(spark, ledger.coalesce(1), "ledger").distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/batches")


def _remove(spark: SparkSession, folders: list[str]) -> None:
    context = spark.sparkContext
    for folder in folders:
        where = context._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Any one query over the tables. It stands inside another query, so what is no query does not parse; files cannot be named.

    The tables are named for this query alone. Files are kept out by a session setting, held for as long as the text is analysed; calls of this
    function take turns."""
    named = ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in tables or {})
    body = text.replace("{", "{{").replace("}", "}}") if tables else text
    with _SQL:
        before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            return spark.sql(f"{'WITH ' + named if named else ''} SELECT * FROM (\n{body}\n)", **(tables or {}))
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", before)
