"""Registered queries over a stored spine, its streams and its sources: each writes what it derives from the tables into a scratch folder and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import changes, hooks, reports, tokens
from ..operators.transcripts import transcript_events
from ..sources import linefiles, logs, sinks
from ..sources.scratch import scratch, stored
from ..streaming import live
from .queries import _ALL_TRANSCRIPT, _CLAUDE, _HOOKED, _PAUSED, AS_OF, FROM, ORACLE_SQL, SUMS, TO, _arrive, _frames, _hooked, _own_lines, _pauses, query

#: When the stand-in batches are said to arrive.
NOW = AS_OF - 90_000_000_000
_KIND = "CASE event_type WHEN 'view' THEN 'command' WHEN 'click' THEN 'prompt' WHEN 'purchase' THEN 'turn.ended' WHEN 'signup' THEN 'session.started' ELSE 'unknown' END"
DAY = 86_400_000_000


def _spine(v):
    """Frames in three batches: a third of them, all, and half once more; two thirds of the sessions were read again, and one third is complete."""
    where = scratch(v.spark, "spine")
    # The events of all frames are written once, and the batches are parts of them.
    events = stored(live.stream_events(logs.accepted_envelopes(_frames(v).repartition(4 * v.spark.sparkContext.defaultParallelism))), "frames")
    at = F.pmod(F.col("timestamp_us"), F.lit(6))
    for k, part in enumerate((at < 2, F.lit(True), at > 2)):
        sinks.append_events(events.where(part), where, f"batch {k}", now_us=NOW + k)
    user = F.col("external_session_id").cast("long")
    sessions = sinks.spine_tables(v.spark, where)["sessions"].where(user % 3 < 2)
    sinks.mark_reconciled(sessions, where, NOW, user % 3 == 0)
    return where, sinks.spine_tables(v.spark, where)


_SESSION_OF = "SELECT user_id, min(timestamp_us) AS started_us FROM ev WHERE k <> 5 GROUP BY user_id"


@query(
    f"""SELECT CAST(user_id AS VARCHAR) AS session, min(timestamp_us) AS started_us, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'active' ELSE 'unknown' END AS status,
 CASE WHEN user_id % 3 = 0 THEN {NOW} END AS reconciled_us, CASE WHEN user_id % 3 < 2 THEN {NOW} END AS attempted_us FROM ev WHERE k <> 5 GROUP BY user_id"""
)
def spine_sessions(v):
    """Sessions from the states that three batches with late and repeated events left."""
    sessions = _spine(v)[1]["sessions"]
    return sessions.select(F.col("external_session_id").alias("session"), "started_us", "status", F.col("reconciled_at_us").alias("reconciled_us"), F.col("reconcile_attempted_at_us").alias("attempted_us"))


@query(f"SELECT {NOW} + CASE WHEN count(*) FILTER (timestamp_us % 6 >= 2) > 0 THEN 1 ELSE 0 END AS last_event_us, count(DISTINCT user_id) FILTER (user_id % 3 <> 0) AS unreconciled, TRUE AS idle FROM ev WHERE k <> 5")
def spine_health(v):
    """Collection health with nothing but what was stored: the third batch brought no event, so the second is the last."""
    stored = _spine(v)[1]
    return reports.collection_health(stored["events"], stored["sessions"], AS_OF)


@query(f"SELECT CAST(user_id AS VARCHAR) AS session FROM ({_SESSION_OF}) WHERE user_id % 3 <> 0 ORDER BY CASE WHEN user_id % 3 = 1 THEN {NOW} ELSE 0 END, started_us DESC, {_CLAUDE} LIMIT 60")
def spine_pending(v):
    """The backlog of the stored sessions: those never tried, then those tried."""
    return reports.pending_sessions(_spine(v)[1]["sessions"], 60).select(F.col("external_session_id").alias("session"))


@query(f"SELECT * FROM ({_HOOKED}) WHERE timestamp_us >= {FROM} AND timestamp_us < {TO}")
def stored_tables(v):
    """A range of the stored events, read by date."""
    where = _spine(v)[0]
    return _hooked(tokens.in_range(logs.load_tables(v.spark, where, ("events",))["events"], FROM, TO))


# ---- streams
def _drained(run):
    run.awaitTermination()
    return run


@query(f"SELECT *, (SELECT count(*) FROM ev WHERE k <> 5) AS offered FROM ({_HOOKED})")
def stream_deduped(v):
    """Every frame arrives twice, in files in any order; the second is stopped by keyed state before the sink, which is offered each once."""
    where = scratch(v.spark, "twice")
    half = _arrive(_frames(v).unionByName(_frames(v)), f"{where}/in")
    stream = live.stream_events(live.hook_stream(v.spark, f"{where}/in", half))
    _drained(live.start_stream(stream, f"{where}/sink", f"{where}/state", available_now=True, repeats_within="6 hours"))
    offered = v.spark.read.parquet(f"{where}/sink/batches").select(F.sum("offered")).scalar()
    return _hooked(v.spark.read.parquet(f"{where}/sink/events")).withColumn("offered", offered)


@query(f"SELECT timestamp_us - timestamp_us % {DAY} AS start_us, {_KIND} AS kind, count(*) AS events FROM ev WHERE k <> 5 GROUP BY 1, 2")
def stream_daily_counts(v):
    """Events a day and kind, kept by a stream over files in any order."""
    where = scratch(v.spark, "counts")
    _frames(v).repartition(6).write.json(f"{where}/in")
    stream = live.stream_events(live.hook_stream(v.spark, f"{where}/in", 2))
    _drained(live.start_rollup(live.windowed_counts(stream, lateness="400 days"), f"{where}/out", f"{where}/state", available_now=True))
    return live.read_rollup(v.spark, f"{where}/out", ["start_us", "kind"])


@query(
    f"""SELECT {_CLAUDE} AS session_id, min(timestamp_us) AS start_us, max(timestamp_us) + 43200000000 AS end_us, count(*) AS events FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR timestamp_us - p >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY timestamp_us, event_id ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(timestamp_us) OVER (PARTITION BY user_id ORDER BY timestamp_us, event_id) AS p FROM ev WHERE k <> 5)) GROUP BY user_id, g"""
)
def stream_spans(v):
    """Spans of activity a session from a stream with state; signs of life of a clock long after end the last of them."""
    where = scratch(v.spark, "spans")
    last = v.ev.agg(F.max("timestamp_us")).first()[0] or 0
    _frames(v).repartition(4).write.json(f"{where}/in")
    for days in (500, 501):
        clock = _frames(v).where("v = 1").limit(1).withColumns({"sent_at": F.lit(last + days * DAY), "payload": F.col("payload").withField("session_id", F.lit("clock"))})
        clock.write.mode("append").json(f"{where}/in")
    stream = live.stream_events(live.hook_stream(v.spark, f"{where}/in", 1))
    _drained(live.start_rollup(changes.activity_windows(stream, "12 hours", lateness="450 days"), f"{where}/out", f"{where}/state", mode="append", available_now=True))
    return v.spark.read.parquet(f"{where}/out").where(F.col("start_us") <= last).drop("batch")


@query(f"SELECT {_KIND} AS kind, count(*) AS events FROM ev WHERE k <> 5 AND user_id % 4 IN (0, 3) GROUP BY 1 UNION ALL SELECT kind, 1 FROM (VALUES ('collection.paused'), ('collection.resumed')) x(kind)")
def stream_pause(v):
    """A quarter of the users' frames arrives at a time, with a restart after each; collection is paused for the middle two."""
    where = scratch(v.spark, "pause")
    for k in range(4):
        half = _arrive(_frames(v).where(F.pmod(F.col("payload.session_id").cast("long"), F.lit(4)) == k), f"{where}/in")
        stream = live.stream_events(live.hook_stream(v.spark, f"{where}/in", half))
        _drained(live.start_stream(stream, f"{where}/sink", f"{where}/state", paused=lambda k=k: k in (1, 2), available_now=True))
    return v.spark.read.parquet(f"{where}/sink/events").groupBy("kind").agg(F.count("*").alias("events"))


# ---- logs as files
_REREAD = f"SELECT CASE WHEN CAST(session AS BIGINT) % 5 <> 0 THEN session END AS session, timestamp_us, kind FROM ({_ALL_TRANSCRIPT}) WHERE kind <> 'queue'"


@query(_REREAD)
def reread_logs(v):
    """The repairing pass over log files, and once more as a stream that follows them: each event is stored once."""
    where = scratch(v.spark, "logs")
    # As agents lay them out: a folder a project, a file a session.
    linefiles.write_logs(_own_lines(v), f"{where}/in", "CAST(file AS BIGINT) % 20")
    live.reprocess(v.spark, f"{where}/in", None, f"{where}/sink", now_us=NOW, pattern="*.txt")
    _drained(live.follow_logs(v.spark, f"{where}/in", f"{where}/sink", f"{where}/state", read=transcript_events, available_now=True, pattern="*.txt"))
    events = v.spark.read.parquet(f"{where}/sink/events").where("kind <> 'queue'")
    return events.select(F.col("external_session_id").alias("session"), "timestamp_us", "kind")


@query("SELECT event_id, user_id % 4 AS bucket FROM ev")
def tail_lines(v):
    """Lines of growing folders, in blocks of 10,000 bytes, by a stream that is stopped and goes on: each line once."""
    where = scratch(v.spark, "tail")
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        v.ev.where(part).selectExpr("user_id % 4 AS bucket", "event_id", "props").repartition(3).write.mode("append").partitionBy("bucket").json(f"{where}/in")
        stream = linefiles.tail_lines(v.spark, f"{where}/in", "*.json", block=10_000)
        _drained(stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).start())
    lines = v.spark.read.parquet(f"{where}/out")
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.regexp_extract("file", "bucket=(\\d+)", 1).cast("long").alias("bucket"))


# ---- projections, formats, zones
@query(
    """SELECT concat(CAST(id AS VARCHAR), ':0') AS id, id AS command_id, CASE WHEN k % 5 = 0 THEN concat('/work/p', CAST(user_id % 20 AS VARCHAR), '/.env') ELSE '~/.ssh/id_rsa' END AS path,
 CASE WHEN k % 5 = 0 THEN 'sensitive' ELSE 'highly_sensitive' END AS sensitivity FROM (SELECT event_id AS id, * FROM ev WHERE event_type = 'view') WHERE k % 5 = 0 OR k % 7 = 0"""
)
def project_path_references(v):
    """The sensitive paths that command events name."""
    events = v.commands.withColumns({"kind": F.lit("command"), "evidence": F.lit("hook"), "payload": F.to_json(F.struct("command"))})
    return hooks.project_path_references(events).select("id", "command_id", "path", "sensitivity")


@query(
    """SELECT event_id AS id, CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN abs(x) < 1000 THEN CAST(abs(x) AS VARCHAR) WHEN abs(x) / 1e6 < 0.9995 THEN printf('%.1fK', abs(x) / 1e3)
 WHEN abs(x) / 1e9 < 0.9995 THEN printf('%.1fM', abs(x) / 1e6) ELSE printf('%.1fB', abs(x) / 1e9) END AS shown
 FROM (SELECT event_id, CAST(event_id % 7 - 2 AS BIGINT) * CAST(10 ** (k % 9) AS BIGINT) * 4 AS x FROM ev)"""
)
def format_compact(v):
    x = F.expr("CAST(event_id % 7 - 2 AS BIGINT) * CAST(power(10, k % 9) AS BIGINT) * 4")
    return v.ev.select(F.col("event_id").alias("id"), values.compact(x).alias("shown"))


#: The stand-in events moved into the spring of 2024, so that they lie on both sides of the clock change of the 10th of March, 7:00 UTC; the next is on the 3rd of November, 6:00 UTC.
_SPRING = 60 * DAY
_OFFSET = "CASE WHEN t < 1710054000000000 OR t >= 1730613600000000 THEN 18000000000 ELSE 14400000000 END"


@query(f"SELECT strftime(make_timestamp(t - {_OFFSET}), '%Y-%m-%d') AS label, {SUMS} FROM (SELECT *, timestamp_us + {_SPRING} AS t FROM token_usage) GROUP BY 1")
def tokens_by_day_clock_change(v):
    """Tokens by day in New York across a change of the clocks."""
    return tokens.tokens_by_day(v.token_usage.withColumn("timestamp_us", F.col("timestamp_us") + _SPRING), "America/New_York")


# ---- gaps and ranks
@query(
    f"""SELECT g.host, g.paused_us, g.resumed_us, count(*) FILTER (s.timestamp_us >= g.paused_us AND s.timestamp_us < coalesce(g.resumed_us, {AS_OF})) AS inside,
 max(s.timestamp_us) FILTER (s.timestamp_us < g.paused_us) AS before_us, min(s.timestamp_us) FILTER (s.timestamp_us >= coalesce(g.resumed_us, {AS_OF})) AS after_us
 FROM (SELECT * FROM (SELECT host, kind, timestamp_us AS paused_us, lead(timestamp_us) OVER (PARTITION BY host ORDER BY timestamp_us) AS resumed_us FROM {_PAUSED}) WHERE kind = 'collection.paused') g
 JOIN spine s ON s.session_id = g.host GROUP BY 1, 2, 3"""
)
def gap_activity(v):
    """What a host did during each pause of collection and on either side of it."""
    gaps = changes.collection_gaps(changes.pause_transitions(_pauses(v)))
    return changes.activity_around_gaps(gaps, v.spine.select(F.col("session_id").alias("host"), "timestamp_us"), AS_OF)


@query(ORACLE_SQL["tool_reliability"].partition("SELECT agent_id, tool, count(*)")[1] + ORACLE_SQL["tool_reliability"].partition("SELECT agent_id, tool, count(*)")[2])
def tool_reliability_by_selection(v):
    """The same ranks as tool_reliability, found digit by digit in bounded memory."""
    return reports.tool_reliability(v.tool_outcomes, by_selection=True)
