"""First-wins deduplication and the tables folded from the event spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list, order: str) -> DataFrame:
    """The row with the least ``order`` of each key, in one shuffle, before which rows of a key are combined. Spark sorts the rows by key on either side
    of it, since a whole row is no buffer for hash aggregation; joining back the least orders would move and sort the same rows."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct("*").alias("_row"), F.col(order).alias("_at"))
    return keyed.groupBy(*names).agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def dedupe_events(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row an event id: the first that arrived."""
    return _first(events, [F.col("id")], order)


def repair_parents(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """(session_id, parent_session_id): the last parent told by first sightings, else the first told by a repeated one."""
    first = events.groupBy("id").agg(F.min(order).alias("_first"))
    told = events.where("parent_session_id is not null and session_id is not null").join(first, "id").select("session_id", "parent_session_id", order, (F.col(order) == F.col("_first")).alias("fresh"))
    return told.groupBy("session_id").agg(F.coalesce(F.max_by("parent_session_id", F.when(F.col("fresh"), F.col(order))), F.min_by("parent_session_id", F.when(~F.col("fresh"), F.col(order)))).alias("parent_session_id"))


def dedupe_responses(usage: DataFrame, order: str = "id") -> DataFrame:
    """One row a model response: the counters of the first record, the provider's own object of the last."""
    keys = [F.col("agent_id"), F.coalesce(F.col("request_id").cast("string"), F.col("id").cast("string"))]
    rows = usage.select(keys[0].alias("_k0"), keys[1].alias("_k1"), F.struct("*").alias("_row"), F.col(order).alias("_at"), F.col("provider_usage").alias("_usage"))
    best = rows.groupBy("_k0", "_k1").agg(F.min_by("_row", "_at").alias("_row"), F.max_by("_usage", "_at").alias("_usage"))
    return best.select(*[F.col("_usage").alias("provider_usage") if c == "provider_usage" else F.col(f"_row.{c}").alias(c) for c in usage.columns])


def record_inflation(usage: DataFrame) -> DataFrame:
    """Records, responses and their ratio (null without responses)."""
    key = F.struct("agent_id", F.coalesce(F.col("request_id").cast("string"), F.col("id").cast("string")))
    return usage.agg(F.count("*").alias("usage_records"), F.count_distinct(key).alias("responses")).withColumn("inflation", F.try_divide("usage_records", "responses"))


def build_agents(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("agent_id").alias("id")).agg(F.min("timestamp_us").alias("first_seen_us"), F.max("timestamp_us").alias("last_seen_us"))


def build_projects(events: DataFrame) -> DataFrame:
    return events.where("project_id is not null").groupBy(F.col("project_id").alias("id")).agg(F.min("timestamp_us").alias("first_seen_us"), F.max("timestamp_us").alias("last_seen_us"))


def build_sessions(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row a session, in one aggregation; events of no session make none. What was told last by arrival stands; the status is the last lifecycle event's; the
    duration runs from the least timestamp of all."""
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    optional = [c for c in ("transcript_path", "git_branch", "surface", "parent_session_id") if c in events.columns]
    life = F.when(F.col("kind").isin("session.started", "session.ended"), F.col(order))
    ended = F.when(F.col("kind") == "session.ended", F.col(order))
    once = [c for c in ("external_session_id",) if c in events.columns]
    out = events.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.min_by("agent_id", order).alias("agent_id"),
        *[F.min_by(c, seen(c)).alias(c) for c in ("project_id", *once)],
        F.min("timestamp_us").alias("started_us"),
        F.max_by("timestamp_us", ended).alias("ended_us"),
        F.max_by("kind", life).alias("_last"),
        *[F.max_by(c, seen(c)).alias(c) for c in optional],
    )
    status = F.when(F.col("_last") == "session.started", "active").when(F.col("_last") == "session.ended", "ended").otherwise("unknown")
    return out.withColumn("status", status).withColumn("duration_ms", F.floor((F.col("ended_us") - F.col("started_us")) / 1000).cast("long")).drop("_last")


def session_projects(events: DataFrame) -> DataFrame:
    return events.where("project_id is not null and session_id is not null").groupBy("session_id", "project_id").agg(F.min("timestamp_us").alias("first_seen_us"), F.max("timestamp_us").alias("last_seen_us"), F.count("*").alias("event_count"))


def demote_unstarted(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Active sessions of which no start was observed become unknown."""
    started = events.where("kind = 'session.started'").select(F.col("session_id").alias("id"), F.lit(True).alias("_started")).distinct()
    marked = sessions.join(started, "id", "left")
    return marked.withColumn("status", F.when((F.col("status") == "active") & F.col("_started").isNull(), "unknown").otherwise(F.col("status"))).drop("_started")


def without_start(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions of which no start was observed."""
    return sessions.join(events.where("kind = 'session.started'").select(F.col("session_id").alias("id")), "id", "left_anti")
