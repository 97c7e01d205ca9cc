"""Stand-in tables over the events table, so that every report has data to run on: one expression list for Spark and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: The views' columns, as expressions that mean the same in both dialects.
AGENT = "CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'claude-code' END"
TOKEN_USAGE = [
    "event_id AS id", "timestamp_us", "user_id AS session_id", "user_id % 20 AS project_id", f"{AGENT} AS agent_id",
    "CASE WHEN user_id % 3 = 0 THEN 'openai' ELSE 'anthropic' END AS provider",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('model-', CAST(event_id % 4 AS STRING)) END AS model",
    "event_id - event_id % 2 AS request_id", "CAST(floor(value * 100) AS BIGINT) AS input_tokens", "k AS cache_creation_input_tokens",
    "k * 10 AS cache_read_input_tokens", "event_id % 500 AS output_tokens", "event_id % 5 = 0 AS is_subagent", "props AS provider_usage",
]
TOOL_OUTCOMES = [
    "event_id AS id", "timestamp_us", "user_id AS session_id", f"{AGENT} AS agent_id", "event_type AS tool",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms", "k < 8 AS failed",
]
FILE_EVENTS = [
    "event_id AS id", "timestamp_us", "user_id AS session_id", "user_id % 20 AS project_id", f"{AGENT} AS agent_id",
    "CASE WHEN event_type = 'click' THEN 'read' ELSE 'write' END AS operation", "event_type AS tool",
    "CASE WHEN k = 7 THEN concat('/work/p', CAST(user_id % 20 AS STRING), '/.env') WHEN k = 13 THEN '/home/dev/.ssh/config'"
    " ELSE concat('/work/p', CAST(user_id % 20 AS STRING), '/src/f', CAST(k AS STRING), '.rs') END AS path",
]
#: Every third page view is a command that may name a path.
COMMANDS = [
    "event_id AS id", "timestamp_us", "user_id AS session_id", "user_id % 20 AS project_id", f"{AGENT} AS agent_id",
    "CASE WHEN k % 5 = 0 THEN concat('cat ', '/work/p', CAST(user_id % 20 AS STRING), '/.env') WHEN k % 7 = 0 THEN 'ls ~/.ssh/id_rsa | wc -l'"
    " ELSE concat('make test-', CAST(k AS STRING)) END AS command",
]
SPINE = [
    "event_id AS id", "timestamp_us", f"{AGENT} AS agent_id", "user_id AS session_id", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id % 20 END AS project_id",
    "CASE WHEN event_id % 4 = 0 THEN concat('surface-', CAST(event_id % 3 AS STRING)) END AS surface",
    "CASE WHEN event_type = 'signup' THEN 'session.started' WHEN event_type = 'error' THEN 'session.ended' WHEN event_type = 'view' THEN 'command' WHEN event_type = 'click' THEN 'file.read' ELSE 'unknown' END AS kind",
    "CASE WHEN k % 2 = 0 THEN 'hook' ELSE 'transcript' END AS evidence", "props AS payload", "event_id AS ingest_seq", "k",
]

_VIEWS = {
    "token_usage": (TOKEN_USAGE, ""), "tool_outcomes": (TOOL_OUTCOMES, ""), "spine": (SPINE, ""),
    "file_events": (FILE_EVENTS, "event_type IN ('click', 'purchase', 'error')"), "commands": (COMMANDS, "event_type = 'view'"),
}
SESSIONS = "SELECT user_id AS id, min(timestamp_us) AS started_us, max(timestamp_us) AS ended_us, CASE WHEN user_id > 10 THEN CAST(floor(user_id / 3.0) AS BIGINT) END AS parent_session_id FROM ev GROUP BY user_id"
PROJECTS = "SELECT DISTINCT user_id % 20 AS id, concat('/work/r', CAST(user_id % 4 AS STRING), '/p', CAST(user_id % 20 AS STRING)) AS path, CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('/work/r', CAST(user_id % 4 AS STRING)) END AS repository_root FROM ev"


def duckdb_views() -> str:
    """The WITH clause that defines all views for the oracle."""
    parts = ["ev AS (SELECT *, epoch_us(ts) AS timestamp_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"]
    parts += [f"{n} AS (SELECT {', '.join(columns)} FROM ev{' WHERE ' + where if where else ''})" for n, (columns, where) in _VIEWS.items()]
    return "WITH RECURSIVE " + ", ".join([*parts, f"sessions AS ({SESSIONS})", f"projects AS ({PROJECTS})"]) + " "


class Views:
    """The views of one folder of tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.ev = self.events.selectExpr("*", "unix_micros(CAST(ts AS TIMESTAMP)) AS timestamp_us", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")

    def __getattr__(self, name: str) -> DataFrame:
        columns, where = _VIEWS[name]
        return (self.ev.where(where) if where else self.ev).selectExpr(*columns)

    @property
    def sessions(self) -> DataFrame:
        return self.spark.sql(SESSIONS.replace("FROM ev", "FROM {ev}"), ev=self.ev)

    @property
    def projects(self) -> DataFrame:
        return self.spark.sql(PROJECTS.replace("FROM ev", "FROM {ev}"), ev=self.ev)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Several sources on one spine; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
