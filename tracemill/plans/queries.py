"""The registered queries: each runs an operator over the stand-in views of a folder of tables, most with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact, sensitivity, values
from ..operators import changes, dedupe, hooks, reports, repositories, rollouts, tokens, transcripts
from ..sources import logs, sinks
from ..sources.scratch import scratch
from ..streaming import live
from .views import Views, duckdb_views, union_all

FROM, TO = 1_704_672_000_000_000, 1_705_276_800_000_000  # the 8th to the 15th of January 2024
AS_OF = 1_706_745_600_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = duckdb_views() + sql
        return f

    return register


TOTAL = "input_tokens + cache_creation_input_tokens + cache_read_input_tokens + output_tokens"
SUMS = (
    ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {n}" for n, c in tokens.COUNTERS.items())
    + f", count(*) AS responses, CAST(coalesce(sum({TOTAL}), 0) AS BIGINT) AS total"
)
RANGED = f"(SELECT * FROM token_usage WHERE timestamp_us >= {FROM} AND timestamp_us < {TO})"


# ---- P and A: token reports
@query(f"SELECT id, timestamp_us, agent_id FROM token_usage WHERE timestamp_us >= {FROM} AND timestamp_us < {TO}")
def in_range(v):
    return tokens.in_range(v.token_usage, FROM, TO).select("id", "timestamp_us", "agent_id")


@query(f"SELECT {SUMS} FROM {RANGED}")
def token_totals(v):
    return tokens.token_totals(tokens.in_range(v.token_usage, FROM, TO))


@query(f"SELECT {SUMS} FROM token_usage WHERE agent_id = 'claude-code'")
def token_totals_for_agent(v):
    return tokens.token_totals(v.token_usage, "claude")


_DIMS = "FROM token_usage u LEFT JOIN projects p ON u.project_id = p.id"
query(f"SELECT max(coalesce(repository_root, path, '(unknown)')) AS label, {SUMS} {_DIMS} GROUP BY coalesce(repository_root, CAST(project_id AS VARCHAR))", "tokens_by_repository")(lambda v: tokens.tokens_by(v.token_usage, "repository", v.projects))
query(f"SELECT max(coalesce(path, '(unknown)')) AS label, {SUMS} {_DIMS} GROUP BY project_id", "tokens_by_project")(lambda v: tokens.tokens_by(v.token_usage, "project", v.projects))
query(f"SELECT provider || '/' || coalesce(model, '(unknown)') AS label, {SUMS} FROM token_usage GROUP BY 1", "tokens_by_model")(lambda v: tokens.tokens_by(v.token_usage, "model"))
query(f"SELECT provider AS label, {SUMS} FROM token_usage GROUP BY 1", "tokens_by_provider")(lambda v: tokens.tokens_by(v.token_usage, "provider"))
query(f"SELECT agent_id AS label, {SUMS} FROM token_usage GROUP BY 1", "tokens_by_agent")(lambda v: tokens.tokens_by(v.token_usage, "agent"))
query(f"SELECT strftime(make_timestamp(timestamp_us), '%Y-%m-%d') AS label, {SUMS} FROM token_usage GROUP BY 1", "tokens_by_day")(lambda v: tokens.tokens_by_day(v.token_usage))
query(f"SELECT *, total * 100.0 / sum(total) OVER () AS share FROM (SELECT agent_id AS label, {SUMS} FROM token_usage GROUP BY 1)", "tokens_with_share")(lambda v: tokens.with_share(tokens.tokens_by(v.token_usage, "agent")))
query(f"SELECT provider || '/' || coalesce(model, '(unknown)') AS label, {SUMS} FROM {RANGED} GROUP BY 1 ORDER BY total DESC, label LIMIT 5", "compare")(lambda v: tokens.ranked(tokens.tokens_by(tokens.in_range(v.token_usage, FROM, TO), "model"), 5))
query(f"SELECT *, greatest((SELECT count(*) FROM (SELECT DISTINCT project_id FROM token_usage)) - 3, 0) AS more FROM (SELECT max(coalesce(path, '(unknown)')) AS label, {SUMS} {_DIMS} GROUP BY project_id) ORDER BY total DESC, label LIMIT 3", "ranked_breakdown")(lambda v: tokens.ranked_with_rest(tokens.tokens_by(v.token_usage, "project", v.projects), 3))


def _with_detail(v):
    usage = F.to_json(F.struct(F.struct((F.col("output_tokens") / 5).cast("long").alias("thinking_tokens")).alias("output_tokens_details"), F.struct(F.col("input_tokens").alias("ephemeral_5m_input_tokens"), F.col("cache_read_input_tokens").alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.when(F.col("id") % 9 == 0, "ttl").alias("cache_miss_reason")))
    return v.token_usage.withColumn("provider_usage", usage)


_DETAIL = "SELECT provider, CAST(sum(output_tokens // 5) AS BIGINT) AS reasoning, CAST(sum(input_tokens) AS BIGINT) AS cache_5m, CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_1h, CAST(0 AS BIGINT) AS web_searches, CAST(0 AS BIGINT) AS web_fetches, count(CASE WHEN id % 9 = 0 THEN 1 END) AS cache_misses, CAST(sum(output_tokens) AS BIGINT) AS output, count(*) AS responses FROM token_usage GROUP BY provider"
query(_DETAIL, "token_detail")(lambda v: tokens.token_detail(_with_detail(v)))
query(f"SELECT *, reasoning * 100.0 / output AS reasoning_share, cache_1h * 100.0 / (cache_5m + cache_1h) AS cache_1h_share, cache_misses * 100.0 / responses AS miss_share, FALSE AS is_empty FROM ({_DETAIL})", "token_detail_ratios")(lambda v: tokens.detail_ratios(tokens.token_detail(_with_detail(v))))
query(f"SELECT responses_drift, tokens_drift, CASE WHEN responses_drift < 0 OR tokens_drift < 0 THEN 'ahead' WHEN responses_drift > 0 OR tokens_drift > 0 THEN 'behind' ELSE 'clean' END AS state FROM (SELECT CAST(sum(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS responses_drift, CAST(sum(CASE WHEN id % 10 = 0 THEN {TOTAL} ELSE 0 END) AS BIGINT) AS tokens_drift FROM token_usage)", "drift")(lambda v: tokens.drift(v.token_usage, v.token_usage.where("id % 10 <> 0")))
query(f"SELECT session_id, responses_drift, tokens_drift, CASE WHEN responses_drift < 0 OR tokens_drift < 0 THEN 'ahead' WHEN responses_drift > 0 OR tokens_drift > 0 THEN 'behind' ELSE 'clean' END AS state FROM (SELECT session_id, CAST(sum(CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS responses_drift, CAST(sum(CASE WHEN id % 50 = 0 THEN {TOTAL} ELSE 0 END) AS BIGINT) AS tokens_drift FROM token_usage GROUP BY session_id)", "drift_by_session")(lambda v: tokens.drift(v.token_usage, v.token_usage.where("id % 50 <> 0"), "session_id"))
query("SELECT id, agent_id FROM token_usage WHERE agent_id = 'codex'", "agent_filter")(lambda v: tokens.agent_filter(v.token_usage, ["codex"]).select("id", "agent_id"))
query(f"SELECT id FROM token_usage WHERE timestamp_us >= 1704844800000000 AND timestamp_us < 1705276800000000", "range_days")(lambda v: tokens.in_range(v.token_usage, *reports.range_days(5, "UTC", date(2024, 1, 14))).select("id"))

# ---- status, health, activity
_STATUS = "CASE WHEN id % 3 = 0 THEN 'active' WHEN id % 3 = 1 THEN 'ended' ELSE 'unknown' END"
_SESSIONS2 = f"(SELECT *, {_STATUS} AS status, CASE WHEN id % 4 = 0 THEN ended_us END AS reconciled_at_us, CASE WHEN id % 5 = 0 THEN started_us END AS reconcile_attempted_at_us, CASE WHEN id % 6 <> 0 THEN CAST(id AS STRING) END AS external_session_id, CASE WHEN id % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS agent_id, CAST((ended_us - started_us - (ended_us - started_us) % 1000) / 1000 AS BIGINT) AS duration_ms FROM {{s}})"


def _sessions(v):
    return v.spark.sql("SELECT * FROM " + _SESSIONS2.format(s="{s}"), s=v.sessions)


_S2 = _SESSIONS2.format(s="sessions")
query(f"SELECT (SELECT count(*) FROM spine) AS events, (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM {_S2} WHERE status = 'active') AS active_sessions, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM spine WHERE kind = 'unknown') AS unknown_events", "status_totals")(lambda v: reports.status_totals(v.spine, _sessions(v), v.projects))
query("SELECT coalesce(json_extract_string(payload, '$.k'), '(no label)') AS label, count(*) AS count FROM spine WHERE kind = 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "unknown_labels")(lambda v: reports.unknown_labels(v.spine, 20, "$.k"))
query(f"SELECT max(timestamp_us) AS last_event_us, (SELECT count(*) FROM {_S2} WHERE reconciled_at_us IS NULL) AS unreconciled, {AS_OF} - max(timestamp_us) >= 86400000000 AS idle FROM spine", "collection_health")(lambda v: reports.collection_health(v.spine.withColumn("created_at_us", F.col("timestamp_us")), _sessions(v), AS_OF))
query("SELECT s.id, timestamp_us, kind, path AS project_path FROM spine s LEFT JOIN projects p ON s.project_id = p.id ORDER BY timestamp_us DESC, s.id DESC LIMIT 100", "recent_events")(lambda v: reports.recent_events(v.spine, v.projects, 100).select("id", "timestamp_us", "kind", "project_path"))
query(f"SELECT s.id, timestamp_us, kind FROM spine s JOIN projects p ON s.project_id = p.id WHERE agent_id = 'codex' AND kind IN ('command', 'file.read') AND timestamp_us >= {FROM} AND (repository_root = '/work/r1' OR starts_with(lower(repository_root), '/work/r1/') OR path = '/work/r1' OR starts_with(lower(path), '/work/r1/')) ORDER BY timestamp_us DESC, s.id DESC LIMIT 200", "activity")(lambda v: reports.activity(v.spine, v.projects, from_us=FROM, agent="codex", kinds=("command", "file.read"), project_prefix="/work/r1", limit=200).select("id", "timestamp_us", "kind"))
query("SELECT id FROM file_events WHERE path = '/work/p1' OR starts_with(lower(path), '/work/p1/')", "under_path")(lambda v: v.file_events.where(values.under_path("path", "/work/p1/")).select("id"))
query("SELECT id, CASE kind WHEN 'unknown' THEN coalesce(json_extract_string(payload, '$.label'), '') WHEN 'command' THEN coalesce(json_extract_string(payload, '$.command'), '') ELSE '' END AS detail FROM spine WHERE kind <> 'file.read'", "event_detail")(lambda v: v.spine.where("kind <> 'file.read'").select("id", values.event_detail("kind", "payload").alias("detail")))

# ---- files, tools, access
_SENSE = "CASE WHEN path LIKE '%/.env' THEN 'sensitive' WHEN path LIKE '%/.ssh/%' THEN 'highly_sensitive' ELSE 'normal' END"
_REFS = "SELECT id, timestamp_us, session_id, project_id, agent_id, CASE WHEN command LIKE 'cat %' THEN substr(command, 5) ELSE '~/.ssh/id_rsa' END AS path, CASE WHEN command LIKE 'cat %' THEN 'sensitive' ELSE 'highly_sensitive' END AS sensitivity FROM commands WHERE command NOT LIKE 'make %'"
query("SELECT path, count(*) FILTER (operation = 'write') AS writes, count(*) FILTER (operation = 'read') AS reads, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN operation = 'read' THEN agent_id END) AS reading_agents FROM file_events GROUP BY path HAVING count(*) FILTER (operation = 'write') > 0 ORDER BY writes DESC, path LIMIT 50", "file_churn")(lambda v: reports.file_churn(v.file_events, 50))
query("SELECT agent_id, tool, count(*) AS calls, count(*) FILTER (failed) AS failures, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, max(duration_ms) AS max_ms, count(*) FILTER (failed) * 100.0 / count(*) AS failure_rate FROM tool_outcomes GROUP BY 1, 2", "tool_reliability")(lambda v: reports.tool_reliability(v.tool_outcomes))
query(f"SELECT id, {_SENSE} AS sensitivity FROM file_events", "classify_path")(lambda v: v.file_events.select("id", sensitivity.classify_path("path").alias("sensitivity")))
query(f"SELECT id, path, {_SENSE} AS sensitivity FROM file_events WHERE {_SENSE} <> 'normal'", "sensitive_files")(lambda v: reports.sensitive_files(v.file_events).select("id", "path", "sensitivity"))


def _files(v):
    return v.file_events.withColumn("sensitivity", sensitivity.classify_path("path"))


def _references(v):
    return sensitivity.scan_commands(v.commands)


query(f"SELECT concat(CAST(id AS VARCHAR), ':0') AS id, id AS command_id, path, sensitivity FROM ({_REFS})", "scan_commands")(lambda v: _references(v).select("id", "command_id", "path", "sensitivity"))
query("SELECT id, CASE WHEN command LIKE 'cat %' THEN 'sensitive' WHEN command LIKE 'make %' THEN 'normal' ELSE 'highly_sensitive' END AS sensitivity FROM commands", "worst_in_command")(lambda v: v.commands.select("id", sensitivity.worst_in_command("command").alias("sensitivity")))
_NOTABLE = f"SELECT timestamp_us, agent_id, session_id, project_id, concat('file.', operation) AS what, path, {_SENSE} AS sensitivity, 'transcript' AS evidence FROM file_events WHERE {_SENSE} <> 'normal' UNION ALL SELECT timestamp_us, agent_id, session_id, project_id, 'command' AS what, path, sensitivity, 'derived' AS evidence FROM ({_REFS})"
query(f"SELECT * FROM ({_NOTABLE}) ORDER BY CASE sensitivity WHEN 'highly_sensitive' THEN 2 ELSE 1 END DESC, timestamp_us DESC, what, path, session_id LIMIT 100", "notable_access")(lambda v: reports.notable_access(_files(v), _references(v), 100))
query(f"SELECT CAST((SELECT sum({TOTAL}) FROM token_usage WHERE timestamp_us >= {FROM} AND timestamp_us < {FROM} + 86400000000) AS BIGINT) AS tokens, (SELECT count(DISTINCT session_id) FROM spine WHERE timestamp_us >= {FROM} AND timestamp_us < {FROM} + 86400000000) AS sessions, (SELECT count(*) FROM file_events WHERE {_SENSE} <> 'normal' AND timestamp_us >= {FROM} AND timestamp_us < {FROM} + 86400000000) AS sensitive", "daily_snapshot")(lambda v: reports.daily_snapshot(v.token_usage, v.file_events, v.spine, date(2024, 1, 8)))
query("SELECT f.id, f.path, s.evidence FROM file_events f JOIN spine s ON f.id = s.id", "file_evidence")(lambda v: reports.file_evidence(v.file_events, v.spine).select("id", "path", "evidence"))

# ---- dedup, folds
query("SELECT id, min(timestamp_us) AS timestamp_us FROM spine GROUP BY id", "dedupe_events")(lambda v: dedupe.dedupe_events(v.spine.unionByName(v.spine.withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000).withColumn("timestamp_us", F.col("timestamp_us") + 5))).select("id", "timestamp_us"))
query("SELECT agent_id, CAST(request_id AS BIGINT) AS request_id, arg_min(id, id) AS id, arg_min(input_tokens, id) AS input_tokens, arg_max(provider_usage, id) AS provider_usage FROM token_usage GROUP BY 1, 2", "dedupe_responses")(lambda v: dedupe.dedupe_responses(v.token_usage).select("agent_id", "request_id", "id", "input_tokens", "provider_usage"))
query("SELECT count(*) AS usage_records, count(DISTINCT (agent_id, request_id)) AS responses, count(*) * 1.0 / count(DISTINCT (agent_id, request_id)) AS inflation FROM token_usage", "record_inflation")(lambda v: dedupe.record_inflation(v.token_usage))
query("SELECT agent_id AS id, min(timestamp_us) AS first_seen_us, max(timestamp_us) AS last_seen_us FROM spine GROUP BY 1", "build_agents")(lambda v: dedupe.build_agents(v.spine))
query("SELECT project_id AS id, min(timestamp_us) AS first_seen_us, max(timestamp_us) AS last_seen_us FROM spine WHERE project_id IS NOT NULL GROUP BY 1", "build_projects")(lambda v: dedupe.build_projects(v.spine))
_BUILT = """SELECT id, agent_id, project_id, started_us, ended_us, surface, CASE last WHEN 'session.started' THEN 'active' WHEN 'session.ended' THEN 'ended' ELSE 'unknown' END AS status, CASE WHEN ended_us IS NOT NULL THEN (ended_us - started_us) // 1000 END AS duration_ms FROM (
 SELECT session_id AS id, arg_min(agent_id, ingest_seq) AS agent_id, arg_min(project_id, ingest_seq) FILTER (project_id IS NOT NULL) AS project_id, min(timestamp_us) AS started_us, arg_max(timestamp_us, ingest_seq) FILTER (kind = 'session.ended') AS ended_us,
 arg_max(surface, ingest_seq) FILTER (surface IS NOT NULL) AS surface, arg_max(kind, ingest_seq) FILTER (kind IN ('session.started', 'session.ended')) AS last FROM spine GROUP BY session_id)"""
query(_BUILT, "build_sessions")(lambda v: dedupe.build_sessions(v.spine))
_SP = "SELECT session_id, project_id, min(timestamp_us) AS first_seen_us, max(timestamp_us) AS last_seen_us, count(*) AS event_count FROM token_usage GROUP BY 1, 2"
query(_SP, "session_projects")(lambda v: dedupe.session_projects(v.token_usage))
query("SELECT session_id, coalesce(arg_max(p, ingest_seq) FILTER (f), arg_min(p, ingest_seq) FILTER (NOT f)) AS parent_session_id FROM (SELECT session_id, k % 9 AS p, ingest_seq, ingest_seq % 2 = 0 AS f FROM spine WHERE k % 4 = 0) GROUP BY 1", "repair_parents")(lambda v: dedupe.repair_parents(v.spine.withColumn("id", F.col("id") - F.col("id") % 2).withColumn("parent_session_id", F.when(F.col("k") % 4 == 0, F.col("k") % 9))))
query(f"SELECT id, CASE WHEN status = 'active' AND id NOT IN (SELECT session_id FROM spine WHERE kind = 'session.started' AND session_id % 2 = 0) THEN 'unknown' ELSE status END AS status FROM {_S2}", "demote_unstarted")(lambda v: dedupe.demote_unstarted(_sessions(v), v.spine.where("session_id % 2 = 0")).select("id", "status"))
query("SELECT id FROM sessions WHERE id NOT IN (SELECT session_id FROM spine WHERE kind = 'session.started' AND k % 20 = 0)", "without_start")(lambda v: dedupe.without_start(v.sessions, v.spine.where("k % 20 = 0")).select("id"))

# ---- repositories, trees
query("SELECT id, path, CASE WHEN id % 4 IN (1, 2) THEN concat('/work/r', CAST(id % 4 AS VARCHAR)) WHEN id % 4 = 3 THEN '/work' ELSE '/work' END AS repository_root FROM projects", "resolve_repositories")(lambda v: repositories.resolve_repositories(v.projects, v.spark.sql("SELECT explode(array('/work', '/work/r1', '/work/r2', '/else')) AS root")).select("id", "path", "repository_root"))
query("SELECT u.id, p.repository_root FROM token_usage u LEFT JOIN projects p ON u.project_id = p.id", "link_repositories")(lambda v: repositories.link_repositories(v.token_usage.withColumn("repository_root", F.lit(None).cast("string")), v.projects).select("id", "repository_root"))
query("SELECT count(*) AS missing_before, count(*) FILTER (p.repository_root IS NULL) AS missing_after FROM token_usage u LEFT JOIN projects p ON u.project_id = p.id", "backfill_report")(lambda v: repositories.backfill_report((u := v.token_usage.withColumn("repository_root", F.lit(None).cast("string"))), repositories.link_repositories(u, v.projects)))
_TREE = "(WITH RECURSIVE t AS (SELECT id AS root_id, id AS member_id, 0 AS depth FROM sessions UNION SELECT t.root_id, s.id, t.depth + 1 FROM t JOIN sessions s ON s.parent_session_id = t.member_id) SELECT * FROM t)"


def _closure(v):
    return repositories.session_descendants(v.sessions)


query(f"SELECT root_id, member_id, depth FROM {_TREE}", "session_descendants")(_closure)
query(f"SELECT root_id, count(*) AS responses FROM token_usage u JOIN {_TREE} t ON u.session_id = t.member_id GROUP BY 1", "usage_in_tree")(lambda v: repositories.in_tree(v.token_usage, _closure(v)).groupBy("root_id").agg(F.count("*").alias("responses")))

# ---- sessions and receipts
query(f"SELECT id FROM sessions WHERE (started_us >= {FROM} AND started_us < {TO}) OR EXISTS (SELECT 1 FROM spine e WHERE e.session_id = sessions.id AND e.timestamp_us >= {FROM} AND e.timestamp_us < {TO})", "sessions_in_range")(lambda v: reports.sessions_in_range(v.sessions, v.spine, FROM, TO).select("id"))
_COUNTS = f"""SELECT s.id, coalesce(u.tokens, 0) AS tokens, coalesce(u.responses, 0) AS responses, coalesce(c.n, 0) AS commands, coalesce(f.n, 0) AS files, coalesce(f.g, 0) + coalesce(r.n, 0) AS sensitive, m.model, d.project, coalesce(d.projects, 0) AS projects,
 s.parent_session_id IS NOT NULL OR coalesce(u.only_sub, FALSE) AS is_subagent FROM sessions s
 LEFT JOIN (SELECT session_id, CAST(sum({TOTAL}) AS BIGINT) AS tokens, count(*) AS responses, bool_and(is_subagent) AS only_sub FROM token_usage GROUP BY 1) u ON s.id = u.session_id
 LEFT JOIN (SELECT session_id, count(*) AS n FROM commands GROUP BY 1) c ON s.id = c.session_id
 LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER ({_SENSE} <> 'normal') AS g FROM file_events GROUP BY 1) f ON s.id = f.session_id
 LEFT JOIN (SELECT session_id, count(*) AS n FROM ({_REFS}) GROUP BY 1) r ON s.id = r.session_id
 LEFT JOIN (SELECT session_id, model FROM (SELECT session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY sum({TOTAL}) DESC, model DESC NULLS LAST) AS n FROM token_usage GROUP BY 1, 2) WHERE n = 1) m ON s.id = m.session_id
 LEFT JOIN (SELECT session_id, count(*) AS projects, max(coalesce(repository_root, path)) AS project FROM ({_SP}) x JOIN projects p ON x.project_id = p.id GROUP BY 1) d ON s.id = d.session_id"""


def _listed(v, **options):
    return reports.session_list(v.sessions, v.spine, v.token_usage, v.commands, _files(v), _references(v), v.projects, dedupe.session_projects(v.token_usage), **options)


_LISTED = ["id", "tokens", "responses", "commands", "files", "sensitive", "model", "project", "projects", "is_subagent"]
query(_COUNTS, "session_list")(lambda v: _listed(v).select(*_LISTED))
query(f"SELECT id, tokens, tokens * 100.0 / max(tokens) OVER () AS share FROM ({_COUNTS})", "session_share")(lambda v: tokens.with_share(_listed(v).select("id", "tokens"), "tokens", "max"))
query(f"SELECT id, CASE status WHEN 'ended' THEN duration_ms WHEN 'active' THEN greatest({AS_OF} - started_us, 0) // 1000 END AS running_ms FROM {_S2}", "running_duration")(lambda v: reports.running_duration(_sessions(v), AS_OF).select("id", "running_ms"))
query(f"SELECT id FROM {_S2} WHERE reconciled_at_us IS NULL AND agent_id = 'claude-code' AND external_session_id IS NOT NULL ORDER BY coalesce(reconcile_attempted_at_us, 0), started_us DESC, id LIMIT 20", "pending_sessions")(lambda v: reports.pending_sessions(_sessions(v), 20).select("id"))
query(f"SELECT id FROM ({_COUNTS}) JOIN (SELECT id AS i, started_us FROM sessions) ON id = i ORDER BY is_subagent, started_us DESC, id DESC LIMIT 1", "find_latest_session")(lambda v: reports.find_session(_listed(v), "latest").select("id"))
query(f"SELECT id, count(*) OVER () AS matches FROM sessions WHERE starts_with(CAST(id AS VARCHAR), '1')", "find_session")(lambda v: reports.find_session(v.sessions, "1").select("id", "matches"))
query(f"SELECT root_id, path, project_id, count(*) FILTER (operation = 'read') AS reads, count(*) FILTER (operation = 'write') AS writes, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM file_events f JOIN {_TREE} t ON f.session_id = t.member_id GROUP BY 1, 2, 3", "receipt_files")(lambda v: reports.receipt_files(v.file_events, _closure(v)))
query(f"SELECT root_id, model, is_subagent, {SUMS} FROM token_usage u JOIN {_TREE} t ON u.session_id = t.member_id GROUP BY 1, 2, 3", "receipt_tokens")(lambda v: reports.receipt_tokens(v.token_usage, _closure(v)))
query(f"SELECT root_id, timestamp_us, id, session_id, command FROM commands c JOIN {_TREE} t ON c.session_id = t.member_id", "receipt_commands")(lambda v: reports.receipt_commands(v.commands, _closure(v)))
query(f"SELECT n.*, root_id FROM ({_NOTABLE}) n JOIN {_TREE} t ON n.session_id = t.member_id", "receipt_notable_access")(lambda v: reports.receipt_notable_access(_files(v), _references(v), _closure(v)))
query(f"SELECT root_id, label, e AS event_count, row_number() OVER (PARTITION BY root_id ORDER BY e DESC, l DESC, label) AS place FROM (SELECT root_id, label, arg_max(event_count, (event_count, last_seen_us)) AS e, arg_max(last_seen_us, (event_count, last_seen_us)) AS l FROM (SELECT root_id, coalesce(repository_root, path) AS label, event_count, last_seen_us FROM ({_SP}) x JOIN {_TREE} t ON x.session_id = t.member_id JOIN projects p ON x.project_id = p.id) GROUP BY 1, 2)", "session_project_list")(lambda v: reports.session_project_list(dedupe.session_projects(v.token_usage), v.projects, _closure(v)))
query("SELECT root_id, "
      + ", ".join(f"CASE WHEN bool_or(kind IN ({k})) THEN 'yes' ELSE 'none seen' END AS {n}" for n, k in (("tokens", "'token.usage'"), ("session_start", "'session.started'"), ("tools", "'tool.call', 'tool.outcome'"), ("commands", "'command'"), ("files", "'file.read', 'file.write'"), ("mcp", "'mcp.call'")))
      + f", 'not collected' AS network, 'not collected' AS processes, 'not collected' AS prompt_content FROM spine s JOIN {_TREE} t ON s.session_id = t.member_id GROUP BY 1", "session_coverage")(lambda v: reports.session_coverage(v.spine, _closure(v)))
query(f"SELECT id, count(*) AS gaps FROM (SELECT id, unnest(range(CASE WHEN agent_id = 'codex' THEN 5 ELSE 3 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END)) FROM {_S2}) GROUP BY 1", "coverage_gaps")(lambda v: reports.coverage_gaps(_sessions(v).withColumn("git_branch", F.when(F.col("id") % 2 != 0, "main"))).groupBy("id").agg(F.count("*").alias("gaps")))


@query(f"SELECT 'tokens' AS section, count(*) AS n FROM (SELECT DISTINCT model, is_subagent FROM token_usage u JOIN {_TREE} t ON u.session_id = t.member_id WHERE root_id = 7) UNION ALL SELECT 'commands', count(*) FROM commands c JOIN {_TREE} t ON c.session_id = t.member_id WHERE root_id = 7 UNION ALL SELECT 'timeline', count(*) FROM spine s JOIN {_TREE} t ON s.session_id = t.member_id WHERE root_id = 7")
def session_receipt(v):
    tables = {"sessions": _sessions(v).withColumn("git_branch", F.lit(None).cast("string")), "session_projects": dedupe.session_projects(v.token_usage), "projects": v.projects, "token_usage": v.token_usage, "file_events": _files(v), "commands": v.commands, "references": _references(v), "spine": v.spine}
    sections = reports.session_receipt(tables, _closure(v), 7)
    return union_all([sections[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("section"), "n") for n in ("tokens", "commands", "timeline")])


# ---- changes and intervals
query("SELECT session_id, id, kind, previous FROM (SELECT *, lag(kind) OVER w AS previous, row_number() OVER w AS n FROM spine WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_us, id)) WHERE n = 1 OR kind <> previous", "transitions")(lambda v: changes.transitions(v.spine, ["session_id"], ["timestamp_us", "id"], "kind").select("session_id", "id", "kind", "previous"))


def _pauses(v):
    return v.spine.select(F.col("session_id").alias("host"), "timestamp_us", (F.col("k") % 2 == 0).alias("paused"), "id").groupBy("host", "timestamp_us").agg(F.max_by("paused", "id").alias("paused"))


_PAUSED = "(SELECT host, timestamp_us, paused, CASE WHEN paused THEN 'collection.paused' ELSE 'collection.resumed' END AS kind FROM (SELECT *, lag(paused) OVER (PARTITION BY host ORDER BY timestamp_us) AS p FROM (SELECT session_id AS host, timestamp_us, arg_max(k % 2 = 0, id) AS paused FROM spine GROUP BY 1, 2)) WHERE (p IS NULL AND paused) OR p <> paused)"
query(f"SELECT host, timestamp_us, kind FROM {_PAUSED}", "pause_transitions")(lambda v: changes.pause_transitions(_pauses(v)).select("host", "timestamp_us", "kind"))
query(f"SELECT host, paused_us, resumed_us FROM (SELECT host, kind, timestamp_us AS paused_us, lead(timestamp_us) OVER (PARTITION BY host ORDER BY timestamp_us) AS resumed_us FROM {_PAUSED}) WHERE kind = 'collection.paused'", "collection_gaps")(lambda v: changes.collection_gaps(changes.pause_transitions(_pauses(v))))


def _snapshots(v):
    rows = v.spine.groupBy(F.concat(F.lit("/home/"), F.col("session_id").cast("string")).alias("path"), F.col("timestamp_us").alias("observed_at_us")).agg(F.max("k").alias("k"))
    hooks_json = F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 3 == 1, '{"b":1,"a":{"d":[2,1],"c":null}}').otherwise('{"a":{"c":null,"d":[2,1]},"b":2}')
    return changes.config_fingerprint(rows.withColumn("hooks_json", hooks_json))


query("SELECT path, observed_at_us, p <> 0 AND k = 0 AS collection_stopped FROM (SELECT path, observed_at_us, k, lag(k) OVER (PARTITION BY path ORDER BY observed_at_us) AS p FROM (SELECT concat('/home/', CAST(session_id AS VARCHAR)) AS path, timestamp_us AS observed_at_us, max(k) % 3 AS k FROM spine GROUP BY 1, 2)) WHERE p <> k", "config_changes")(lambda v: changes.config_changes(_snapshots(v)).select("path", "observed_at_us", "collection_stopped"))
query("SELECT session_id, nth, e AS enqueued_us, d AS dequeued_us, (d - e) // 1000 AS wait_ms FROM (SELECT session_id, nth, max(timestamp_us) FILTER (o = 0) AS e, max(timestamp_us) FILTER (o = 1) AS d FROM (SELECT session_id, timestamp_us, k % 2 AS o, row_number() OVER (PARTITION BY session_id, k % 2 ORDER BY timestamp_us, id) AS nth FROM spine) GROUP BY 1, 2) WHERE e IS NOT NULL AND d >= e", "queue_waits")(lambda v: changes.queue_waits(v.spine.withColumn("operation", F.when(F.col("k") % 2 == 0, "enqueue").otherwise("dequeue"))).withColumn("nth", F.col("nth").cast("long")))
query("SELECT id, session_id, timestamp_us, mode FROM (SELECT id, session_id, timestamp_us, f, last_value(m IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY timestamp_us, f, id ROWS UNBOUNDED PRECEDING) AS mode FROM (SELECT id, session_id, timestamp_us, CASE WHEN kind = 'command' THEN 1 ELSE 0 END AS f, CASE WHEN kind <> 'command' THEN concat('mode-', CAST(k % 3 AS VARCHAR)) END AS m FROM spine WHERE kind IN ('command', 'unknown'))) WHERE f = 1", "posture_in_force")(lambda v: changes.posture_in_force(v.spine.where("kind = 'command'"), v.spine.where("kind = 'unknown'").withColumn("mode", F.concat(F.lit("mode-"), (F.col("k") % 3).cast("string")))).select("id", "session_id", "timestamp_us", "mode"))
query("SELECT session_id, min(timestamp_us) AS start_us, max(timestamp_us) + 43200000000 AS end_us, count(*) AS events FROM (SELECT *, sum(CASE WHEN p IS NULL OR timestamp_us - p >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp_us, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(timestamp_us) OVER (PARTITION BY session_id ORDER BY timestamp_us, id) AS p FROM spine)) GROUP BY session_id, g", "activity_windows")(lambda v: changes.activity_windows(v.spine, "12 hours"))

# ---- redaction over whole texts
_SECRET_ROWS = "SELECT page_id AS id, concat('curl --token ', CAST(page_id AS VARCHAR), ' https://me:pw', CAST(page_id AS VARCHAR), '@h/run?api_key=', CAST(page_id AS VARCHAR), ' sk-abcdefgh', CAST(page_id AS VARCHAR)) AS command FROM pages"


def _secrets(v):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("curl --token "), n, F.lit(" https://me:pw"), n, F.lit("@h/run?api_key="), n, F.lit(" sk-abcdefgh"), n)
    return v.spark.read.parquet(f"{v.dir}/pages.parquet").select(F.col("page_id").alias("id"), text.alias("command"))


query("SELECT page_id AS id, 'curl --token [REDACTED] https://me:[REDACTED]@h/run?api_key=[REDACTED] [REDACTED]' AS command FROM pages", "redact_commands")(lambda v: redact.redact_commands(_secrets(v)))


@query("SELECT count(*) AS documents, CAST(0 AS BIGINT) AS leaks, CAST(0 AS BIGINT) AS changed_again FROM documents WHERE text IS NOT NULL")
def redact_documents(v):
    # Each text takes long, and a file's rows may all be in one row group, which is read by one task.
    texts = v.spark.read.parquet(f"{v.dir}/documents.parquet").where("text is not null").select("doc_id", "text").repartition(4 * v.spark.sparkContext.defaultParallelism)
    docs = texts.select("doc_id", redact.redacted("text", ["ACME-[A-Z0-9]{8}"]).alias("once"))
    leak = F.col("once").rlike(redact.KEY_SHAPES)
    return docs.agg(F.count("*").alias("documents"), F.count_if(leak).alias("leaks"), F.count_if(redact.redacted("once", ["ACME-[A-Z0-9]{8}"]) != F.col("once")).alias("changed_again"))


@query("SELECT count(*) AS scanned, count(*) AS changed, CAST(0 AS INTEGER) AS patterns FROM pages")
def scrub(v):
    commands = _secrets(v)
    events = commands.select("id", F.lit("command").alias("kind"), F.to_json(F.struct("command")).alias("payload"))
    return redact.scrub(events, commands)[2]


@query("SELECT count(*) AS scanned, CAST(0 AS BIGINT) AS changed, CAST(0 AS INTEGER) AS patterns FROM pages")
def scrub_again(v):
    commands = _secrets(v)
    events, cleaned, _ = redact.scrub(commands.select("id", F.lit("command").alias("kind"), F.to_json(F.struct("command")).alias("payload")), commands)
    return redact.scrub(events, cleaned)[2]


query("SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name FROM pages", "display_name")(lambda v: v.spark.read.parquet(f"{v.dir}/pages.parquet").select("page_id", values.display_name("url").alias("name")))
query("SELECT doc_id, length(text) AS char_count, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL", "prompt_fingerprint")(lambda v: hooks.prompt_fingerprint(v.spark.read.parquet(f"{v.dir}/documents.parquet").where("text is not null").select("doc_id", F.col("text").alias("prompt"))).withColumn("char_count", F.col("char_count").cast("long")))
query("SELECT id, CASE WHEN duration_ms IS NULL THEN '—' WHEN duration_ms < 1000 THEN concat(CAST(duration_ms AS VARCHAR), 'ms') WHEN duration_ms < 60000 THEN printf('%d.%ds', (duration_ms + 50) // 1000, (duration_ms + 50) // 100 % 10) ELSE printf('%dm%02ds', duration_ms // 60000, (duration_ms % 60000) // 1000) END AS shown FROM tool_outcomes", "format_duration")(lambda v: v.tool_outcomes.select("id", values.duration("duration_ms").alias("shown")))
query("SELECT id, printf('%,d', input_tokens) AS thousands FROM token_usage", "format_thousands")(lambda v: v.token_usage.select("id", values.thousands("input_tokens").alias("thousands")))
query("SELECT id, concat(replace(path, '/', '-'), '/', CAST(id AS VARCHAR), '.jsonl') AS log FROM projects", "transcript_path")(lambda v: v.projects.select("id", values.transcript_path("path", F.col("id").cast("string")).alias("log")))
query("SELECT id, strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS told, timestamp_us AS back_us FROM spine", "rfc3339")(lambda v: v.spine.withColumn("told", values.us_to_rfc3339("timestamp_us")).select("id", "told", values.rfc3339_to_us("told").alias("back_us")))
query("SELECT count(DISTINCT id) AS ids, count(DISTINCT id) AS keys, 36 AS length FROM spine", "deterministic_ids")(lambda v: v.spine.select("id", values.event_id("agent_id", F.col("id").cast("string")).alias("key")).agg(F.count_distinct("id").alias("ids"), F.count_distinct("key").alias("keys"), F.max(F.length("key")).alias("length")))

# ---- logs made of events: file = user, lines in order of time
_LINED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_us, event_id) - 1 AS line_no FROM ev)"


def _lined(v):
    return v.spark.sql(f"SELECT * FROM {_LINED.replace('FROM ev', 'FROM {ev}')}", ev=v.ev)


def _transcript_lines(v):
    at = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp, CAST(user_id AS STRING) AS sessionId, '/work/a' AS cwd"
    use = "named_struct('type', 'tool_use', 'id', concat('c', CAST(k % 10 AS STRING)), 'name', CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'mcp__srv__find' ELSE 'Glob' END, 'input', named_struct('file_path', IF(k % 4 = 0, '/a/b', NULL), 'command', IF(k % 4 = 1, 'ls', NULL)))"
    value = f"""CASE event_type
      WHEN 'view' THEN to_json(struct('assistant' AS type, {at}, event_id % 5 = 0 AS isSidechain, named_struct('id', concat('m', CAST(k AS STRING)), 'model', 'x', 'usage', named_struct('input_tokens', event_id, 'output_tokens', k, 'extra', named_struct('deep', k)), 'content', array({use})) AS message))
      WHEN 'purchase' THEN to_json(struct('user' AS type, {at}, named_struct('content', array(named_struct('type', 'tool_result', 'tool_use_id', concat('c', CAST(k % 10 AS STRING)), 'is_error', k % 2 = 0))) AS message))
      WHEN 'click' THEN to_json(struct('user' AS type, {at}, concat('mode-', CAST(k % 3 AS STRING)) AS permissionMode))
      WHEN 'signup' THEN to_json(struct('queue-operation' AS type, {at}, IF(k % 2 = 0, 'enqueue', 'dequeue') AS operation))
      ELSE '{{"type": "assist' END"""
    return _lined(v).selectExpr("CAST(user_id AS STRING) AS file", "CAST(line_no AS BIGINT) AS line_no", f"{value} AS value")


_FIRST = "(SELECT *, row_number() OVER (PARTITION BY user_id, {k} ORDER BY line_no) AS nth FROM " + _LINED + " WHERE event_type = 'view')"
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, concat('m', CAST(k AS VARCHAR)) AS request_id, event_id AS input_tokens, k AS output_tokens, event_id % 5 = 0 AS is_subagent, concat('{{\"extra\":{{\"deep\":', CAST(k AS VARCHAR), '}}}}') AS provider_usage FROM {_FIRST.format(k='k')} WHERE nth = 1", "transcript_token_usage")(
    lambda v: (e := transcripts.transcript_token_usage(_transcript_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "request_id string, input_tokens bigint, output_tokens bigint, is_subagent boolean, provider_usage string").alias("p")).select("session", "timestamp_us", "p.*")
)
query(f"SELECT count(*) AS usage_records, count(DISTINCT (user_id, k)) AS responses, count(*) * 1.0 / count(DISTINCT (user_id, k)) AS inflation FROM {_LINED} WHERE event_type = 'view'", "transcript_inflation")(lambda v: transcripts.record_inflation(_transcript_lines(v)))
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, CASE k % 4 WHEN 0 THEN 'file.read' WHEN 1 THEN 'command' WHEN 2 THEN 'mcp.call' ELSE 'tool.call' END AS kind, CASE k % 4 WHEN 0 THEN '/a/b' WHEN 1 THEN 'ls' WHEN 2 THEN 'srv.find' ELSE 'Glob' END AS detail FROM {_FIRST.format(k='k % 10')} WHERE nth = 1", "transcript_activity")(
    lambda v: transcripts.transcript_activity(_transcript_lines(v)).select(F.col("external_session_id").alias("session"), "timestamp_us", "kind", values.event_detail("kind", "payload").alias("detail"))
)
_PAIRED = f"SELECT c.user_id, c.k % 10 AS id, c.k AS ck, c.timestamp_us AS called, min(r.line_no) AS line FROM {_FIRST.format(k='k % 10')} c JOIN {_LINED} r ON r.event_type = 'purchase' AND r.user_id = c.user_id AND r.k % 10 = c.k % 10 AND r.line_no > c.line_no WHERE c.nth = 1 GROUP BY 1, 2, 3, 4"
query(f"SELECT CAST(p.user_id AS VARCHAR) AS session, l.timestamp_us, concat('c', CAST(p.id AS VARCHAR)) AS tool_use_id, (l.timestamp_us - called) // 1000 AS duration_ms, l.k % 2 = 0 AS failed, CASE ck % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'mcp__srv__find' ELSE 'Glob' END AS tool FROM ({_PAIRED}) p JOIN {_LINED} l ON l.user_id = p.user_id AND l.line_no = p.line", "transcript_outcomes")(
    lambda v: transcripts.transcript_outcomes(_transcript_lines(v)).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "tool_use_id string, duration_ms bigint, failed boolean, tool string").alias("p")).select("session", "timestamp_us", "p.*")
)
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, concat('mode-', CAST(m AS VARCHAR)) AS mode, CASE WHEN p IS NOT NULL THEN concat('mode-', CAST(p AS VARCHAR)) END AS previous FROM (SELECT user_id, timestamp_us, k % 3 AS m, lag(k % 3) OVER (PARTITION BY user_id ORDER BY line_no) AS p FROM {_LINED} WHERE event_type = 'click') WHERE p IS NULL OR p <> m", "posture_transitions")(
    lambda v: transcripts.posture_transitions(_transcript_lines(v)).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "mode string, previous string").alias("p")).select("session", "timestamp_us", "p.*")
)
query("SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, CASE WHEN k % 2 = 0 THEN 'enqueue' ELSE 'dequeue' END AS operation FROM ev WHERE event_type = 'signup'", "queue_events")(lambda v: transcripts.queue_events(_transcript_lines(v)).select(F.col("external_session_id").alias("session"), "timestamp_us", F.get_json_object("payload", "$.operation").alias("operation")))
query("SELECT count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM ev", "parse_lines")(lambda v: union_all([(p := logs.parse_lines(_transcript_lines(v), transcripts.RECORD))[0].select(F.lit(1).alias("g")), p[1].select(F.lit(0).alias("g"))]).agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad")))


@query(f"SELECT count(DISTINCT user_id) AS files, count(*) AS lines, (SELECT count(*) FROM {_FIRST.format(k='k')} WHERE nth = 1) AS usage_records, (SELECT count(DISTINCT k) FROM ev WHERE event_type = 'view') AS responses FROM ev")
def import_report(v):
    lines = _transcript_lines(v)
    usage = transcripts.transcript_token_usage(lines).withColumn("request_id", F.get_json_object("payload", "$.request_id"))
    return logs.import_report(lines, usage).drop("inflation")


def _rollout_lines(v):
    at = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp"
    usage = "named_struct('input_tokens', k * 3, 'cached_input_tokens', k, 'cache_write_input_tokens', 1, 'output_tokens', k + 1, 'reasoning_output_tokens', 2, 'total_tokens', k + 1)"
    value = f"""CASE WHEN line_no = 0 THEN to_json(struct({at}, 'session_meta' AS type, named_struct('id', CAST(user_id AS STRING), 'session_id', CAST(user_id % 7 AS STRING), 'cwd', '/w', 'source', 'cli') AS payload))
      WHEN event_type = 'view' THEN to_json(struct({at}, 'event_msg' AS type, named_struct('type', 'token_count', 'info', named_struct('last_token_usage', {usage}, 'total_token_usage', {usage})) AS payload))
      WHEN event_type = 'signup' THEN to_json(struct({at}, 'turn_context' AS type, named_struct('model', IF(k % 4 = 0, NULL, concat('g', CAST(k % 4 AS STRING))), 'effort', 'high') AS payload))
      WHEN event_type = 'click' THEN to_json(struct({at}, 'response_item' AS type, named_struct('type', 'custom_tool_call', 'name', 'exec', 'call_id', CAST(event_id AS STRING), 'input', concat('a = tools.exec_command({{"cmd":"ls ', CAST(k AS STRING), '"}}); tools.exec_command({{"cmd":"pwd","workdir":"/d', CAST(k % 5 AS STRING), '"}}); x()')) AS payload))
      WHEN event_type = 'purchase' THEN to_json(struct({at}, 'event_msg' AS type, named_struct('type', 'patch_apply_end', 'success', k % 2 = 0, 'changes', map('/r/b', named_struct('type', 'add'), '/r/a', named_struct('type', 'update'))) AS payload))
      ELSE to_json(struct({at}, 'event_msg' AS type, named_struct('type', CASE k % 3 WHEN 0 THEN 'task_started' WHEN 1 THEN 'task_complete' ELSE 'turn_aborted' END) AS payload)) END"""
    return _lined(v).selectExpr("CAST(user_id AS STRING) AS file", "CAST(line_no AS BIGINT) AS line_no", f"{value} AS value")


_MODEL = f"(SELECT *, last_value(CASE WHEN event_type = 'signup' AND line_no > 0 THEN concat('g', CAST(k % 4 AS VARCHAR)) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS m FROM {_LINED})"
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, CASE WHEN m = 'g0' THEN NULL ELSE m END AS model, k * 2 AS input_tokens, CAST(1 AS BIGINT) AS cache_creation_input_tokens, k AS cache_read_input_tokens, k + 1 AS output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY line_no) AS nth FROM {_MODEL} WHERE event_type = 'view' AND line_no > 0) WHERE nth = 1", "rollout_token_usage")(
    lambda v: rollouts.rollout_token_usage(rollouts.rollout_context(_rollout_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "model string, input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint").alias("p")).select("session", "timestamp_us", "p.*")
)
_CLICKS = f"(SELECT *, coalesce(last_value(CASE WHEN event_type = 'click' AND line_no > 0 THEN concat('/d', CAST(k % 5 AS VARCHAR)) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '/w') AS d FROM {_LINED})"
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, concat('ls ', CAST(k AS VARCHAR)) AS command, d AS project_path FROM {_CLICKS} WHERE event_type = 'click' AND line_no > 0 UNION ALL SELECT CAST(user_id AS VARCHAR), timestamp_us, 'pwd', concat('/d', CAST(k % 5 AS VARCHAR)) FROM {_CLICKS} WHERE event_type = 'click' AND line_no > 0", "rollout_commands")(
    lambda v: rollouts.rollout_commands(rollouts.rollout_context(_rollout_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.get_json_object("payload", "$.command").alias("command"), "project_path")
)
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, path, tool FROM {_LINED}, (VALUES ('/r/a', 'apply_patch:update'), ('/r/b', 'apply_patch:add')) x(path, tool) WHERE event_type = 'purchase' AND k % 2 = 0 AND line_no > 0", "rollout_file_writes")(
    lambda v: rollouts.rollout_file_writes(rollouts.rollout_context(_rollout_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "path string, tool string").alias("p")).select("session", "timestamp_us", "p.*")
)
query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, CASE WHEN line_no = 0 OR k % 3 = 0 THEN 'session.started' ELSE 'session.ended' END AS kind FROM {_LINED} WHERE line_no = 0 OR event_type = 'error'", "rollout_lifecycle")(lambda v: rollouts.rollout_lifecycle(rollouts.rollout_context(_rollout_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", "kind"))


def _frames(v):
    name = "CASE event_type WHEN 'view' THEN 'PreToolUse' WHEN 'click' THEN 'UserPromptSubmit' WHEN 'purchase' THEN 'Stop' WHEN 'signup' THEN 'SessionStart' ELSE 'Surprise' END"
    return v.ev.selectExpr(
        "IF(k = 5, 2, 1) AS v", "'claude-code' AS source", "timestamp_us AS sent_at", "'1' AS hook_version",
        f"struct({name} AS hook_event_name, CAST(user_id AS STRING) AS session_id, CAST(NULL AS STRING) AS transcript_path, '/w' AS cwd, 'Bash' AS tool_name, struct(CAST(NULL AS STRING) AS file_path, CAST(NULL AS STRING) AS notebook_path, concat('run --token ', CAST(event_id AS STRING)) AS command, CAST(NULL AS STRING) AS description) AS tool_input, CAST(event_id AS STRING) AS tool_use_id, 'secret prompt' AS prompt, 'startup' AS source, CAST(NULL AS STRING) AS reason, CAST(NULL AS STRING) AS message, CAST(NULL AS STRING) AS trigger) AS payload",
    )


def _arrive(frames, where) -> int:
    """Writes frames as JSON files, several a core; returns how many files are half of them."""
    files = 4 * frames.sparkSession.sparkContext.defaultParallelism
    frames.repartition(files).write.mode("append").json(where)
    return files // 2


_HOOKED = "SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, CASE event_type WHEN 'view' THEN 'command' WHEN 'click' THEN 'prompt' WHEN 'purchase' THEN 'turn.ended' WHEN 'signup' THEN 'session.started' ELSE 'unknown' END AS kind, CASE event_type WHEN 'view' THEN 'run --token [REDACTED]' WHEN 'click' THEN '13 chars' WHEN 'error' THEN 'Surprise' ELSE '' END AS detail FROM ev WHERE k <> 5"
_hooked = lambda events: events.select(F.col("external_session_id").alias("session"), "timestamp_us", "kind", values.event_detail("kind", "payload").alias("detail"))
query(_HOOKED, "normalize_hooks")(lambda v: _hooked(live.stream_events(logs.accepted_envelopes(_frames(v)))))
query("SELECT count(*) AS rejected FROM ev WHERE k = 5", "rejected_envelopes")(lambda v: logs.rejected_envelopes(_frames(v)).agg(F.count("*").alias("rejected")))


@query(_HOOKED)
def stream_hooks(v):
    """The same frames as files, read by a stream until none is left, appended batch by batch."""
    where = scratch(v.spark, "hooks")
    half = _arrive(_frames(v), f"{where}/in")
    run = live.start_stream(live.stream_events(live.hook_stream(v.spark, f"{where}/in", half)), f"{where}/sink", f"{where}/state", available_now=True)
    run.awaitTermination()
    return _hooked(v.spark.read.parquet(f"{where}/sink/events"))


@query("SELECT count(*) AS stored FROM ev WHERE k <> 5")
def append_twice(v):
    """A batch appended again adds nothing."""
    where = scratch(v.spark, "append")
    events = live.stream_events(logs.accepted_envelopes(_frames(v)))
    for _ in range(2):
        sinks.append_events(events, where)
    return v.spark.read.parquet(f"{where}/events").agg(F.count("*").alias("stored"))


@query("SELECT external_session_id AS session, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS external_session_id FROM ev WHERE k <> 5 AND event_type = 'view') GROUP BY 1")
def project_commands(v):
    events = live.stream_events(logs.accepted_envelopes(_frames(v)))
    return hooks.project_commands(events).join(events.select("id", F.col("external_session_id").alias("session")), "id").groupBy("session").agg(F.count("*").alias("n"))


query("SELECT timestamp_us - timestamp_us % 86400000000 AS start_us, kind, count(*) AS events FROM spine GROUP BY 1, 2", "windowed_counts")(lambda v: live.windowed_counts(v.spine))
query(f"SELECT id FROM {_S2} WHERE status = 'ended' OR {AS_OF} - ended_us >= 3600000000 * 200", "finished_sessions")(lambda v: live.finished_sessions((s := _sessions(v).withColumn("transcript_path", F.col("id").cast("string"))), s.select("transcript_path", (F.col("ended_us") + 3600 * 1_000_000 * 199).alias("modified_us")), AS_OF).select("id"))
query("SELECT concat('{\"timestamp\":\"', strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '\",\"agent\":\"', agent_id, '\",\"kind\":\"', kind, '\",\"evidence\":\"', evidence, '\",\"event\":{\"k\":', CAST(k AS VARCHAR), '}}') AS value FROM spine", "export_jsonl")(lambda v: sinks.export_rows(v.spine))
query("SELECT agent_id, count(*) AS n FROM spine GROUP BY agent_id", "ad_hoc_sql")(lambda v: sinks.sql(v.spark, "SELECT agent_id, count(*) AS n FROM adhoc_spine GROUP BY agent_id", {"adhoc_spine": v.spine}))
query("SELECT id, 'codex' AS side FROM token_usage WHERE agent_id = 'codex' UNION ALL SELECT id, NULL FROM token_usage WHERE agent_id <> 'codex'", "union_sources")(lambda v: union_all([v.token_usage.where("agent_id = 'codex'").select("id", F.lit("codex").alias("side")), v.token_usage.where("agent_id <> 'codex'").select("id")]))


# ---- whole paths: from lines to events, projections and sessions
def _uuid_sql(name: str) -> str:
    """UUID version 5 of a text in SQL; null for null."""
    digest = f"sha1(unhex('{values.NAMESPACE.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab', CAST(('0x' || substr({digest}, 17, 1)) AS INTEGER) % 4 + 1, 1)"
    return f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))"


def _own_lines(v):
    """The stand-in transcripts with keys of their own in every file; every fifth user's records name no session, and every other user's no folder."""
    user = F.col("file").cast("long")
    keyed = F.regexp_replace("value", F.lit('"(id|tool_use_id)":"([mc])'), F.concat(F.lit('"$1":"'), "file", F.lit("-$2")))
    nameless = F.when(user % 5 == 0, F.regexp_replace(keyed, '"sessionId":"[^"]*",?', "")).otherwise(keyed)
    bare = F.when(user % 2 == 0, F.regexp_replace(nameless, '"cwd":"[^"]*",?', "")).otherwise(nameless)
    return _transcript_lines(v).withColumn("value", F.regexp_replace(bare, ",}", "}"))


_AGENT_KEY = "'{agent}' || chr(31) || CAST({user} AS VARCHAR)"
_CLAUDE, _CODEX = (_uuid_sql(_AGENT_KEY.format(agent=a, user="user_id")) for a in ("claude-code", "codex"))
_LIFE = f"(SELECT *, CASE WHEN line_no = 0 OR k % 3 = 0 THEN 'session.started' ELSE 'session.ended' END AS life FROM {_LINED} WHERE line_no = 0 OR event_type = 'error')"


@query(f"""SELECT {_CLAUDE} AS id, 'claude-code' AS agent_id, CAST(user_id AS VARCHAR) AS external_session_id, CAST(NULL AS VARCHAR) AS parent_session_id, CASE WHEN user_id % 2 <> 0 THEN {_uuid_sql("'/work/a'")} END AS project_id,
 min(timestamp_us) AS started_us, CAST(NULL AS BIGINT) AS ended_us, 'unknown' AS status, coalesce(bool_and(CASE WHEN event_type = 'view' AND nth = 1 THEN event_id % 5 = 0 END), FALSE) AS is_subagent
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY line_no) AS nth FROM {_LINED}) WHERE user_id % 5 <> 0 AND event_type IN ('view', 'click', 'signup') GROUP BY user_id
 UNION ALL SELECT {_CODEX}, 'codex', CAST(user_id AS VARCHAR), CASE WHEN user_id % 7 <> user_id THEN {_uuid_sql(_AGENT_KEY.format(agent="codex", user="(user_id % 7)"))} END, {_uuid_sql("'/w'")},
 min(timestamp_us), max(timestamp_us) FILTER (life = 'session.ended'), CASE arg_max(life, timestamp_us) WHEN 'session.started' THEN 'active' ELSE 'ended' END, user_id % 7 <> user_id FROM {_LIFE} GROUP BY user_id""")
def lines_to_sessions(v):
    """Log lines of both kinds to the stored spine, each log parsed once, and from it to sessions with their parents and subagent flags."""
    where = scratch(v.spark, "sessions")
    for events in (transcripts.transcript_events(_own_lines(v)), rollouts.rollout_events(_rollout_lines(v))):
        sinks.append_events(events, where, now_us=AS_OF)
    events, sessions = sinks.spine_tables(v.spark, where).values()
    flags = reports.subagent_flags(sessions, hooks.project_tokens(events))
    columns = ["id", "agent_id", "external_session_id", "parent_session_id", "project_id", "started_us", "ended_us", "status", "is_subagent"]
    return sessions.join(flags, "id").select(*columns)


query(f"SELECT DISTINCT {_uuid_sql("'/work/a'")} AS id FROM ev WHERE user_id % 2 <> 0 AND event_type IN ('view', 'click', 'signup')", "lines_to_projects")(lambda v: dedupe.build_projects(transcripts.transcript_events(_own_lines(v))).select("id"))
query(f"SELECT {_uuid_sql("agent_id || chr(31) || CAST(id AS VARCHAR)")} AS event_id, id, CAST(NULL AS VARCHAR) AS none FROM spine", "event_ids")(lambda v: v.spine.select(values.event_id("agent_id", F.col("id").cast("string")).alias("event_id"), "id", values.event_id("agent_id", F.lit(None).cast("string")).alias("none")))

_ALL_TRANSCRIPT = " UNION ALL ".join([
    f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, 'token.usage' AS kind FROM {_FIRST.format(k='k')} WHERE nth = 1",
    f"SELECT CAST(user_id AS VARCHAR), timestamp_us, CASE k % 4 WHEN 0 THEN 'file.read' WHEN 1 THEN 'command' WHEN 2 THEN 'mcp.call' ELSE 'tool.call' END FROM {_FIRST.format(k='k % 10')} WHERE nth = 1",
    f"SELECT CAST(p.user_id AS VARCHAR), l.timestamp_us, 'tool.outcome' FROM ({_PAIRED}) p JOIN {_LINED} l ON l.user_id = p.user_id AND l.line_no = p.line",
    f"SELECT CAST(user_id AS VARCHAR), timestamp_us, 'permission.mode' FROM (SELECT user_id, timestamp_us, k % 3 AS m, lag(k % 3) OVER (PARTITION BY user_id ORDER BY line_no) AS p FROM {_LINED} WHERE event_type = 'click') WHERE p IS NULL OR p <> m",
    "SELECT CAST(user_id AS VARCHAR), timestamp_us, 'queue' FROM ev WHERE event_type = 'signup'",
])
_shown = lambda events: events.select(F.col("external_session_id").alias("session"), "timestamp_us", "kind")
query(_ALL_TRANSCRIPT, "transcript_events")(lambda v: _shown(transcripts.transcript_events(_transcript_lines(v))))
_ALL_ROLLOUT = " UNION ALL ".join([
    f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, life AS kind FROM {_LIFE}",
    f"SELECT CAST(user_id AS VARCHAR), timestamp_us, 'token.usage' FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY line_no) AS nth FROM {_LINED} WHERE event_type = 'view' AND line_no > 0) WHERE nth = 1",
    f"SELECT CAST(user_id AS VARCHAR), timestamp_us, 'command' FROM {_LINED}, range(2) WHERE event_type = 'click' AND line_no > 0",
    f"SELECT CAST(user_id AS VARCHAR), timestamp_us, 'file.write' FROM {_LINED}, range(2) WHERE event_type = 'purchase' AND k % 2 = 0 AND line_no > 0",
])
query(_ALL_ROLLOUT, "rollout_events")(lambda v: _shown(rollouts.rollout_events(_rollout_lines(v))))


def _tool_lines(v):
    """Rollouts of tool calls and their outputs."""
    at = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp"
    call = "concat('c', CAST(k % 10 AS STRING)) AS call_id"
    value = f"""CASE WHEN line_no = 0 THEN to_json(struct({at}, 'session_meta' AS type, named_struct('id', CAST(user_id AS STRING), 'cwd', '/w') AS payload))
      WHEN event_type IN ('view', 'click') THEN to_json(struct({at}, 'response_item' AS type, struct('function_call' AS type, concat('fn', CAST(k % 3 AS STRING)) AS name, {call}) AS payload))
      ELSE to_json(struct({at}, 'response_item' AS type, struct('function_call_output' AS type, {call}, array(named_struct('text', IF(k % 2 = 0, 'Script failed: 1', 'Script completed'))) AS output) AS payload)) END"""
    return _lined(v).selectExpr("CAST(user_id AS STRING) AS file", "CAST(line_no AS BIGINT) AS line_no", f"{value} AS value")


query(f"SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, concat('fn', CAST(k % 3 AS VARCHAR)) AS tool FROM {_LINED} WHERE line_no > 0 AND event_type IN ('view', 'click')", "rollout_tool_calls")(
    lambda v: rollouts.rollout_tool_calls(rollouts.rollout_context(_tool_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.get_json_object("payload", "$.tool").alias("tool"))
)
query(f"""SELECT CAST(user_id AS VARCHAR) AS session, timestamp_us, concat('fn', CAST(pk % 3 AS VARCHAR)) AS tool, concat('c', CAST(k % 10 AS VARCHAR)) AS tool_use_id, greatest(timestamp_us - pt, 0) // 1000 AS duration_ms, k % 2 = 0 AS failed
 FROM (SELECT *, lag(event_type) OVER w AS pe, lag(k) OVER w AS pk, lag(timestamp_us) OVER w AS pt FROM {_LINED} WHERE line_no > 0 WINDOW w AS (PARTITION BY user_id, k % 10 ORDER BY line_no)) WHERE event_type NOT IN ('view', 'click') AND pe IN ('view', 'click')""", "rollout_outcomes")(
    lambda v: rollouts.rollout_outcomes(rollouts.rollout_context(_tool_lines(v))).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", "tool string, tool_use_id string, duration_ms bigint, failed boolean").alias("p")).select("session", "timestamp_us", "p.*")
)

# ---- projections of transcripts
_of = lambda project, *columns: lambda v: project(transcripts.transcript_events(_transcript_lines(v))).select("timestamp_us", *columns)
query(f"SELECT timestamp_us, 'anthropic' AS provider, 'x' AS model, concat('m', CAST(k AS VARCHAR)) AS request_id, event_id AS input_tokens, k AS output_tokens, event_id % 5 = 0 AS is_subagent FROM {_FIRST.format(k='k')} WHERE nth = 1", "project_tokens")(_of(hooks.project_tokens, "provider", "model", "request_id", "input_tokens", "output_tokens", "is_subagent"))
query(f"SELECT timestamp_us, 'read' AS operation, '/a/b' AS path, 'Read' AS tool, 'normal' AS sensitivity FROM {_FIRST.format(k='k % 10')} WHERE nth = 1 AND k % 4 = 0", "project_files")(_of(hooks.project_files, "operation", "path", "tool", "sensitivity"))
query(f"SELECT timestamp_us, 'srv' AS server, 'find' AS tool FROM {_FIRST.format(k='k % 10')} WHERE nth = 1 AND k % 4 = 2", "project_mcp")(_of(hooks.project_mcp, "server", "tool"))
query(f"SELECT l.timestamp_us, CASE ck % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'mcp__srv__find' ELSE 'Glob' END AS tool, (l.timestamp_us - called) // 1000 AS duration_ms, l.k % 2 = 0 AS failed FROM ({_PAIRED}) p JOIN {_LINED} l ON l.user_id = p.user_id AND l.line_no = p.line", "project_outcomes")(_of(hooks.project_outcomes, "tool", "duration_ms", "failed"))

# ---- files, formats, zones
_BUCKETS = "(SELECT event_id, user_id % 4 AS bucket, row_number() OVER (PARTITION BY user_id % 4 ORDER BY timestamp_us, event_id) - 1 AS line_no FROM ev)"


@query(f"SELECT event_id, line_no FROM {_BUCKETS}")
def read_lines(v):
    """Files with a line an event, read back with their line numbers."""
    where = scratch(v.spark, "lines")
    rows = v.spark.sql(f"SELECT * FROM {_BUCKETS.replace('FROM ev', 'FROM {ev}')}", ev=v.ev)
    rows.repartition(4, "bucket").sortWithinPartitions("bucket", "line_no").select("bucket", "event_id").write.partitionBy("bucket").json(where)
    lines = logs.read_jsonl_lines(v.spark, where, pattern="*.json")
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "line_no")


query("SELECT id, CASE WHEN duration_ms IS NULL THEN '—' WHEN duration_ms < 60000 THEN printf('%ds', duration_ms // 1000) WHEN duration_ms < 3600000 THEN printf('%dm %ds', duration_ms // 60000, duration_ms // 1000 % 60) ELSE printf('%dh %dm', duration_ms // 3600000, duration_ms // 60000 % 60) END AS shown FROM (SELECT id, duration_ms * 1000 AS duration_ms FROM tool_outcomes)", "format_session_duration")(lambda v: v.tool_outcomes.select("id", values.session_duration(F.col("duration_ms") * 1000).alias("shown")))
query("SELECT id, CASE WHEN starts_with(path, '/work/p1') THEN concat('~', substr(path, 9)) ELSE path END AS shown FROM file_events", "short_path")(lambda v: v.file_events.select("id", values.short_path("path", "/work/p1").alias("shown")))
query(f"SELECT strftime(make_timestamp(timestamp_us - 18000000000), '%Y-%m-%d') AS label, {SUMS} FROM token_usage WHERE timestamp_us < 1709251200000000 GROUP BY 1", "tokens_by_day_new_york")(lambda v: tokens.tokens_by_day(v.token_usage.where("timestamp_us < 1709251200000000"), "America/New_York"))


@query("SELECT concat('{\"timestamp\":\"', strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '\",\"agent\":\"', agent_id, '\",\"kind\":\"', kind, '\",\"evidence\":\"', evidence, '\",\"event\":{\"k\":', CAST(k AS VARCHAR), '}}') AS value FROM spine")
def export_files(v):
    """The export, written to files and read back."""
    where = scratch(v.spark, "export")
    sinks.export_jsonl(v.spine, where)
    return v.spark.read.text(where)


from . import spine_queries, tree_queries  # noqa: E402, F401  register their queries, with what stands above
