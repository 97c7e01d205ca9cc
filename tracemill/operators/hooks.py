"""Hook frames to events, and the spine to its typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import redacted
from ..functions.sensitivity import classify_path, scan_commands, worst_in_command
from ..functions.values import held
from .ingest import as_events, classify_tool_call


def prompt_fingerprint(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Adds the number of characters and the SHA-256 of a prompt, and drops the prompt."""
    return df.withColumn("char_count", F.coalesce(F.char_length(column), F.lit(0))).withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256)).drop(column)


def normalize_hooks(envelopes: DataFrame) -> DataFrame:
    """One event a frame. A tool call has the id its transcript gives it, so the two become one row; other frames are told apart
    by all that they hold. No window and no join, so it runs on streams too."""
    p = F.col("payload")
    flat = envelopes.select("*", p["tool_name"].alias("name"), p["tool_input"]["file_path"].alias("file_path"), p["tool_input"]["notebook_path"].alias("notebook_path"), p["tool_input"]["command"].alias("command"), p["tool_input"]["description"].alias("description"), F.struct("payload").alias("hook")).drop("payload")
    tool = classify_tool_call(flat.withColumnRenamed("kind", "_kind") if "kind" in flat.columns else flat).withColumnsRenamed({"kind": "tool_kind", "payload": "tool_payload"})
    h = F.col("hook.payload")
    name = F.lower(h["hook_event_name"])
    is_tool = name.isin("pretooluse", "posttooluse")
    kind = (
        F.when(name == "sessionstart", "session.started").when(name == "sessionend", "session.ended").when(name.isin("userpromptsubmit", "beforesubmitprompt"), "prompt")
        .when(is_tool, F.col("tool_kind")).when(name == "notification", "notification").when(name.isin("stop", "subagentstop"), "turn.ended").when(name == "precompact", "context.compacted").otherwise("unknown")
    )
    of = lambda **fields: F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    payload = (
        F.when(name == "sessionstart", of(trigger=h["source"], transcript_path=h["transcript_path"]))
        .when(name == "sessionend", of(reason=h["reason"]))
        .when(name.isin("userpromptsubmit", "beforesubmitprompt"), of(char_count=F.coalesce(F.char_length(h["prompt"]), F.lit(0)), sha256=F.sha2(h["prompt"].cast("binary"), 256)))
        .when(is_tool, F.col("tool_payload"))
        .when(name == "notification", of(has_message=h["message"].isNotNull()))
        .when(name.isin("stop", "subagentstop"), of(subagent=name == "subagentstop"))
        .when(name == "precompact", of(trigger=F.coalesce(h["trigger"], h["source"])))
        .otherwise(of(label=F.coalesce(h["hook_event_name"], F.lit("missing_hook_event_name"))))
    )
    key = F.coalesce(h["tool_use_id"], F.sha2(F.to_json(F.struct("source", "sent_at", "hook")).cast("binary"), 256))
    return as_events(tool, agent=F.col("source"), key=key, kind=kind, payload=payload, timestamp=F.col("sent_at"), session=h["session_id"], project=h["cwd"], evidence="hook")


def redact_events(events: DataFrame, patterns=()) -> DataFrame:
    """Redacts the command in command events."""
    own = F.from_json("payload", "command string, description string")
    clean = held(own, lambda told: F.to_json(F.struct(redacted(told["command"], patterns).alias("command"), told["description"].alias("description"))))
    return events.withColumn("payload", F.when(F.col("kind") == "command", clean).otherwise(F.col("payload")))


_BASE = ["id", "timestamp_us", "agent_id", "session_id", "project_id"]


def _of(events: DataFrame, kinds: tuple, schema: str) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds)).select(*_BASE, "kind", "evidence", F.from_json("payload", schema).alias("p"))


def project_tokens(events: DataFrame) -> DataFrame:
    names = "provider string, model string, request_id string, input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint, is_subagent boolean, provider_usage string"
    return _of(events, ("token.usage",), names).select(*_BASE, "p.*")


def project_files(events: DataFrame) -> DataFrame:
    rows = _of(events, ("file.read", "file.write"), "path string, tool string")
    return rows.select(*_BASE, F.substring_index("kind", ".", -1).alias("operation"), "p.path", "p.tool", classify_path("p.path").alias("sensitivity"), "evidence")


def project_commands(events: DataFrame) -> DataFrame:
    rows = _of(events, ("command",), "command string, description string")
    return rows.select(*_BASE, "p.command", "p.description", worst_in_command("p.command").alias("sensitivity"))


def project_path_references(events: DataFrame) -> DataFrame:
    return scan_commands(project_commands(events).drop("description"))


def project_mcp(events: DataFrame) -> DataFrame:
    return _of(events, ("mcp.call",), "server string, tool string").select(*_BASE, "p.*")


def project_outcomes(events: DataFrame) -> DataFrame:
    return _of(events, ("tool.outcome",), "tool string, tool_use_id string, duration_ms bigint, failed boolean").select(*_BASE, "p.*")
