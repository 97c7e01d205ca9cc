"""What every normalizer shares: the event row with its deterministic ids, and the tool classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import event_id, project_id, rfc3339_to_us, session_id

# The tool names that mean a file read, a file write or a command.
READ_TOOLS, WRITE_TOOLS, COMMAND_TOOLS = ("Read", "NotebookRead"), ("Write", "Edit", "MultiEdit", "NotebookEdit"), ("Bash", "BashOutput")

EVENT_COLUMNS = ["id", "timestamp_us", "agent_id", "session_id", "external_session_id", "parent_session_id", "project_id", "project_path", "git_branch", "surface", "kind", "evidence", "confidence", "payload", "file", "line_no"]


def when(df: DataFrame, text: Column) -> Column:
    """A record's time; where it tells none the file's modification time, so that a second run gives the same."""
    told = rfc3339_to_us(text)
    return F.coalesce(told, F.unix_micros("modified")) if "modified" in df.columns else told


def as_events(df: DataFrame, *, agent: str | Column, key: Column, kind: str | Column, payload: Column, timestamp: Column, session: Column, project: Column | None = None, branch: Column | None = None, surface: Column | None = None, parent: Column | None = None, evidence: str = "transcript") -> DataFrame:
    """Rows of the event spine. Ids depend on the agent and the key alone, so reading a log again gives the same rows."""
    text = lambda c: c if c is not None else F.lit(None).cast("string")
    name = F.lit(agent) if isinstance(agent, str) else agent
    at = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    return df.select(
        event_id(name, key).alias("id"), timestamp.alias("timestamp_us"), name.alias("agent_id"), session_id(name, session).alias("session_id"), session.alias("external_session_id"),
        session_id(name, text(parent)).alias("parent_session_id"), project_id(text(project)).alias("project_id"), text(project).alias("project_path"), text(branch).alias("git_branch"), text(surface).alias("surface"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(evidence).alias("evidence"), F.lit(1.0).alias("confidence"), payload.alias("payload"), at("file").alias("file"), at("line_no", "bigint").alias("line_no"),
    )


def classify_tool_call(calls: DataFrame) -> DataFrame:
    """Adds kind and payload to rows with name, file_path, notebook_path, command and description."""
    name, path = F.col("name"), F.coalesce("file_path", "notebook_path")
    mcp = name.startswith("mcp__")
    server, tool = F.regexp_extract(name, "^mcp__(.+?)__(.+)$", 1), F.regexp_extract(name, "^mcp__(.+?)__(.+)$", 2)
    split = server != ""
    kind = (
        F.when(name.isNull(), "unknown").when(mcp, "mcp.call")
        .when(name.isin(*READ_TOOLS) & path.isNotNull(), "file.read").when(name.isin(*WRITE_TOOLS) & path.isNotNull(), "file.write")
        .when(name.isin(*COMMAND_TOOLS) & F.col("command").isNotNull(), "command").otherwise("tool.call")
    )
    fields = lambda *pairs: F.to_json(F.struct(*[v.alias(n) for n, v in pairs]))
    payload = (
        F.when(kind == "unknown", fields(("label", F.lit("missing_tool_name"))))
        .when(kind == "mcp.call", F.when(split, fields(("server", server), ("tool", tool))).otherwise(fields(("server", F.lit("unknown")), ("tool", name))))
        .when(kind.isin("file.read", "file.write"), fields(("path", path), ("tool", name)))
        .when(kind == "command", fields(("command", F.col("command")), ("description", F.col("description"))))
        .otherwise(fields(("tool", name)))
    )
    return calls.withColumn("kind", kind).withColumn("payload", payload)
