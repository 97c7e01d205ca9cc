"""Session transcripts to events: token usage, activity, tool outcomes, permission posture, queue.

A log is parsed once: each record gives an array of the facts it tells, and one window over facts of the same key decides which of them are events. A key
is a response, a call or a file's mode, so a long file is no single task but for its few changes of mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.logs import parse_lines
from .ingest import as_events, classify_tool_call, when

AGENT, PROVIDER = "claude-code", "anthropic"
#: What is read of a record. Prose, tool output and patch bodies are not named here, so they are never read.
RECORD = (
    "type string, requestId string, timestamp string, sessionId string, cwd string, gitBranch string, entrypoint string, isSidechain boolean, operation string, permissionMode string,"
    " message struct<id:string, model:string, usage:string, diagnostics:struct<cache_miss_reason:struct<type:string>>, content:array<struct<type:string, id:string, name:string,"
    " input:struct<file_path:string, notebook_path:string, command:string, description:string>, tool_use_id:string, is_error:boolean>>>"
)
KNOWN_USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def _records(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, RECORD)[0]


def usage_records(lines: DataFrame) -> DataFrame:
    """Every usage record with its response's key; several records may tell of one response."""
    key = F.coalesce("r.message.id", "r.requestId")
    return _records(lines).where((F.col("r.type") == "assistant") & F.col("r.message.usage").isNotNull()).withColumn("response", key).where("response is not null")


def record_inflation(lines: DataFrame) -> DataFrame:
    """Usage records, responses and their ratio."""
    return usage_records(lines).agg(F.count("*").alias("usage_records"), F.count_distinct("file", "response").alias("responses")).withColumn("inflation", F.try_divide("usage_records", "responses"))


#: What a fact holds beside its group, key, place in the record and whether it is a call's result.
FACT = {
    "name": "string", "file_path": "string", "notebook_path": "string", "command": "string", "description": "string",
    "failed": "boolean", "mode": "string", "operation": "string", "usage": "string", "model": "string", "reason": "string", "sidechain": "boolean",
}
FACTS = ("usage", "calls", "results", "mode", "queue")


def _fact(group: str, key: Column, place: Column | None = None, is_result: bool = False, **fields: Column) -> Column:
    held = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in FACT.items()]
    return F.struct(F.lit(group).alias("group"), key.alias("key"), (F.lit(0) if place is None else place).alias("place"), F.lit(int(is_result)).alias("is_result"), *held)


def _facts(lines: DataFrame, wanted) -> DataFrame:
    """The facts of every record, with the record's time, session, folder, branch and surface."""
    kind, message = F.col("r.type"), F.col("r.message")
    of = lambda block, t: block["type"] == t

    def use(block, place):
        own = {n: block["input"][n] for n in ("file_path", "notebook_path", "command", "description")}
        return F.when(of(block, "tool_use") & block["id"].isNotNull(), _fact("call", block["id"], place, name=block["name"], **own))

    def result(block, place):
        known = of(block, "tool_result") & block["tool_use_id"].isNotNull()
        return F.when(known, _fact("call", block["tool_use_id"], place, True, failed=F.coalesce(block["is_error"], F.lit(False))))

    response = F.coalesce(message["id"], F.col("r.requestId"))
    reason = message["diagnostics"]["cache_miss_reason"]["type"]
    usage = _fact("usage", response, usage=message["usage"], model=message["model"], reason=reason, sidechain=F.coalesce("r.isSidechain", F.lit(False)))
    told = {
        "usage": F.when((kind == "assistant") & message["usage"].isNotNull() & response.isNotNull(), F.array(usage)),
        "calls": F.when(kind == "assistant", F.transform(message["content"], use)),
        "results": F.when(kind == "user", F.transform(message["content"], result)),
        "mode": F.when((kind == "user") & F.col("r.permissionMode").isNotNull(), F.array(_fact("mode", F.lit(""), mode=F.col("r.permissionMode")))),
        "queue": F.when((kind == "queue-operation") & F.col("r.operation").isNotNull(), F.array(_fact("queue", F.col("line_no").cast("string"), operation=F.col("r.operation")))),
    }
    none = F.filter(F.array(_fact("", F.lit(""))), lambda f: F.lit(False))
    facts = F.array_compact(F.concat(*[F.coalesce(told[w], none) for w in FACTS if w in wanted]))
    record = {"timestamp": "timestamp", "session": "sessionId", "cwd": "cwd", "branch": "gitBranch", "entry": "entrypoint"}
    kept = ["file", "line_no", *[c for c in ("modified",) if c in lines.columns], *[F.col(f"r.{v}").alias(k) for k, v in record.items()]]
    return _records(lines).select(*kept, F.explode(facts).alias("f")).select("*", "f.*").drop("f")


def _usage_payload() -> Column:
    usage = F.col("usage")
    count = lambda n: F.coalesce(F.get_json_object(usage, f"$.{n}").try_cast("bigint"), F.lit(0).cast("long"))
    rest = F.map_filter(F.try_parse_json(usage).cast("map<string,variant>"), lambda k, v: ~k.isin(*KNOWN_USAGE))
    missed = F.map_concat(F.map_filter(rest, lambda k, v: k != "cache_miss_reason"), F.create_map(F.lit("cache_miss_reason"), F.col("reason").cast("variant")))
    return F.to_json(F.struct(
        F.lit(PROVIDER).alias("provider"), "model", F.col("key").alias("request_id"), *[count(n).alias(n) for n in KNOWN_USAGE],
        F.col("sidechain").alias("is_subagent"), F.to_json(F.when(F.col("reason").isNull(), rest).otherwise(missed)).alias("provider_usage"),
    ))


def _events(lines: DataFrame, wanted=FACTS) -> DataFrame:
    same = Window.partitionBy("file", "group", "key").orderBy("line_no", "is_result", "place")
    upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    call = F.when(F.col("is_result") == 0, F.struct("name", F.col("told_us").alias("us")))
    rows = _facts(lines, wanted).withColumn("told_us", F.unix_micros(F.try_to_timestamp("timestamp")))
    rows = rows.select("*", F.sum(1 - F.col("is_result")).over(upto).alias("calls"), F.first(call, ignorenulls=True).over(upto).alias("call"), F.lag("mode").over(same).alias("previous"))
    rows = rows.select("*", F.count_if((F.col("is_result") == 1) & (F.col("calls") > 0)).over(upto).alias("answers"))
    group, first = F.col("group"), (F.col("is_result") == 0) & (F.col("calls") == 1)
    answer = (F.col("is_result") == 1) & (F.col("calls") > 0) & (F.col("answers") == 1) & F.col("call.name").isNotNull() & F.col("call.us").isNotNull()
    changed = F.col("previous").isNull() | (F.col("previous") != F.col("mode"))
    rows = rows.where((group == "queue") | ((group == "mode") & changed) | ((group == "usage") & first) | ((group == "call") & (first | answer)))

    span = F.col("told_us") - F.col("call.us")
    of = lambda *fields: F.to_json(F.struct(*fields))
    outcome = of(F.col("call.name").alias("tool"), F.col("key").alias("tool_use_id"), F.when(span >= 0, F.floor(span / 1000).cast("long")).alias("duration_ms"), "failed")
    session, at = F.coalesce("session", F.lit("")), F.coalesce("timestamp", F.lit(""))
    named = classify_tool_call(rows).withColumnsRenamed({"kind": "call_kind", "payload": "call_payload"})
    is_answer = (group == "call") & (F.col("is_result") == 1)
    kind = F.when(group == "usage", "token.usage").when(group == "mode", "permission.mode").when(group == "queue", "queue").when(is_answer, "tool.outcome").otherwise(F.col("call_kind"))
    payload = (
        F.when(group == "usage", _usage_payload()).when(group == "mode", of("mode", "previous")).when(group == "queue", of("operation"))
        .when(is_answer, outcome).otherwise(F.col("call_payload"))
    )
    key = (
        F.when(group == "mode", F.concat_ws(":", session, "mode", at)).when(group == "queue", F.concat_ws(":", F.lit("queue"), session, "operation", at))
        .when(is_answer, F.concat("key", F.lit(":outcome"))).otherwise(F.col("key"))
    )
    return as_events(named, agent=AGENT, key=key, kind=kind, payload=payload, timestamp=when(named, F.col("timestamp")), session=F.col("session"), project=F.col("cwd"), branch=F.col("branch"), surface=F.col("entry"))


def transcript_token_usage(lines: DataFrame) -> DataFrame:
    """One event a response: the first record of its key in a file."""
    return _events(lines, ("usage",))


def transcript_activity(lines: DataFrame) -> DataFrame:
    """One event a tool call, at its first sighting in a file."""
    return _events(lines, ("calls",))


def transcript_outcomes(lines: DataFrame) -> DataFrame:
    """One event a call whose result follows in the same file."""
    return _events(lines, ("calls", "results")).where("kind = 'tool.outcome'")


def posture_transitions(lines: DataFrame) -> DataFrame:
    """Changes of the permission mode within a file; the first mode seen is one."""
    return _events(lines, ("mode",))


def queue_events(lines: DataFrame) -> DataFrame:
    return _events(lines, ("queue",))


def transcript_events(lines: DataFrame) -> DataFrame:
    """All events of transcripts, from one reading of the log."""
    return _events(lines)
