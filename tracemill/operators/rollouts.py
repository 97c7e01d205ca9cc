"""Rollout logs to events.

A log is parsed once: each record becomes slim columns, what it tells of its session, and an array of facts, and these are written once. The
session, project and model in force are carried forward within segments of a file, and from segment to segment by their last values, so a file of any length is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.logs import parse_lines
from ..sources.scratch import stored
from .ingest import as_events, when

AGENT, PROVIDER = "codex", "openai"
_USAGE = "struct<input_tokens:bigint, cached_input_tokens:bigint, cache_write_input_tokens:bigint, output_tokens:bigint, reasoning_output_tokens:bigint, total_tokens:bigint>"
RECORD = (
    "timestamp string, type string, payload struct<type:string, id:string, session_id:string, cwd:string, originator:string, source:string, model:string, effort:string, reason:string,"
    f" info:struct<last_token_usage:{_USAGE}, total_token_usage:{_USAGE}>, success:boolean, changes:map<string,struct<type:string>>,"
    " name:string, input:string, call_id:string, output:string>"
)
NEEDLE = "tools.exec_command("
STATUS = 48
#: Lines of a file that are carried forward together.
SEGMENT = 65_536


#: What a fact holds beside its group, key, place in the record and whether it is a call's output.
FACT = {"suffix": "string", "kind": "string", "payload": "string", "folder": "string", "tool": "string", "failed": "boolean", "last": _USAGE}
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def _is_exec() -> Column:
    return (F.col("r.type") == "response_item") & (F.col("p.type") == "custom_tool_call") & (F.col("p.name") == "exec")


def _scripts() -> Column:
    """The calls in an exec script: from_json ends with the first object and ignores the script after it."""
    parts = F.split("p.input", r"tools\.exec_command\(")
    tails = F.slice(parts, 2, F.size(parts))
    return F.filter(F.transform(tails, lambda t: F.from_json(t, "cmd string, workdir string")), lambda c: c["cmd"].isNotNull())


def _fact(group: str, key: Column, place: Column | None = None, is_result: bool = False, **fields: Column) -> Column:
    held = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in FACT.items()]
    return F.struct(F.lit(group).alias("group"), key.alias("key"), (F.lit(0) if place is None else place).alias("place"), F.lit(int(is_result)).alias("is_result"), *held)


def _line(suffix: str) -> Column:
    return F.concat(F.lit("line:"), F.col("line_no").cast("string"), F.lit(":" + suffix))


def _n(counters: Column, field: str) -> Column:
    return F.coalesce(counters[field], F.lit(0).cast("long"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))


def _lifecycle() -> Column:
    meta, message = F.col("r.type") == "session_meta", F.when(F.col("r.type") == "event_msg", F.col("p.type"))
    told = lambda suffix, kind, payload: F.array(_fact("life", _line(suffix), suffix=_line(suffix), kind=F.lit(kind), payload=payload))
    started = lambda trigger: _json(trigger=F.lit(trigger), transcript_path=F.col("file"))
    return (
        F.when(meta, told("session", "session.started", started("startup"))).when(message == "task_started", told("turn-start", "session.started", started("turn")))
        .when(message == "task_complete", told("turn-end", "session.ended", _json(reason=F.lit("turn_complete"))))
        .when(message == "turn_aborted", told("turn-aborted", "session.ended", _json(reason=F.coalesce("p.reason", F.lit("turn_aborted")))))
    )


def _usage() -> Column:
    """A snapshot of the counters is one response: the totals where they are told, else those of the last request."""
    last, total = F.col("p.info.last_token_usage"), F.col("p.info.total_token_usage")
    snapshot = lambda s: F.concat_ws(":", *[_n(s, f).cast("string") for f in COUNTERS])
    known = (F.col("r.type") == "event_msg") & (F.col("p.type") == "token_count") & last.isNotNull() & (_n(last, "total_tokens") != 0)
    return F.when(known, F.array(_fact("usage", F.when(total.isNotNull(), snapshot(total)).otherwise(snapshot(last)), last=last)))


def _commands() -> Column:
    """A call without a workdir has that of the last before it in its script; one without any has null here."""

    def told(call, place):
        dirs = F.filter(F.transform(F.slice(F.col("scripts"), 1, place + 1), lambda c: c["workdir"]), lambda w: w.isNotNull())
        suffix = F.concat(_line("command:"), place.cast("string"))
        return _fact("command", suffix, place, suffix=suffix, kind=F.lit("command"), payload=_json(command=call["cmd"]), folder=F.try_element_at(dirs, F.lit(-1)))

    return F.transform("scripts", told)


def _writes() -> Column:
    """The paths of a patch that was applied, in order."""

    def told(change, place):
        suffix = F.concat(_line("file:"), place.cast("string"))
        tool = F.concat_ws(":", F.lit("apply_patch"), change["value"]["type"])
        return _fact("write", suffix, place, suffix=suffix, kind=F.lit("file.write"), payload=_json(path=change["key"], tool=tool), folder=F.regexp_extract(change["key"], "^(.*)/[^/]*$", 1))

    done = (F.col("r.type") == "event_msg") & (F.col("p.type") == "patch_apply_end") & F.col("p.success")
    return F.when(done, F.transform(F.array_sort(F.map_entries("p.changes")), told))


def _calls() -> tuple[Column, Column, Column]:
    """Other tools' calls as events, and all calls and outputs for pairing; of an output only the first chunk's first characters are looked at."""
    item = F.col("r.type") == "response_item"
    call = item & F.col("p.type").isin("custom_tool_call", "function_call") & F.col("p.name").isNotNull()
    tool = F.when(call & ~F.coalesce(_is_exec(), F.lit(False)), F.array(_fact("tool", _line("tool"), suffix=_line("tool"), kind=F.lit("tool.call"), payload=_json(tool=F.col("p.name")))))
    output = item & F.col("p.type").isin("custom_tool_call_output", "function_call_output")
    status = F.substring(F.get_json_object("p.output", "$[0].text"), 1, STATUS)
    named = F.col("p.call_id").isNotNull()
    begun = F.when(call & named, F.array(_fact("call", F.col("p.call_id"), tool=F.col("p.name"))))
    answered = F.when(output & named, F.array(_fact("call", F.col("p.call_id"), None, True, failed=F.coalesce(status.startswith("Script failed"), F.lit(False)))))
    return tool, begun, answered


def rollout_context(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The file's records: file, line_no, at_us, the facts told, and the session, project and model in force at its line.

    The records are written once, so all projections made of one context read the log no further. What is in force at the start of a segment comes from the last values of the
    segments before it, a row a segment."""
    good = parse_lines(lines, RECORD)[0].withColumn("p", F.col("r.payload"))
    good = good.select("file", "line_no", "r", "p", when(lines, F.col("r.timestamp")).alias("at_us"), F.when(_is_exec(), _scripts()).alias("scripts"))
    meta, turn = F.col("r.type") == "session_meta", F.col("r.type") == "turn_context"
    is_object = F.col("p.source").startswith("{")
    child = is_object & F.get_json_object("p.source", "$.subagent").isNotNull()
    surface = F.coalesce("p.originator", F.when(child, "codex-subagent").when(is_object, "codex").when(F.col("p.source").isNotNull(), F.concat(F.lit("codex-"), F.col("p.source"))))
    parent = F.when(F.col("p.session_id") != F.col("p.id"), F.col("p.session_id"))
    session = F.struct(F.col("p.id").alias("session"), parent.alias("parent"), surface.alias("surface"), F.coalesce(child, F.lit(False)).alias("is_subagent"))
    workdirs = F.filter(F.transform("scripts", lambda c: c["workdir"]), lambda w: w.isNotNull())
    project = F.when(meta | turn, F.col("p.cwd")).otherwise(F.try_element_at(workdirs, F.lit(-1)))
    none = F.filter(F.array(_fact("", F.lit(""))), lambda f: F.lit(False))
    facts = F.concat(*[F.coalesce(part, none) for part in (_lifecycle(), _usage(), _commands(), _writes(), *_calls())])
    slim = good.select("file", "line_no", "at_us", F.when(meta, session).alias("s"), F.when(turn, F.struct("p.model", "p.effort")).alias("t"), project.alias("c"), facts.alias("facts"))
    return _carried(stored(slim.withColumn("segment", F.floor(F.col("line_no") / segment)), "rollout-records"))


def _carried(slim: DataFrame) -> DataFrame:
    """Last values: within a segment by a window, before it by those of the segments before."""
    lasts = slim.groupBy("file", "segment").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in "stc"])
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select("file", "segment", *[last(c, earlier).alias(f"{c}_start") for c in "stc"])
    within = Window.partitionBy("file", "segment").orderBy("line_no")
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    value = lambda c, w: F.coalesce(last(c, w), F.col(f"{c}_start"))
    rows = slim.join(starts, ["file", "segment"], "left")
    return rows.select("file", "line_no", "at_us", "facts", value("s", upto).alias("ctx"), value("t", upto).alias("turn"), value("c", upto).alias("project"), value("c", before).alias("project_before"))


def _events(ctx: DataFrame, *groups: str) -> DataFrame:
    wanted = F.filter("facts", lambda f: f["group"].isin(*groups)) if groups else F.col("facts")
    rows = ctx.select("*", F.explode(wanted).alias("f")).select("*", "f.*").drop("facts", "f")
    same = Window.partitionBy("file", "group", "key").orderBy("line_no", "is_result", "place")
    previous = F.lag(F.struct("is_result", "tool", "at_us")).over(same)
    rows = rows.select("*", F.row_number().over(same).alias("nth"), previous.alias("call"))
    group, is_result = F.col("group"), F.col("is_result") == 1
    first, answer = (group == "usage") & (F.col("nth") == 1), (group == "call") & is_result & (F.col("call.is_result") == 0)
    rows = rows.where(~group.isin("usage", "call") | first | answer)

    name = F.coalesce("ctx.session", F.lit("unknown"))
    request = F.concat(name, F.lit(":"), "key")
    tokens = {
        "provider": F.lit(PROVIDER), "model": F.col("turn.model"), "request_id": request, "input_tokens": F.greatest(_n(F.col("last"), "input_tokens") - _n(F.col("last"), "cached_input_tokens"), F.lit(0)),
        "cache_creation_input_tokens": _n(F.col("last"), "cache_write_input_tokens"), "cache_read_input_tokens": _n(F.col("last"), "cached_input_tokens"), "output_tokens": _n(F.col("last"), "output_tokens"),
        "is_subagent": F.coalesce("ctx.is_subagent", F.lit(False)), "provider_usage": _json(reasoning_output_tokens=_n(F.col("last"), "reasoning_output_tokens"), reasoning_effort=F.col("turn.effort")),
    }
    span = F.col("at_us") - F.col("call.at_us")
    duration = F.when(span >= 0, F.floor(span / 1000).cast("long")).when(span < 0, F.lit(0).cast("long"))
    outcome = _json(tool=F.col("call.tool"), tool_use_id=F.col("key"), duration_ms=duration, failed=F.col("failed"))
    kind = F.when(group == "usage", "token.usage").when(group == "call", "tool.outcome").otherwise(F.col("kind"))
    payload = F.when(group == "usage", _json(**tokens)).when(group == "call", outcome).otherwise(F.col("payload"))
    suffix = F.when(group == "usage", F.concat(F.lit("usage:"), request)).when(group == "call", F.concat(F.lit("outcome:"), "key")).otherwise(F.col("suffix"))
    project = F.when(group == "command", F.coalesce("folder", "project_before")).when(group == "write", F.coalesce("project", "folder")).otherwise(F.col("project"))
    return as_events(rows, agent=AGENT, key=F.concat(name, F.lit(":"), suffix), kind=kind, payload=payload, timestamp=F.col("at_us"), session=F.col("ctx.session"), project=project, surface=F.col("ctx.surface"), parent=F.col("ctx.parent"))


def rollout_token_usage(ctx: DataFrame) -> DataFrame:
    """One event a snapshot of the counters, the first in a file."""
    return _events(ctx, "usage")


def rollout_commands(ctx: DataFrame) -> DataFrame:
    """One event an exec call in a script; a call without a workdir has that of the last before it."""
    return _events(ctx, "command")


def rollout_file_writes(ctx: DataFrame) -> DataFrame:
    """One event a path of a patch that was applied, in path order."""
    return _events(ctx, "write")


def rollout_tool_calls(ctx: DataFrame) -> DataFrame:
    return _events(ctx, "tool")


def rollout_outcomes(ctx: DataFrame) -> DataFrame:
    """One event a call whose output follows."""
    return _events(ctx, "call")


def rollout_lifecycle(ctx: DataFrame) -> DataFrame:
    return _events(ctx, "life")


def rollout_events(lines: DataFrame) -> DataFrame:
    """All events of rollouts, from one reading of the log."""
    return _events(rollout_context(lines))
