"""Reports over the spine and its projections: activity, health, files, tools, access, sessions, receipts."""

from __future__ import annotations

from functools import reduce
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensitivity import classify_path, sensitivity_rank
from ..functions.values import share, under_path
from .repositories import in_tree
from .tokens import agent_filter, in_range

FOREVER = (0, 2**63 - 1)
IDLE_US = 24 * 3600 * 1_000_000

# Fixed value: what no adapter or one adapter cannot report.
GAPS_ALL = ("network        not collected", "processes      not collected", "prompt content disabled by design")
GAPS_BRANCH = "git branch     not reported by the source log"
GAPS_AGENT = {"codex": ("Codex files    rollout logs expose patch writes, but not direct file-read events", "Codex MCP      rollout calls are generic tools unless Codex identifies MCP metadata")}


def _midnight(day: date, tz: str) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz)).timestamp()) * 1_000_000


def range_between(first: date, last: date, tz: str = "UTC") -> tuple[int, int]:
    """Both days included, from midnight to midnight of the zone."""
    if first > last:
        raise ValueError("the first day is after the last")
    return _midnight(first, tz), _midnight(last + timedelta(days=1), tz)


def range_days(days: int, tz: str, as_of: date) -> tuple[int, int]:
    """The last days up to ``as_of``, which counts as one."""
    return range_between(as_of - timedelta(days=max(1, days) - 1), as_of, tz)


def range_all() -> tuple[int, int]:
    return FOREVER


def activity(events: DataFrame, projects: DataFrame | None = None, *, from_us=None, to_us=None, agent=None, session=None, closure: DataFrame | None = None, kinds=(), project_prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` events that pass all filters, oldest first. With ``closure`` a session brings its descendants."""
    out = agent_filter(in_range(events, from_us, to_us), [agent] if agent else ())
    if session is not None:
        out = out.where(F.col("session_id") == session) if closure is None else in_tree(out, closure, session).drop("root_id")
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if projects is not None:
        dims = projects.select(F.col("id").alias("_p"), F.col("path").alias("project_path"), "repository_root")
        out = out.join(dims, F.col("project_id") == F.col("_p"), "left").drop("_p")
        if project_prefix is not None:
            out = out.where(under_path("repository_root", project_prefix) | under_path("project_path", project_prefix))
    if limit is not None:
        out = out.orderBy(F.desc("timestamp_us"), F.desc("id")).limit(limit)
    return out.orderBy("timestamp_us", "id")


def recent_events(events: DataFrame, projects: DataFrame, limit: int) -> DataFrame:
    dims = projects.select(F.col("id").alias("_p"), F.col("path").alias("project_path"))
    newest = events.orderBy(F.desc("timestamp_us"), F.desc("id")).limit(limit)
    return newest.join(dims, F.col("project_id") == F.col("_p"), "left").drop("_p")


def status_totals(events: DataFrame, sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """One row of counts; each table gives one aggregated row, and the rows are added up."""
    zero = lambda n: F.lit(0).cast("long").alias(n)
    names = ["events", "sessions", "active_sessions", "projects", "unknown_events"]

    def row(df, **counts):
        return df.agg(*[counts[n].alias(n) if n in counts else zero(n) for n in names])

    parts = row(events, events=F.count("*"), unknown_events=F.count_if(F.col("kind") == "unknown"))
    parts = parts.unionByName(row(sessions, sessions=F.count("*"), active_sessions=F.count_if(F.col("status") == "active"))).unionByName(row(projects, projects=F.count("*")))
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def unknown_labels(events: DataFrame, limit: int = 50, label_path: str = "$.label") -> DataFrame:
    label = F.coalesce(F.get_json_object("payload", label_path), F.lit("(no label)"))
    return events.where("kind = 'unknown'").groupBy(label.alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(limit)


def collection_health(events: DataFrame, sessions: DataFrame, as_of_us: int) -> DataFrame:
    """When the last event came in, how many sessions wait to be reconciled, and whether nothing came for a day."""
    last = events.agg(F.max("created_at_us").alias("last_event_us"), F.lit(0).cast("long").alias("unreconciled"))
    waiting = sessions.agg(F.lit(None).cast("long").alias("last_event_us"), F.count_if(F.col("reconciled_at_us").isNull()).alias("unreconciled"))
    out = last.unionByName(waiting).agg(F.max("last_event_us").alias("last_event_us"), F.sum("unreconciled").alias("unreconciled"))
    return out.withColumn("idle", F.coalesce(F.lit(as_of_us) - F.col("last_event_us") >= IDLE_US, F.lit(True)))


def file_churn(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Per path written to: writes, reads, sessions, and how many agents report reads at all."""
    write, read = F.col("operation") == "write", F.col("operation") == "read"
    out = files.groupBy("path").agg(F.count_if(write).alias("writes"), F.count_if(read).alias("reads"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(read, F.col("agent_id"))).alias("reading_agents")).where("writes > 0")
    return out.orderBy(F.desc("writes"), "path").limit(limit) if limit is not None else out


def selected_ranks(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(keys, percent, value): of each group's known values the one of nearest rank, exactly, without a group in one buffer.

    Equal values are counted before the shuffle. The rank is then sought digit by digit, 16 bits at a time: a histogram of a digit has at most 65,536 rows a group
    (the first one as many as the values have different upper halves), its running sum tells in which row the rank falls, and only values
    with that digit are looked at further."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    names = [f"_k{i}" for i in range(len(keys))]
    hist = hist.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_v", "_n")
    total = hist.groupBy(*names).agg(F.sum("_n").alias("_all"))
    state = total.select(*names, F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"), "_all")
    # The nearest rank is the percent of all, rounded up.
    state = state.select(*names, "percent", F.expr("(percent * _all + 99) div 100").alias("_rank"))
    found: list[str] = []
    for bits in (32, 16, 0):
        digit = F.shiftright("_v", bits)
        known = state.withColumnsRenamed({n: f"_s{n}" for n in (*names, *found)})
        same = [F.col(n).eqNullSafe(F.col(f"_s{n}")) for n in names] + [F.shiftright("_v", 32 if f == "_d32" else 16) == F.col(f"_s{f}") for f in found]
        counted = hist.join(known, reduce(lambda x, y: x & y, same)).groupBy(*names, "percent", "_rank", *[F.col(f"_s{f}").alias(f) for f in found], digit.alias(f"_d{bits}")).agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*names, "percent").orderBy(f"_d{bits}"))
        here = counted.withColumn("_upto", upto).where("_upto >= _rank and _upto - _n < _rank")
        found = [f"_d{bits}"]
        state = here.select(*names, "percent", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), *found)
    return state.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "percent", F.col("_d0").alias(value))


def tool_reliability(outcomes: DataFrame, approx: bool = False, by_selection: bool = False) -> DataFrame:
    """Per agent and tool: calls, failures, and of the known durations the nearest-rank p50 and p95 and the maximum. By default a tool's different durations are
    held in one buffer; ``by_selection`` finds the same ranks in bounded memory, ``approx`` nearly the same in one pass."""
    sums = [F.count("*").alias("calls"), F.count_if("failed").alias("failures")]
    most = F.max("duration_ms").alias("max_ms")
    if by_selection:
        keys = ["agent_id", "tool"]
        ranks = selected_ranks(outcomes, keys, "duration_ms", (50, 95)).groupBy(F.col("agent_id").alias("_a"), F.col("tool").alias("_t"))
        ranks = ranks.agg(*[F.max(F.when(F.col("percent") == p, F.col("duration_ms"))).alias(f"p{p}_ms") for p in (50, 95)])
        out = outcomes.groupBy(*keys).agg(*sums, most)
        out = out.join(ranks, F.col("agent_id").eqNullSafe(F.col("_a")) & F.col("tool").eqNullSafe(F.col("_t")), "left").select(*keys, "calls", "failures", "p50_ms", "p95_ms", "max_ms")
    else:
        rank = (lambda p: F.percentile_approx("duration_ms", p, 10_000)) if approx else (lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY duration_ms) AS BIGINT)"))
        out = outcomes.groupBy("agent_id", "tool").agg(*sums, rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), most)
    return out.withColumn("failure_rate", share("failures", "calls"))


def sensitive_files(files: DataFrame) -> DataFrame:
    """Files with their sensitivity, if it is not normal."""
    return files.withColumn("sensitivity", classify_path("path")).where("sensitivity <> 'normal'")


def notable_access(files: DataFrame, references: DataFrame, limit: int | None = None) -> DataFrame:
    """Sensitive file events and sensitive paths in commands: the gravest first, and then the newest."""
    columns = ["timestamp_us", "agent_id", "session_id", "project_id", "what", "path", "sensitivity", "evidence"]
    own = files.withColumn("what", F.concat(F.lit("file."), F.col("operation"))).where("sensitivity <> 'normal'")
    own = own if "evidence" in own.columns else own.withColumn("evidence", F.lit("transcript"))
    told = references.withColumn("what", F.lit("command")).withColumn("evidence", F.lit("derived")).where("sensitivity <> 'normal'")
    out = own.select(*columns).unionByName(told.select(*columns))
    if limit is None:
        return out
    return out.orderBy(F.desc(sensitivity_rank("sensitivity")), F.desc("timestamp_us"), "what", "path", "session_id").limit(limit)


def file_evidence(files: DataFrame, events: DataFrame) -> DataFrame:
    """File events with the evidence of their event."""
    return files.join(events.select("id", "evidence"), "id")


def daily_snapshot(usage: DataFrame, files: DataFrame, events: DataFrame, day: date, tz: str = "UTC") -> DataFrame:
    """Tokens, sessions and sensitive accesses of a day."""
    low, high = range_between(day, day, tz)
    total = F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens") + F.col("output_tokens")
    none = F.lit(None).cast("long")
    parts = in_range(usage, low, high).select(total.alias("tokens"), none.alias("session"), none.alias("sensitive"))
    parts = parts.unionByName(in_range(events, low, high).select(none.alias("tokens"), F.col("session_id").alias("session"), none.alias("sensitive")))
    parts = parts.unionByName(sensitive_files(in_range(files, low, high)).select(none.alias("tokens"), none.alias("session"), F.lit(1).cast("long").alias("sensitive")))
    return parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_distinct("session").alias("sessions"), F.coalesce(F.sum("sensitive"), F.lit(0)).alias("sensitive"))


# ---- sessions


def sessions_in_range(sessions: DataFrame, events: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """Sessions that started in the range or have an event in it."""
    active = in_range(events, from_us, to_us).select(F.col("session_id").alias("id")).unionByName(in_range(sessions, from_us, to_us, "started_us").select("id")).distinct()
    return sessions.join(active, "id", "left_semi")


def session_counts(usage: DataFrame, commands: DataFrame, files: DataFrame, references: DataFrame, mcp: DataFrame | None = None) -> DataFrame:
    """Per session the counts of each projection. The projections are put under one another and aggregated once."""
    total = F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens") + F.col("output_tokens")
    names = ["tokens", "responses", "commands", "files", "mcp_calls", "sensitive"]

    def part(df, **values):
        return df.select("session_id", *[values.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    one, grave = F.lit(1), (F.col("sensitivity") != "normal").cast("long")
    rows = part(usage, tokens=total, responses=one).unionByName(part(commands, commands=one)).unionByName(part(files, files=one, sensitive=grave)).unionByName(part(references, sensitive=grave))
    if mcp is not None:
        rows = rows.unionByName(part(mcp, mcp_calls=one))
    return rows.groupBy("session_id").agg(*[F.sum(n).alias(n) for n in names])


def dominant_model(usage: DataFrame) -> DataFrame:
    """(session_id, model): the one with most tokens; no model is a model of its own."""
    total = F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens") + F.col("output_tokens")
    sums = usage.groupBy("session_id", "model").agg(F.sum(total).alias("t"))
    return sums.groupBy("session_id").agg(F.max_by("model", F.struct("t", "model")).alias("model"))


def dominant_project(session_projects: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, project, projects): the label of the busiest, and how many there are."""
    dims = projects.select(F.col("id").alias("_p"), F.coalesce("repository_root", "path").alias("label"))
    rows = session_projects.join(dims, F.col("project_id") == F.col("_p"), "left")
    return rows.groupBy("session_id").agg(F.max_by("label", F.struct("event_count", "last_seen_us", "label")).alias("project"), F.count("*").alias("projects"))


def subagent_flags(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """(id, is_subagent): it has a parent, or all its usage is a subagent's."""
    only = usage.groupBy("session_id").agg(F.bool_and("is_subagent").alias("only"))
    joined = sessions.join(only, F.col("id") == F.col("session_id"), "left")
    return joined.select("id", (F.col("parent_session_id").isNotNull() | F.coalesce("only", F.lit(False))).alias("is_subagent"))


def session_list(sessions: DataFrame, events: DataFrame, usage: DataFrame, commands: DataFrame, files: DataFrame, references: DataFrame, projects: DataFrame, session_projects: DataFrame, *, from_us: int = 0, to_us: int = FOREVER[1], agents=(), limit: int | None = None) -> DataFrame:
    """Sessions in the range, newest first, each with its counts, model, project and subagent flag."""
    chosen = sessions_in_range(agent_filter(sessions, agents), events, from_us, to_us)
    if limit is not None:
        chosen = chosen.orderBy(F.desc("started_us"), F.desc("id")).limit(limit)
    out = chosen
    for extra in (session_counts(usage, commands, files, references), dominant_model(usage), dominant_project(session_projects, projects)):
        out = out.join(extra, F.col("id") == F.col("session_id"), "left").drop("session_id")
    out = out.join(subagent_flags(chosen, usage), "id")
    return out.na.fill(0, ["tokens", "responses", "commands", "files", "mcp_calls", "sensitive", "projects"])


def running_duration(sessions: DataFrame, as_of_us: int) -> DataFrame:
    """duration_ms as stored of an ended session, up to now of an active one, and null otherwise."""
    now = F.floor(F.greatest(F.lit(as_of_us) - F.col("started_us"), F.lit(0)) / 1000).cast("long")
    return sessions.withColumn("running_ms", F.when(F.col("status") == "ended", F.col("duration_ms")).when(F.col("status") == "active", now))


def pending_sessions(sessions: DataFrame, limit: int) -> DataFrame:
    """Sessions to be reconciled: those least recently tried first, then the newest."""
    waiting = sessions.where("reconciled_at_us is null and agent_id = 'claude-code' and external_session_id is not null")
    return waiting.orderBy(F.coalesce("reconcile_attempted_at_us", F.lit(0)), F.desc("started_us"), "id").limit(limit)


def find_session(sessions: DataFrame, reference: str) -> DataFrame:
    """``latest`` is the newest main session, or the newest of all; else the sessions whose id starts with the text: one if it is unique."""
    if reference == "latest":
        return sessions.orderBy(F.col("is_subagent").asc(), F.desc("started_us"), F.desc("id")).limit(1)
    found = sessions.where(F.col("id").cast("string").startswith(reference))
    return found.withColumn("matches", found.select(F.count("*")).scalar()) if reference else found.limit(0)


# ---- receipts: of one session tree, or of all at once


def receipt_files(files: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    return in_tree(files, closure, root).groupBy("root_id", "path", "project_id").agg(
        F.count_if(F.col("operation") == "read").alias("reads"), F.count_if(F.col("operation") == "write").alias("writes"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
    )


def receipt_tokens(usage: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    from .tokens import _sums

    return in_tree(usage, closure, root).groupBy("root_id", "model", "is_subagent").agg(*_sums())


def receipt_commands(commands: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    out = in_tree(commands, closure, root).select("root_id", "timestamp_us", "id", "session_id", "command")
    return out.orderBy("timestamp_us", "id") if root is not None else out


def receipt_notable_access(files: DataFrame, references: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    out = in_tree(notable_access(files, references), closure, root)
    return out.orderBy("timestamp_us", "what", "path") if root is not None else out


def session_project_list(session_projects: DataFrame, projects: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    """The labels a tree worked in, each once, the busiest first (place counts from 1)."""
    dims = projects.select(F.col("id").alias("_p"), F.coalesce("repository_root", "path").alias("label"))
    rows = in_tree(session_projects, closure, root).join(dims, F.col("project_id") == F.col("_p"))
    best = rows.groupBy("root_id", "label").agg(F.max(F.struct("event_count", "last_seen_us")).alias("best"))
    order = Window.partitionBy("root_id").orderBy(F.desc("best"), "label")
    return best.select("root_id", "label", F.col("best.event_count").alias("event_count"), F.row_number().over(order).alias("place"))


def session_coverage(events: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    """Per tree, which kinds of fact were seen: yes, none seen, or not collected."""
    seen = lambda *kinds: F.when(F.bool_or(F.col("kind").isin(*kinds)), "yes").otherwise("none seen")
    return in_tree(events, closure, root).groupBy("root_id").agg(
        seen("token.usage").alias("tokens"), seen("session.started").alias("session_start"), seen("tool.call", "tool.outcome").alias("tools"), seen("command").alias("commands"),
        seen("file.read", "file.write").alias("files"), seen("mcp.call").alias("mcp"), *[F.first(F.lit("not collected")).alias(n) for n in ("network", "processes", "prompt_content")],
    )


def coverage_gaps(sessions: DataFrame) -> DataFrame:
    """(id, place, gap): what the session's adapter cannot report."""
    gaps = F.array_compact(F.array(F.when(F.col("git_branch").isNull(), F.lit(GAPS_BRANCH))))
    for agent, lines in GAPS_AGENT.items():
        gaps = F.concat(gaps, F.when(F.col("agent_id") == agent, F.array(*map(F.lit, lines))).otherwise(F.array().cast("array<string>")))
    return sessions.select("id", F.posexplode(F.concat(gaps, F.array(*map(F.lit, GAPS_ALL)))).alias("place", "gap"))


def session_receipt(tables: dict[str, DataFrame], closure: DataFrame, root) -> dict[str, DataFrame]:
    """All sections of one session's receipt, as lazy frames."""
    return {
        "header": tables["sessions"].where(F.col("id") == root),
        "projects": session_project_list(tables["session_projects"], tables["projects"], closure, root),
        "tokens": receipt_tokens(tables["token_usage"], closure, root),
        "files": receipt_files(tables["file_events"], closure, root),
        "commands": receipt_commands(tables["commands"], closure, root),
        "notable": receipt_notable_access(tables["file_events"], tables["references"], closure, root),
        "timeline": activity(tables["spine"], session=root, closure=closure),
        "coverage": session_coverage(tables["spine"], closure, root),
        "gaps": coverage_gaps(tables["sessions"].where(F.col("id") == root)),
    }
