"""Registered queries over labelled session trees, a row a session, and over rollouts carried forward in segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sensitivity
from ..operators import dedupe, reports, repositories, rollouts, trees
from ..sources.scratch import stored
from .queries import _S2, _TREE, ORACLE_SQL, _files, _references, _rollout_lines, _sessions, query
from .views import duckdb_views, union_all


def _labels(v):
    return trees.tree_labels(v.sessions)


def _as(name: str) -> str:
    """The SQL of another query."""
    return ORACLE_SQL[name].removeprefix(duckdb_views())


query(
    f"""SELECT root_id AS id, top.tree, count(*) AS size, max(top.depth) AS depth FROM {_TREE} t
 JOIN (SELECT member_id, arg_max(root_id, depth) AS tree, max(depth) AS depth FROM {_TREE} GROUP BY 1) top ON top.member_id = root_id GROUP BY 1, 2""",
    "tree_labels",
)(lambda v: _labels(v).select("id", "tree", (F.col("high") - F.col("low") + 1).alias("size"), "depth"))
query(_as("session_descendants"), "tree_members")(lambda v: trees.members(_labels(v)))
query(
    f"""SELECT root_id, count(u.id) AS rows, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
 FROM {_TREE} t LEFT JOIN token_usage u ON u.session_id = t.member_id GROUP BY 1""",
    "tree_totals",
)(lambda v: trees.tree_totals(v.token_usage, _labels(v), ["input_tokens", "output_tokens"]))

for _name, _receipt in {
    "receipt_files": lambda v: reports.receipt_files(v.file_events, _labels(v)),
    "receipt_tokens": lambda v: reports.receipt_tokens(v.token_usage, _labels(v)),
    "receipt_commands": lambda v: reports.receipt_commands(v.commands, _labels(v)),
    "receipt_notable_access": lambda v: reports.receipt_notable_access(_files(v), _references(v), _labels(v)),
    "session_coverage": lambda v: reports.session_coverage(v.spine, _labels(v)),
}.items():
    query(_as(_name), f"{_name}_by_labels")(_receipt)

#: What the rows of a section are told by, in the order of their columns.
SECTIONS = {
    "projects": ("label", "event_count", "place"),
    "tokens": ("model", "is_subagent", "responses", "total"),
    "files": ("path", "project_id", "reads", "writes", "first_us", "last_us", "tools"),
    "commands": ("timestamp_us", "id", "session_id", "command"),
    "notable": ("timestamp_us", "what", "path"),
    "timeline": ("timestamp_us", "id", "kind", "session_id"),
    "coverage": ("tokens", "session_start", "tools", "commands", "files", "mcp", "network", "processes", "prompt_content"),
    "header": ("id", "agent_id", "status"),
    "gaps": ("place", "gap"),
}
_TEXT = {n: f"concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})" for n, columns in SECTIONS.items()}
ROOT = 7


def _list(lines) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


_AGENT_GAPS = " ".join(f"WHEN '{agent}' THEN {_list(lines)}" for agent, lines in reports.GAPS_AGENT.items())
_GAPS = f"list_concat(list_concat({_list([reports.GAPS_BRANCH])}, CASE agent_id {_AGENT_GAPS} ELSE [] END), {_list(reports.GAPS_ALL)})"
_SECTION_SQL = {
    "projects": f"SELECT label, event_count, row_number() OVER (ORDER BY event_count DESC, last_seen_us DESC, label) AS place, root_id FROM (SELECT root_id, coalesce(p.repository_root, p.path) AS label, max((u.n, u.seen))[1] AS event_count, max((u.n, u.seen))[2] AS last_seen_us FROM (SELECT session_id, project_id, count(*) AS n, max(timestamp_us) AS seen FROM token_usage GROUP BY 1, 2) u JOIN projects p ON p.id = u.project_id JOIN {_TREE} t ON u.session_id = t.member_id WHERE root_id = {ROOT} GROUP BY 1, 2)",
    "tokens": _as("receipt_tokens"),
    "files": _as("receipt_files"),
    "commands": _as("receipt_commands"),
    "notable": _as("receipt_notable_access"),
    "timeline": f"SELECT s.*, root_id FROM spine s JOIN {_TREE} t ON s.session_id = t.member_id",
    "coverage": _as("session_coverage"),
    "header": f"SELECT *, id AS root_id FROM {_S2}",
    "gaps": f"SELECT id AS root_id, generate_subscripts(g, 1) - 1 AS place, unnest(g) AS gap FROM (SELECT id, {_GAPS} AS g FROM {_S2})",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS section, {_TEXT[n]} AS line FROM ({sql}) WHERE root_id = {ROOT}" for n, sql in _SECTION_SQL.items()))
def receipt_rows(v):
    """The rows of the sections of one session's receipt, by its tree's labels."""
    labels = _labels(v)
    # Only the tree's paths and commands are classified, once each: what is stored stands before that, since Spark would judge all rows before it joins them.
    own = lambda facts, what: stored(repositories.in_tree(facts, labels, ROOT).drop("root_id"), what)
    files, commands = own(v.file_events, "receipt-files"), own(v.commands, "receipt-commands")
    tables = {"sessions": _sessions(v).withColumn("git_branch", F.lit(None).cast("string")), "session_projects": dedupe.session_projects(v.token_usage), "projects": v.projects, "token_usage": v.token_usage, "file_events": files.withColumn("sensitivity", sensitivity.classify_path("path")), "commands": commands, "references": sensitivity.scan_commands(commands), "spine": v.spine}
    sections = reports.session_receipt(tables, labels, ROOT)
    return union_all([sections[n].select(F.lit(n).alias("section"), F.concat_ws("|", *[F.col(c).cast("string") for c in SECTIONS[n]]).alias("line")) for n in _SECTION_SQL])


_USAGE = "model string, input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint"
query(_as("rollout_token_usage"), "rollout_usage_by_segments")(
    lambda v: rollouts.rollout_token_usage(rollouts.rollout_context(_rollout_lines(v), segment=3)).select(F.col("external_session_id").alias("session"), "timestamp_us", F.from_json("payload", _USAGE).alias("p")).select("session", "timestamp_us", "p.*")
)
query(_as("rollout_commands"), "rollout_commands_by_segments")(
    lambda v: rollouts.rollout_commands(rollouts.rollout_context(_rollout_lines(v), segment=3)).select(F.col("external_session_id").alias("session"), "timestamp_us", F.get_json_object("payload", "$.command").alias("command"), "project_path")
)
