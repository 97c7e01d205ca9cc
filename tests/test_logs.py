"""Log files, hook frames and the stream, on small inputs with known results."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tracemill.operators import changes, dedupe, hooks, reports, repositories, rollouts, tokens, transcripts
from tracemill.sources import logs, sinks
from tracemill.streaming import live


def lines(spark, *records, file="f"):
    rows = [(file, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "file string, line_no long, value string")


def assistant(mid="m1", at="2024-01-01T00:00:00Z", usage=None, content=(), **more):
    return {"type": "assistant", "timestamp": at, "sessionId": "s", "cwd": "/w", "message": {"id": mid, "model": "x", "usage": usage or {"input_tokens": 1, "output_tokens": 2}, "content": list(content)}, **more}


def payloads(events):
    return [json.loads(r["payload"]) for r in events.orderBy("line_no", "id").collect()]


def test_one_response_in_two_records(spark):
    data = lines(spark, assistant(), assistant(usage={"input_tokens": 9}), assistant("m2", usage={"input_tokens": None, "output_tokens": "many", "extra": {"a": [1, {"b": 2.5}]}}), '{"type": "assist', "", {"type": "user", "message": {"content": "plain"}})
    found = payloads(transcripts.transcript_token_usage(data))
    assert [(p["request_id"], p["input_tokens"], p["output_tokens"]) for p in found] == [("m1", 1, 2), ("m2", 0, 0)]
    assert json.loads(found[1]["provider_usage"]) == {"extra": {"a": [1, {"b": 2.5}]}}
    assert transcripts.record_inflation(data).first()[:] == (3, 2, 1.5)
    assert logs.parse_lines(data, transcripts.RECORD)[1].count() == 2


def test_request_id_stands_in_and_cache_misses_are_kept(spark):
    record = assistant(None, requestId="r1", isSidechain=True)
    record["message"]["diagnostics"] = {"cache_miss_reason": {"type": "ttl"}}
    (found,) = payloads(transcripts.transcript_token_usage(lines(spark, record)))
    assert found["request_id"] == "r1" and found["is_subagent"] and json.loads(found["provider_usage"]) == {"cache_miss_reason": "ttl"}


def test_calls_are_paired_with_results(spark):
    use = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}
    result = lambda i, **m: {"type": "user", "timestamp": "2024-01-01T17:22:06Z", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": i, **m}]}}
    data = lines(spark, result("t1"), assistant(at="2024-01-01T17:22:02Z", content=[use]), result("t1", is_error=True), result("t1"), result("orphan"))
    assert payloads(transcripts.transcript_outcomes(data)) == [{"tool": "Bash", "tool_use_id": "t1", "duration_ms": 4000, "failed": True}]
    back = lines(spark, assistant(at="2024-01-01T18:00:00Z", content=[use]), result("t1"))
    assert "duration_ms" not in payloads(transcripts.transcript_outcomes(back))[0]


CALLS = [
    ("mcp__a__b__c", {}, "mcp.call", {"server": "a", "tool": "b__c"}), ("mcp__a", {}, "mcp.call", {"server": "unknown", "tool": "mcp__a"}), ("Read", {"file_path": "/a"}, "file.read", {"path": "/a", "tool": "Read"}),
    ("NotebookEdit", {"notebook_path": "/n"}, "file.write", {"path": "/n", "tool": "NotebookEdit"}), ("Read", {}, "tool.call", {"tool": "Read"}), ("Bash", {"command": "ls"}, "command", {"command": "ls"}), ("Bash", {}, "tool.call", {"tool": "Bash"}), (None, {}, "unknown", {"label": "missing_tool_name"}),
]


def test_tool_names(spark):
    use = [{"type": "tool_use", "id": f"t{i}", "input": inp, **({"name": n} if n else {})} for i, (n, inp, _, _) in enumerate(CALLS)]
    rows = transcripts.transcript_activity(lines(spark, *[assistant(f"m{i}", content=[u]) for i, u in enumerate(use)])).orderBy("line_no").collect()
    assert [(r["kind"], json.loads(r["payload"])) for r in rows] == [(k, p) for _, _, k, p in CALLS]


def test_postures(spark):
    told = [{"type": "user", "permissionMode": m, "timestamp": f"2024-01-01T00:00:0{i}Z", "sessionId": "s"} for i, m in enumerate(["default", "default", "acceptEdits", "acceptEdits"])]
    assert payloads(transcripts.posture_transitions(lines(spark, *told))) == [{"mode": "default"}, {"mode": "acceptEdits", "previous": "default"}]


def counters(i, cached=0, write=0, out=0, total=1, reasoning=0):
    return {"input_tokens": i, "cached_input_tokens": cached, "cache_write_input_tokens": write, "output_tokens": out, "reasoning_output_tokens": reasoning, "total_tokens": total}


def rollout(kind, at="2024-01-01T00:00:00Z", **payload):
    return {"timestamp": at, "type": kind, "payload": payload}


def test_rollout_usage_and_context(spark):
    usage = {"last_token_usage": counters(100, 70, 5, 20, 120), "total_token_usage": counters(100, 70, 5, 20, 120)}
    later = {"last_token_usage": counters(100, 70, 5, 20, 120), "total_token_usage": counters(200, 140, 10, 40, 240)}
    data = lines(spark, rollout("session_meta", id="c", session_id="p", cwd="/w", source={"subagent": {}}), rollout("turn_context", model="g", effort="high"), rollout("event_msg", type="token_count", info=usage), rollout("event_msg", type="token_count", info=usage), rollout("turn_context", cwd="/v"), rollout("event_msg", type="token_count", info=later), rollout("event_msg", type="token_count", info=None))
    events = rollouts.rollout_token_usage(rollouts.rollout_context(data))
    found = payloads(events)
    assert [(p["input_tokens"], p["cache_creation_input_tokens"], p["cache_read_input_tokens"], p["output_tokens"]) for p in found] == [(30, 5, 70, 20)] * 2
    assert found[0]["model"] == "g" and "model" not in found[1] and all(p["is_subagent"] for p in found) and json.loads(found[0]["provider_usage"])["reasoning_effort"] == "high"
    row = events.orderBy("line_no").collect()[-1]
    assert (row["project_path"], row["surface"]) == ("/v", "codex-subagent") and row["parent_session_id"] is not None


def test_rollout_scripts_patches_and_outputs(spark):
    script = 'const a = tools.exec_command({"cmd":"ls","workdir":"/a"}); tools.exec_command({"cmd":"pwd","workdir":"/b"}); tools.exec_command(broken)'
    data = lines(
        spark, rollout("session_meta", id="c", cwd="/w", source="cli"), rollout("response_item", type="custom_tool_call", name="exec", input=script, call_id="1"),
        rollout("response_item", "2023-12-31T00:00:00Z", type="custom_tool_call_output", call_id="1", output=[{"text": "Script failed\nWall time"}]), rollout("response_item", type="function_call", name="plan", call_id="2"),
        rollout("event_msg", type="patch_apply_end", success=True, changes={"/r/b": {"type": "add"}, "/r/a": {}}), rollout("event_msg", type="turn_aborted"), rollout("event_msg", type="patch_apply_end", success=False, changes={"/r/c": {}}),
    )
    ctx = rollouts.rollout_context(data)
    assert [(r["project_path"], json.loads(r["payload"])["command"]) for r in rollouts.rollout_commands(ctx).orderBy("project_path").collect()] == [("/a", "ls"), ("/b", "pwd")]
    assert sorted((p["path"], p["tool"]) for p in payloads(rollouts.rollout_file_writes(ctx))) == [("/r/a", "apply_patch"), ("/r/b", "apply_patch:add")]
    assert payloads(rollouts.rollout_outcomes(ctx)) == [{"tool": "exec", "tool_use_id": "1", "duration_ms": 0, "failed": True}]
    assert payloads(rollouts.rollout_tool_calls(ctx)) == [{"tool": "plan"}]
    assert [r["kind"] for r in rollouts.rollout_lifecycle(ctx).orderBy("line_no").collect()] == ["session.started", "session.ended"]


def test_line_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for n in range(3):
        (tmp_path / "deep" / f"{n}.jsonl").write_text("".join(f'{{"n": {i}, "pad": "{"x" * 200}"}}\n' for i in range(500)))
    (tmp_path / "other.txt").write_text("no\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = logs.read_jsonl_lines(spark, str(tmp_path)).select("line_no", F.get_json_object("value", "$.n").cast("long").alias("n"))
        assert got.count() == 1500 and got.where("n <> line_no").count() == 0
        assert logs.read_jsonl_lines(spark, str(tmp_path), limit_files=2).count() == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def frames(n):
    names = ["SessionStart", "UserPromptSubmit", "PreToolUse", "Notification", "Stop", "PreCompact", "Odd"]
    return [{"v": 1, "source": "claude-code", "sent_at": 1_704_067_200_000_000 + i, "hook_version": "1", "payload": {"hook_event_name": names[i % 7], "session_id": f"s{i % 3}", "cwd": "/w", "tool_name": "Bash", "tool_input": {"command": "x --token abc"}, "tool_use_id": f"t{i}" if i % 7 == 2 else None, "prompt": "héllo"}} for i in range(n)]


def test_hooks_live_and_in_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    told = frames(28) + [{"v": 2, "source": "claude-code"}, {"v": 1, "source": "who"}]
    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(f) for f in told[part::3]))
    stream = live.stream_events(live.hook_stream(spark, str(tmp_path / "in"), 1))
    live.start_stream(stream, str(tmp_path / "sink"), str(tmp_path / "state"), available_now=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "sink" / "events"))
    batch = live.stream_events(logs.read_hook_envelopes(spark, str(tmp_path / "in")))
    assert sorted(r["id"] for r in stored.collect()) == sorted(r["id"] for r in batch.collect()) and stored.count() == 28
    sinks.append_events(batch, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink" / "events")).count() == 28
    text = " ".join(r["payload"] for r in stored.collect())
    assert "abc" not in text and "héllo" not in text and '"char_count":5' in text
    kinds = {r["kind"] for r in stored.collect()}
    assert kinds == {"session.started", "prompt", "command", "notification", "turn.ended", "context.compacted", "unknown"}


def test_the_live_and_the_reread_row_are_one(spark):
    use = {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}
    told = transcripts.transcript_activity(lines(spark, assistant(content=[use]))).first()
    schema = spark.read.schema(logs.HOOK_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(frames(3)[2])]))
    assert hooks.normalize_hooks(schema).first()["id"] == told["id"]


def test_reprocessing_changes_nothing(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("\n".join(json.dumps(assistant(f"m{i}")) for i in range(5)))
    for _ in range(2):
        live.reprocess(spark, str(tmp_path / "logs"), None, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink" / "events")).count() == 5


def test_sessions_do_not_depend_on_row_order(spark):
    rng = random.Random(7)
    rows = [(f"e{i}", rng.randrange(1000) * 1000, "codex", f"s{rng.randrange(4)}", rng.choice([None, "p1", "p2"]), rng.choice([None, "a", "b"]), rng.choice(["session.started", "session.ended", "prompt"]), i) for i in range(200)]
    schema = "id string, timestamp_us long, agent_id string, session_id string, project_id string, surface string, kind string, ingest_seq long"
    one = sorted(dedupe.build_sessions(spark.createDataFrame(rows, schema)).collect())
    rng.shuffle(rows)
    assert one == sorted(dedupe.build_sessions(spark.createDataFrame(rows, schema).repartition(5)).collect())


def test_a_start_after_an_end_makes_a_session_active_again(spark):
    rows = [("a", 0, "x", "s", "session.started", 1), ("b", 5000, "x", "s", "session.ended", 2), ("c", 9000, "x", "s", "session.started", 3)]
    got = dedupe.build_sessions(spark.createDataFrame([(*r[:4], None, *r[4:]) for r in rows], "id string, timestamp_us long, agent_id string, session_id string, project_id string, kind string, ingest_seq long")).first()
    assert (got["status"], got["ended_us"], got["duration_ms"]) == ("active", 5000, 5)


def test_trees_with_a_cycle(spark):
    sessions = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z")], "id string, parent_session_id string")
    got = {(r[0], r[1]) for r in repositories.session_descendants(sessions).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"), ("x", "x"), ("x", "y"), ("y", "y"), ("y", "x"), ("z", "z")}


def test_the_gravest_access_survives_a_limit(spark):
    schema = "timestamp_us long, agent_id string, session_id string, project_id string, operation string, path string, sensitivity string, command string"
    rows = [(9, "a", "s", "p", "read", "/x/.env", "sensitive", ""), (1, "a", "s", "p", "read", "/x/id_rsa", "highly_sensitive", ""), (5, "a", "s", "p", "read", "/x", "normal", "")]
    df = spark.createDataFrame(rows, schema)
    assert [r["path"] for r in reports.notable_access(df, df.limit(0), 1).collect()] == ["/x/id_rsa"]


def test_ranges():
    assert reports.range_between(date(2024, 3, 31), date(2024, 3, 31), "Europe/Berlin")[1] - reports.range_between(date(2024, 3, 31), date(2024, 3, 31), "Europe/Berlin")[0] == 23 * 3600 * 10**6
    assert reports.range_days(1, "UTC", date(2024, 1, 2)) == (1704153600000000, 1704240000000000) and reports.range_all() == (0, 2**63 - 1)
    with pytest.raises(ValueError):
        reports.range_between(date(2024, 1, 2), date(2024, 1, 1))


def test_totals_of_nothing(spark):
    usage = spark.createDataFrame([], "agent_id string, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long")
    assert tokens.token_totals(usage).first()[:] == (0, 0, 0, 0, 0, 0)


def test_first_look_at_settings_is_no_change(spark):
    rows = [("/a", '{"x":1}', 1), ("/a", '{"x":1}', 2), ("/a", None, 3), ("/b", "{}", 1)]
    got = changes.config_changes(changes.config_fingerprint(spark.createDataFrame(rows, "path string, hooks_json string, observed_at_us long"))).collect()
    assert [(r["path"], r["observed_at_us"], r["collection_stopped"]) for r in got] == [("/a", 3, True)]


def test_sql_reads_only(spark):
    table = spark.createDataFrame([(1, None), (2, "")], "a int, b string")
    assert sinks.sql(spark, "WITH t AS (SELECT * FROM t_sql) SELECT count(b) AS n FROM t", {"t_sql": table}).first()["n"] == 1
    for bad in ("DROP TABLE t_sql", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`", "SET a=b"):
        with pytest.raises(Exception):
            sinks.sql(spark, bad).collect()


def test_export(spark, tmp_path):
    rows = [("a", 2_000_000, "x", "prompt", "hook", "/p", '{"char_count":1}'), ("b", 1_000_000, "x", "prompt", "hook", None, '{"char_count":2}')]
    sinks.export_jsonl(spark.createDataFrame(rows, "id string, timestamp_us long, agent_id string, kind string, evidence string, project_path string, payload string"), str(tmp_path / "out"), single_file=True)
    told = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [t["event"]["char_count"] for t in told] == [2, 1] and told[1]["project"] == "/p" and told[0]["timestamp"].startswith("1970-01-01T00:00:01")


def test_appends_look_at_all_dates_and_are_compacted(spark, tmp_path):
    schema = "id string, timestamp_us long, evidence string, payload string"
    day = 86_400_000_000
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    path = str(tmp_path / "spine")
    sinks.append_events(rows(("a", 10 * day, "hook", "1"), ("b", 10 * day, "hook", "1")), path)
    sinks.append_events(rows(("a", 11 * day, "log", "2"), ("b", 10 * day, "hook", "1"), ("c", 11 * day, "log", "2")), path)
    stored = lambda: spark.read.parquet(f"{path}/events")
    assert sorted((r["id"], r["payload"]) for r in stored().collect()) == [("a", "1"), ("b", "1"), ("c", "2")]
    sinks.append_events(rows(("a", 20 * day, "log", "3")), path)
    sinks.append_events(rows(("a", 30 * day, "log", "4"), ("d", 30 * day, "log", "4")), path)
    assert stored().where("id = 'a'").count() == 1
    sinks.compact(spark, path, "1970-01-01", "1970-02-28")
    assert sorted((r["id"], r["payload"]) for r in stored().collect()) == [("a", "1"), ("b", "1"), ("c", "2"), ("d", "4")]
    ranged = tokens.in_range(stored(), 11 * day, 12 * day)
    assert [r["id"] for r in ranged.collect()] == ["c"] and "PartitionFilters: [isnotnull(event_date" in ranged._jdf.queryExecution().executedPlan().toString()


def test_ids_of_nothing_are_null(spark):
    records = [assistant("m1", at="2024-01-01T00:00:00Z"), {"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "message": {"id": "m2", "usage": {"input_tokens": 1}}}]
    events = transcripts.transcript_events(lines(spark, *records)).withColumn("ingest_seq", F.col("line_no"))
    rows = events.orderBy("line_no").collect()
    assert [r["parent_session_id"] for r in rows] == [None, None] and rows[1]["session_id"] is None and rows[1]["project_id"] is None
    assert rows[0]["session_id"] is not None and rows[0]["project_id"] is not None
    sessions = dedupe.build_sessions(events).collect()
    assert [(r["id"], r["parent_session_id"]) for r in sessions] == [(rows[0]["session_id"], None)]
    assert dedupe.build_projects(events).count() == 1 and dedupe.session_projects(events).count() == 1
    flags = reports.subagent_flags(dedupe.build_sessions(events), hooks.project_tokens(events)).collect()
    assert [r["is_subagent"] for r in flags] == [False]


@pytest.mark.parametrize("edges", [[(i, i - 1) for i in range(1, 40)], [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6)], [(1, 9), (2, 1), (3, 1)]])
def test_closures_of_chains_cycles_and_missing_parents(spark, edges):
    parent = dict(edges)
    ids = sorted({x for e in edges for x in e})
    want = set()
    for member in ids:
        at, depth, seen = member, 0, set()
        while at is not None and at not in seen:
            seen.add(at)
            want.add((at, member, depth))
            at, depth = parent.get(at), depth + 1
    rows = spark.createDataFrame([(i, parent.get(i)) for i in ids], "id long, parent_session_id long")
    got = {tuple(r) for r in repositories.session_descendants(rows).collect()}
    assert got == want
    some = {tuple(r) for r in repositories.session_descendants(rows, rows.where("id in (1, 3)")).collect()}
    assert some == {w for w in want if w[0] in (1, 3)}


def test_deep_paths_keep_their_repository(spark):
    paths = spark.createDataFrame([(1, "/d0/" + "/".join(f"x{i}" for i in range(80))), (2, "/other")], "id long, path string")
    got = repositories.resolve_repositories(paths, spark.createDataFrame([("/d0",)], "root string")).collect()
    assert {r["id"]: r["repository_root"] for r in got} == {1: "/d0", 2: None}


def test_logs_are_read_once(spark):
    """Each line is evaluated once, also where the records are written before they are carried forward and then used for all projections."""
    for read in (transcripts.transcript_events, rollouts.rollout_events):
        seen = spark.sparkContext.accumulator(0)

        def told(value, seen=seen):
            seen.add(1)
            return value

        data = lines(spark, assistant(), rollout("session_meta", id="c", cwd="/w"), rollout("event_msg", type="task_started"))
        events = read(data.withColumn("value", F.udf(told, "string").asNondeterministic()("value")))
        assert events.count() and seen.value == 3
    assert transcripts.transcript_events(lines(spark, assistant()))._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
