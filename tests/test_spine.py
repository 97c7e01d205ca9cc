"""The stored spine: order of arrival, batches done again, states that merge, pauses, and streams with state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_logs import assistant, frames
from tracemill.operators import changes, dedupe, folds, reports
from tracemill.sources import logs, sinks
from tracemill.streaming import live

SCHEMA = "id string, timestamp_us long, agent_id string, session_id string, external_session_id string, parent_session_id string, project_id string, git_branch string, surface string, kind string, evidence string, payload string, file string, line_no long"
DAY = 86_400_000_000


def event(i, at, session="s", kind="prompt", parent=None, project=None, branch=None, file=None, line=None):
    return (i, at, "claude-code", session, session, parent, project, branch, None, kind, "hook", "{}", file, line)


def random_events(n, seed):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    kinds = ("prompt", "session.started", "session.ended")
    return [event(f"e{i}", rng.randrange(40) * DAY // 8, pick("a", "b", "c", None), pick(*kinds), pick(None, "p", "q"), pick(None, "x", "y"), pick(None, "main", "dev")) for i in range(n)]


def as_set(df, columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


SESSION = ["id", "agent_id", "project_id", "external_session_id", "started_us", "ended_us", "status", "duration_ms", "git_branch", "surface", "parent_session_id"]


@pytest.mark.parametrize("seed", range(3))
def test_states_merge_in_any_split(spark, seed):
    events = spark.createDataFrame([(*e, k) for k, e in enumerate(random_events(80, seed))], SCHEMA + ", ingest_seq long")
    parts = [folds.fold_sessions(events.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) == k)) for k in range(3)]
    states = parts[2].unionByName(folds.merge_folds(parts[0].unionByName(parts[1]))).unionByName(parts[1])
    assert as_set(folds.sessions_of(folds.merge_folds(states)), SESSION) == as_set(dedupe.build_sessions(events), SESSION)


def test_reports_run_on_what_was_stored(spark, tmp_path):
    path, told = str(tmp_path / "spine"), random_events(90, 7)
    repeated = [event(told[k][0], 0, "a", "prompt", parent="later") for k in range(0, 20)]
    for k, rows in enumerate((told[40:], told[:40] + told[30:60], repeated)):
        sinks.append_events(spark.createDataFrame(rows, SCHEMA).repartition(3), path, f"b{k}", now_us=1000 + k)
    stored = sinks.spine_tables(spark, path)
    events, sessions = stored["events"], stored["sessions"]
    assert events.count() == 90 and dedupe.dedupe_events(events).count() == 90
    assert as_set(sessions.drop("parent_session_id").withColumn("parent_session_id", F.lit(None).cast("string")), SESSION) == as_set(dedupe.build_sessions(events).withColumn("parent_session_id", F.lit(None).cast("string")), SESSION)
    parents = {r["id"]: r["parent_session_id"] for r in sessions.collect()}
    built = {r["id"]: r["parent_session_id"] for r in dedupe.build_sessions(events).collect()}
    assert all(parents[s] == (built[s] or ("later" if s == "a" else None)) for s in parents)
    assert {r["session_id"] for r in dedupe.repair_parents(events).collect()} <= set(parents)
    seen = events.select("ingest_seq.batch", "created_at_us").distinct().collect()
    assert {tuple(r) for r in seen} == {(1, 1000), (2, 1001)}  # the third batch adds nothing
    health = reports.collection_health(events, sessions, 1001 + DAY).first()
    assert tuple(health) == (1001, 3, True)
    sinks.mark_reconciled(sessions.where("id = 'a'"), path, 2000)
    sinks.mark_reconciled(sessions.where("id = 'b'"), path, 2001, F.lit(False))
    again = sinks.spine_tables(spark, path)["sessions"]
    assert [r["id"] for r in reports.pending_sessions(again, 5).collect()] == ["c", "b"]
    before = as_set(again, SESSION)
    sinks.compact(spark, path, "1970-01-01", "1971-01-01")
    after = sinks.spine_tables(spark, path)
    assert as_set(after["sessions"], SESSION) == before and after["events"].count() == 90
    assert spark.read.parquet(f"{path}/folds").select("batch").distinct().count() == 1
    sinks.append_events(spark.createDataFrame(told, SCHEMA), path, "b9")
    assert spark.read.parquet(f"{path}/events").count() == 90 and sinks.last_batch(spark, path)["seq"] == 4


def test_repeated_parent_is_kept(spark, tmp_path):
    path = str(tmp_path / "spine")
    sinks.append_events(spark.createDataFrame([event("1", 5), event("2", 6)], SCHEMA), path)
    sinks.append_events(spark.createDataFrame([event("1", 5, parent="p"), event("1", 5, parent="q")], SCHEMA).coalesce(1), path)
    assert sinks.spine_tables(spark, path)["sessions"].first()["parent_session_id"] == "p"


def test_a_known_batch_is_passed_over_unread(spark, tmp_path):
    path = str(tmp_path / "spine")
    rows = spark.createDataFrame([event("1", 5)], SCHEMA)
    sinks.append_events(rows, path, "b")
    sinks.append_events(rows.withColumn("payload", F.raise_error(F.lit("was read"))), path, "b")
    assert spark.read.parquet(f"{path}/batches").count() == 1
    with pytest.raises(Exception, match="was read"):
        sinks.append_events(rows.withColumn("payload", F.raise_error(F.lit("was read")).cast("string")), path, "c")


@pytest.mark.parametrize("fails", ["before", "after"])
def test_a_batch_that_failed_is_done_again(spark, tmp_path, monkeypatch, fails):
    path, told = str(tmp_path / "spine"), random_events(30, 3)
    sinks.append_events(spark.createDataFrame(told[:10], SCHEMA), path, "b0")
    append = sinks._append

    def broken(events, where, rows):
        if fails == "after":
            append(events.where("pmod(xxhash64(id), 2) = 0"), where, rows)  # a part is stored
        raise OSError("gone")

    monkeypatch.setattr(sinks, "_append", broken)
    with pytest.raises(OSError):
        sinks.append_events(spark.createDataFrame(told, SCHEMA), path, "b1")
    monkeypatch.setattr(sinks, "_append", append)
    sinks.append_events(spark.createDataFrame(told, SCHEMA), path, "b1")
    events = spark.read.parquet(f"{path}/events")
    assert events.count() == events.select("id").distinct().count() == 30
    assert as_set(sinks.spine_tables(spark, path)["sessions"], SESSION) == as_set(dedupe.build_sessions(events), SESSION)


def test_few_ids_are_looked_up_by_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "spine")
    rows = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) as id", "5L as timestamp_us", "'hook' as evidence")
    sinks.append_events(rows.coalesce(1), path)
    assert sinks._holding(spark, path, ["no", "none"]) == []
    there = rows.limit(3).collect()
    assert sorted(sinks._holding(spark, path, ["no", *[r["id"] for r in there]])) == sorted(r["id"] for r in there)
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "100")
    try:  # ids within the files' least and largest, so only the filter can tell
        absent = spark.read.schema("id string").parquet(f"{path}/events").where(F.col("id").isin(*[f"{k:02x}zz" for k in range(20, 200, 9)]))
        absent.collect()
        leaf = absent._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        leaf = leaf.metrics().contains("numOutputRows") and leaf or leaf.executedPlan().collectLeaves().apply(0)
        assert leaf.metrics().apply("numOutputRows").value() == 0
    finally:
        spark.conf.unset("spark.sql.parquet.pushdown.inFilterThreshold")


# ---- streams
def write_frames(folder, name, told):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(f) for f in told))


def drained(run):
    run.awaitTermination()
    return run


def test_a_pause_leaves_two_events_also_after_restarts(spark, tmp_path):
    sink, told = str(tmp_path / "sink"), frames(60)
    for k, stop in enumerate((False, True, True, False, False)):
        write_frames(tmp_path / "in", f"f{k}", told[k * 12 : k * 12 + 12])
        stream = live.stream_events(live.hook_stream(spark, str(tmp_path / "in")))
        drained(live.start_stream(stream, sink, str(tmp_path / "state"), paused=lambda stop=stop: stop, available_now=True))
    events = spark.read.parquet(f"{sink}/events")
    kinds = [r["kind"] for r in events.where("agent_id = 'collector'").orderBy("ingest_seq").collect()]
    assert kinds == ["collection.paused", "collection.resumed"]
    times = sorted(r["timestamp_us"] - 1_704_067_200_000_000 for r in events.where("agent_id <> 'collector'").collect())
    assert times == [*range(12), *range(36, 60)]
    marker = events.where("kind = 'collection.paused'").first()
    sinks.append_events(events.where("kind = 'collection.paused'"), sink, "again")
    assert spark.read.parquet(f"{sink}/events").where(F.col("id") == marker["id"]).count() == 1


def test_repeats_stop_before_the_sink(spark, tmp_path):
    sink, told = str(tmp_path / "sink"), frames(40)
    for k in range(4):
        write_frames(tmp_path / "in", f"f{k}", told[k * 10 : k * 10 + 10] + told[max(0, k * 10 - 10) : k * 10])
    stream = live.stream_events(live.hook_stream(spark, str(tmp_path / "in"), 1))
    run = drained(live.start_stream(stream, sink, str(tmp_path / "state"), available_now=True, repeats_within="1 hour"))
    assert spark.read.parquet(f"{sink}/events").count() == 40
    assert spark.read.parquet(f"{sink}/batches").agg(F.sum("offered")).first()[0] == 40
    assert live.state_report(run)[-1]["rows"] == 40


def test_late_events_reach_the_spine_and_not_the_state(spark, tmp_path):
    hour = 3_600_000_000
    told = [dict(f, sent_at=1_704_067_200_000_000 + k * hour) for k, f in enumerate(frames(72))]
    parts = (told[:24], told[24:72], [dict(told[0], sent_at=told[0]["sent_at"] + 1)])  # the last is three days late
    sink, counts = str(tmp_path / "sink"), str(tmp_path / "counts")
    late = 0
    for k, part in enumerate(parts):
        write_frames(tmp_path / "in", f"f{k}", part)
        stream = live.stream_events(live.hook_stream(spark, str(tmp_path / "in"), 1))
        drained(live.start_stream(stream, sink, str(tmp_path / "s1"), available_now=True))
        run = drained(live.start_rollup(live.windowed_counts(stream, lateness="1 hour"), counts, str(tmp_path / "s2"), available_now=True))
        late += sum(s["late"] for s in live.state_report(run))
    got = live.read_rollup(spark, counts, ["start_us", "kind"])
    on_time = spark.read.parquet(f"{sink}/events").where(F.col("timestamp_us") != parts[2][0]["sent_at"])
    assert as_set(got, ["start_us", "kind", "events"]) == as_set(live.windowed_counts(on_time), ["start_us", "kind", "events"])
    assert spark.read.parquet(f"{sink}/events").count() == 73 and late == 1


def test_spans_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(3)
    told = [dict(f, sent_at=1_704_067_200_000_000 + rng.randrange(200) * 600_000_000) for f in frames(90)]
    rng.shuffle(told)
    for k in range(3):
        write_frames(tmp_path / "in", f"f{k}", told[k * 30 : k * 30 + 30])
    far = 1_704_067_200_000_000 + 30 * DAY
    source = str(tmp_path / "in")
    build = lambda events: changes.activity_windows(events, "2 hours", lateness="3 days")
    batch = as_set(build(live.stream_events(logs.read_hook_envelopes(spark, source))), ["session_id", "start_us", "end_us", "events"])
    for k in range(2):  # a sign of life long after ends all spans
        write_frames(tmp_path / "in", f"z{k}", [dict(told[0], sent_at=far + k * DAY, payload=dict(told[0]["payload"], session_id="clock"))])
    stream = live.stream_events(live.hook_stream(spark, source, 1))
    drained(live.start_rollup(build(stream), str(tmp_path / "out"), str(tmp_path / "state"), mode="append", available_now=True))
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("start_us") < far)
    assert as_set(got, ["session_id", "start_us", "end_us", "events"]) == batch


def test_followed_logs_are_repaired_as_they_grow(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log, sink = tmp_path / "logs" / "a.jsonl", str(tmp_path / "sink")
    run = lambda: drained(live.follow_logs(spark, str(tmp_path / "logs"), sink, str(tmp_path / "state"), available_now=True))
    log.write_text("".join(json.dumps(assistant(f"m{i}", sessionId="s")) + "\n" for i in range(5)))
    (tmp_path / "logs" / "b.jsonl").write_text(json.dumps(assistant("other", sessionId="t")) + "\n")
    run()
    with log.open("a") as f:
        f.write(json.dumps(assistant("m5", sessionId="s")) + "\n" + json.dumps(assistant("m6", sessionId="s")))
    run()
    run()
    assert spark.read.parquet(f"{sink}/events").count() == 8  # the file that holds a new line is read whole, with its last line
    sessions = sinks.spine_tables(spark, sink)["sessions"]
    assert sessions.where("reconcile_attempted_at_us is not null").count() == 2 and sessions.where("reconciled_at_us is not null").count() == 0
    later = spark.read.parquet(f"{sink}/events").agg(F.max("created_at_us")).first()[0] + 2 * live.IDLE_US
    live.reprocess(spark, str(tmp_path / "logs"), None, sink, now_us=later)
    assert sinks.spine_tables(spark, sink)["sessions"].where(F.col("reconciled_at_us") == later).count() == 2


# ---- gaps and ranks
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_activity_around_gaps_does_not_depend_on_the_buckets(spark, width):
    rng = random.Random(width)
    events = [(rng.choice("ab"), rng.randrange(200)) for _ in range(60)] + [(None, 5), ("a", None), ("c", 3)]
    gaps = [(rng.choice("ab"), a, a + rng.choice([0, 1, 3, 40, 90])) for a in (rng.randrange(190) for _ in range(25))] + [("a", 100, None), ("c", 4, 9), ("d", 1, 2), (None, 1, 2)]
    got = changes.activity_around_gaps(spark.createDataFrame(gaps, "host string, paused_us long, resumed_us long"), spark.createDataFrame(events, "host string, timestamp_us long"), 150, width_us=width)
    want = set()
    for h, a, b in {g for g in gaps if g[0]}:
        end, mine = 150 if b is None else b, [t for k, t in events if k == h and t is not None]
        want.add((h, a, b, sum(a <= t < end for t in mine), max((t for t in mine if t < a), default=None), min((t for t in mine if t >= end), default=None)))
    assert {tuple(r) for r in got.select("host", "paused_us", "resumed_us", "inside", "before_us", "after_us").collect()} == want


def test_selected_ranks_are_those_of_a_sort(spark):
    rng = random.Random(2)
    rows = [(g, v) for g in ("a", "b", None, "c") for v in [rng.choice([rng.randrange(-50, 50), rng.randrange(2**20), rng.randrange(-(2**50), 2**50), None]) for _ in range(rng.randint(1, 120))]]
    rows += [("one", 7)] * 1000 + [("none", None)]
    got = {(r["g"], r["percent"]): r["v"] for r in reports.selected_ranks(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], "v", (1, 50, 95, 100)).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        mine = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, p): mine[-(-p * len(mine) // 100) - 1] for p in (1, 50, 95, 100) if mine}
    assert got == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_large_batches_move_only_their_ids(spark, tmp_path, monkeypatch, few):
    """Rows are written once where no id comes again; what is stored or comes again leaves, rows without an id are one, and the parents that repeats tell are kept."""
    monkeypatch.setattr(sinks, "FEW_IDS", 4)
    monkeypatch.setattr(sinks, "FEW_REPEATS", few)
    written, write = [], sinks._written
    monkeypatch.setattr(sinks, "_written", lambda spark, df, what: written.append(what) or write(spark, df, what))
    path, told = str(tmp_path / "spine"), random_events(60, 3)
    told = [(*e[:12], "log", k) for k, e in enumerate(told)]
    sinks.append_events(spark.createDataFrame(told[:30], SCHEMA).repartition(3), path, "a")
    assert "fresh" not in written
    later = [(*event(told[40][0], 5 * DAY, "a", parent="twice")[:12], "log", 99), (*event(told[2][0], 5 * DAY, "a", parent="stored")[:12], "log", 98)]
    nameless = [(*event(None, 5 * DAY, "b")[:12], "log", 200 + k) for k in range(3)]
    sinks.append_events(spark.createDataFrame(told[20:] + later + nameless, SCHEMA).repartition(3), path, "b")
    assert "fresh" in written
    rows = {r["id"]: (r["timestamp_us"], r["kind"], r["line_no"]) for r in spark.read.parquet(f"{path}/events").collect()}
    assert rows == {e[0]: (e[1], e[9], e[13]) for e in told} | {None: (5 * DAY, "prompt", 200)}
    assert spark.read.parquet(f"{path}/events").count() == 61
    assert [tuple(r) for r in spark.read.parquet(f"{path}/batches").orderBy("seq").select("offered", "added").collect()] == [(30, 30), (45, 31)]
    assert {"twice", "stored"} <= {r[0] for r in spark.read.parquet(f"{path}/repairs").select("parent_session_id").collect()}


def test_frames_arrive_in_files_of_all_cores(spark, tmp_path):
    from tracemill.plans import queries

    frames_ = queries._frames(queries.Views(spark, "/root/testdata/sf0.001"))
    half = queries._arrive(frames_, str(tmp_path / "in"))
    assert half == 2 * spark.sparkContext.defaultParallelism and len(list((tmp_path / "in").glob("*.json"))) == 2 * half
