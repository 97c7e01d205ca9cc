"""Session trees by labels against walks in Python; rollouts in segments against whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import repositories, rollouts, trees


def closure(parent, ids):
    found = set()
    for member in ids:
        at, seen = member, set()
        while at is not None and at not in seen:
            seen.add(at)
            found.add((at, member))
            at = parent.get(at)
    return found


def random_forest(seed):
    r = random.Random(seed)
    return [(i, r.randrange(max(0, i - 5), i)) for i in range(1, 60) if r.random() < 0.85]


CASES = [
    [(i, i - 1) for i in range(1, 40)],
    [(i, 0) for i in range(1, 30)],
    [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (7, 7), (9, 8), (8, 9), (10, 6)],
    random_forest(1),
    random_forest(2) + [(0, 3)],
]


@pytest.mark.parametrize("edges", CASES)
def test_labels_are_ranges(spark, edges):
    parent, ids = dict(edges), sorted({x for e in edges for x in e} | {99})
    rows = spark.createDataFrame([(i, parent.get(i)) for i in ids] + [(None, None)], "id long, parent_session_id long")
    labels = trees.tree_labels(rows, together=4).cache()
    want = closure(parent, ids)
    table = labels.collect()
    assert sorted(r["id"] for r in table) == ids
    assert {(a["id"], b["id"]) for a in table for b in table if a["tree"] == b["tree"] and a["low"] <= b["low"] <= a["high"]} == want
    pairs = [(r["root_id"], r["member_id"]) for r in trees.members(labels).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    for root in ids[:3]:
        assert {r["member_id"] for r in trees.below(labels, root).collect()} == {m for r, m in want if r == root}
    facts = spark.createDataFrame([(i, i * 10 + k, None) for i in ids for k in range(i % 3)], "session_id long, v long, none long")
    got = {r["root_id"]: (r["rows"], r["v"], r["none"]) for r in trees.tree_totals(facts, labels, ["v", "none"], block=3).collect()}
    below = {root: [m for r, m in want if r == root] for root in ids}
    assert got == {root: (sum(m % 3 for m in ms), sum(m * 10 + k for m in ms for k in range(m % 3)), 0) for root, ms in below.items()}
    assert repositories.in_tree(facts, labels).count() == sum(n for n, _, _ in got.values())
    labels.unpersist()


def test_empty_and_flat_tables(spark):
    empty = spark.createDataFrame([], "id string, parent_session_id string")
    assert trees.tree_labels(empty).count() == 0 and trees.members(trees.tree_labels(empty)).count() == 0
    flat = trees.tree_labels(spark.createDataFrame([("a", None), ("b", None), ("a", None)], "id string, parent_session_id string"))
    assert sorted(map(tuple, flat.collect())) == [("a", "a", -1, -1, 0), ("b", "b", -1, -1, 0)]


def test_a_long_chain_takes_a_row_a_session(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_session_id"))
    labels = trees.tree_labels(chain)
    assert labels.count() == n and labels.where("high <> -1 or low <> id - 100000 or depth <> id or tree <> 0").count() == 0
    facts = spark.range(n).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("v"))
    assert trees.tree_totals(facts, labels, ["v"]).where("v <> 100000 - root_id").count() == 0


def test_one_parent_of_very_many(spark):
    n = 20_000
    star = spark.range(n).select("id", F.when(F.col("id") > 0, F.lit(0).cast("long")).alias("parent_session_id"))
    labels = trees.tree_labels(star, together=1000)
    assert labels.where("id > 0 and (low <> high or depth <> 1 or tree <> 0)").count() == 0 and labels.select("low").distinct().count() == n


def test_a_rollout_over_many_segments(spark):
    r, told = random.Random(5), []
    for i in range(600):
        at = f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z"
        kind = r.choice(["session_meta", "turn_context", "exec", "exec", "done", "usage", "noise"])
        usage = {"input_tokens": i + 1, "total_tokens": i + 1}
        payload = {
            "session_meta": ("session_meta", {"id": f"s{i}", "cwd": f"/w{i}"}), "turn_context": ("turn_context", {"model": f"m{i}", "cwd": f"/t{i}"}),
            "exec": ("response_item", {"type": "custom_tool_call", "name": "exec", "call_id": f"c{i}", "input": 'tools.exec_command({"cmd":"ls"' + (f',"workdir":"/x{i}"' if i % 3 else "") + "})"}),
            "done": ("event_msg", {"type": "task_complete"}), "usage": ("event_msg", {"type": "token_count", "info": {"last_token_usage": usage, "total_token_usage": usage}}), "noise": ("event_msg", {"type": "other"}),
        }[kind]
        told.append((f"f{i % 2}", i // 2, json.dumps({"timestamp": at, "type": payload[0], "payload": payload[1]}), 0))
    lines = spark.createDataFrame(told, "file string, line_no long, value string, modified_us long").withColumn("modified_at", F.timestamp_micros("modified_us"))
    columns = ["id", "kind", "payload", "project_path", "external_session_id", "timestamp_us"]
    whole = sorted(map(str, rollouts._events(rollouts.rollout_context(lines, segment=1 << 40)).select(*columns).collect()))
    assert len(whole) > 300
    for segment in (1, 6, 50):
        assert sorted(map(str, rollouts._events(rollouts.rollout_context(lines, segment=segment)).select(*columns).collect())) == whole


def test_a_receipt_makes_its_labels_once(spark, monkeypatch):
    from tracemill.plans import tree_queries
    from tracemill.plans.views import Views

    made, looked, label, scan = [], [], trees.tree_labels, tree_queries.sensitivity.scan_commands
    monkeypatch.setattr(tree_queries.trees, "tree_labels", lambda *a: made.append(1) or label(*a))
    monkeypatch.setattr(tree_queries.sensitivity, "scan_commands", lambda commands: looked.append(commands) or scan(commands))
    v = Views(spark, "/root/testdata/sf0.01")
    rows = tree_queries.receipt_rows(v)
    assert made == [1] and looked[0].count() == rows.where("section = 'commands'").count() < v.commands.count()
