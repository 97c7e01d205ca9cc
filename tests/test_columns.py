"""Column functions on tables of cases."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracemill.functions import redact, sensitivity, values
from tracemill.operators import changes


def column(spark, rows, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").select("i", f("x").alias("y")).orderBy("i").select("y").collect()]


def test_patterns_are_java(spark):
    assert redact.compile_patterns("(?<word>secret)[0-9]+\n\\p{Lu}{3}") == ["(?<word>secret)[0-9]+", "\\p{Lu}{3}"]
    assert column(spark, ["a secret12 b"], lambda c: redact.redact_custom(c, ["(?<word>secret)[0-9]+"])) == ["a [REDACTED: custom] b"]
    for bad in ("(?P<word>x)", "[a", "x*", "(a|)"):
        with pytest.raises(ValueError, match="pattern"):
            redact.compile_patterns(bad)


def test_ids_are_uuid5(spark):
    texts = ["/work/a", "", "é\u2603", "x" * 500]
    assert column(spark, texts, values.project_id) == [str(uuid.uuid5(uuid.UUID(values.NAMESPACE), t)) for t in texts]
    assert column(spark, ["k"], lambda c: values.event_id(F.lit("codex"), F.col(c))) == [str(uuid.uuid5(uuid.UUID(values.NAMESPACE), "codex\x1fk"))]


PATHS = {
    "": "normal", "/": "normal", "src/main.rs": "normal", "/home/a/.ssh/config": "highly_sensitive", "/home/a/.SSH/config": "normal", "C:\\Users\\a\\.aws\\credentials": "highly_sensitive", "/x/ID_RSA": "highly_sensitive",
    "/x/cert.PEM": "highly_sensitive", "/x/.env": "sensitive", "/x/.env.local": "sensitive", "/x/.environment": "normal", "secrets.yaml": "sensitive", "/x/Credentials.json": "sensitive", "/a/.kube/config": "sensitive", "/a/gcloud/x": "sensitive", ".ssh": "normal", "key": "normal",
}


def ruled(path):
    """The rule of path sensitivity, step by step."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if not parts:
        return "normal"
    name, folders = parts[-1], parts[:-1]
    low, extension = name.lower(), name.rpartition(".")[2].lower() if "." in name else ""
    if low in sensitivity.KEY_NAMES or extension in sensitivity.KEY_EXTENSIONS or set(folders) & set(sensitivity.KEY_FOLDERS):
        return "highly_sensitive"
    return "sensitive" if low in sensitivity.SECRET_NAMES or low.startswith(sensitivity.SECRET_PREFIXES) or set(folders) & set(sensitivity.SECRET_FOLDERS) else "normal"


def ruled_words(command):
    """The words of a command that look like sensitive paths, letter by letter."""
    words, word, quote, begun = [], "", None, False
    for c in command + "\n":
        if quote:
            quote, word = (None, word) if c == quote else (quote, word + c)
            if quote is None:
                continue
        elif c in "\"'":
            quote, begun = c, True
        elif c in " \t\n|;&":
            words, word, begun = words + [word], "", False
        else:
            word += c
    words.append(word.removesuffix("\n") if quote else word)
    found = []
    for w in words:
        w = w.strip("\"'(),")
        if w and not w.startswith("-") and ("/" in w or "." in w) and ruled(w) != "normal" and (w, ruled(w)) not in found:
            found.append((w, ruled(w)))
    return found


def test_path_rule_at_random(spark):
    rng = random.Random(7)
    pieces = [".env", ".ssh", ".kube", "id_rsa", "ID_RSA", "a.pem", "Credentials", "secrets", "x", ".", "/", "//", "\\", "\n", " ", "key", ".git-credentials", "gcloud", ".env.", "`"]
    paths = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(3000)] + [f"{p}\n" for p in pieces]
    assert column(spark, paths, sensitivity.classify_path) == [ruled(p) for p in paths]


def test_command_rule_at_random(spark):
    rng = random.Random(8)
    pieces = ["cat", " ", " ", "\t", "|", ";", "&", '"', "'", "`", "(", ")", ",", ".env", "/.ssh/x", "a.pem", "-", "x", "/", ".env.local", "\n"]
    commands = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    got = [[tuple(w) for w in r] for r in column(spark, commands, sensitivity.named_paths)]
    assert got == [ruled_words(c) for c in commands]


def test_path_sensitivity(spark):
    assert column(spark, list(PATHS), sensitivity.classify_path) == list(PATHS.values())


COMMANDS = {
    "less conf/.env": ["conf/.env"], "tar czf k.tgz ~/.aws/config.d | wc -c": ["~/.aws/config.d"], "scp '/srv/keys/id_rsa' host:": ["/srv/keys/id_rsa"], "cd x; vi .env.test || true": [".env.test"], "make -j8 all": [],
    "python tools/report.py": [], "du -h --max-depth=1": [], "cmp .env .env": [".env"], 'head "/mnt/old disk/.ssh/known_hosts"': ["/mnt/old disk/.ssh/known_hosts"], "": [], 'x a"b/.env"c': [],
}


def test_paths_named_by_commands(spark):
    found = column(spark, list(COMMANDS), lambda c: F.transform(sensitivity.named_paths(c), lambda s: s["path"]))
    assert found == list(COMMANDS.values())
    assert column(spark, ["grep k .env.prod ~/.aws/credentials", "source .env", "ninja -C out", "", None], sensitivity.worst_in_command) == ["highly_sensitive", "sensitive", "normal", "normal", "normal"]


REDACTED = {
    "DEPLOY_TOKEN=t-123 rsync --password p4ss mysql://root:pw@host/shop": "DEPLOY_TOKEN=[REDACTED] rsync --password [REDACTED] mysql://root:[REDACTED]@host/shop",
    "curl -H 'X-Api-Key: k-77' https://shop.example/cart": "[REDACTED: credential header]",
    "wget 'https://shop.example/feed?api_key=k-78&page=2'": "wget 'https://shop.example/feed?api_key=[REDACTED]&page=2'",
    "APP_SECRET=one SMTP_PASSWORD=two ./start": "APP_SECRET=[REDACTED] SMTP_PASSWORD=[REDACTED] ./start",
    "LOGIN_PASSWORD='three small words' npm test": "LOGIN_PASSWORD=[REDACTED] npm test",
    "go    vet   ./...": "go vet ./...",
    "run 'password' x token": "run 'password' [REDACTED] token",
}


def test_redaction(spark):
    assert column(spark, list(REDACTED), redact.redacted) == list(REDACTED.values())
    assert column(spark, [None], redact.redacted) == [None]


def test_custom_patterns_leave_marks_alone(spark):
    pattern = redact.compile_patterns("# names\n\n[A-Z]{4,}\n")
    once = column(spark, ["print HIDDEN TOKEN=t-9"], lambda c: redact.redacted(c, pattern))
    assert once == ["print [REDACTED: custom] [REDACTED: custom]=[REDACTED]"]
    assert column(spark, once, lambda c: redact.redacted(c, pattern)) == once
    for bad in (".*", "(", "x" * 2000, "\n".join("ab"[i % 2] * (i + 1) for i in range(101))):
        with pytest.raises(Exception):
            redact.compile_patterns(bad)


def test_formats(spark):
    assert column(spark, [None, 0, 999, 1000, 59_949, 60_000, 61_500], values.duration, "long") == ["—", "0ms", "999ms", "1.0s", "59.9s", "1m00s", "1m01s"]
    assert column(spark, [None, 59_000, 61_000, 3_661_000], values.session_duration, "long") == ["—", "59s", "1m 1s", "1h 1m"]
    assert column(spark, [0, 999, 1000, 999_499, 999_500, 999_999, 6_006_377_004, -1500, 2 * 10**12], values.compact, "long") == ["0", "999", "1.0K", "999.5K", "1.0M", "1.0M", "6.0B", "-1.5K", "2.0T"]
    assert column(spark, [1234567, -1000, 5], values.thousands, "long") == ["1,234,567", "-1,000", "5"]
    assert column(spark, ["/home/a/x", "/home/a", "/srv"], lambda c: values.short_path(c, "/home/a")) == ["~/x", "~", "/srv"]
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00.5+02:00", "junk", None], values.rfc3339_to_us) == [1704067200000000, 1704067200500000, None, None]


def test_path_prefixes_have_no_wildcards(spark):
    paths = ["/work/app_1", "/work/app_1/x", "/work/appX1", "/work/app_10", "/WORK/APP_1/x", "/WORK/app_1", "/work/app%1/y", None]
    assert column(spark, paths, lambda c: values.under_path(c, "/work/app_1/")) == [True, True, False, False, True, False, False, False]
    assert column(spark, paths, lambda c: values.under_path(c, "/work/app%1")) == [False] * 6 + [True, False]
    assert column(spark, ["/x", "y"], lambda c: values.under_path(c, "/")) == [True, False]


def test_event_details(spark):
    rows = [("command", '{"command":"ls"}', "ls"), ("prompt", '{"char_count":5}', "5 chars"), ("mcp.call", '{"server":"a","tool":"b"}', "a.b"), ("command", "{broken", ""), ("queue", "{}", ""), ("config.changed", '{"hooks_present":false,"path":"/h/x"}', "OUR HOOKS REMOVED — collection stopped  ~/x")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, p string, want string").select("want", values.event_detail("k", "p", "/h").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_fingerprints_ignore_key_order(spark):
    rows = [('{"b":1,"a":{"d":[2,1],"c":null}}',), ('{"a": {"c": null, "d": [2, 1]}, "b": 1}',), ('{"a":{"c":null,"d":[1,2]},"b":1}',), (None,), ("broken",)]
    got = changes.config_fingerprint(spark.createDataFrame(rows, "hooks_json string")).select("fingerprint", "hooks_present").collect()
    assert got[0] == got[1] != got[2] and got[3] == got[4] and [r[1] for r in got] == [True, True, True, False, False]


def test_redaction_and_ids_compute_what_they_share_once(spark):
    frame = spark.range(1).select(F.concat(F.lit("run --token "), "id").alias("c"))
    plan = frame.select(redact.redacted("c", ["ACME-[A-Z0-9]{8}"]).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(redact.BEARER) == 1 and plan.count("(?U)\\s+") == 1
    assert frame.select(values.uuid5("c").alias("u"))._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1


def test_sessions_and_projects_have_ids_in_generated_code(spark):
    """As columns of their own they need no lambda, which Spark interprets row by row; the ids are those of a held digest."""
    from tracemill.functions import values

    frame = spark.createDataFrame([("claude-code", "s1", "/w"), ("codex", None, None)], "a string, s string, p string")
    ids = frame.select(values.session_id("a", "s").alias("s"), values.project_id("p").alias("p"))
    assert "lambda" not in ids._jdf.queryExecution().optimizedPlan().toString()
    held = frame.select(values.uuid5(F.concat("a", F.lit("\x1f"), "s")).alias("s"), values.uuid5("p").alias("p"))
    want = str(uuid.uuid5(uuid.UUID(values.NAMESPACE), "claude-code\x1fs1")), str(uuid.uuid5(uuid.UUID(values.NAMESPACE), "/w"))
    assert [tuple(r) for r in ids.collect()] == [tuple(r) for r in held.collect()] == [want, (None, None)]
