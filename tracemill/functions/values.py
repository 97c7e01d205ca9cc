"""Column functions: deterministic ids, timestamps, path predicates, text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of the deterministic ids.
NAMESPACE = "6167656e-7477-6174-6368-5f70726f6a73"

# Agent names people type, and the ids they stand for.
AGENT_ALIASES = {"claude": "claude-code", "copilot": "github-copilot"}


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def held(value, use) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it. Inside branches Spark would compute it each time."""
    return F.transform(F.array(_c(value)), use)[0]


def uuid5(name, namespace: str = NAMESPACE, hold: bool = True) -> Column:
    """UUID version 5 of a text, in lower case with hyphens; null for null. Its digest is named several times. It is held, so that branches do not compute it each time; a column of its
    own needs no ``hold``, as Spark computes the digest once there, and in generated code."""
    dash = F.lit("-")

    def shown(digest):
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(digest, 1, 8), dash, F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), dash, variant, F.substring(digest, 18, 3), dash, F.substring(digest, 21, 12))

    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), _c(name).cast("string").cast("binary")))
    return held(digest, shown) if hold else shown(digest)


def event_id(agent, key) -> Column:
    # Held, which also keeps the wide projections of events out of one generated method that would be too long to be compiled.
    return uuid5(F.concat(_c(agent), F.lit("\x1f"), _c(key)))


def session_id(agent, external) -> Column:
    return uuid5(F.concat(_c(agent), F.lit("\x1f"), _c(external)), hold=False)


def project_id(path) -> Column:
    return uuid5(path, hold=False)


def rfc3339_to_us(text) -> Column:
    """Microseconds since the epoch; null where the text is no timestamp."""
    return F.unix_micros(F.try_to_timestamp(_c(text)))


def us_to_rfc3339(us) -> Column:
    return F.date_format(F.timestamp_micros(_c(us)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def under_path(column, prefix: str) -> Column:
    """Equal to the prefix or below it at a ``/``. Below is told without regard to ASCII case, equal is not; no character is a wildcard."""
    base = prefix.rstrip("/") or "/"
    if base == "/":
        return F.coalesce(_c(column).startswith("/"), F.lit(False))
    lower = F.translate(_c(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = "".join(c.lower() if c.isascii() else c for c in base)
    return F.coalesce((_c(column) == base) | lower.startswith(wanted + "/"), F.lit(False))


def share(part, whole) -> Column:
    """part * 100 / whole, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(_c(part) * 100.0, _c(whole)), F.lit(0.0))


def confidence(column) -> Column:
    return F.least(F.greatest(_c(column).cast("double"), F.lit(0.0)), F.lit(1.0))


def display_name(path) -> Column:
    """The last segment of a path."""
    trimmed = F.regexp_replace(_c(path), "/+$", "")
    return F.when(trimmed == "", _c(path)).otherwise(F.element_at(F.split(trimmed, "/"), -1))


def short_path(path, home: str) -> Column:
    """The path with ``~`` for the home folder it starts with."""
    if not home:
        return _c(path)
    return F.when(_c(path).startswith(home), F.concat(F.lit("~"), F.substring(_c(path), F.lit(len(home) + 1), F.length(_c(path))))).otherwise(_c(path))


def transcript_path(project_path, session) -> Column:
    return F.concat(F.translate(_c(project_path), "/", "-"), F.lit("/"), _c(session), F.lit(".jsonl"))


def duration(ms) -> Column:
    """Under a second in ms, under a minute in seconds with one decimal, else minutes and seconds; a dash if unknown. Halves of a tenth go up."""
    x = _c(ms).cast("long")
    tenths = F.floor((x + 50) / 100)
    return (
        F.when(x.isNull(), F.lit("\u2014"))
        .when(x < 1000, F.concat(x.cast("string"), F.lit("ms")))
        .when(x < 60_000, F.format_string("%d.%ds", F.floor(tenths / 10), tenths % 10))
        .otherwise(F.format_string("%dm%02ds", F.floor(x / 60_000), F.floor(x / 1000) % 60))
    )


def session_duration(ms) -> Column:
    """Seconds, or minutes and seconds, or hours and minutes; a dash if unknown."""
    x = F.floor(_c(ms).cast("long") / 1000)
    return (
        F.when(x.isNull(), F.lit("\u2014"))
        .when(x < 60, F.format_string("%ds", x))
        .when(x < 3600, F.format_string("%dm %ds", F.floor(x / 60), x % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(x / 3600), F.floor(x / 60) % 60))
    )


def thousands(number) -> Column:
    return F.format_number(_c(number).cast("long"), 0)


def compact(number) -> Column:
    """One decimal with K, M, B or T; a value that rounds to the next letter's 1.0 takes that letter."""
    x = F.abs(_c(number).cast("double"))
    out = F.format_string("%d", x.cast("long"))
    for letter, unit in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        out = F.when(x / unit >= 0.9995, F.format_string(f"%.1f{letter}", x / unit)).otherwise(out)
    return F.concat(F.when(_c(number) < 0, "-").otherwise(""), out)


# What is shown for these kinds of events, and for a change of the configuration by whether the hooks are there.
SENTENCES = {"collection.paused": "collection PAUSED by the user", "collection.resumed": "collection resumed"}
HOOKS_SHOWN = {"true": "hooks present", "false": "OUR HOOKS REMOVED \u2014 collection stopped"}
CHANGED = "changed"


def event_detail(kind, payload, home: str = "") -> Column:
    """One line on an event; empty where the payload says nothing or is no JSON."""
    k = _c(kind)
    get = lambda name: F.coalesce(F.get_json_object(_c(payload), "$." + name), F.lit(""))
    state = F.lit(CHANGED)
    for value, shown in HOOKS_SHOWN.items():
        state = F.when(get("hooks_present") == value, shown).otherwise(state)
    text = (
        F.when(k.isin("file.read", "file.write"), get("path"))
        .when(k == "command", get("command"))
        .when(k == "tool.call", get("tool"))
        .when(k == "unknown", get("label"))
        .when(k == "prompt", F.concat(get("char_count"), F.lit(" chars")))
        .when(k == "mcp.call", F.concat(get("server"), F.lit("."), get("tool")))
        .when(k == "config.changed", F.concat(state, F.lit("  "), short_path(get("path"), home)))
    )
    for name, sentence in SENTENCES.items():
        text = text.when(k == name, sentence)
    return F.when(F.try_parse_json(_c(payload)).isNull(), "").otherwise(F.coalesce(text, F.lit("")))
