"""Hiding credentials in commands and urls. Column expressions only, linear in the text; applying them again changes nothing."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import _c, held

MARK, CUSTOM_MARK = "[REDACTED]", "[REDACTED: custom]"
HEADER_MARK = "[REDACTED: credential header]"

# Names of secrets, the ends of such names, and the shapes of tokens and well-known keys.
SECRET_NAMES = ("authorization", "auth", "password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
SECRET_ENDS = ("_token", "_secret", "_password", "_passwd", "_pwd", "_api_key", "_access_key", "_secret_key", "_private_key")
BEARER = r"(?i)\bbearer[ \t]+[A-Za-z0-9._~+/=-]{8,}"
QUERY_SECRET = r"""(?i)([?&](?:[A-Za-z0-9_-]+[_-])?(?:token|secret|password|passwd|api[_-]?key|authorization)=)[^&#\s'"]+"""
KEY_SHAPES = r"(?i)\b(?:sk-(?:proj-|ant-api[0-9]{2}-)?[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,})"
MAX_PATTERNS, MAX_PATTERN_BYTES = 100, 1024


def _name() -> str:
    """A word that names a secret: quotes about it and hyphens before it do not count, a hyphen in it is an underscore."""
    either = lambda names: "|".join(n.replace("_", "[-_]") for n in names)
    return rf"""["']*-*(?:{either(SECRET_NAMES)}|[A-Za-z0-9_-]*(?:{either(SECRET_ENDS)}))["']*"""


# A value: from an opened quote to the first word that ends with it, or to the end; or else one word.
_VALUE = r"""(?:(["'])(?![^ ]*\3(?![^ ]))(?:[^ ]* .*?\3(?![^ ])|.*$)|[^ ]*)"""
_ASSIGNED = rf"(?i)(?<![^ ])({_name()})([ =]){_VALUE}"


def _structural(text: Column) -> Column:
    """Hides the value after the name of a secret, whether it is the next word or stands after an equals sign. Matches are
    taken from left to right, so a value is never read as a name. Then the passwords and queries of urls."""
    spaced = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))

    def url(word):
        safe = F.regexp_replace(word, r"^(.*?://[^/?#:]*:)[^/?#]*(@[^/?#@]*)(?=[/?#]|$)", r"$1\[REDACTED\]$2")
        return F.when(word.contains("://"), F.regexp_replace(safe, QUERY_SECRET, r"$1\[REDACTED\]")).otherwise(word)

    urls = lambda hidden: F.when(hidden.contains("://"), F.array_join(F.transform(F.split(hidden, " "), url), " ")).otherwise(hidden)
    return held(F.regexp_replace(spaced, _ASSIGNED, r"$1$2\[REDACTED\]"), urls)


def redact_builtin(column) -> Column:
    return held(_c(column), _builtin)


def _builtin(text: Column) -> Column:
    lower = F.lower(text)
    hidden = F.regexp_replace(_structural(text), BEARER, r"Bearer \[REDACTED\]")
    hidden = F.regexp_replace(hidden, KEY_SHAPES, r"\[REDACTED\]")
    header = lower.contains("authorization:") | lower.contains("x-api-key:")
    return F.when(text.isNull(), F.lit(None)).when(header, F.lit(HEADER_MARK)).otherwise(hidden)


def compile_patterns(text: str) -> list[str]:
    """One Java regular expression a line; blank lines and lines that start with # are ignored. A bad one fails them all: each is tried once by Spark, which will use it."""
    found = [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    for p in found:
        if len(p.encode()) > MAX_PATTERN_BYTES:
            raise ValueError("a pattern is too long")
        try:
            empty = SparkSession.builder.getOrCreate().range(1).select(F.lit("").rlike(p)).first()[0]
        except PySparkException as e:
            raise ValueError(f"the pattern {p!r} is no Java regular expression") from e
        if empty:
            raise ValueError(f"the pattern {p!r} matches an empty text")
    return found


def redact_custom(column, patterns) -> Column:
    """Applies the patterns outside the marks that are there already."""
    text = _c(column)
    if not patterns:
        return text
    marks = r"\[REDACTED[^\]]*\]"

    def clean(piece):
        for p in patterns:
            piece = F.regexp_replace(piece, p, r"\[REDACTED: custom\]")
        return piece

    def apart(text):
        between = F.transform(F.split(text, marks), clean)
        return F.array_join(F.zip_with(between, F.regexp_extract_all(text, F.lit(marks), F.lit(0)), lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")

    return held(text, apart)


def redacted(column, patterns=()) -> Column:
    return redact_custom(redact_builtin(column), patterns)


def redact_commands(df: DataFrame, column: str = "command", patterns=()) -> DataFrame:
    return df.withColumn(column, redacted(column, patterns))


def scrub(events: DataFrame, commands: DataFrame, patterns=(), dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Redacts stored commands and the command in their event's payload: (events, commands, report). A second pass changes nothing."""
    told = F.get_json_object("payload", "$.command")
    fixed = F.when((F.col("kind") == "command") & told.isNotNull(), F.to_json(F.map_concat(F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: k != "command"), F.create_map(F.lit("command"), redacted(told, patterns))))).otherwise(F.col("payload"))
    new_events = events.withColumn("_told", F.when((F.col("kind") == "command") & told.isNotNull(), redacted(told, patterns) != told)).withColumn("payload", F.when(F.col("_told"), fixed).otherwise(F.col("payload")))
    new_commands = commands.withColumn("_old", F.col("command")).withColumn("command", redacted("command", patterns))
    hit = new_commands.select("id", (~F.col("_old").eqNullSafe(F.col("command"))).alias("own")).join(new_events.select("id", "_told"), "id", "left")
    report = hit.agg(F.count("*").alias("scanned"), F.count_if(F.col("own") | F.coalesce("_told", F.lit(False))).alias("changed"), F.lit(len(patterns)).alias("patterns"))
    if dry_run:
        return events, commands, report
    return new_events.drop("_told"), new_commands.drop("_old"), report
