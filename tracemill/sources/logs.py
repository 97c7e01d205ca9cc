"""Log files and hook frames as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linefiles import BLOCK, count_blocks, reachable, read_blocks
from .scratch import scratch

HOOK_SCHEMA = (
    "v int, source string, sent_at bigint, hook_version string, payload struct<hook_event_name:string, session_id:string, transcript_path:string, cwd:string, tool_name:string,"
    " tool_input:struct<file_path:string, notebook_path:string, command:string, description:string>, tool_use_id:string, prompt:string, source:string, reason:string, message:string, trigger:string>"
)
#: Fixed value: the hook sources known.
HOOK_SOURCES = ("claude-code", "codex", "github-copilot")
TABLES = ("events", "token_usage", "file_events", "command_events", "command_path_references", "mcp_events", "tool_outcomes", "projects", "repositories", "sessions", "session_projects", "config_snapshots")


#: Rows of a table that is broadcast at most.
FEW = 100_000


def _reader(spark: SparkSession, pattern: str, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def log_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """(path, file, size, modified) of every file of that name below ``root``, from its listing alone; ``file`` is the path as a URI."""
    found = _reader(spark, pattern, modified_after).format("binaryFile").load(root)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_jsonl_lines(
    spark: SparkSession,
    root: str,
    limit_files: int | None = None,
    modified_after: str | None = None,
    pattern: str = "*.jsonl",
    only: DataFrame | None = None,
    block: int = BLOCK,
    files: DataFrame | None = None,
) -> DataFrame:
    """(file, line_no, value, modified) of every file of that name below ``root``; lines are numbered from 0 in file order. Only the first
    ``limit_files`` in path order, and only those whose paths ``only`` holds in its column file, if given. ``files`` is a listing that ``log_files`` gave and that is stored, so that none is made anew.

    Files are listed once, with their sizes; what is appended later is not read. A first pass counts the lines of each block of bytes of the files that have several, and a row a
    block, with the number of lines before it, is written. The lines are read from these rows, so a large file is many tasks, no text is moved or joined, and no
    setting changes what a block holds. A task reads some ``block`` bytes: one block of a large file, or many small files. Where tasks cannot open the files by position (a store that only Spark reaches), Spark's own reader writes the lines once with their
    block and place, and they are numbered from that table."""
    if files is None or only is not None or limit_files is not None:
        found = log_files(spark, root, pattern, modified_after) if files is None else files
        if only is not None:
            found = found.join(only.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
        if limit_files is not None:
            found = found.orderBy("file").limit(limit_files)
        files = spark.read.schema(found.schema).parquet(_written(spark, found, "files"))
    some = files.select("path").first()
    if some is not None and not reachable(some[0]):
        return _through_spark(_reader(spark, pattern, modified_after), root, files)
    begin = F.col("block") * F.lit(block)
    blocks = files.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(block)))))
    blocks = blocks.select("path", "file", "size", "modified", begin.alias("begin"), F.least(begin + F.lit(block), F.col("size")).alias("end"))
    cores = 4 * spark.sparkContext.defaultParallelism
    counted = blocks.where(F.col("size") > block).repartition(cores).mapInArrow(count_blocks, "path string, file string, size long, modified timestamp, begin long, end long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = counted.withColumn("before", before).where("n > 0").drop("n")
    single = blocks.where(F.col("size") <= block).withColumn("before", F.lit(0).cast("long"))
    rows = spark.read.parquet(_written(spark, several.unionByName(single), "blocks"))
    told = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("bytes")).first()
    return rows.repartition(read_tasks(told["rows"], told["bytes"], block, cores)).mapInArrow(read_blocks, "file string, line_no long, value string, modified timestamp")


def read_tasks(rows: int, size: int, block: int, cores: int) -> int:
    """How many tasks read so many blocks of so many bytes together: one a block's bytes, a few a core where there is less, and at most one a row."""
    return max(1, min(rows, max(cores, -(-size // block)), 100_000))


def _written(spark: SparkSession, df: DataFrame, what: str) -> str:
    where = scratch(spark, what)
    df.write.parquet(where)
    return where


def _through_spark(reader, root: str, files: DataFrame) -> DataFrame:
    """The lines as Spark's reader cuts them, written once, since another scan may cut the files elsewhere."""
    spark = files.sparkSession
    meta = {"file": "file_path", "_block": "file_block_start", "modified": "file_modification_time"}
    lines = reader.format("text").load(root).select("value", *[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()], F.monotonically_increasing_id().alias("_at"))
    lines = spark.read.parquet(_written(spark, lines.join(files.select("file"), "file", "left_semi"), "lines"))
    counted = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = spark.read.parquet(_written(spark, counted.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "blocks"))
    blocks = F.broadcast(blocks) if blocks.count() <= FEW else blocks
    number = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long")
    return lines.join(blocks, ["file", "_block"]).select("file", number.alias("line_no"), "value", "modified")


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good has the parsed record in ``r``; blank lines are in neither."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    some = lines.where(F.trim("value") != "")
    parsed = some.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("r")


def read_hook_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Frames of version 1 from known sources. ``rejected_envelopes`` gives the others."""
    reader = (spark.readStream if streaming else spark.read).schema(HOOK_SCHEMA)
    return accepted_envelopes(reader.json(path))


def accepted_envelopes(frames: DataFrame) -> DataFrame:
    return frames.where((F.col("v") == 1) & F.col("source").isin(*HOOK_SOURCES))


def rejected_envelopes(frames: DataFrame) -> DataFrame:
    return frames.where(~F.coalesce((F.col("v") == 1) & F.col("source").isin(*HOOK_SOURCES), F.lit(False)))


def load_tables(spark: SparkSession, folder: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def import_report(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Files, lines, usage records, responses, events, and the inflation: records a response, 1.0 without any."""
    usage = events.where("kind = 'token.usage'")
    none = F.lit(None).cast("string")
    rows = lines.select("file", none.alias("response"), F.lit("line").alias("what")).unionByName(usage.select(none.alias("file"), F.concat("agent_id", F.lit("\x1f"), "request_id").alias("response"), F.lit("usage").alias("what")))
    out = rows.agg(F.count_distinct("file").alias("files"), F.count_if(F.col("what") == "line").alias("lines"), F.count_if(F.col("what") == "usage").alias("usage_records"), F.count_distinct("response").alias("responses"))
    return out.withColumn("inflation", F.coalesce(F.try_divide("usage_records", "responses"), F.lit(1.0)))
