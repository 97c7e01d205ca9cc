"""What the corpus operators share: the shared scratch folder, kept tables, connected components, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of labelled texts a label that a classifier is fitted on at most.
LEARN_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder and a
    cluster a folder under its warehouse, which all its machines share.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(context, "_tracemill_folder", None)
    if not folder:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="spark-tracemill-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context._tracemill_folder = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: A query's shuffle files go when it ends. What follows reads the table written, so they are of no more use.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The databases of the open blocks of ``temporary``. What ``keep`` writes is no table of theirs, as that takes the driver twice the queries, but lies in their folder, which goes with them.
_open: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``keep`` and ``passing`` write in this block are deleted together at its end, but for ``lasting`` ones. What is returned from it may not read the others."""
    base = _database(spark, uuid.uuid4().hex)
    _open.append(base)
    try:
        yield
    finally:
        _open.remove(base)
        spark.sql(f"DROP DATABASE IF EXISTS {base} CASCADE")


def _database(spark: SparkSession, *name: str) -> str:
    base = "_".join(["tracemill", re.sub(r"\W", "_", spark.sparkContext.applicationId), *name])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{shared_folder(spark)}/{base}'")
    return base


def keep(df: DataFrame, what: str, counted: bool = False, lasting: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a scan of it, so that later jobs neither
    recompute it nor depend on an executor that may be lost. Turns ``CLEANUP`` on for the session. With ``counted`` the rows
    are counted as they are written, for ``by_size``. In a block of ``temporary`` it is deleted at the end, unless it is ``lasting``."""
    spark = df.sparkSession
    seen = Observation() if counted else None
    rows = df.observe(seen, F.count("*").alias("rows")) if counted else df
    folder = "/".join([shared_folder(spark), *([] if lasting else _open[-1:])])
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    rows.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if counted:
        out._tracemill_rows = seen.get["rows"]
    return out


def keep_counted(df: DataFrame, what: str) -> DataFrame:
    return keep(df, what, counted=True)


def passing(df: DataFrame, what: str) -> DataFrame:
    """As ``keep``, for a large table that ``discard`` deletes once what is made of it has been written. It is a table of a
    database in the shared folder, so that plain SQL can drop it."""
    spark = df.sparkSession
    base = _open[-1] if _open else _database(spark)
    name = f"{base}.{re.sub(r'[^A-Za-z0-9]', '_', what)}_{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    df.write.format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._tracemill_table = name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``passing`` wrote; others are left alone, and so are those that are gone."""
    for table_ in tables:
        if name := getattr(table_, "_tracemill_table", None):
            table_.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def spread(scan: DataFrame) -> DataFrame:
    """For costly work on the rows of a table just read: a small one is dealt out evenly over the cluster's cores.

    A scan of about as many splits as there are cores was cut to serve them, below the size that files allow; such splits need not hold rows, since those of a row
    group are read together. Where there are more, the splits have their full size, and the table stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


def checkpoint(df: DataFrame) -> DataFrame:
    """For the small tables of loops: a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, measure: Column) -> tuple[DataFrame, int]:
    """As ``checkpoint``, with an aggregate of the rows that is taken as they are written, without a query of its own; 0 where there are none."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.coalesce(measure, F.lit(0)).alias("value")))
    return out, seen.get["value"]


#: Rows of a small table that is broadcast at most.
BROADCAST_ROWS = 100_000
#: The same where rows are two hashes and the other side is texts, which otherwise are shuffled whole.
HASH_ROWS = 500_000


def by_size(small: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """A kept or checkpointed table, marked for broadcast if it has at most ``rows`` rows; a larger one is joined as Spark sees fit,
    by a shuffle whose skewed parts it can split. ``known`` is its number of rows, where that has been counted."""
    known = getattr(small, "_tracemill_rows", known)
    return F.broadcast(small) if (small.count() if known is None else known) <= rows else small


def uniform(*columns, salt: int = 0):
    """A number in [0, 1) that depends only on the columns' values."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 50)) / F.lit(float(1 << 50))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (node, root); root is the smallest node reachable.

    Alternates the large-star and small-star steps. Each is one aggregation, combined before the
    shuffle, and one equi-join whose long side adaptive execution may split, so a hub with very many
    neighbours meets no single task; no row holds a neighbour list. Nodes without an edge are absent;
    self-edges, repeated edges and nulls do no harm. An empty input gives an empty result.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    pairs = checkpoint(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(pairs):
        # Large star: every larger neighbour of u is hung on the smallest of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are hung on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether every u of the distinct pairs (u, v), v < u, has one v, which is nobody's u: then v is the smallest node reachable."""
    roles = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    return roles.groupBy("node").agg(F.sum("below").alias("k"), F.min("below").alias("least")).where("k > 1 or k = 1 and least = 0").isEmpty()


def fold(column, parts: int):
    """crc32 of a value as text, modulo ``parts``; null for a null."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, group: str, bound: int, *key: str, salt: int = 3) -> DataFrame:
    """About ``bound`` of the rows of each value of ``group`` that differ in ``key``, or all of them: those whose hash falls under the group's share. Rows equal in
    group and key count once, so a group that has rows is never left without.

    The counts, a row a value, are broadcast if they are few; the choice depends on the keys alone, not on the order of rows."""
    draw = F.xxhash64(F.lit(salt), *key)
    counts = checkpoint(rows.groupBy(group).agg(F.count_distinct(draw).alias("_n")).withColumnRenamed(group, "_g"))
    drawn = rows.join(by_size(counts), F.col(group) == F.col("_g")).where(uniform(*[F.col(k) for k in key], salt=salt) * F.col("_n") < bound)
    return drawn.withColumn("_draw", draw).dropDuplicates([group, "_draw"]).drop("_g", "_n", "_draw")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int = 5, id_col="doc_id", text_col="text", most_bytes: int = LEARN_BYTES) -> list[tuple[int, str, int]]:
    """(id, text, label), sorted, of about ``bound`` labelled documents a label outside the held-out fold, for fitting.

    The ids are few and bounded, so they are broadcast to the documents and no text is shuffled. Where an id has
    several labels the largest counts; where it has several texts, the one with the least hash. Of each label whole texts are taken in an order that the ids' hashes give,
    as long as they have ``most_bytes`` together; one that does not fit is passed over, and so is always one that is longer than that. The driver gets a row of numbers an id, and then the texts that fit."""
    usable = labels.where((fold(F.col(id_col), parts) != 0) & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    chosen = checkpoint(bounded_sample(usable, "_label", bound, id_col).select(F.col(id_col).alias("_id"), "_label"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    sizes = found.groupBy("_doc", "_label").agg(F.min(F.struct("_hash", size.alias("n"))).alias("one")).select("_doc", "_label", "one._hash", "one.n").collect()
    fits, used = [], Counter()
    for i, value, h, n in sorted(sizes, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
        if used[value] + n <= most_bytes:
            used[value] += n
            fits.append((i, h))
    wanted = docs.sparkSession.createDataFrame(fits, f"_id {chosen.schema['_id'].dataType.simpleString()}, _one long")
    held = found.drop("_id").join(F.broadcast(wanted), (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_one")))
    rows = held.groupBy("_doc", "_label").agg(F.min("_text").alias("_text")).collect()
    return sorted((r["_doc"], r["_text"] or "", int(r["_label"])) for r in rows)
