"""Sharding by a k-d tree, with DataFrame operations only.

Starting from all rows, a node that is to hold k shards is cut along its widest metadata dimension at the
weighted quantile floor(k/2)/k of its bytes, until every leaf holds one shard. The quantile is found in
three distributed histogram passes of ``BINS`` bins over the order of the dimension, told apart to a 16-millionth of the node's range however
skewed it is, then of the texts' checksums where it ties, and of the ids where texts tie, so that a group of equal texts stays together unless the cut falls
inside it, and a group of any size can be cut.

A node is its first shard and its number of shards, so a leaf needs no table. The nodes of a level are cut all at once; their cuts, a row a node, are
computed in Spark and never collected. All levels see slim rows, which are written once a level, so every level's plan is as short as the first.

Nulls: a null text has no bytes, a null dimension counts as the smallest value. Repeated rows (equal in
id and text) share a place in every order, and go to one shard, unless they weigh more than a ``SLIGHT``-th of a mean shard: then each has
a place of its own among those of its text, so that cuts fall between them. More shards than rows leave shards
empty. An empty table gives an empty result. Other columns stay in ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, discard, keep, measured, passing, uniform

#: A row's place has 24 bits of the dimension, 12 of the checksum and 12 of the id; a histogram pass tells ``BITS`` of them apart.
TIE = 1 << 12
BITS, PASSES = 16, 3
BINS = 1 << BITS
#: Rows in one sorting group of a shard, as a mean.
ROWS_A_BUCKET = 20_000
#: Rows equal in id and text that weigh more than this part of a mean shard are told apart; there are at most SLIGHT such groups a shard.
SLIGHT = 64


def shard_count(total_bytes: int, target_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def _dimension(df: DataFrame, name: str):
    """A dimension as a double: numbers as they are, other values by a hash (equal values stay together)."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        return F.coalesce(value, F.lit(-1.0))
    return F.when(F.col(name).isNull(), F.lit(-1.0)).otherwise(F.crc32(F.col(name).cast("string").cast("binary")).cast("double"))


def _hashed(docs: DataFrame, name: str):
    """A column as xxhash64 takes it: maps as text."""
    return F.to_json(name) if "map<" in dict(docs.dtypes)[name] else F.col(f"`{name}`")


def prepared(docs: DataFrame, id_col="doc_id", text_col="text", dims=("n_chars", "lang", "source"), whole: bool = True) -> DataFrame:
    """id, size, crc and one double d0, d1 ... a dimension; the texts' bytes are always one of them. print is a hash of the row: of all its columns, or, unless
    ``whole``, of the dimensions."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    values = [_dimension(docs, d) for d in dims if d in docs.columns]
    # Where the dimension ties the checksum orders the rows, and where texts tie the id; 12 bits of each.
    ties = F.floor(crc / F.lit(2.0**32) * TIE) * TIE + F.floor(uniform(F.col(id_col), crc, salt=7) * TIE)
    own = F.xxhash64(*[_hashed(docs, c) for c in docs.columns]) if whole else F.xxhash64(size, *values)
    places = [v.alias(f"d{i}") for i, v in enumerate([size.cast("double"), *values])]
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), own.alias("print"), ties.cast("long").alias("ties"), *places)


def heavy_repeats(slim: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """(_id, _crc), and their number, of rows equal in id and text that weigh more than a ``SLIGHT``-th of a mean shard together."""
    groups = slim.groupBy(F.col("id").alias("_id"), F.col("crc").alias("_crc")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return measured(groups.where((F.col("n") > 1) & (F.col("bytes") > total / (shards * SLIGHT))).select("_id", "_crc"), F.count("*"))


def told_apart(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Gives heavy repeats places of their own. Equal rows are counted, not moved: one stands for all until they are numbered, so a hot group sends a row a task. The
    places depend on the rows' contents and numbers alone, so the same rows in another table get the same."""
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc"))
    # At most SLIGHT groups a shard.
    light = rows.join(F.broadcast(heavy), same, "left_anti")
    others = [c for c in rows.columns if c not in ("id", "crc", "size", "print", "ties")]
    counted = rows.join(F.broadcast(heavy), same, "left_semi").groupBy("id", "crc", "size", "print").agg(F.first(F.struct(*others)).alias("rest"), F.count("*").alias("n"))
    numbered = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ties = F.floor(F.col("crc") / F.lit(2.0**32) * TIE) * TIE + F.floor(uniform("id", "crc", "print", "k", salt=7) * TIE)
    return light.unionByName(numbered.select("id", "crc", "size", "print", ties.cast("long").alias("ties"), "rest.*"))


def _dims(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "d" and c[1:].isdigit()]


def _few(cuts: DataFrame, nodes: int) -> DataFrame:
    """A level's cuts, marked for broadcast if there are few; there is at most one a node."""
    return F.broadcast(cuts) if nodes <= BROADCAST_ROWS else cuts


def level_cuts(rows: DataFrame, spans: dict[str, float], nodes: int) -> DataFrame:
    """(first, shards, dim, low, wide, code) of every node that is to hold several shards: rows whose place is ``code`` or more go right."""
    dims = list(spans)
    open_ = rows.where("shards > 1")
    ranges = open_.groupBy("first", "shards").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))])
    options = F.array(*[F.struct(((F.col(f"max_{d}") - F.col(f"min_{d}")) / spans[d]).alias("share"), F.lit(-i).alias("nth"), F.col(f"min_{d}").alias("low"), (F.col(f"max_{d}") - F.col(f"min_{d}")).alias("wide")) for i, d in enumerate(dims)])
    best = ranges.withColumn("best", F.array_max(options))
    left = F.floor(F.col("shards") / 2)
    zero = F.lit(0).cast("long")
    cuts = best.select("first", "shards", (-F.col("best.nth")).alias("dim"), F.col("best.low").alias("low"), F.greatest("best.wide", F.lit(1e-300)).alias("wide"), (F.col("bytes") * left / F.col("shards")).alias("want"), zero.alias("base"), zero.alias("code"))
    known = ["first", "shards", "dim", "low", "wide", "want", "base", "code"]
    for step in range(PASSES):
        at = F.shiftright(_place(dims), BITS * (PASSES - 1 - step))
        placed = open_.drop("shards").join(_few(cuts, nodes), "first").select(*known, "size", at.alias("at")).where(F.shiftright("at", BITS) == F.col("code"))
        binned = placed.groupBy(*known, F.col("at").bitwiseAND(F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("mass"))
        filled = binned.select("*", F.sum("mass").over(Window.partitionBy("first").orderBy("bin")).alias("upto"))
        # The first bin at which the node's bytes reach the share wanted; the last one if none does.
        short = F.col("base") + F.col("upto") < F.col("want")
        nearest = F.struct(short.alias("short"), F.when(short, -F.col("bin")).otherwise(F.col("bin")).alias("k"), "bin", "upto", "mass")
        hit = filled.groupBy(*known).agg(F.min(nearest).alias("hit"))
        base = F.col("base") + F.col("hit.upto") - F.col("hit.mass")
        code = F.col("code") * BINS + F.col("hit.bin")
        if step == PASSES - 1:
            code = code + (F.col("want") - base > F.col("hit.mass") / 2).cast("long")
        cuts = checkpoint(hit.select(*known[:-2], base.alias("base"), code.alias("code")))
    return cuts.drop("want", "base")


def _place(dims: list[str]):
    """A row's place in its node's order: 24 bits of the dimension, then the ties."""
    value = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("dim") + 1)
    most = TIE * TIE - 1
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor((value - F.col("low")) / F.col("wide") * (most + 1)))).cast("long") * (TIE * TIE) + F.col("ties")


def send_down(rows: DataFrame, cuts: DataFrame, nodes: int) -> DataFrame:
    """Moves rows (first, shards) one level down the tree; leaves stay."""
    joined = rows.join(_few(cuts.withColumnsRenamed({"first": "_first", "shards": "_shards"}), nodes), F.col("first") == F.col("_first"), "left")
    left = F.floor(F.col("shards") / 2).cast("int")
    right = F.coalesce(_place(_dims(rows)) >= F.col("code"), F.lit(False))
    leaf = F.col("_first").isNull()
    moved = joined.withColumn("_left", left).withColumn("first", F.when(right, F.col("first") + left).otherwise(F.col("first")))
    shards = F.when(leaf, F.col("shards")).when(right, F.col("shards") - F.col("_left")).otherwise(F.col("_left"))
    return moved.withColumn("shards", shards).drop("_first", "_shards", "_left", "dim", "low", "wide", "code")


def kd_tree(slim: DataFrame, shards: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The cuts level by level, each with a bound of its nodes, and the slim rows in their leaves. The widest node halves with every level."""
    dims = _dims(slim)
    ends = slim.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    spans = {d: max((ends[2 * i + 1] or 0.0) - (ends[2 * i] or 0.0), 1e-300) for i, d in enumerate(dims)}
    rows, levels = slim.withColumn("first", F.lit(0)).withColumn("shards", F.lit(shards)), []
    for level in range((shards - 1).bit_length()):
        nodes = min(shards, 1 << level)
        levels.append((level_cuts(rows, spans, nodes), nodes))
        above, rows = rows, passing(send_down(rows, *levels[-1]), f"shard-level-{level}")
        discard(above)
    return levels, rows


def kd_shards(slim: DataFrame, shards: int, to_place: DataFrame | None = None) -> DataFrame:
    """Adds shard and slot to the rows of ``prepared``. slot numbers the rows of a shard from 0 without gaps,
    by bucket of the id's hash, then id: no task sorts a whole shard."""
    levels, leaves = kd_tree(slim, shards)
    buckets = max(1, math.ceil(slim.count() / shards / ROWS_A_BUCKET))
    if to_place is not None:
        rows = to_place.withColumn("first", F.lit(0)).withColumn("shards", F.lit(shards))
        for cuts, nodes in levels:
            rows = send_down(rows, cuts, nodes)
    else:
        rows = leaves

    def placed(df):
        return df.withColumnRenamed("first", "shard").drop("shards").withColumn("bucket", F.floor(uniform("id", "crc", "ties", salt=11) * buckets).cast("long"))

    counted = placed(leaves).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "crc")
    numbered = placed(rows).withColumn("nth", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("nth") - 1 + F.col("offset")).cast("long")).drop("nth", "offset", "bucket")


def _placed(slim: DataFrame, shards: int | None, target_bytes: int, full: DataFrame | None = None) -> DataFrame:
    if shards is None:
        shards = shard_count(slim.agg(F.sum("size")).first()[0] or 0, target_bytes)
    heavy, found = heavy_repeats(slim, shards)
    if found:
        slim = keep(told_apart(slim, heavy), "shard-repeats")
        full = told_apart(full, heavy) if full is not None else None
    return kd_shards(slim, shards, full)


def shard_plan(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20, **columns) -> DataFrame:
    """id, size, crc, shard, slot of every document; the texts are read once. Without ``shards`` the leaves aim at ``target_bytes``."""
    slim = keep(prepared(docs, whole=False, **columns).drop("row"), "shard-sizes")
    return _placed(slim, shards, target_bytes)


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20, **columns) -> DataFrame:
    """The documents' own columns in ``row``, with shard and slot."""
    full = prepared(docs, **columns)
    slim = keep(full.drop("row"), "shard-sizes")
    return _placed(slim, shards, target_bytes, full).select("row", "size", "crc", "shard", "slot")
