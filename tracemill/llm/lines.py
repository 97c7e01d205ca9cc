"""Line dedup through a sharded minimal perfect hash.

Every distinct line key has a 128-bit hash. The distinct (document, hash) pairs are counted in one aggregation, and each shard of
distinct hashes is indexed by a minimal perfect hash: bit arrays of falling size, in each of which a hash that meets no other owns a
bit, and the number of owned bits before it is its place. At that place stand a fingerprint of 32 bits and the number of documents, in
as few bytes as the shard's largest count needs. Documents send the hashes of their lines, never the lines, to the shards and probe the arrays there; what comes
back is the list of a document's keys that are common.

Shards hold about ``SHARD`` hashes, whatever the corpus. A shard whose lines are in very many documents is probed by several tasks with
a copy of its arrays each, as many as its counts add up to, so a line that all documents share meets no single task.

A key is the line without ASCII blanks at both ends and with A-Z lowered. Keys shorter than ``least`` code points never go; neither does what
fewer than ``documents`` documents hold. Rows with equal ids are one document, and so are all rows with a null id; each row is
returned. A null or empty text is one empty line. Every line of a text of any length is read. Other columns are ignored. An empty table gives an empty result.
A hash the index does not hold is taken for one with a chance of 2**-32; the documents it was made of ask for none. Two keys are taken for one with a chance of 2**-128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BLANKS, mixed
from .common import by_size, checkpoint, discard, passing

DOCUMENTS = 10
LEAST = 1
#: Hashes of a shard, and probes of a shard that one task answers, about.
SHARD = 1 << 16
PROBES = 1 << 18
#: Bytes of a text whose lines are worked on at a time, unless one line is longer.
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Maps n distinct 64-bit numbers to 0 .. n - 1. ``levels`` are arrays of bits; ``rest`` are the numbers, sorted, that no level tells apart."""

    LEVELS, ROOM = 40, 2

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self._before = [np.cumsum(bits, dtype=np.int32) - bits for bits in levels]

    @classmethod
    def of(cls, numbers: np.ndarray) -> PerfectHash:
        levels, left = [], numbers
        while len(left) and len(levels) < cls.LEVELS:
            at = cls._at(left, len(levels), -(-cls.ROOM * len(left) // 64) * 64)
            owned = np.bincount(at, minlength=-(-cls.ROOM * len(left) // 64) * 64) == 1
            levels.append(owned)
            left = left[~owned[at]]
        return cls(levels, np.unique(left))

    @staticmethod
    def _at(numbers: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mixed(numbers ^ mixed(np.full(1, level + 1, np.uint64) * _STEP)) % np.uint64(bits)).astype(np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number; for one that was not given to ``of`` that of another, or -1."""
        out, left, base = np.full(len(numbers), -1, np.int64), np.arange(len(numbers)), 0
        for level, (bits, before) in enumerate(zip(self.levels, self._before, strict=True)):
            if not len(left):
                return out
            at = self._at(numbers[left], level, len(bits))
            owned = bits[at]
            out[left[owned]] = base + before[at[owned]]
            left, base = left[~owned], base + int(before[-1]) + int(bits[-1])
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, numbers[left]), len(self.rest) - 1)
            same = self.rest[at] == numbers[left]
            out[left[same]] = base + at[same]
        return out


def line_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, some at a time."""
    begin = 0
    while len(raw) - begin > PIECE and (cut := raw.find(b"\n", begin + PIECE)) >= 0:
        yield raw[begin:cut].split(b"\n")
        begin = cut + 1
    yield raw[begin:].split(b"\n")


def _digest(line: bytes, least: int, digest=xxhash.xxh3_128_digest) -> bytes:
    """Of the key; empty if it is too short to go."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (least > 1 and len(key.decode("utf-8", "surrogatepass")) < least):
        return b""
    return digest(key) if key else b""


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _hashes(least: int):
    """(id, h1, h2) of the distinct keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(_raw(batch.column(1))):
                found: set[bytes] = set()
                for lines in line_pieces(raw):
                    found.update(_digest(line, least) for line in lines)
                found.discard(b"")
                if found:
                    pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                    ids = batch.column(0).take(pa.array(np.full(len(pair), i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["id", "h1", "h2"])

    return run


def _number(h1: pa.Array, h2: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What the perfect hash tells apart, and the fingerprint, which shares no bits with it."""
    a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (h1, h2))
    return b ^ (a << np.uint64(32)), (a >> np.uint64(32)).astype(np.uint32)


def _index(table: pa.Table) -> pa.Table:
    """One row, the arrays of a shard, from its (shard, h1, h2, n)."""
    table = table.combine_chunks()
    numbers, prints = _number(table["h1"].combine_chunks(), table["h2"].combine_chunks())
    index = PerfectHash.of(numbers)
    place = index.places(numbers)
    counts = table["n"].to_numpy()
    # Different hashes may share a number: they share the place, and the larger count stands there.
    order = np.argsort(counts, kind="stable")
    size = int(place.max()) + 1
    held, fingerprints = np.zeros(size, np.int64), np.zeros(size, np.uint32)
    held[place[order]], fingerprints[place[order]] = counts[order], prints[order]
    width = np.min_scalar_type(int(counts.max()))
    row = {
        "shard": table["shard"][:1],
        "levels": [[np.packbits(bits).tobytes() for bits in index.levels]],
        "rest": [index.rest.tobytes()],
        "fingerprints": [fingerprints.tobytes()],
        "counts": [held.astype(width).tobytes()],
        "width": [width.itemsize],
        "probes": [int(counts.sum())],
    }
    return pa.table({k: pa.array(v, pa.list_(pa.binary())) if k == "levels" else v.combine_chunks() if k == "shard" else pa.array(v) for k, v in row.items()})


INDEX = "shard long, levels array<binary>, rest binary, fingerprints binary, counts binary, width long, probes long"


def _probe(documents: int):
    """Of the probes (id, h1, h2) of a shard those that its arrays say enough documents hold."""

    def run(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        probes = probes.select(["id", "h1", "h2"]).combine_chunks()
        if not probes.num_rows or not arrays.num_rows:
            return probes.slice(0, 0)
        row = arrays.slice(0, 1).to_pylist()[0]
        index = PerfectHash([np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for b in row["levels"]], np.frombuffer(row["rest"], np.uint64))
        counts = np.frombuffer(row["counts"], f"u{row['width']}")
        numbers, prints = _number(probes["h1"].combine_chunks(), probes["h2"].combine_chunks())
        place = index.places(numbers)
        known = (place >= 0) & (np.frombuffer(row["fingerprints"], np.uint32)[place] == prints)
        return probes.filter(pa.array(known & (counts[place] >= documents)))

    return run


def line_index(pairs: DataFrame) -> DataFrame:
    """The arrays of every shard, a row each, over the distinct hashes of (id, h1, h2), each pair once."""
    spark = pairs.sparkSession
    counted = passing(pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")), "line-counts")
    shards = max(-(-counted.count() // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = counted.withColumn("shard", F.pmod("h1", F.lit(shards)))
    index = passing(rows.groupBy("shard").applyInArrow(_index, INDEX), "line-index")
    index._tracemill_shards = shards
    discard(counted)
    return index


def common_lines(pairs: DataFrame, index: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(id, h1, h2) of the pairs whose line at least ``documents`` documents hold, by probing ``line_index``."""
    kind = pairs.schema["id"].dataType.simpleString()
    tasks = checkpoint(index.select("shard", F.ceil(F.col("probes") / PROBES).cast("int").alias("tasks")))
    probes = pairs.withColumn("shard", F.pmod("h1", F.lit(index._tracemill_shards))).join(by_size(tasks), "shard")
    probes = probes.select("id", "h1", "h2", "shard", F.pmod(F.xxhash64("id", "h2"), F.col("tasks")).cast("int").alias("task"))
    arrays = index.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("probes") / PROBES).cast("int") - 1)).alias("task"))
    return probes.groupBy("shard", "task").cogroup(arrays.groupBy("shard", "task")).applyInArrow(_probe(documents), f"id {kind}, h1 long, h2 long")


def _cut(least: int):
    """Of documents with the hashes of their common lines: what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for raw, common in zip(_raw(batch.column(1)), batch.column(2), strict=True):
                n = raw.count(b"\n") + 1
                n_lines.append(n)
                if common.values is None:
                    n_dropped.append(0)
                    kept.append(raw)
                    continue
                packed = np.stack([common.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1).tobytes()
                gone = {packed[at : at + 16] for at in range(0, len(packed), 16)}
                left, parts = 0, []
                for lines in line_pieces(raw):
                    stay = [line for line in lines if _digest(line, least) not in gone]
                    left += len(stay)
                    if stay:
                        parts.append(b"\n".join(stay))
                n_dropped.append(n - left)
                kept.append(b"\n".join(parts))
            columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_dropped", "kept"])

    return run


def without_common_lines(docs: DataFrame, id_col="doc_id", text_col="text", documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row; kept is the remaining lines joined by line breaks."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    pairs = passing(chosen.mapInArrow(_hashes(least), f"id {kind}, h1 long, h2 long").distinct(), "line-pairs")
    index = line_index(pairs)
    common = passing(common_lines(pairs, index, documents).groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("common")), "line-common")
    discard(pairs, index)
    # The lists grow with the corpus, so texts and lists are sorted alike at every size; a broadcast would only serve small tables.
    marked = chosen.join(common.withColumnRenamed("id", "_id").hint("merge"), F.col("id").eqNullSafe(F.col("_id")), "left")
    return marked.select("id", "text", "common").mapInArrow(_cut(least), f"id {kind}, n_lines long, n_dropped long, kept string")
