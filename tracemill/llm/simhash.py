"""SimHash near-duplicates, linked through BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are one class. Two fingerprints
within ``RADIUS`` bits agree in at least two of their four 16-bit blocks, so each class is dealt to the
six shards named by its pairs of blocks, and every link falls into a shard. A shard of more than
``SHARD`` classes is dealt again by pairs of 8-bit blocks of its other 32 bits, which leaves 16 free
bits: no shard can pass 65,536 classes. Each shard's classes make a BK-tree, whose children are keyed by
their Hamming distance to the parent; a search follows only the edges within the radius. The trees stay
where their shard is: a broadcast of all trees would grow with the corpus.

From a shard come the edges of a spanning forest of its links, at most one a class, never pairs. The
components of the union over all shards are those of the whole link graph.

Nulls and texts without words: fingerprint 0, linked like any other. Repeated rows: each is returned, and all
share a component. Texts of any length are read whole. Columns beyond id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .bytewords import pieces
from .common import HASH_ROWS, by_size, components, keep, keep_counted, temporary

RADIUS = 2
SHARD = 256
#: Bytes of a text whose shingles are hashed and counted at a time.
PIECE = 1 << 18


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned integer."""
    return fingerprint_bytes(b"" if text is None else text.encode("utf-8", "surrogatepass"), shingle, seed)


def fingerprint_bytes(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    bits, count, held = np.zeros(64, np.int64), 0, []
    for piece in pieces(raw, PIECE):
        # Bytes: A-Z only, and the six ASCII blanks. The last words are needed again by the next piece's first shingles.
        words = held + piece.lower().split()
        if len(words) >= shingle:
            bits += _counted(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), seed)
            count += len(words) - shingle + 1
        held = words[-(shingle - 1) :] if shingle > 1 else []
    if not count and held:
        bits, count = _counted([b" ".join(held)], seed), 1
    return int(((2 * bits > count).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _counted(grams, seed: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], np.uint64)
    # Byte by byte: bit k of a hash is column k of its little-endian bits.
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if pa.types.is_string(batch.column(1).type) else batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint_bytes(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, print): the fingerprint as a signed long."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(_fingerprints(shingle, seed), f"id {kind}, print long")


class BKTree:
    """Over distinct integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while place:
            distance = (value ^ self.values[at]).bit_count()
            following = self.children[at].get(distance)
            if following is None:
                self.children[at][distance] = place
                break
            at = following
        return place

    def near(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield at
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for the values linked to another: a value is searched in the tree of those before it."""
    tree, parent = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[i], values[r]) for i in range(len(values)) if (r := top(i)) != i]


def _link_shards(radius: int):
    """Rows come sorted by shard; the rows of one shard may straddle batches, and never pass 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(values: list[int]) -> list[tuple[int, int]]:
            return forest(values, radius) if len(values) > 1 else []

        shard, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(prints)], strict=True):
                if start == end:
                    continue
                key = (int(keys[0, start]), int(keys[1, start]))
                if key != shard:
                    out += linked(held)
                    shard, held = key, []
                held += prints[start:end]
            if out:
                yield _edges(out)
        if out := linked(held):
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _block_pairs(value, low: int, width: int):
    """The six pairs of the four blocks of ``width`` bits from bit ``low`` on, each with its pair's number on top."""
    block = [F.shiftrightunsigned(value, low + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return [(block[i] * (1 << width) + block[j] + F.lit(n << (2 * width)), (i, j)) for n, (i, j) in enumerate(pairs)]


def _free_bits(value):
    """For each of the six shards, the 32 bits that its key leaves open, as one long."""
    block = [F.shiftrightunsigned(value, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out = []
    for _, (i, j) in _block_pairs(value, 0, 16):
        a, b = [k for k in range(4) if k not in (i, j)]
        out.append(block[a] * 65536 + block[b])
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (column print) to (a, b): edges whose components are those of all links within the radius."""
    if radius > 2:
        raise ValueError("the shards hold links of at most 2 bits")
    value = F.col("print")
    options = F.array(*[F.struct(key.alias("shard"), free.alias("free")) for (key, _), free in zip(_block_pairs(value, 0, 16), _free_bits(value), strict=True)])
    dealt = prints.select("print", F.explode(options).alias("o")).select("print", "o.*")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    held = dealt.join(sizes, "shard")
    zero = F.lit(-1).cast("long")
    again = F.explode(F.array(*[key for key, _ in _block_pairs(F.col("free"), 0, 8)]))
    small = held.where(F.col("n") <= SHARD).select("shard", zero.alias("part"), "print")
    large = held.where(F.col("n") > SHARD).select("shard", again.alias("part"), "print")
    both = small.unionByName(large)
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "print").mapInArrow(_link_shards(radius), "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, print) to (id, print, component): the smallest id reachable through links, itself included."""
    distinct = keep(prints.groupBy("print").agg(F.min("id").alias("least")), "prints")
    return labelled(prints, distinct, keep(components(links(distinct.select("print"), radius)), "print-components"))


def labelled(prints: DataFrame, distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """Adds component to (id, print), from (print, least) and the components (node, root) of the linked prints."""
    roots = joined.join(distinct, F.col("node") == F.col("print")).groupBy("root").agg(F.min("least").alias("component"))
    member = joined.join(roots, "root").select(F.col("node").alias("print"), "component")
    known = distinct.join(member, "print", "left").select("print", F.coalesce("component", "least").alias("component"))
    return prints.join(by_size(keep_counted(known, "print-classes")), "print")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """(id, print, component) of every row."""
    return classes(keep(fingerprints(docs, id_col, text_col, shingle, seed), "simhash"), radius)


def hexadecimal(value):
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", grouped=near_duplicates, **options) -> DataFrame:
    """One document of every component that ``grouped`` finds, in the input's columns: the one with the least id, and of several rows with that
    id the one whose text hashes least; of rows equal in both the one that is least as JSON text. Rows are told apart by two hashes of id and text."""
    tags = [F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col)) for salt in (1, 2)]
    tag = F.struct(tags[0].alias("h1"), tags[1].alias("h2"))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), tag.alias("tag")).alias("id"), F.col(text_col).alias("text"))
    seen = Observation()
    with temporary(docs.sparkSession):
        members = grouped(keyed, "id", "text", **options).select("component", "id")
        chosen = members.groupBy("component").agg(F.min("id").alias("first"))
        own = members.join(chosen, "component").groupBy("id.tag").agg(F.max(F.col("id.tag") == F.col("first.tag")).alias("kept"), F.count("*").alias("n"))
        verdicts = own.select("tag.h1", "tag.h2", "kept", (F.col("kept") & (F.col("n") > 1)).alias("again"))
        counts = [F.count_if(F.col("kept")).alias("kept"), F.count_if(~F.col("kept")).alias("gone"), F.count_if("again").alias("again")]
        verdicts = keep(verdicts.observe(seen, *counts), "row-verdicts", lasting=True)
    some = lambda which, known: by_size(verdicts.where(which).select("h1", "h2"), HASH_ROWS, known)
    # The fewer tags go to the texts. Where both are too many for that, the texts are shuffled.
    tagged, n = docs.select(F.struct("*").alias("row"), tag.alias("tag")).select("row", "tag.*"), seen.get
    which, how = ("kept", "left_semi") if n["kept"] < n["gone"] else ("not kept", "left_anti")
    kept = tagged.join(some(which, min(n["kept"], n["gone"])), ["h1", "h2"], how)
    if not n["again"]:
        return kept.select("row.*")
    # Rows that are equal in id and text meet under one tag; only such rows are put together here.
    again = some("again", n["again"])
    single = kept.join(again, ["h1", "h2"], "left_anti").select("row")
    merged = kept.join(again, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionByName(merged.select("row")).select("row.*")
