"""Embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors are one class, which goes through the forest once. ``TREES`` trees are fitted on a sample of at most about ``FIT`` classes
and ``FIT_NUMBERS`` components (the stated bounds; it is what is broadcast): a node splits at the median of its members' projections on a random
direction, and members within ``SPILL`` of the ranks on either side of it go to both children. Every class is sent down
every tree. Leaves that still pass ``LEAF_MAX`` classes are split again in Spark in the same way, round by round, by a direction drawn
from the leaf's number and quantiles of all its members. A median is of the data, so vectors that all point much the same way are split as finely as
others. Only a clump is left whole: a leaf of which ``TIGHT`` of the pairs of a few members are links already, so that comparing all
pairs costs at most 1 / ``TIGHT`` times the links found; it is compared block against block. Inside leaves all pairs are
compared in double precision, and links are those at or above the threshold.

A pair may meet in several leaves. Each class carries its leaves, so a pair is counted in the least leaf that both
share, and no pair leaves its task: a leaf gives a row a linked class, with its number of links and one edge to its local root. The
union of the edges gives the components.

Vectors that are null, zero, or hold null or non-finite components link with nothing; each is its own component. Vectors of different lengths
have no cosine; each length has trees of its own, and links within itself. Rows with equal ids are one vector id held twice: each row is returned. Other columns are
ignored. An empty table gives an empty result. Tests measure the recall against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint, components, keep, uniform

TREES, FIT, SPILL = 10, 16_384, 0.05
FIT_NUMBERS = 1 << 21
LEAF, LEAF_MAX = 256, 1024
#: The share of sampled pairs that are links from which on a leaf is left whole, and about how many of its members are sampled.
TIGHT, PROBE = 0.25, 48
#: A leaf's number: the tree, then the vectors' length and the tree's own number, or for a leaf split again a hash.
TREE_BITS = 56


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_share(x: np.ndarray, threshold: float) -> float:
    """The share of the pairs of these unit vectors that are links."""
    n = len(x)
    return (np.count_nonzero(x @ x.T >= threshold) - n) / (n * (n - 1)) if n > 1 else 0.0


QUANTILES = (0.5 - SPILL, 0.5 + SPILL)


class Tree:
    """Node i sends projections on planes[i] left up to cuts[i][1] and right from cuts[i][0] on; its children are at left[i] and right[i]. A negative place is leaf -place - 1."""

    def __init__(self, sample: np.ndarray, least: int, threshold: float, rng: np.random.Generator) -> None:
        self.planes: list[np.ndarray] = []
        self.cuts: list[tuple[float, float]] = []
        self.left, self.right, self.leaves = [], [], 0
        todo = [(np.arange(len(sample)), None)]
        while todo:
            members, hook = todo.pop()
            low = high = 0.0
            if len(members) >= 2 * least and linked_share(sample[rng.choice(members, min(PROBE, len(members)), replace=False)], threshold) < TIGHT:
                plane = rng.standard_normal(sample.shape[1])
                plane /= np.linalg.norm(plane)
                along = sample[members] @ plane
                low, high = np.quantile(along, QUANTILES)
            if low == high:
                place, self.leaves = -self.leaves - 1, self.leaves + 1
            else:
                place = len(self.planes)
                self.planes.append(plane)
                self.cuts.append((low, high))
                self.left.append(0)
                self.right.append(0)
                todo += [(members[along <= high], (place, 0)), (members[along >= low], (place, 1))]
            if hook is None:
                self.root = place
            else:
                (self.right if hook[1] else self.left)[hook[0]] = place

    def send(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row reaches."""
        rows, out = [(np.arange(len(x)), self.root)], []
        while rows:
            members, place = rows.pop()
            if not len(members):
                continue
            if place < 0:
                out.append((members, np.full(len(members), -place - 1)))
                continue
            along, (low, high) = x[members] @ self.planes[place], self.cuts[place]
            rows += [(members[along <= high], self.left[place]), (members[along >= low], self.right[place])]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int),) * 2


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_width(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of the vectors, the rows that have it, and these as unit vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        yield width, rows, _unit(_matrix(column.take(pa.array(rows)), width))


def _leaves(forests, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, mine, x in _by_width(batch.column(1)):
                own = forests.value.get(width)
                for t in range(trees):
                    # A length that the sample lacks starts as one leaf.
                    rows, leaf = own[t].send(x) if own else (np.arange(len(x)), np.zeros(len(x), int))
                    number = (t << TREE_BITS) + (width << 24) + leaf
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine[rows])), pa.array(number, pa.int64())], ["rep", "leaf"])

    return run


def _direction(leaf: int, width: int) -> np.ndarray:
    v = np.random.default_rng([leaf, width]).standard_normal(width)
    return v / np.linalg.norm(v)


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, leaf, vector, probed) to the projections on their leaves' directions, and the unit vectors of the probed ones."""
    for batch in batches:
        leaf, probed = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        along, probes = np.empty(len(leaf)), [None] * len(leaf)
        for width, rows, x in _by_width(batch.column(2)):
            for l in np.unique(leaf[rows]).tolist():
                here = leaf[rows] == l
                along[rows[here]] = x[here] @ _direction(l, width)
            for k in np.flatnonzero(probed[rows]):
                probes[rows[k]] = x[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(along), pa.array(probes, pa.list_(pa.float64()))], ["rep", "leaf", "along", "probe"])


def _shares(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [linked_share(np.array([p for p in probes.as_py() if len(p) == len(probes[0])]), threshold) for probes in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], ["leaf", "share"])

    return run


def _split_again(placed: DataFrame, vectors: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(rep, leaf) with no leaf over LEAF_MAX but clumps. A round halves the large leaves, all at once."""
    done, open_ = None, placed
    while True:
        sizes = keep(open_.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_MAX), "forest-large")
        if sizes.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        sizes = by_size(sizes)
        small = open_.join(sizes, "leaf", "left_anti")
        probed = uniform("rep", "leaf", salt=17) * F.col("n") < PROBE
        large = open_.join(sizes, "leaf").join(vectors.select("rep", "vector"), "rep").select("rep", "leaf", "vector", probed.alias("probed"))
        along = keep(large.mapInArrow(_projected, f"rep {kind}, leaf long, along double, probe array<double>"), "forest-along")
        shares = along.where("probe is not null").groupBy("leaf").agg(F.collect_list("probe").alias("probes")).mapInArrow(_shares(threshold), "leaf long, share double")
        cuts = along.groupBy("leaf").agg(F.percentile_approx("along", F.array(*map(F.lit, QUANTILES)), 1000).alias("q")).join(shares, "leaf", "left")
        whole = (F.coalesce("share", F.lit(0.0)) >= TIGHT) | (F.col("q")[0] >= F.col("q")[1])
        cuts = by_size(checkpoint(cuts.select("leaf", whole.alias("tight"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))))
        judged = along.drop("probe").join(cuts, "leaf")
        kept = small.select("rep", "leaf").unionByName(judged.where("tight").select("rep", "leaf"))
        tree = F.shiftright("leaf", TREE_BITS) * F.lit(1 << TREE_BITS)
        child = lambda side: tree + F.pmod(F.xxhash64("leaf", F.lit(side)), F.lit(1 << TREE_BITS))
        sides = F.array_compact(F.array(F.when(F.col("along") <= F.col("high"), child(0)), F.when(F.col("along") >= F.col("low"), child(1))))
        halves = judged.where("not tight").select("rep", F.explode(sides).alias("leaf"))
        done = keep(kept if done is None else done.unionByName(kept), "forest-done")
        open_ = keep(halves, "forest-open")


def _compared(threshold: float):
    """Rows come sorted by leaf, length and block pair; those of one pair are at most two blocks."""

    def links(leaf: int, side: np.ndarray, reps: list, weight: np.ndarray, x: np.ndarray, leaves: list[np.ndarray]):
        x, cross = _unit(x), bool(side.any())
        close = x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if cross:
            close &= side[:, None] != side[None, :]
        some = np.flatnonzero(close.any(axis=1))
        if not len(some):
            return []
        close = close[np.ix_(some, some)]
        # Pairs that share an earlier leaf were counted there.
        other = np.concatenate([leaves[i] for i in some])
        owner = np.repeat(np.arange(len(some)), [len(leaves[i]) for i in some])
        earlier = other < leaf
        names, number = np.unique(other[earlier], return_inverse=True)
        held = np.zeros((len(some), len(names)), np.float32)
        held[owner[earlier], number] = 1.0
        fresh = close & (held @ held.T == 0)
        out, parent = [], np.arange(len(some))
        for i in range(len(some)):  # each joins the component of the first it is close to
            if parent[i] == i:
                reach = close[i]
                frontier = reach & (parent == np.arange(len(some)))
                frontier[i] = True
                members = frontier
                while True:
                    more = close[frontier].any(axis=0) & ~members
                    if not more.any():
                        break
                    members, frontier = members | more, more
                parent[members] = i
        sums = fresh @ weight[some]
        for i, s in enumerate(some):
            if sums[i] or parent[i] != i:
                out.append((reps[s], int(sums[i]), reps[some[parent[i]]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cols = {n: block.column(i) for i, n in enumerate(block.schema.names)}
            return links(key[0], cols["side"].to_numpy(zero_copy_only=False), cols["rep"].to_pylist(), cols["n"].to_numpy(zero_copy_only=False), _matrix(cols["vector"], key[1]), [l.values.to_numpy(zero_copy_only=False) for l in cols["leaves"]])

        for batch in batches:
            out = []
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                now = tuple(keys[:, start].tolist())
                if now != key:
                    if held:
                        out += flush()
                    held, key = [], now
                held.append(batch.slice(start, end - start))
            if out:
                yield _linked(out, batch.schema.field("rep").type)
        if held and (out := flush()):
            yield _linked(out, held[0].schema.field("rep").type)

    return run


def _linked(rows: list[tuple], kind) -> pa.RecordBatch:
    a, n, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(n, pa.int64()), pa.array(b, kind)], ["rep", "links", "root"])


def classes(rows: DataFrame, usable) -> DataFrame:
    """(h1, h2, rep, n, vector): the distinct vectors, by two hashes, with the least id and the number of rows that hold each."""
    known = rows.where(usable).select("id", "vector", *_hashes())
    return keep(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vectors")


def _hashes() -> list:
    return [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]


def leaves(distinct: DataFrame, threshold: float, trees: int = TREES, seed: int = 5) -> DataFrame:
    """(rep, leaf): the leaves of every distinct vector. Pairs within a leaf are what is compared."""
    context, kind = distinct.sparkSession.sparkContext, distinct.schema["rep"].dataType.simpleString()
    count, mean = distinct.agg(F.count("*"), F.avg(F.size("vector"))).first()
    share = min(FIT, FIT_NUMBERS / (mean or 1)) / max(1, count)
    by_width: dict[int, list] = {}
    for r in distinct.where(uniform("rep", salt=seed) < share).select("rep", "vector").orderBy("rep").toLocalIterator():
        by_width.setdefault(len(r["vector"]), []).append(np.array(r["vector"]))
    least = max(32, math.ceil(LEAF / 2 * min(1.0, share)))
    forests = {w: [Tree(_unit(np.array(x)), least, threshold, np.random.default_rng([seed, t])) for t in range(trees)] for w, x in by_width.items()}
    placed = keep(distinct.select("rep", "vector").mapInArrow(_leaves(context.broadcast(forests), trees), f"rep {kind}, leaf long"), "forest-leaves")
    return keep(_split_again(placed, distinct, threshold, kind), "forest-placed")


def near_duplicates(table: DataFrame, id_col="vec_id", vector_col="embedding", threshold: float = 0.9, trees: int = TREES, seed: int = 5) -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    absent = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~absent & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    distinct = classes(rows, usable)
    placed = leaves(distinct, threshold, trees, seed)

    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(float(LEAF_MAX))).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1")
    carried = distinct.join(placed.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")), "rep").select("rep", "n", "vector", "leaves")
    dealt = carried.select("*", F.explode("leaves").alias("leaf")).join(blocks.drop("m"), "leaf").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Block pairs (i, j), i <= j: a row meets its own block once and every other block once.
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("width", F.size("vector"))
    side = (F.col("mine") > F.col("other")).cast("int")
    pairs = pairs.select("leaf", "width", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "rep", "n", "vector", "leaves")
    grouped = pairs.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "width", "i", "j", "rep")
    found = keep(grouped.mapInArrow(_compared(threshold), f"rep {kind}, links long, root {kind}"), "forest-links")

    united = components(found.where("rep <> root"), "rep", "root")
    per_class = distinct.select("h1", "h2", "rep", "n").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(united.select(F.col("node").alias("rep"), "root"), "rep", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    known = rows.select("id", *[F.when(usable, h).alias(name) for h, name in zip(_hashes(), ("h1", "h2"), strict=True)])
    out = known.join(by_size(keep(per_class, "vector-classes")), ["h1", "h2"], "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
