"""Hard negatives by inner product, found with length buckets and coordinate pruning.

A vector's components are floor(256 * x) as integers, and a score is the inner product with an anchor. An anchor's positives are
the best rows of its label; for each positive the best rows of other labels whose score lies between ``LOW`` and ``HIGH`` hundredths of the positive's.

Rows are dealt to buckets of similar lengths: lengths within 5 % of each other share a bucket, and a bucket of more than ``BUCKET`` rows is cut by
a hash of the rows, so copies of one vector meet no single task. A bucket holds, for every coordinate, its rows sorted by the coordinate of their
direction. An anchor needs a score of at least t. In a bucket whose longest row is l that is a cosine of at least t / (|anchor| * l): above 1 the bucket is passed over;
else the angles of an anchor's and a row's coordinate may differ by at most the angle of that cosine, which gives a feasible range of values in each
coordinate. The ranges of the anchor's largest coordinates, its focus, are looked up in the sorted lists and intersected, and what is left is scored exactly.

The threshold t is a score that enough rows are known to reach: the last of an anchor's wanted best rows among ``SEEDS`` rows drawn by
hash, and for negatives at least the lower end of the range. It only saves work; where too few seeds qualify, all rows are candidates.

Anchors are a stated query set and come in blocks; every block meets every bucket it may need, and no task holds more than one of each.

Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part. Rows equal in id, label and vector count once; rows that
share an id alone are rows of their own. Vectors of different lengths in components are not compared. A vector without components, or of zeros, scores 0 with all. A scaled
component beyond 2**62 counts as that; products are exact, and one beyond the range of a long counts as its end. Fewer rows than wanted give fewer results; an anchor without a positive, or a positive without a
negative, gives none. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, checkpoint, discard, passing, uniform

POSITIVES, NEGATIVES = 5, 3
#: A negative's score as hundredths of the positive's.
LOW, HIGH = 50, 95
BUCKET, BLOCK, SEEDS = 8192, 1024, 2048
FOCUS = 4
_EXACT = 2.0**53


def prepared(vectors: DataFrame, anchors, id_col="vec_id", vector_col="embedding", label_col="label", label=None) -> DataFrame:
    """(id, label, v, size, width, anchor) of the rows that take part, each once. ``label`` replaces the label, ``anchors`` tells the anchors."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * 256.0, F.lit(-(2.0**62))), F.lit(2.0**62))))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), scaled.alias("v"), anchors.alias("anchor"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    return rows.distinct().select("*", F.size("v").alias("width"), length.alias("length"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds bin and piece, which name a bucket of its width."""
    rows = rows.withColumn("bin", F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(float(np.log(1.05))))).otherwise(F.lit(-(1 << 20))).cast("int"))
    counts = checkpoint(rows.groupBy("width", "bin").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("pieces")))
    return rows.join(by_size(counts), ["width", "bin"]).withColumn("piece", F.pmod(F.xxhash64("id", "label", "v"), F.col("pieces")).cast("int")).drop("pieces")


class Bucket:
    """Rows of one width with their sorted coordinate lists."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["id", "label"], kind="stable").reset_index(drop=True)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.rows = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
        self.real = self.rows.astype(np.float64)
        self.lengths = np.sqrt((self.real * self.real).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.largest = float(np.abs(self.real).max(initial=0.0))
        self.turned = self.real / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in the order of their direction's coordinate ``f``, and its values; sorted when first asked for."""
        if f not in self._lists:
            order = np.argsort(self.turned[:, f], kind="stable")
            self._lists[f] = order, self.turned[order, f]
        return self._lists[f]

    def candidates(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """The rows that may score at least ``least`` with the anchor; all that do are among them."""
        every = np.arange(len(self.ids))
        length = float(np.sqrt((anchor * anchor).sum()))
        if not length or not self.longest:
            return every if least <= 0 else every[:0]
        cosine = least / (length * self.longest) - 1e-9
        if cosine > 1:
            return every[:0]
        # A shorter row needs a larger cosine where least > 0, but a smaller one where it is below: there nothing is known.
        if cosine <= 0:
            return every
        angle, turned = np.arccos(cosine), anchor / length
        best, found = None, []
        for f in np.argsort(-np.abs(turned), kind="stable")[:FOCUS]:
            at = np.arccos(np.clip(turned[f], -1, 1))
            low, high = np.cos(min(np.pi, at + angle)) - 1e-7, np.cos(max(0.0, at - angle)) + 1e-7
            order, values = self.coordinate(int(f))
            begin, end = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            found.append((end - begin, int(f), low, high))
            if best is None or end - begin < len(best):
                best = order[begin:end]
        for n, f, low, high in sorted(found)[1:]:
            if n < len(self.ids) and len(best):
                value = self.turned[best, f]
                best = best[(value >= low) & (value <= high)]
        return np.sort(best) if best is not None else every

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact: in floating point where no sum can pass 2**53, else in integers of any size."""
        most = float(np.abs(anchor).max(initial=0)) * self.largest * max(1, self.rows.shape[1])
        if most < _EXACT:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[at].astype(object) @ anchor.astype(object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties by smaller id."""
    if len(scores) > 64 * k and scores.dtype != object:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= limit)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _clipped(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _positives(k: int, seeds: bool):
    """Of a block of anchors and a bucket: each anchor's k best rows of its label, others than itself."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            bucket = Bucket(rows)
            for a in anchors.itertuples(index=False):
                v = np.asarray(a.v, np.int64)
                at = bucket.candidates(v.astype(np.float64), a.least)
                at = at[bucket.labels[at] == a.label]
                same = at[bucket.ids[at] == a.id]
                at = np.setdiff1d(at, same[(bucket.rows[same] == v).all(axis=1)])
                s = bucket.scores(v, at)
                out += [(a.key, _clipped(s[i]), int(bucket.ids[at[i]])) for i in _best(s, bucket.ids[at], k)]
        found = pd.DataFrame(out, columns=["key", "score", "other"])
        if seeds and len(anchors):
            # The last of k known scores; without k of them nothing is known.
            best = found.groupby("key")["score"].agg(["min", "size"])
            least = best["min"][best["size"] >= k]
            return pd.DataFrame({"key": anchors["key"], "least": anchors["key"].map(least).astype(float).fillna(-np.inf)})
        return found

    return run


def _negatives(k: int, low: int, high: int, seeds: bool):
    """Of a block of anchors with their positives and a bucket: for each positive the k best rows of other labels within the range."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            bucket = Bucket(rows)
            for a in anchors.itertuples(index=False):
                wanted = [(p, int(s), float(t)) for p, s, t in zip(a.positives, a.scores, a.leasts, strict=True)]
                v = np.asarray(a.v, np.int64)
                at = bucket.candidates(v.astype(np.float64), min(t for _, _, t in wanted))
                at = at[bucket.labels[at] != a.label]
                s = bucket.scores(v, at)
                for place, (p, score, _) in enumerate(wanted):
                    # Exact: 100 * a negative's score lies between the two products.
                    top, bottom = (high * score) // 100, -((-low * score) // 100)
                    inside = np.flatnonzero((s >= bottom) & (s <= top))
                    best = inside[_best(s[inside], bucket.ids[at[inside]], k)]
                    if seeds:
                        least = float(s[best[-1]]) if len(best) == k else -np.inf
                        out.append((a.key, place, max(least, float(bottom))))
                    else:
                        out += [(a.key, place, p, score, _clipped(s[i]), int(bucket.ids[at[i]])) for i in best]
        return pd.DataFrame(out, columns=["key", "place", "least"] if seeds else ["key", "place", "positive", "positive_score", "score", "other"])

    return run


def _met(anchors: DataFrame, rows: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """Every block of anchors with every bucket of its width that may matter: a bucket is passed over where no anchor of the block can reach its least score in it."""
    blocks = checkpoint(anchors.groupBy("width", "block").agg(F.max(F.when(F.col("least") > 0, F.col("length") / F.col("least")).otherwise(F.lit(float("inf")))).alias("reach")))
    buckets = checkpoint(rows.groupBy("width", *by).agg(F.max("length").alias("longest")))
    pairs = checkpoint(buckets.join(by_size(blocks), "width").where("longest * reach >= 1 - 1e-9").select("width", *by, "block"))
    left = anchors.join(pairs, ["width", "block"])
    right = rows.join(pairs, ["width", *by])
    keys = ["width", *by, "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group, numbered from 1. Spark keeps only the k best of a group in each task before its shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors,
    id_col="vec_id",
    vector_col="embedding",
    label_col="label",
    label=None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchors`` is a condition on the table's columns."""
    every = passing(_dealt(prepared(vectors, anchors, id_col, vector_col, label_col, label)), "negatives-rows")
    key = F.xxhash64("id", "label", "v")
    n = every.where("anchor").count()
    asked = every.where("anchor").select("id", "label", "v", "width", "length", key.alias("key"), F.pmod(F.xxhash64(F.lit(7), "id", "label", "v"), F.lit(max(1, -(-n // BLOCK)))).cast("int").alias("block"))
    rows = every.select("width", "bin", "piece", "id", "label", "v", "length")
    few = passing(rows.orderBy(uniform("id", "label", "v", salt=11)).limit(SEEDS).withColumn("bin", F.lit(0)).withColumn("piece", F.lit(0)), "negatives-seeds")
    unknown = F.lit(float("-inf"))

    # The k best of each anchor's label: first a score that k rows reach, then all rows that reach it.
    first = _met(asked.withColumn("least", unknown), few, ["bin", "piece"], _positives(positives, True), "key long, least double")
    known = passing(asked.join(first, "key", "left").withColumn("least", F.coalesce("least", unknown)), "negatives-known")
    found = passing(_met(known, rows, ["bin", "piece"], _positives(positives, False), "key long, score long, other long"), "negatives-found")
    merged = _first(found, ["key"], positives).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("best"))
    paired = passing(asked.join(merged, "key").select("*", F.col("best.other").alias("positives"), F.col("best.score").alias("scores")).drop("best"), "negatives-paired")

    # For each positive the same within its range.
    unsure = paired.withColumn("leasts", F.transform("scores", lambda s: unknown)).withColumn("least", unknown)
    first = _met(unsure, few, ["bin", "piece"], _negatives(negatives, low, high, True), "key long, place int, least double")
    leasts = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("known"))
    bottom = F.transform("scores", lambda s: s.cast("double") * low / 100.0 - F.abs(s) * 1e-9 - 1.0)
    sure = paired.join(leasts, "key", "left").withColumn("leasts", F.coalesce(F.col("known.least"), bottom)).drop("known").withColumn("least", F.array_min("leasts"))
    sure = passing(sure, "negatives-sure")
    got = passing(_met(sure, rows, ["bin", "piece"], _negatives(negatives, low, high, False), "key long, place int, positive long, positive_score long, score long, other long"), "negatives-got")
    best = _first(got, ["key", "place", "positive", "positive_score"], negatives).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    out = best.select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = passing(out, "negatives")
    discard(every, few, known, found, paired, sure, got)
    return out
