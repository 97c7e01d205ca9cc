"""Substring dedup by level-wise doubling of word windows.

To find the windows of ``window`` words that several documents share, shorter windows are judged first, and those repeated
at one length alone are extended to twice that length less one: windows of 7 words, then of 13 = 2 * 7 - 1, of 25 and so on, until the
length wanted is reached or no candidates survive.

First level. A window of twice the length holds as many windows as that length; the one with the least hash stands for it (equal
windows choose alike), which leaves about a quarter of the 7-word windows to be counted. One aggregation
finds those that start in two documents or more.
Each further level. Only windows whose chosen half survives are hashed whole, and one aggregation finds the repeated ones; at the last it gives the smallest
document in which each starts. Words covered by a window that also starts in a smaller document go.

A document whose whole text a smaller one has needs no further level: all its windows start there too.

What is removed is told by two hashes of 64 bits: windows that differ are taken for equal with a chance of about 2**-128 a pair, unless two of
their words share a 64-bit hash and all others are equal; the same holds for whole texts. A false survivor of a lower level does no harm.

A window counts as removed where a smaller id has it, so the first holder keeps its words, and the result
does not depend on the order of rows. Nulls: a null text has no words; a null id is no smaller than any, loses nothing and is
no witness. Texts of fewer than ``window`` words keep all. Rows with equal ids are one document. Texts of any length are
read whole; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import chunks, window_hashes, word_hashes
from .common import BROADCAST_ROWS, discard, keep, passing

WINDOW = 13
#: Windows of fewer words are repeated in most texts, so no level is shorter, unless the windows wanted are.
SHORTEST = 7


def levels(window: int) -> list[int]:
    """The lengths judged, each but the first twice the one before less one, or one less than that."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def _least(hashes: np.ndarray, short: int, long: int) -> np.ndarray:
    """For every window of ``long`` words the least hash of its windows of ``short``."""
    grams, n = window_hashes(hashes, short), len(hashes) - long + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for k in range(1, long - short + 1):
        np.minimum(least, grams[k : n + k], out=least)
    return least


def _starts(text: np.ndarray, length: int) -> np.ndarray:
    """Where the windows within one text start."""
    return np.flatnonzero(text[: len(text) - length + 1] == text[length - 1 :]) if len(text) >= length else np.empty(0, np.int64)


def _first_level(short: int, long: int):
    """(value, id): the windows of ``short`` words that stand for those of ``long``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch.column(1))
            for begin, end in chunks([len(t) for t in texts]):
                hashes, text = word_hashes(texts[begin:end])
                starts = _starts(text, long)
                if len(starts):
                    least, of = _least(hashes, short, long)[starts], text[starts]
                    new = np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), ids.take(pa.array(of[new] + begin))], ["value", "id"])

    return run


def _next_level(lengths: list[int], k: int):
    """(value, check, id) from documents with their survivors of the level before: the windows of this level whose half survives;
    of a level that is not the last only those that stand for one of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, survive = batch.column(0), _texts(batch.column(1)), batch.column(2)
            for begin, end in chunks([len(t) for t in texts]):
                hashes, text = word_hashes(texts[begin:end])
                starts = _starts(text, lengths[k])
                if not len(starts):
                    continue
                half = _least(hashes, lengths[k - 1], lengths[k])[starts] if k else None
                value, check, of = window_hashes(hashes, lengths[k])[starts], window_hashes(hashes, lengths[k], 1)[starts], text[starts]
                edges = np.searchsorted(of, np.arange(end - begin + 1))
                if k + 1 < len(lengths):
                    wanted, whose = _least(hashes, lengths[k], lengths[k + 1]), _starts(text, lengths[k + 1])
                    bounds = np.searchsorted(text[whose], np.arange(end - begin + 1))
                found, owner = [], []
                for i in range(end - begin):
                    part = slice(edges[i], edges[i + 1])
                    mine = np.ones(edges[i + 1] - edges[i], bool)
                    if half is not None:
                        mine &= np.isin(half[part], survive[begin + i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    if k + 1 < len(lengths):
                        mine &= np.isin(value[part], wanted[whose[bounds[i] : bounds[i + 1]]])
                    here = np.flatnonzero(mine) + edges[i]
                    here = here[np.unique(value[here], return_index=True)[1]]
                    found.append(here)
                    owner.append(np.full(len(here), begin + i))
                at = np.concatenate(found)
                columns = [pa.array(value[at].view(np.int64)), pa.array(check[at].view(np.int64)), ids.take(pa.array(np.concatenate(owner)))]
                yield pa.RecordBatch.from_arrays(columns, ["value", "check", "id"])

    return run


def _covered(raw: bytes, bad, window: int) -> np.ndarray:
    """Where the repeated windows (value, check) of a text start."""
    hashes = word_hashes([raw])[0]
    whole, check = window_hashes(hashes, window), window_hashes(hashes, window, 1)
    values, checks = (bad.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
    order = np.argsort(values, kind="stable")
    values, checks = values[order], checks[order]
    at = np.searchsorted(values, whole)
    hit, left = np.zeros(len(whole), bool), np.arange(len(whole))
    while len(left):  # once more for each further window with the same first hash
        left = left[at[left] < len(values)]
        left = left[values[at[left]] == whole[left]]
        same = checks[at[left]] == check[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
    return np.flatnonzero(hit)


def _cut(window: int):
    """Of documents with their repeated windows: what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, repeated, copies = batch.column(0), _texts(batch.column(1)), batch.column(2), batch.column(3)
            n_words, removed, kept = [], [], []
            for raw, bad, copy in zip(texts, repeated, copies, strict=True):
                words, bad = raw.split(), bad.values
                gone = np.zeros(len(words) + 1, np.int64)
                if len(words) >= window and copy.as_py():
                    gone[:-1] = 1
                elif len(words) >= window and bad is not None and len(bad):
                    at = _covered(raw, bad, window)
                    gone[at] += 1
                    np.subtract.at(gone, at + window, 1)
                    gone = np.cumsum(gone)
                keeps = gone[:-1] == 0
                n_words.append(len(words))
                removed.append(int(len(words) - keeps.sum()))
                kept.append(b" ".join(words if keeps.all() else compress(words, keeps)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def _repeated(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """(values, first): what two ids or more hold, with the smallest; one aggregation, combined before its shuffle."""
    ends = rows.groupBy(*values).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return passing(ends.where("first < last").select(*values, "first"), name)


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; kept is the remaining words joined by one space."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    known = chosen.where("id is not null and text is not null")

    text_key = keep(known.select("id", F.xxhash64("text", F.octet_length("text")).alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")), "substring-keys")
    copied = text_key.join(_repeated(text_key, ["k1", "k2"], "substring-copied"), ["k1", "k2"])
    # An id is a copy if all its rows are.
    some = copied.where("first < id").select("id", F.lit(1).alias("copy")).unionByName(text_key.select("id", F.lit(-1).alias("copy")))
    copies = keep(some.groupBy("id").agg(F.sum("copy").alias("copy")).where("copy >= 0").select("id"), "substring-copies")

    # Copies are left out as candidates, since their originals are none, and no window starts in copies alone. Few are left out at once.
    few = copies.count() <= BROADCAST_ROWS
    open_ = known.join(F.broadcast(copies), "id", "left_anti") if few else known
    lengths = levels(window)
    if len(lengths) > 1:
        rows = passing(open_.mapInArrow(_first_level(lengths[0], lengths[1]), f"value long, id {kind}"), "substring-level-0")
    else:
        rows = _extended(open_.withColumn("survive", F.lit(None).cast("array<long>")), lengths, 0, kind)
    for k in range(1, len(lengths)):
        again = _repeated(rows, ["value"], f"substring-repeats-{k - 1}")
        survive = rows.select("id", "value").join(again.select("value"), "value")
        survive = survive if few else survive.join(copies, "id", "left_anti")
        candidates = passing(survive.groupBy("id").agg(F.collect_set("value").alias("survive")), f"substring-candidates-{k}")
        discard(rows, again)
        rows = _extended(known.join(candidates, "id"), lengths, k, kind)
        discard(candidates)
        if rows.isEmpty():
            break

    again = _repeated(rows, ["value", "check"], "substring-repeats")
    held = rows.join(again, ["value", "check"]).where("first < id")
    held = held if few else held.join(copies, "id", "left_anti")
    repeats = held.groupBy("id").agg(F.collect_set(F.struct("value", "check")).alias("repeated")).withColumn("copy", F.lit(False))
    none = F.lit(None).cast("array<struct<value:long,check:long>>")
    verdicts = keep(repeats.unionByName(copies.select("id", none.alias("repeated"), F.lit(True).alias("copy"))), "substring-verdicts")
    discard(rows, again)
    judged = chosen.join(verdicts, "id", "left").select("id", "text", "repeated", F.coalesce("copy", F.lit(False)).alias("copy"))
    return judged.mapInArrow(_cut(window), f"id {kind}, n_words long, n_removed long, kept string")


def _extended(candidates: DataFrame, lengths: list[int], k: int, kind: str) -> DataFrame:
    return passing(candidates.select("id", "text", "survive").mapInArrow(_next_level(lengths, k), f"value long, check long, id {kind}"), f"substring-level-{k}")
