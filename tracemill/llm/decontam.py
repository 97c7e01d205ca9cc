"""Benchmark decontamination with a positional inverted index.

``index`` stores, document by document, the postings of the terms that any benchmark item holds: for each
term the positions at which it stands. A word outside that vocabulary cannot be part of a phrase sought, so
nothing is lost by leaving it out. ``search`` reads the stored postings in segments of many documents, joins
them to one sorted list a term, and answers each phrase by intersecting the lists shifted by the terms'
offsets, from the rarest term on, which ends as soon as no start is left. The documents never move: the
index is split by document, and the phrases, a stated query set, go to every segment in blocks of at most
``BLOCK_WORDS`` words, so that what is broadcast has a bound; more items mean more passes.

Phrases are the windows of ``WINDOW`` consecutive words of an item, or all of a shorter item's. Near matches:
at least ``SHARE`` of an item's distinct terms, whichever are missing, stand within ``SLOP`` words of the places that they have in the
item. Places are counted from one of its terms that are rarest in all documents: as many as may be missing, and ``RARE`` more, so that
``RARE`` of them are near one another in any match. The result for a document depends on no partition or batch.

Nulls: a null text has no words, on either side; a null item id is an item of its own. Items without words
find nothing. Repeated rows are each returned. Long texts are indexed whole. Columns other than id and text
are ignored. Empty documents give an empty result, an empty benchmark documents without matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_ROWS, by_size, keep, temporary

WINDOW = 13
BLOCK_WORDS = 400_000
#: Postings joined into one segment.
SEGMENT = 4_000_000
RARE, SLOP = 4, 5
#: The share of an item's distinct terms that makes a near match, as a fraction.
SHARE = (4, 5)

#: Bytes to bytes: A-Z lower-cased; digits, letters and all bytes of non-ASCII characters stay; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, near array<string>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def term(word: bytes) -> int:
    """A term's number: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64))


class Phrases:
    """One block of the query set: its windows and, for near matches, its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.items, self.starts = [i for i, _ in items], defaultdict(list)
        self.vocabulary = {w: term(w) for _, ws in items for w in ws}
        self.whole = [[self.vocabulary[w] for w in ws] for _, ws in items]
        for k, terms in enumerate(self.whole):
            for s in range(max(1, len(terms) - window + 1)):
                self.starts[tuple(terms[s : s + window])].append(k)
        self.terms = np.unique(np.array(list(self.vocabulary.values()), np.int64))
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.windows = [(np.array([place[t] for t in w]), sorted(set(ks))) for w, ks in self.starts.items()]
        self.whole = [np.array([place[t] for t in ts]) for ts in self.whole]
        self.gap = max((len(ts) for ts in self.whole), default=0) + 2 * SLOP + 1
        self.near: list[tuple] = []
        del self.starts

    def rank(self, counts: dict[int, int]) -> None:
        """Prepares near matches from the numbers of documents that hold the terms: for each item of two terms or more its distinct
        terms, their first places, those to start from and how many must be met."""
        held = np.array([counts.get(t, 0) for t in self.terms.tolist()], np.int64)
        for k, whole in enumerate(self.whole):
            numbers, places = np.unique(whole, return_index=True)
            need = -(-len(numbers) * SHARE[0] // SHARE[1])
            if len(numbers) > 1:
                rare = np.argsort(held[numbers], kind="stable")[: len(numbers) - need + min(RARE, need)]
                self.near.append((k, numbers, places, rare, need))


def blocks(benchmark: DataFrame, id_col="item_id", text_col="text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size; a single longer item is a block of its own."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        if not (found := words(text)):
            continue
        if held and size + len(found) > block_words:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, found))
        size += len(found)
    if held:
        yield Phrases(held, window)


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary is not None else None
        for batch in batches:
            ids, counts, lengths, terms, places = batch.column(0), [], [0], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                numbers = list(map(known.get, found, repeat(None))) if known is not None else list(map(term, found))
                at = np.array([i for i, t in enumerate(numbers) if t is not None], np.int32)
                values = np.array([t for t in numbers if t is not None], np.int64)
                order = np.argsort(values, kind="stable")
                terms.append(values[order])
                places.append(at[order])
                counts.append(len(found))
                lengths.append(lengths[-1] + len(at))
            offsets = pa.array(lengths, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((terms, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), *lists], ["id", "n_words", "terms", "positions"])

    return run


def index(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: dict[bytes, int] | None = None) -> DataFrame:
    """The stored index: id, n_words and, sorted by term, the terms and positions of each document's postings.

    ``vocabulary`` limits it to the terms that will be asked for; without it every word is indexed."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return keep(chosen.mapInArrow(_postings(known), f"id {kind}, n_words long, terms array<long>, positions array<int>"), "postings")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column's row lengths and its values end to end."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


class Segment:
    """The postings of some documents, a sorted list of positions a term. Documents stand apart by ``gap`` words."""

    def __init__(self, phrases: Phrases, n_words: np.ndarray, lengths: np.ndarray, terms: np.ndarray, positions: np.ndarray) -> None:
        self.base = np.concatenate([[0], np.cumsum(n_words + phrases.gap)])
        at = positions + np.repeat(self.base[:-1], lengths)
        number = np.searchsorted(phrases.terms, terms)
        number[number == len(phrases.terms)] = 0
        mine = phrases.terms[number] == terms if len(phrases.terms) else np.zeros(len(terms), bool)
        number, at = number[mine], at[mine]
        order = np.lexsort((at, number))
        self.at = at[order]
        self.first = np.searchsorted(number[order], np.arange(len(phrases.terms) + 1))
        self.length = np.diff(self.first)

    def postings(self, number: int) -> np.ndarray:
        return self.at[self.first[number] : self.first[number + 1]]

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """The places at which the phrase starts."""
        lengths = self.length[numbers]
        if not lengths.all():
            return self.at[:0]
        order = np.argsort(lengths, kind="stable")
        starts = self.postings(numbers[order[0]]) - order[0]
        for k in order[1:]:
            starts = starts[_within(self.postings(numbers[k]), starts + k, 0)]
            if not len(starts):
                break
        return starts

    def near(self, numbers: np.ndarray, places: np.ndarray, rare: np.ndarray, need: int) -> np.ndarray:
        """Places of an item's rare terms about which enough of its terms stand where the item has them."""
        at = np.concatenate([self.postings(numbers[k]) for k in rare])
        starts = at - np.repeat(places[rare], self.length[numbers[rare]])
        order = np.argsort(starts, kind="stable")
        at, starts = at[order], starts[order]
        around = np.searchsorted(starts, starts + SLOP, side="right") - np.searchsorted(starts, starts - SLOP)
        some = around >= len(rare) - (len(numbers) - need)
        at, starts = at[some], starts[some]
        hits = np.zeros(len(starts), np.int64)
        if len(starts):
            for number, place in zip(numbers, places, strict=True):
                if self.length[number]:
                    hits += _within(self.postings(number), starts + place, SLOP)
        return at[hits >= need]

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1


def _within(sorted_list: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have a list member at most ``slop`` away."""
    following = np.searchsorted(sorted_list, wanted - slop)
    return (following < len(sorted_list)) & (sorted_list[np.minimum(following, len(sorted_list) - 1)] <= wanted + slop)


def _searched(phrases_of, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of.value
        for batch in batches:
            n_words = batch.column(1).to_numpy(zero_copy_only=False)
            lengths, terms = _flat(batch.column(2))
            positions = _flat(batch.column(3))[1]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            begin = 0
            while begin < len(n_words):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + SEGMENT, side="right")) - 1)
                cut = slice(upto[begin], upto[end])
                segment = Segment(phrases, n_words[begin:end], lengths[begin:end], terms[cut], positions[cut])
                yield _results(batch.slice(begin, end - begin), phrases, segment, last)
                begin = end

    return run


def _results(batch: pa.RecordBatch, phrases: Phrases, segment: Segment, last: bool) -> pa.RecordBatch:
    rows = batch.num_rows
    items, near, spans = ([set(x.as_py()) for x in batch.column(6)], [set(x.as_py()) for x in batch.column(7)], [[(y["start"], y["end"]) for y in x.as_py()] for x in batch.column(5)])
    for numbers, owners in phrases.windows:
        starts = segment.phrase(numbers)
        for d, s in zip(segment.documents(starts).tolist(), starts.tolist(), strict=True):
            spans[d].append((int(s - segment.base[d]), int(s - segment.base[d]) + len(numbers)))
            items[d].update(phrases.items[k] for k in owners)
    for k, *item in phrases.near:
        for d in set(segment.documents(segment.near(*item)).tolist()):
            near[d].add(phrases.items[k])
    merged = [_merged(s) for s in spans]
    order = lambda s: sorted(s, key=lambda x: (x is None, x))
    out = [batch.column(0), batch.column(1)] + ([] if last else [batch.column(2), batch.column(3)])
    names = ["id", "n_words"] + ([] if last else ["terms", "positions"])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out += [pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], span), pa.array([order(i) for i in items], pa.list_(pa.string())), pa.array([order(near[d] - items[d]) for d in range(rows)], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(out, [*names, "spans", "items", "near"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def frequencies(indexed: DataFrame) -> DataFrame:
    """(term, n): the number of documents that hold each indexed term."""
    return keep(indexed.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def _ranked(block: Phrases | None, counts: DataFrame | None) -> Phrases | None:
    if block is not None and counts is not None:
        terms = counts.sparkSession.createDataFrame([(t,) for t in block.terms.tolist()], "term long")
        block.rank(dict(map(tuple, counts.join(F.broadcast(terms), "term").select("term", "n").collect())))
    return block


def search(indexed: DataFrame, phrases: Iterator[Phrases], proximity: bool = True) -> DataFrame:
    """Every indexed document with its matches: id, n_words, spans (words inside an occurrence of a window, as half-open
    ranges), items (those with such an occurrence) and near (others, found by proximity; none without ``proximity``)."""
    spark = indexed.sparkSession
    kind = indexed.schema["id"].dataType.simpleString()
    lists = "terms array<long>, positions array<int>, "
    none = [F.lit(None).cast("array<struct<start:int,end:int>>"), F.lit(None).cast("array<string>")]
    out = indexed.select("id", "n_words", "terms", "positions", F.lit(0).alias("_"), F.coalesce(none[0], F.array()).alias("spans"), F.coalesce(none[1], F.array()).alias("items"), F.coalesce(none[1], F.array()).alias("near"))
    block = next(phrases, None)
    if block is None:
        return out.drop("terms", "positions", "_")
    counts = frequencies(indexed) if proximity else None
    while block is not None:
        following = next(phrases, None)
        shape = f"id {kind}, " + FOUND.replace("spans", ("" if following is None else lists) + "spans", 1)
        out = out.mapInArrow(_searched(spark.sparkContext.broadcast(_ranked(block, counts)), following is None), shape)
        if following is not None:
            out = keep(out, "postings-found").select("id", "n_words", "terms", "positions", F.lit(0).alias("_"), "spans", "items", "near")
        block = following
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, block_words: int = BLOCK_WORDS, proximity: bool = True) -> DataFrame:
    """Indexes the documents for the benchmark's terms and searches them, a block of items at a time; see ``search``."""
    phrases = blocks(benchmark, item_col, item_text_col, window, block_words)
    some = list(islice(phrases, 2))
    # One block's terms are few enough to index no others; for more, every word is indexed, once for all blocks.
    vocabulary = (some[0].vocabulary if some else {}) if len(some) < 2 else None
    return search(index(docs, id_col, text_col, vocabulary), chain(some, phrases), proximity)


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def contaminated():
    """At least one hit, and hits are at least a twentieth of the words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that are not contaminated, in the input's columns. The verdict depends on the text alone, so rows are
    met again by a hash of their id and text. It rests on exact windows, so near matches are not sought."""
    rows = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col))
    keyed = docs.select(F.struct(*_keys(id_col, text_col)).alias("id"), F.col(text_col).alias("text"))
    with temporary(docs.sparkSession):
        found = matches(keyed, benchmark, "id", "text", proximity=False, **options)
        bad = keep(found.where(contaminated()).select("id.*").distinct(), "contaminated", counted=True, lasting=True)
    return rows.join(by_size(bad, HASH_ROWS), ["k1", "k2"], "left_anti").select("row.*")


def _keys(id_col: str, text_col: str) -> list:
    """Two independent hashes of a row's id and text."""
    return [F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col)).alias(name) for salt, name in ((1, "k1"), (2, "k2"))]
