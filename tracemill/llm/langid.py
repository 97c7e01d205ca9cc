"""Language identification by rank-order profiles (out-of-place distance).

A profile is a ranking of the ``TOP`` most frequent letter n-grams, n from 1 to 3, of lower-cased words with a blank at
either end. A document's profile is compared with each language's: every n-gram costs the difference of its
ranks, or ``TOP`` where the language's profile lacks it. The language that costs least is predicted; equal costs go to
the language first in code-point order, equal counts to the n-gram first in order. score is 1 less the share of the
greatest cost possible.

Profiles are learned from about ``LEARN`` documents a language, chosen by a hash of their ids: the stated bound of the
sample. Every document is scored on its whole text.

Nulls: a null text, or one without a letter, is ``und`` with score 0; so is everything where nothing could be learned.
Documents with a null lang teach nothing. Repeated rows are each returned; other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, spread

TOP = 300
LEARN = 1500
#: Characters of a text worked on at a time.
PART = 1 << 18
_OTHER = re.compile(r"\W")


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART`` characters, each ending before one that is no letter, if there is one in the next 4,096."""
    begin = 0
    while len(text) - begin > PART:
        cut = _OTHER.search(text, begin + PART, begin + PART + 4096)
        end = cut.start() if cut else min(len(text), begin + PART + 4096)
        yield text[begin:end]
        begin = end
    yield text[begin:]


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """The lower-cased text's code points, 0 for all but letters, blanks single, one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[0], np.where(_letters()[points], points, 0), [0]])
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


class Profiles:
    """The languages' profiles, and the alphabet that numbers the n-grams; a letter outside it is one letter more."""

    def __init__(self, ranked: dict[str, list[str]]) -> None:
        self.languages = sorted(ranked)
        alphabet = sorted({c for grams in ranked.values() for g in grams for c in g if c != " "})
        self.number = np.full(0x110000, len(alphabet) + 1, np.int32)
        self.number[0] = 0
        for i, c in enumerate(alphabet):
            self.number[ord(c)] = i + 1
        self.base = len(alphabet) + 2
        codes = {l: [self.code(g) for g in grams] for l, grams in ranked.items()}
        self.known = np.unique(np.array([c for cs in codes.values() for c in cs], np.int64))
        self.ranks = np.full((len(self.languages), len(self.known) + 1), -1, np.int32)
        for i, l in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.known, codes[l])] = np.arange(len(codes[l]))

    def code(self, gram: str) -> int:
        out = 0
        for c in gram:
            out = out * self.base + int(self.number[0 if c == " " else ord(c)])
        return out + (0, 0, self.base**1, self.base**1 + self.base**2)[len(gram)]

    def codes(self, points: np.ndarray) -> np.ndarray:
        kind = np.int32 if self.base**3 * 2 < 2**31 else np.int64
        x, b = self.number[points].astype(kind), kind(self.base)
        two = x[:-1] * b + x[1:]
        three = two[:-1] * b + x[2:]
        return np.concatenate([x[x != 0], two + b, three[x[1:-1] != 0] + (b + b * b)])

    def predict(self, text: str | None, top: int) -> tuple[str, float]:
        found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in _parts(text or "") if self.languages else ():
            points = _points(part)
            if len(points) >= 3:
                codes = np.sort(self.codes(points))
                new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                more, n = codes[new].astype(np.int64), np.diff(np.concatenate([new, [len(codes)]]))
                if len(found):
                    more, place = np.unique(np.concatenate([found, more]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
                found, counts = more, n
        if not len(found):
            return "und", 0.0
        mine = found[np.argsort(-counts, kind="stable")[:top]]
        at = np.searchsorted(self.known, mine)
        at[self.known[np.minimum(at, len(self.known) - 1)] != mine] = len(self.known)
        ranks = self.ranks[:, at]
        costs = np.where(ranks < 0, top, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(costs))
        return self.languages[best], float(1.0 - costs[best] / (top * len(mine)))


def _words(text: str) -> Counter:
    words: Counter = Counter()
    for part in _parts(text):
        words.update("".join(map(chr, _points(part))).split("\0"))
    return words


def _grams(words: Counter) -> Counter:
    counts: Counter = Counter()
    for word, n in words.items():
        if word:
            padded = f" {word} "
            for size in (1, 2, 3):
                for i in range(len(padded) - size + 1):
                    if padded[i : i + size] != " ":
                        counts[padded[i : i + size]] += n
    return counts


def grams(text: str) -> Counter:
    """The n-grams of one text with their counts, a blank for either end of a word."""
    return _grams(_words(text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each language, counted over the different words of a batch."""
    for batch in batches:
        total: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(lang, Counter()).update(_words(text or ""))
        rows = [(l, g, n) for l, words in total.items() for g, n in _grams(words).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", top: int = TOP, per_language: int = LEARN) -> Profiles:
    """Counts n-grams over a sample of bounded size and ranks them in Spark; the driver gets ``top`` rows a language."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sample = spread(bounded_sample(labelled, "lang", per_language, "id", "text")).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[str]] = {}
    for r in counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def _predicted(profiles, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = profiles.value
        for batch in batches:
            out = [known.predict(t.as_py(), top) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles, id_col="doc_id", text_col="text", top: int = TOP) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return chosen.mapInArrow(_predicted(shared, top), f"id {kind}, lang_pred string, score double")
