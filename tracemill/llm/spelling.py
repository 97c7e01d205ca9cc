"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Words are counted first. The pairs of words one edit apart (a code point inserted, deleted or replaced) are the paths of A o E o A, where A is the
minimal acceptor of the vocabulary and E copies its input but for one edit. The composition is cut by its initial states: a partition (m, lo, hi, prefix, suffix)
holds the words of m or m - 1 code points that start with the prefix of ``lo`` and end with the suffix of m - ``hi``, and finds the pairs whose longer word has m and
whose first difference is at lo or later, but before hi. Partitions start as one for each m. One of more than ``GROUP`` words, or of over ``REGION`` places, is cut in two: the
first half shares more of its end, the second more of its beginning. Every pair is in exactly one partition at each step; one that is a single place wide
holds at most a word for each letter, and one more. So no partition outgrows a task, whatever the vocabulary, and none is left out. A word alone in its partition goes at once.

In each partition the acceptor of the words' middles is built in sorted order, minimal after each word. From its start the identical part of a path is
followed state by state; at each place of the partition it branches by a replaced or a deleted letter into pairs of states, whose common language is enumerated, each pair of states once.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is ``RATIO`` times its own or more. Forms have ever larger counts, so following them
ends; their last word is found by doubling.

Nulls: a null text has no words; a null id counts as an empty text where letters are deleted. Repeated rows count again. Texts of any length are read whole; words of any length
are compared. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint, discard, passing

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
GROUP, REGION = 2048, 64
#: Characters of a text worked on at a time; distinct words a task holds before it hands its counts on.
PIECE, HELD = 1 << 20, 1 << 18
LETTERS = "a-zÀ-ÿ"
_BREAK = re.compile(f"[^{LETTERS}]")


def _counted(least: int, deletes: int | None):
    """(word, n): counts of the words of at least ``least`` letters; a word may appear several times."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text, begin = (raw.as_py() or b"").lower().decode("utf-8", "replace"), 0  # of bytes: A-Z only
                salt = zlib.crc32(f"{i or ''}:".encode())
                while begin < len(text):
                    cut = _BREAK.search(text, begin + PIECE) if len(text) - begin > PIECE else None
                    end = cut.start() if cut else len(text)
                    for word, n in Counter(runs.findall(text, begin, end)).items():
                        if deletes and (h := zlib.crc32(word.encode(), salt)) % deletes == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        counts[word] += n
                    begin = end
                if len(counts) > HELD:
                    yield _counts(counts)
                    counts.clear()
        if counts:
            yield _counts(counts)

    return run


def _counts(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, deletes: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lowered, found often enough. With ``deletes`` a run loses a letter in the documents where that number divides the
    crc32 of "<id>:<run>"."""
    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_counted(least_letters, deletes), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words. State 0 is the start; ``moves`` are a state's letters and where they lead."""

    def __init__(self, words: list[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        path, before = [0], ""
        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            self._settle(path, before, same)
            for letter in word[same:]:
                self.moves.append({})
                self.final.append(False)
                self.moves[path[-1]][letter] = len(self.moves) - 1
                path.append(len(self.moves) - 1)
            self.final[path[-1]] = True
            before = word
        self._settle(path, before, 0)

    def _settle(self, path: list[int], word: str, depth: int) -> None:
        """The states below ``depth`` of the last word's path get no more moves: each is replaced by one like it, if there is one."""
        while len(path) > depth + 1:
            state = path.pop()
            shape = (self.final[state], *self.moves[state].items())
            self.moves[path[-1]][word[len(path) - 1]] = self._known.setdefault(shape, state)


def one_edit(words: list[str], longer: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """The pairs of sorted words one edit apart whose longer one has ``longer`` letters and whose first difference is in [lo, hi), each once: a longer one and its partner."""
    acceptor = Acceptor(words)
    moves, final = acceptor.moves, acceptor.final
    shared: dict[tuple[int, int, int], tuple[str, ...]] = {}

    def common(p: int, q: int, left: int) -> tuple[str, ...]:
        """The texts of ``left`` letters that lead from both states to an end."""
        if not left:
            return ("",) if final[p] and final[q] else ()
        key = (p, q, left) if p < q else (q, p, left)
        if key not in shared:
            a, b = moves[p], moves[q]
            shared[key] = tuple(letter + rest for letter in a if letter in b for rest in common(a[letter], b[letter], left - 1))
        return shared[key]

    stack = [(0, "")]
    while stack:
        state, read = stack.pop()
        here, left = moves[state], longer - len(read) - 1
        if left < 0:
            continue
        if lo <= len(read):
            letters = list(here)
            for k, one in enumerate(letters):
                for other in letters[k + 1 :]:
                    for rest in common(here[one], here[other], left):
                        yield read + one + rest, read + other + rest
                for rest in common(here[one], state, left):
                    if rest[:1] != one:  # else the first difference comes later
                        yield read + one + rest, read + rest
        if len(read) + 1 < hi:
            stack.extend((to, read + letter) for letter, to in here.items())


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n), both ways, from rows sorted by partition and middle."""
    now, held, out = None, {}, []

    def pairs():
        if len(held) > 1:
            m, lo, hi = now[2:]
            # Only the middles are compared: what stands before and behind is the same in a partition. The next letter tells whether a first difference comes later.
            for a, b in one_edit(list(held), hi - lo + (hi < m), 0, hi - lo):
                out.extend(((*held[a], *held[b]), (*held[b], *held[a])))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:5] != now:
                pairs()
                now, held = row[:5], {}
                if len(out) > HELD:
                    yield _pairs(out)
                    out = []
            held[row[5]] = row[6:]
    pairs()
    yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _named(rows: DataFrame) -> DataFrame:
    """Adds the two hashes that name a word's partition."""
    parts = ["m", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), F.right("word", F.col("m") - F.col("hi"))]
    return rows.withColumns({"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit(1), *parts)})


def near_words(words: DataFrame, group: int = GROUP, region: int = REGION) -> DataFrame:
    """(word, n, near, near_n): every pair of words of (word, n) one edit apart, both ways."""
    spark = words.sparkSession
    m = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = passing(_named(words.select("word", "n", m.alias("m")).withColumns({"lo": F.lit(0), "hi": F.col("m")})), "spelling-level")
    ready, kept, level = [], [rows], rows
    while True:
        sizes = checkpoint(level.groupBy("k1", "k2").agg(F.count("*").alias("held"), F.max(F.col("hi") - F.col("lo")).alias("places")).where("held > 1"))
        cut = (F.col("places") > 1) & ((F.col("held") > group) | (F.col("places") > region))
        placed = passing(level.join(by_size(sizes), ["k1", "k2"]).withColumn("cut", cut).drop("held", "places"), "spelling-placed")
        ready.append(placed.where("not cut").drop("cut"))
        kept.append(placed)
        more = placed.where("cut")
        if more.isEmpty():
            break
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        ranges = F.explode(F.array(F.struct(F.col("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi"))))
        discard(level)
        level = passing(_named(more.select("word", "n", "m", ranges.alias("part")).select("word", "n", "m", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"))), "spelling-level")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    behind = F.greatest(F.col("m") - F.col("hi") - 1, F.lit(0))
    middle = F.substr("word", F.col("lo") + 1, F.char_length("word") - F.col("lo") - behind)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = every.select("k1", "k2", "m", "lo", "hi", middle.alias("middle"), "word", "n").repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2", "middle")
    found = passing(dealt.mapInArrow(_composed, "word string, n long, near string, near_n long"), "spelling-near")
    discard(*kept, level)
    return found


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): the last word that following forms leads to. The steps double, so a chain of n takes log n rounds."""
    links = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = by_size(links.select(F.col("word").alias("_word"), F.col("root").alias("_root")))
        step = checkpoint(links.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = passing(words, "spelling-words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = passing(judged.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n")), "spelling-judged")
    roots = last_forms(judged.where("form is not null"))
    discard(words, near)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
