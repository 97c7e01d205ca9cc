"""Spelling variants, line dedup and hard negatives against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import lowered, make
from tracemill.llm import lines, negatives, spelling
from tracemill.llm.common import table
from tracemill.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# ---- spelling
def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows, deletes=199, least=6, count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if deletes and h % deletes == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= count}


def brute_variants(words, ratio=5):
    near = defaultdict(set)
    for w in words:  # all words one deletion below stand for both
        for i in range(len(w)):
            near[w[:i] + w[i + 1 :]].add(w)
    links = defaultdict(set)
    for w in words:
        below = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for other in set().union(*(near[b] for b in below), below & words.keys(), near[w]):
            if other != w and one_apart(w, other):
                links[w].add(other)
                links[other].add(w)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(links[w]), words.get(form[w]))
    return out


def as_variants(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_composition_finds_each_pair_once():
    rng = random.Random(1)
    for _ in range(150):
        m = rng.randint(1, 6)
        words = sorted({"".join(rng.choice("abc") for _ in range(m - rng.randint(0, 1))) for _ in range(rng.randint(0, 60))})
        lo = rng.randint(0, m - 1)
        hi = rng.randint(lo + 1, m)

        def first_difference(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        want = [tuple(sorted(p)) for p in ((a, b) for i, a in enumerate(words) for b in words[i + 1 :]) if one_apart(*p) and max(map(len, p)) == m and lo <= first_difference(*p) < hi]
        assert sorted(tuple(sorted(p)) for p in spelling.one_edit(words, m, lo, hi)) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abcd" for b in "xy" for c in ("ing", "ed", ""))
    acceptor = spelling.Acceptor(words)
    reached, stack = {0}, [0]
    while stack:
        for to in acceptor.moves[stack.pop()].values():
            if to not in reached:
                reached.add(to)
                stack.append(to)
    # Start, after the first letter, after the second, i, in, e, end.
    assert len(reached) == 7


@pytest.mark.parametrize(("group", "region"), [(4096, 64), (3, 64), (1, 2)])
def test_near_words_do_not_depend_on_the_partitions(spark, group, region):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))): rng.randint(1, 90) for _ in range(250)}
    words |= {"q" * 90 + "a": 7, "q" * 90 + "b": 8, "q" * 90: 9, "z" + "q" * 90 + "a": 1}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group=group, region=region).collect()
    want = sorted((a, words[a], b, words[b]) for a in words for b in words if a != b and one_apart(a, b))
    assert sorted(map(tuple, got)) == want


def test_variants_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefñ") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    rows = [(None, None), (None, "Garden garden"), (1, ""), (2, "short GARDENÉ gardené gardne 12"), (3, "garden " * 700 + "gardens " * 60 + "gardenss " * 6), (3, "garden " * 3)]
    for i in range(10, 200):
        text = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(base)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "bc", "ß"]) + w[at + 1 :]
            text.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", "-", "1"]).join(text)))
    rows.append((500, " ".join(rng.choice(base) for _ in range(150_000))))  # over a piece
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    for deletes in (None, 3, 199):
        want = brute_words(rows, deletes)
        counted = spelling.vocabulary(docs, deletes=deletes)
        assert {r["word"]: r["n"] for r in counted.collect()} == want
        assert as_variants(spelling.variants(counted)) == brute_variants(want)
    assert brute_variants(brute_words(rows, None))["gardenss"][:2] == ("gardens", "garden")
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
    parted = spelling.vocabulary(docs.repartition(7), deletes=199)
    assert as_variants(spelling.variants(parted)) == brute_variants(brute_words(rows, 199))


def test_registered_spelling_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect()]
    assert as_variants(QUERIES["op11_fst_spelling"](spark, SF_DIR)) == brute_variants(brute_words(rows))


# ---- lines
def brute_lines(rows, documents=10, least=1):
    key = lambda line: lowered(line.strip("\t\n\x0b\x0c\r "))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        split = (text or "").split("\n")
        kept = [line for line in split if len(key(line)) < least or len(holders[key(line)]) < documents]
        out[i, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_rows():
    rng = random.Random(8)
    pool = [f"line {k} of the Pool" for k in range(60)] + ["Über uns", " nbsp", " ", "", "x", "é"]
    rows = [(None, None), (None, "Common"), (None, "Common\ncommon"), (1, ""), (2, "\n\n"), (3, "Common\r\n\x0bCOMMON \nown"), (3, "common\nown"), (4, "common")]
    rows += [(i, "\n".join([rng.choice(["common", " Common\t", "COMMON"]), *(rng.choice(pool) for _ in range(rng.randint(0, 30)))])) for i in range(10, 90)]
    rows += [(200, "common\n" * 150_000 + "tail of a long text"), (201, "\n".join(f"unlike {k}" for k in range(150_000)))]
    return rows


@pytest.mark.parametrize(("documents", "least"), [(10, 1), (2, 2), (300, 1)])
def test_lines_against_brute_force(spark, documents, least):
    rows = line_rows()
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    got = lines.without_common_lines(docs.repartition(5), documents=documents, least=least)
    found = Counter((r["id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect())
    assert found == brute_lines(rows, documents, least)
    assert lines.without_common_lines(docs.limit(0)).count() == 0


def test_lines_when_shards_and_tasks_are_small(spark, monkeypatch):
    rows = [r for r in line_rows() if r[0] != 201]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    pairs = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(lines._hashes(1), "id long, h1 long, h2 long").distinct()
    monkeypatch.setattr(lines, "SHARD", 5)
    monkeypatch.setattr(lines, "PROBES", 20)
    index = lines.line_index(pairs)
    assert index.count() > 5 and index.agg(F.max("probes")).first()[0] > 40  # the common line's shard is probed by several tasks
    got = Counter(r["id"] for r in lines.common_lines(pairs, index).collect())
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[lowered(line.strip("\t\n\x0b\x0c\r "))].add(i)
    want = Counter(i for key, ids in holders.items() if key and len(ids) >= 10 for i in ids)
    assert got == want


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 70_000):
        numbers = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        index = lines.PerfectHash.of(numbers)
        assert sorted(index.places(numbers)) == list(range(len(numbers)))
        assert sum(len(bits) for bits in index.levels) <= 5 * len(numbers) + 64 * len(index.levels)
        again = lines.PerfectHash([np.unpackbits(np.packbits(b)).view(bool) for b in index.levels], index.rest)
        assert (again.places(numbers) == index.places(numbers)).all()
        strange = rng.integers(0, 2**63, 100).astype(np.uint64)
        assert ((index.places(strange) >= -1) & (index.places(strange) < max(1, len(numbers)))).all()


# ---- hard negatives
SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, key string, bin string, least string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def brute_negatives(rows):
    fit = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            ints = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
            fit[i, (label + 1) % 10 if i % 7 == 0 else label, ints] = None
    out = set()
    for a, la, va in fit:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in fit if len(v) == len(va) and (i, label, v) != (a, la, va)]
        for p, i, _ in sorted(s for s in scored if s[2] == la)[:5]:
            fits = sorted(s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out |= {(a, i, rank + 1, n, -p, -s) for rank, (s, n, _) in enumerate(fits[:3])}
    return out


def mined(frame):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, label=label).collect()
    found = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] + rng.standard_normal(8) * 0.4
        rows.append((i, (v * rng.choice([0.1, 1.0, 30.0]) / 3).tolist(), int(i % 6)))
    rows += [(1000, [0.0] * 8, 1), (1001, [0.0] * 8, 1), (1050, [0.0] * 8, 2), (1002, None, 1), (1003, [1.0] * 8, None), (1100, [float("nan")] * 8, 1), (1150, [None] * 8, 1), (None, [1.0] * 8, 1)]
    rows += [(1200, [1.0, 2.0], 1), (1201, [1.0, 2.5], 1), (1202, [0.5, 1.5], 2), (1250, [], 1), (1251, [], 1), (1252, [], 3), (1300, [float("inf")] + [0.0] * 7, 1)]
    rows += [(2000 + k, [0.5] * 8, 3) for k in range(60)] + [(2100 + k, [0.45] * 8, 4) for k in range(60)]  # ties
    rows += [(2000, [0.5] * 8, 3)] * 3  # equal rows count once
    rows += [(2050, [0.3] * 8, 3), (3000, [1e30] * 8, 5), (3001, [9e29] * 8, 5), (3002, [-1e30] * 8, 4)]
    return rows


def test_negatives_against_brute_force(spark, monkeypatch):
    rows = [r for r in vector_rows() if r[0] is None or r[0] < 3000]
    want = brute_negatives(rows)
    assert len(want) > 60 and any(r[4] == 0 for r in want)
    assert mined(vectors(spark, rows)) == want
    monkeypatch.setattr(negatives, "BUCKET", 40)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "SEEDS", 30)
    assert mined(vectors(spark, rows).repartition(5)) == want


def test_negatives_on_extremes(spark):
    assert {r[0] for r in mined(vectors(spark, vector_rows()))} >= {r[0] for r in brute_negatives([r for r in vector_rows() if r[0] is None or r[0] < 3000])}
    assert mined(vectors(spark, vector_rows()).limit(0)) == set()
    assert mined(vectors(spark, [(50, [1.0], 1)])) == set()


def test_feasible_ranges_lose_nothing_and_prune():
    import pandas as pd

    rng = np.random.default_rng(6)
    v = rng.standard_normal((3000, 12))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) * 256).astype(int)
    bucket = negatives.Bucket(pd.DataFrame({"id": range(3000), "label": 0, "v": list(v)}))
    kept = []
    for a in v[:60]:
        scores = v @ a
        for least in (-5.0, 0.0, *np.quantile(scores, [0.5, 0.9, 0.99, 0.999, 1.0])):
            at = bucket.candidates(a.astype(float), float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(at.tolist())
        kept.append(len(bucket.candidates(a.astype(float), float(np.quantile(scores, 0.999)))) / 3000)
    assert np.mean(kept) < 0.6
    axis = np.zeros(12)
    axis[0] = 256
    assert 0 in negatives.Bucket(pd.DataFrame({"id": [0], "label": [0], "v": [axis.astype(int)]})).candidates(axis, 256.0 * 256)
