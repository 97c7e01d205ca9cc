"""Repeated rows, clashing columns, many groups, sizes that must not matter, and registered queries against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import BLANK, make, slow_url
from tracemill.llm import decontam, langid, mixing, quality, urlfilter
from tracemill.llm.common import fold, labelled_texts, spread, table
from tracemill.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# ---- mixing
def brute_rates(sizes, target, cap=2.0):
    """The tilt min(cap, exp(lam * size / mean)) whose words meet the target, by bisection."""
    total = sum(sizes)
    mean = total / len(sizes)
    if target >= cap * total:
        return [cap if n else 1.0 for n in sizes]
    low, high = -200.0, 200.0
    for _ in range(300):
        lam = (low + high) / 2
        rates = [min(cap, math.exp(min(700, lam * n / mean))) for n in sizes]
        low, high = (lam, high) if sum(n * r for n, r in zip(sizes, rates, strict=True)) < target else (low, lam)
    return rates


def test_rates_are_the_exponential_tilt(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "en", rng.choice(["a", "b", "c", "d"])) for i in range(400)]
    got = mixing.mix_plan(make(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for mine in by.values():
        want = brute_rates([r["size"] for r in mine], mine[0]["target"])
        assert [r["rate"] for r in mine] == pytest.approx(want, rel=1e-3)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 300


@pytest.mark.parametrize("seed", range(4))
def test_rows_that_share_an_id_stay_within_the_cap(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), " ".join(["w"] * rng.choice([0, 0, 7, 10, 11])), "en", rng.choice(["a", "b"])) for _ in range(40)]
    got = mixing.mix_plan(make(spark, rows)).collect()
    copies = defaultdict(set)
    for r in got:
        assert 0 <= r["copies"] <= 2 and (r["size"] or r["copies"] == 1)
        copies[r["source"], r["id"], r["size"]].add(r["copies"])
    assert all(len(c) == 1 for c in copies.values())  # equal rows get equally many
    assert mixing.repeated(make(spark, rows)).count() == sum(r["copies"] for r in got)


def test_registered_mix_meets_its_targets(spark):
    got = QUERIES["op1_entropy_mix"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: r for r in table(spark, SF_DIR, "documents").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == len(BLANK.findall(texts[r["doc_id"]]["text"] or "")) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 for s in target)


def test_a_source_without_words_has_target_0(spark):
    rows = [(1, None, "en", "y"), (2, "", "en", "y"), (3, "a b c", "en", "x"), (4, "d", "en", None)]
    got = {r["id"]: r for r in mixing.mix_plan(make(spark, rows)).collect()}
    assert len(got) == 4 and all((got[i]["target"], got[i]["source_size"], got[i]["copies"]) == (0, 0, 1) for i in (1, 2))
    assert got[3]["target"] > 0 and mixing.repeated(make(spark, rows)).count() >= 4
    blank = mixing.mix_plan(make(spark, rows[:2])).collect()
    assert [(r["target"], r["copies"]) for r in blank] == [(0, 1), (0, 1)]


# ---- urls
def brute_scores(edges, good, bad, damping=0.85):
    hosts = sorted({h for e in edges for h in e} | set(good) | set(bad))
    at = {h: i for i, h in enumerate(hosts)}
    a = np.zeros((len(hosts), len(hosts)))
    for s, d in edges:
        a[at[s], at[d]] = 1
    share = lambda m: m / np.maximum(1, m.sum(axis=1, keepdims=True))
    out = []
    for matrix, seeds in ((share(a), good), (share(a.T), bad)):
        home = np.array([(1 - damping) * seeds.get(h, 0.0) for h in hosts])
        out.append(np.linalg.solve(np.eye(len(hosts)) - damping * matrix.T, home))
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


def test_scores_are_the_limit_of_pagerank(spark):
    rng = random.Random(9)
    edges = {(f"h{rng.randrange(40)}", f"h{rng.randrange(40)}") for _ in range(120)}
    edges = sorted(e for e in edges if e[0] != e[1])
    judged = [(f"h{i}", rng.choice(["allow", "block", None])) for i in range(0, 40, 2) for _ in range(3)]
    share = lambda v: {h: sum(x == (h, v) for x in judged) / 3 for h, _ in judged}
    want = brute_scores(edges, share("allow"), share("block"))
    rows = urlfilter.host_scores(spark.createDataFrame(judged, "host string, verdict string"), spark.createDataFrame(edges, "src string, dst string")).collect()
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows}
    for h, (t, d) in want.items():
        for mine, exact in zip(got.get(h, (0.0, 0.0)), (t, d), strict=True):
            assert mine <= exact + 1e-9 and exact - mine <= urlfilter.TOLERANCE * max(exact, urlfilter.FLOOR)


def test_verdicts_do_not_depend_on_unrelated_hosts(spark):
    pages = [(1, "http://a.example.com/de/1", ""), (2, "http://a.example.com/de/2", ""), (3, "http://a.example.com/x", ""), (4, "http://b.test/", '<a href="http://a.example.com/">'), (5, "http://c.org/fr/", '<a href="http://d.test/x">'), (6, "http://d.test/", "")]
    more = [(100 + i, f"http://h{i}.net/", f'<a href="http://k{i}.test/">') for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = [{r["id"]: (r["verdict"], round(r["trust"], 9), round(r["distrust"], 9)) for r in urlfilter.judged(frame(rows)).collect()} for rows in (pages, pages + more)]
    assert {i: verdicts[1][i] for i in verdicts[0]} == verdicts[0]
    assert verdicts[0][3][0] == "block" and verdicts[0][6][0] == "allow"


def test_registered_url_query(spark):
    got = {r["page_id"]: r for r in QUERIES["op8_url_linkgraph"](spark, SF_DIR).collect()}
    pages = table(spark, SF_DIR, "pages").collect()
    plain = {p["page_id"]: slow_url(p["url"]) for p in pages}
    verdict, share = dict(urlfilter.RULES), {"allow": Counter(), "block": Counter()}
    count, edges = Counter(h for h, _, _ in plain.values() if h), set()
    for h, _, rule in plain.values():
        if h and rule:
            share[verdict[rule]][h] += 1 / count[h]
    assert not any("//" in (p["html"] or "") and "href" in p["html"] and "://" in p["html"] for p in pages)  # no links to other hosts
    for h in count:
        labels = h.split(".")
        tails = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
        edges |= {e for a, b in zip(tails, tails[1:], strict=False) for e in ((a, b), (b, a))}
    scores = brute_scores(sorted(edges), share["allow"], share["block"]) if edges else {}
    for i, (h, path, rule) in plain.items():
        t, d = scores.get(h, (0.0, 0.0))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, path, rule)
        want = verdict[rule] if rule else "block" if d > t and d >= urlfilter.FLOOR else "allow"
        assert got[i]["verdict"] == want or abs(d - t) < 0.01 or abs(d - urlfilter.FLOOR) < 0.01


# ---- learned operators
def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i) * 5, f"l{i:04d}", "s") for i in range(1050)]
    assert len(langid.learn(make(spark, rows)).languages) == 1050


def test_samples_are_bounded_by_bytes_not_by_length(spark):
    rows = [(i, "x" * (300_000 if i % 3 == 0 else 100), "en", "s") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, 1), (2, None)], "doc_id long, toxic int")
    usable = {i for i in range(30) if zlib.crc32(str(i).encode()) % 5}
    whole = labelled_texts(make(spark, rows), labels, "toxic", 1000)
    assert {(r[0], len(r[1]), r[2]) for r in whole} == {(i, len(rows[i][1]), i % 2) for i in usable}
    some = labelled_texts(make(spark, rows), labels, "toxic", 1000, most_bytes=700_000)
    assert max(len(r[1]) for r in some) == 300_000 and all(sum(len(r[1]) for r in some if r[2] == v) <= 700_000 for v in (0, 1))
    assert {r[0] for r in some if len(r[1]) == 100} == {i for i in usable if i % 3}


def test_an_id_on_many_rows_gives_one_text(spark):
    docs = spark.range(2000).selectExpr("7L as doc_id", "concat(repeat('x', 10000), id % 1500) as text", "'en' as lang", "'s' as source")
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(8, "other", "en", "s")], docs.schema))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id long, toxic int")
    got = labelled_texts(docs, labels, "toxic", 1000)
    assert [(i, len(t) > 9000, v) for i, t, v in got] == [(7, True, 1), (8, False, 0)]
    assert got == labelled_texts(docs.repartition(3), labels, "toxic", 1000)


@pytest.mark.parametrize("shared", range(5))
def test_languages_of_rows_that_share_an_id_are_learned(spark, shared):
    rows = spark.range(3000).selectExpr(f"{shared}L as doc_id", "concat('the word ', id) as text", "'en' as lang")
    equal = spark.range(3000).selectExpr(f"{shared}L as doc_id", "'das Wort' as text", "'de' as lang")
    known = langid.learn(rows.unionByName(equal), per_language=100)
    assert known.languages == ["de", "en"] and known.predict("the word", langid.TOP)[0] == "en"


def test_a_single_row_group_is_dealt_to_every_core(spark, tmp_path):
    spark.range(4000).selectExpr("id", "sha2(cast(id as string), 512) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() > 1
        held = spread(scan).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(held) == spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 2000


def brute_near(documents, items):
    """(document, item) by the definition, place by place."""
    holders = Counter(t for words in documents.values() for t in set(words))
    out = set()
    for item, terms in items.items():
        place = {t: terms.index(t) for t in terms}
        need = math.ceil(len(place) * 4 / 5)
        if len(place) < 2:
            continue
        order = sorted(place, key=lambda t: (holders[t], decontam.term(t)))
        rare = order[: len(place) - need + min(decontam.RARE, need)]
        size = min(len(terms), decontam.WINDOW)
        windows = {tuple(terms[s : s + size]) for s in range(len(terms) - size + 1)}
        for d, words in documents.items():
            if any(tuple(words[s : s + size]) in windows for s in range(len(words) - size + 1)):
                continue
            where = defaultdict(list)
            for at, w in enumerate(words):
                where[w].append(at)
            starts = [at - place[t] for t in rare for at in where[t]]
            for s in starts:
                around = sum(abs(s - other) <= decontam.SLOP for other in starts)
                if around >= len(rare) - (len(place) - need) and sum(any(abs(s + p - at) <= decontam.SLOP for at in where[t]) for t, p in place.items()) >= need:
                    out.add((d, item))
                    break
    return out


def test_near_benchmark_items_against_brute_force(spark):
    documents = {r["doc_id"]: decontam.words(r["text"]) for r in table(spark, SF_DIR, "documents").collect()}
    items = {str(r["item_id"]): decontam.words(r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["near_benchmark_items"](spark, SF_DIR).collect()}
    assert got == brute_near(documents, items)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    item = {str(k): [rng.choice(words) for _ in range(rng.randint(2, 30))] for k in range(20)}
    texts = {}
    for d in range(120):
        base = list(rng.choice(list(item.values())))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(base))
            base[at : at + rng.randint(0, 1)] = rng.choice([[], ["odd"], [rng.choice(words)]])
            base = base or ["none"]
        texts[d] = [rng.choice(words) for _ in range(rng.randint(0, 40))] + base + [rng.choice(words) for _ in range(rng.randint(0, 40))]
    frame = make(spark, [(d, " ".join(w), "en", "s") for d, w in texts.items()])
    found = decontam.matches(frame, spark.createDataFrame([(int(k), " ".join(w)) for k, w in item.items()], "item_id long, text string"))
    brute = brute_near({d: decontam.words(" ".join(w)) for d, w in texts.items()}, {k: decontam.words(" ".join(w)) for k, w in item.items()})
    assert {(r["id"], n) for r in found.collect() for n in r["near"]} == brute and len(brute) > 20


def test_registered_language_query_is_the_out_of_place_distance(spark):
    docs = table(spark, SF_DIR, "documents")
    profiles = langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: r for r in QUERIES["op5_rank_order_langid"](spark, SF_DIR).collect()}
    for r in docs.collect():
        counts = Counter()
        for gram, n in langid.grams(r["text"] or "").items():
            counts[profiles.code(gram)] += n
        mine = sorted(counts, key=lambda c: (-counts[c], c))[: langid.TOP]
        costs = []
        for k in range(len(profiles.languages)):
            rank = {int(c): int(x) for c, x in zip(profiles.known, profiles.ranks[k], strict=False) if x >= 0}
            costs.append(sum(abs(rank[c] - p) if c in rank else langid.TOP for p, c in enumerate(mine)))
        if not mine:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        best = min(range(len(costs)), key=lambda k: (costs[k], profiles.languages[k]))
        assert got[r["doc_id"]]["lang_pred"] == profiles.languages[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - costs[best] / (langid.TOP * len(mine)))
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_equal_costs_go_to_the_first_language():
    profiles = langid.Profiles({"zz": ["x", "y"], "aa": ["x", "y"], "mm": ["y", "x"]})
    assert profiles.predict("xx y", 2)[0] == "aa"


def test_registered_quality_query_is_the_cumulative_link(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in QUERIES["op6_ordinal_quality"](spark, SF_DIR).collect()}
    for r in docs.collect():
        counts = np.zeros(quality.BUCKETS)
        raw = b" " + (r["text"] or "").encode() + b" "
        words = BLANK.findall(r["text"] or "")
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            counts[((a * 961 + b * 31 + c) * 40503 >> 4) & (quality.BUCKETS - 1)] += 1
        for w in words:
            counts[int(quality.word_hashes([w.encode()])[0][0] >> np.uint64(40)) & (quality.BUCKETS - 1)] += 1
        x = np.log1p(counts) if words else counts * 0
        x = x / (np.linalg.norm(x) or 1.0)
        tail = 1 - 1 / (1 + math.exp(-(model.thresholds[-1] - float(x @ model.weights)))) if len(model.thresholds) else 1.0
        assert got[r["doc_id"]]["tail_probability"] == pytest.approx(tail, abs=1e-4)
        assert got[r["doc_id"]]["accepted"] == (got[r["doc_id"]]["tail_probability"] >= quality.ACCEPT)


def test_registered_toxicity_query_ranks_held_out_texts(spark):
    large = "/root/testdata/sf0.1"  # sf0.01 holds out six toxic texts only
    rows = QUERIES["op3_toxicity_bigru"](spark, large).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, large, "labels").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(rows) == table(spark, large, "documents").count() and ones and zeros
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) >= 0.95 * len(ones) * len(zeros)


# ---- sharding
def test_registered_sharding_query(spark):
    got = QUERIES["op10_kd_shards"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF_DIR, "documents").collect()}
    by = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        by[r["shard"]].append(r)
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and set(by) <= set(range(24))
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    # A cut misses its share by half a document at most, so a shard by half a document a level.
    mean, most = sum(len(t) + 8 for t in texts.values()) / 24, max(len(t) + 8 for t in texts.values())
    assert all(abs(sum(r["size"] for r in g) - mean) <= 2.5 * most for g in by.values())


# ---- names that clash
NAMES = "_key _tag shard slot row id k1 k2 h1 h2 tag first component copies size node leaf print source_size bucket crc ties d0 dim code shards target rate text_ _s last_id".split()


def test_columns_of_any_name_pass_through_the_pipeline(spark):
    import corpus_pipeline
    from tracemill.llm.common import keep

    df = table(spark, SF_DIR, "documents")
    for name in NAMES:
        df = df.withColumn(name, F.lit("x"))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        df = keep(stage(spark, df, SF_DIR), name)
        own = [c for c in NAMES if c not in ("shard", "slot") or name != "sharding"]
        assert sorted(df.columns) == sorted(columns) and df.count() > 0
        assert df.where(" or ".join(f"`{c}` is null or `{c}` <> 'x'" for c in own)).count() == 0
    assert dict(df.dtypes)["shard"] == "int" and dict(df.dtypes)["slot"] == "bigint"
