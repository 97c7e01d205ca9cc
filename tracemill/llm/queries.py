"""The registered queries of the corpus operators: each reads its whole table and derives the stated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed, langid, lines, mixing, negatives, quality, sharding, simhash, spelling, substring, toxicity, urlfilter
from .common import fold, spread, table

SHARDS = 24


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies")


def op2_positional_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest has no column for near matches: near_benchmark_items returns them.
    found = decontam.matches(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), proximity=False)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        decontam.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def near_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity half of decontamination: (doc_id, item_id) where an item is near a passage of a document without standing in it."""
    found = decontam.matches(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.explode("near").alias("item_id"))


def op3_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("id"), 5) == 0, F.lit(False))
    scored = toxicity.score(_texts(spark, sf_dir), network)
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(_texts(spark, sf_dir))
    return linked.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    profiles = langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False))
    return langid.predict(_texts(spark, sf_dir), profiles).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    graded = quality.grade(_texts(spark, sf_dir), model)
    held_out = F.coalesce(fold(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return graded.select("row.doc_id", held_out.alias("held_out"), "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= quality.ACCEPT).alias("accepted"))


def op7_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.without_repeats(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_url_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = urlfilter.judged(table(spark, sf_dir, "pages"))
    return verdicts.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embed.near_duplicates(table(spark, sf_dir, "embeddings"))
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_plan(table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fst_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_texts(spark, sf_dir), deletes=199))


def op12_line_mphf(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.without_common_lines(_texts(spark, sf_dir))
    return left.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OPERATORS = [
    op1_entropy_mix,
    op2_positional_decontam,
    op3_toxicity_bigru,
    op4_simhash_bktree,
    op5_rank_order_langid,
    op6_ordinal_quality,
    op7_substring_doubling,
    op8_url_linkgraph,
    op9_rp_forest,
    op10_kd_shards,
    op11_fst_spelling,
    op12_line_mphf,
    op13_lemp_negatives,
    near_benchmark_items,
]
QUERIES = {f.__name__: f for f in OPERATORS}
#: Where SQL can express the whole result: DuckDB over the same tables.
ORACLE_SQL: dict[str, str] = {
    "op2_positional_decontam": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
phrases AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(ws[i + 1:i + size], ' ') AS phrase FROM (SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
windows AS (SELECT doc_id, size, i, array_to_string(ws[i + 1:i + size], ' ') AS phrase FROM (SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM phrases) WHERE len(ws) >= size)),
found AS (SELECT doc_id, item, w.size, i FROM windows w JOIN phrases p ON w.phrase = p.phrase AND w.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""",
    "op7_substring_doubling": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS phrase FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT phrase, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (phrase) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON d.doc_id = g.doc_id""",
    "op12_line_mphf": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, place, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text FROM k ANTI JOIN common USING (key) GROUP BY 1)
SELECT d.doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op13_lemp_negatives": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
