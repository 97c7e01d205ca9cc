"""URL filters: rules, and trust spread over the host graph where no rule fits. DataFrame operations only.

A rule names a host and a path prefix; it fits the host and all its subdomains, and the longest fitting rule decides.
For the other pages a score of their host decides. A host is a trusted seed by the share of its pages that rules allow, and a blocked
seed by the share that rules block. Trust is a personalised PageRank from the trusted seeds along the edges; distrust is
one from the blocked seeds against them, since who links to a blocked host is suspect. Both are sums over the seeds, not divided by their number,
so the verdict on a host depends on what is linked to it and not on the size of the table. A host is blocked where
distrust is over ``BLOCK_SHARE`` of both and at least ``FLOOR``, half of what a host whose pages are all blocked has of its own; it is allowed otherwise, so that neither a
host which nothing reaches nor one which only shares a large domain with a blocked one is blocked.

Edges: absolute links in ``html`` (href and src) from the page's host to the link's, and, both ways, between a host and the domain
above it, down to two labels. Repeated edges count once. A step is one join and one aggregation over distinct edges, combined
before the shuffle; nothing is collected, and every ``STEPS`` steps a checkpoint cuts the plan off. Steps go on until what they can still add to any host
is at most ``TOLERANCE`` of its scores or of ``FLOOR``; as each step brings at most ``DAMPING`` of the one before, they end.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule, is no node, and is allowed. A null html has no
links. Repeated rows are each returned; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint, keep

DAMPING, STEPS, TOLERANCE, BLOCK_SHARE = 0.85, 4, 0.02, 0.5
#: A host whose pages are all blocked has 1 - DAMPING of its own.
FLOOR = (1 - DAMPING) / 2
#: (rule, verdict); a rule is a host, then a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null; of equally long ones the first in order."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + rest)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of a table with host and html."""
    named = pages.where("host <> ''")
    links = named.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.regexp_replace(F.translate("dst", _UPPER, _LOWER), r"^.*@|:\d*$", "").alias("dst"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    steps = F.transform(F.sequence(F.lit(1), F.size("tails") - 1), lambda i: F.struct(F.element_at("tails", i).alias("low"), F.element_at("tails", i + 1).alias("high")))
    above = named.select("host").distinct().select(tails.alias("tails")).where(F.size("tails") > 1).select(F.explode(steps).alias("s"))
    both = above.select(F.col("s.low").alias("src"), F.col("s.high").alias("dst")).distinct()
    return links.unionByName(both).unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst and dst <> ''").distinct()


def host_scores(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from (host, verdict) rows, one a page, whose verdict is null where no rule fits, and distinct (src, dst) edges."""
    share = lambda v: F.count_if(F.col("verdict") == v) / F.count("*")
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")).where("good + bad > 0")
    seeds = keep(seeds, "host-seeds")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("into"))
    weighted = edges.join(out, "src").join(into, "dst")
    moves = weighted.select(F.col("src").alias("from"), F.col("dst").alias("to"), (1.0 / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    back = weighted.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (1.0 / F.col("into")).alias("d"))
    moves = keep(moves.unionByName(back).groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "host-moves")
    # What moves in a step; the scores are the sums of all steps. It shrinks by the damping at least.
    moving = seeds.select("host", (F.col("good") * (1 - DAMPING)).alias("trust"), (F.col("bad") * (1 - DAMPING)).alias("distrust"))
    scores = moving
    while True:
        arrived = []
        for _ in range(STEPS):
            sent = moves.join(moving, F.col("from") == F.col("host"))
            moving = sent.groupBy(F.col("to").alias("host")).agg(F.sum(F.col("t") * F.col("trust") * DAMPING).alias("trust"), F.sum(F.col("d") * F.col("distrust") * DAMPING).alias("distrust"))
            arrived.append(moving)
        rows = scores.select("host", "trust", "distrust", F.lit(0.0).alias("t"), F.lit(0.0).alias("d"))
        for step in arrived:
            last = step is arrived[-1]
            rows = rows.unionByName(step.select("host", "trust", "distrust", *[(F.col(c) if last else F.lit(0.0)).alias(c[0]) for c in ("trust", "distrust")]))
        state = checkpoint(rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]))
        scores, moving = state.select("host", "trust", "distrust"), state.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
        rest = DAMPING / (1 - DAMPING)
        open_ = F.lit(False)
        for moved, score in (("t", "trust"), ("d", "distrust")):
            open_ = open_ | (F.col(moved) * rest > TOLERANCE * F.greatest(F.col(score), F.lit(FLOOR)))
        if state.where(open_).isEmpty():
            return scores


def judged(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    url = F.col(url_col)
    plain = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), F.col(html_col).alias("html"))
    edges = keep(host_edges(plain), "host-edges")
    verdict = F.create_map(*[F.lit(x) for r in rules for x in r])
    ruled = plain.select("id", "host", "path").withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict[F.col("rule")])
    scores = host_scores(ruled.select("host", "verdict"), edges)
    share = F.coalesce(F.try_divide("distrust", F.col("trust") + F.col("distrust")), F.lit(0.0))
    by_host = F.when((share > BLOCK_SHARE) & (F.col("distrust") >= FLOOR), "block").otherwise("allow")
    return ruled.join(by_size(scores), "host", "left").select("id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
