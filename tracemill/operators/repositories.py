"""Directories and the repositories they lie in; session trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from . import trees


def resolve_repositories(projects: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path, repository_root): the deepest of the known roots at or above each path, or null. Roots are a table
    with a column root; every path is joined by all its own ancestors, however deep it is."""
    parts = F.split(F.regexp_replace("path", "(?<=.)/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("root")))
    steps = projects.select("path").distinct().select("path", F.explode(above).alias("s"))
    steps = steps.select("path", "s.depth", F.when(F.col("s.root") == "", "/").otherwise(F.col("s.root")).alias("root"))
    best = steps.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("repository_root"))
    return projects.drop("repository_root").join(best, "path", "left")


def link_repositories(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Gives facts without a repository that of their project."""
    known = projects.select(F.col("id").alias("_project"), F.col("repository_root").alias("_root"))
    linked = facts.join(known, F.col("project_id") == F.col("_project"), "left")
    return linked.withColumn("repository_root", F.coalesce("repository_root", "_root")).drop("_project", "_root")


def backfill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows had no repository before and after."""
    sides = before.select(F.col("repository_root").isNull().alias("missing"), F.lit(0).alias("side")).unionByName(after.select(F.col("repository_root").isNull().alias("missing"), F.lit(1).alias("side")))
    return sides.agg(F.count_if((F.col("side") == 0) & F.col("missing")).alias("missing_before"), F.count_if((F.col("side") == 1) & F.col("missing")).alias("missing_after"))


def session_descendants(sessions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root_id, member_id, depth) of every session or of the given roots (column id), itself included at depth 0; a member of a cycle
    counts once. A session has one parent: of several rows of an id the greatest parent counts.

    The parents are written once. Of given roots a round adds a level, and as parents are single only a root can be met again. Of all sessions a round
    doubles the depth covered: what is known so far is joined to the ancestors a power of two above, so a chain of n sessions takes log n rounds."""
    spark = sessions.sparkSession
    where = scratch(spark, "parents")
    told = sessions.where("parent_session_id is not null").groupBy(F.col("id").alias("node")).agg(F.max("parent_session_id").alias("up"))
    told.write.parquet(where)
    parents = spark.read.schema(told.schema).parquet(where)
    own = (roots if roots is not None else sessions).select(F.col("id").alias("root_id"), F.col("id").alias("member_id"), F.lit(0).alias("depth"))
    pairs = own.distinct().checkpoint()
    return _below(pairs, parents) if roots is not None else _doubled(pairs, parents)


def _below(found: DataFrame, parents: DataFrame) -> DataFrame:
    frontier, depth = found, 0
    while True:
        depth += 1
        below = frontier.join(parents, F.col("member_id") == F.col("up")).where("node <> root_id")
        frontier = below.select("root_id", F.col("node").alias("member_id"), F.lit(depth).alias("depth")).checkpoint()
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def _doubled(pairs: DataFrame, jump: DataFrame) -> DataFrame:
    step, cycles, before = 1, False, 0
    while True:
        more = pairs.join(jump, F.col("root_id") == F.col("node")).select(F.col("up").alias("root_id"), "member_id", (F.col("depth") + step).alias("depth"), F.lit(1).alias("new"))
        both = pairs.withColumn("new", F.lit(0)).unionByName(more)
        if cycles:
            both = both.groupBy("root_id", "member_id").agg(F.min("depth").alias("depth"), F.max("new").alias("new"))
        both = both.checkpoint()
        rows, added, met = both.agg(F.count("*"), F.max("new"), F.count_if((F.col("root_id") == F.col("member_id")) & (F.col("depth") > 0))).first()
        if not added or (cycles and rows == before):
            return both.drop("new")
        if met and not cycles:
            cycles = True
            both = both.groupBy("root_id", "member_id").agg(F.min("depth").alias("depth"), F.max("new").alias("new")).checkpoint()
            rows = both.count()
        pairs, before, step = both.drop("new"), rows, step * 2
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up").checkpoint()


def in_tree(facts: DataFrame, closure: DataFrame, root=None) -> DataFrame:
    """The facts of a root's tree; without a root those of every tree, each with its root_id. ``closure`` is what ``session_descendants`` gives, a row a pair,
    or what ``trees.tree_labels`` gives, a row a session."""
    labels = "low" in closure.columns
    if root is not None:
        found = trees.below(closure, root) if labels else closure.where(F.col("root_id") == root)
        members = found.select(F.col("member_id").alias("_member"))
        return facts.join(members, F.col("session_id") == F.col("_member"), "left_semi").withColumn("root_id", F.lit(root))
    members = (trees.members(closure) if labels else closure).select("root_id", F.col("member_id").alias("_member"))
    return facts.join(members, F.col("session_id") == F.col("_member")).drop("_member")
