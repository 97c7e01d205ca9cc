"""Session trees as intervals: one row a session, in which a tree is a range of numbers.

The sessions of a tree are numbered as a walk meets them, a parent before its children, so what lies below a session is the range from its own
number to its last descendant's. The walk enters and leaves every session once. Each step names the next one, and pointer doubling adds up what is left of the walk, so a
tree of n sessions takes log n rounds and 2 n rows, also where it is a chain, and no task sees a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Children of one parent that are put in order together.
SIBLINGS = 65_536


def _cycles(parents: DataFrame) -> DataFrame | None:
    """(member, head) of every session on a cycle, the head being its least member; None without a cycle."""
    far, most = parents.withColumn("least", F.col("node")), parents.count()
    step = 1
    while step <= most:
        # What has an ancestor 2 * step above stays; after enough rounds only what leads to a cycle does.
        above = far.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        far = far.join(above, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"), F.least("least", "_least").alias("least")).checkpoint()
        if far.isEmpty():
            return None
        step *= 2
    # So many steps up, every session has come to one on the cycle, and those are all on it.
    return far.join(far.select(F.col("up").alias("_up")).distinct(), F.col("node") == F.col("_up"), "left_semi").select(F.col("node").alias("member"), F.col("least").alias("head"))


def _siblings(edges: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """(up, child), the first child of each parent, and (node, beside), the next child of the same parent or null.

    Children are in order of a bucket of their hash, then their id; a parent of very many has many buckets, and only the buckets' first children meet in one window."""
    counts = edges.groupBy("up").agg(F.ceil(F.count("*") / F.lit(float(together))).cast("int").alias("_buckets"))
    rows = edges.join(counts, "up").withColumn("_bucket", F.pmod(F.xxhash64("node"), F.col("_buckets")).cast("int"))
    heads = rows.groupBy("up", "_bucket").agg(F.min("node").alias("_head"))
    by_bucket = Window.partitionBy("up").orderBy("_bucket")
    following = heads.select("up", "_bucket", F.lead("_head").over(by_bucket).alias("_after"))
    within = Window.partitionBy("up", "_bucket").orderBy("node")
    beside = rows.join(following, ["up", "_bucket"]).select("node", F.coalesce(F.lead("node").over(within), "_after").alias("beside"))
    return heads.groupBy("up").agg(F.min_by("_head", "_bucket").alias("child")), beside


def tree_labels(sessions: DataFrame, together: int = SIBLINGS) -> DataFrame:
    """(id, tree, low, high, depth) of every session and every parent told: the top of its tree, its number there, that of the last session below it, and the levels above it.

    Numbers end with -1 at the last session of a tree. A session has one parent: of several rows of an id the greatest parent counts. All members of a cycle are above all
    others of it, so they share the numbers of the whole tree, and its top is the least of them."""
    spark = sessions.sparkSession
    parents = stored(sessions.where("parent_session_id is not null").groupBy(F.col("id").alias("node")).agg(F.max("parent_session_id").alias("up")), "tree-parents")
    everyone = sessions.select("id").where("id is not null").unionByName(parents.select(F.col("up").alias("id"))).distinct()
    cycles = _cycles(parents)
    edges = parents
    if cycles is not None:
        cycles = cycles.checkpoint()
        edges = edges.join(cycles, F.col("node") == F.col("member"), "left_anti").join(cycles, F.col("up") == F.col("member"), "left").select("node", F.coalesce("head", "up").alias("up"))
    edges = edges.checkpoint()
    first, beside = _siblings(edges, together)
    nodes = edges.select("node").unionByName(edges.select(F.col("up").alias("node"))).distinct()
    known = nodes.join(edges, "node", "left").join(beside, "node", "left").join(first.withColumnRenamed("up", "node"), "node", "left")
    # A step is entering (0) or leaving (1) a session; after the last child its parent is left, and after the top nothing follows.
    step = lambda node, out: F.struct(node.alias("node"), F.lit(out).alias("out"))
    entering = F.struct(F.lit(0).alias("out"), F.coalesce(F.when(F.col("child").isNotNull(), step(F.col("child"), 0)), step(F.col("node"), 1)).alias("next"))
    leaving = F.struct(F.lit(1).alias("out"), F.when(F.col("beside").isNotNull(), step(F.col("beside"), 0)).when(F.col("up").isNotNull(), step(F.col("up"), 1)).alias("next"))
    walk = known.select("node", F.explode(F.array(entering, leaving)).alias("e")).select("node", "e.out", F.col("e.next.node").alias("to"), F.col("e.next.out").alias("to_out"))
    count = lambda out: F.when(F.col("out") == out, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    walk = walk.select("*", count(0).alias("enters"), count(1).alias("leaves"), F.col("node").alias("last")).checkpoint()
    while not (open_ := walk.where("to is not null")).isEmpty():
        ahead = walk.select(F.col("node").alias("to"), F.col("out").alias("to_out"), *[F.col(c).alias(f"_{c}") for c in ("to", "to_out", "enters", "leaves", "last")])
        moved = open_.join(ahead, ["to", "to_out"]).select("node", "out", F.col("_to").alias("to"), F.col("_to_out").alias("to_out"), (F.col("enters") + F.col("_enters")).alias("enters"), (F.col("leaves") + F.col("_leaves")).alias("leaves"), F.col("_last").alias("last"))
        walk = moved.unionByName(walk.where("to is null")).checkpoint()
    at = lambda c, out: F.max(F.when(F.col("out") == out, F.col(c)))
    told = walk.groupBy("node").agg(F.max("last").alias("tree"), (-at("enters", 0)).alias("low"), (-at("enters", 1) - 1).alias("high"), (at("leaves", 0) - at("enters", 0)).cast("int").alias("depth"))
    if cycles is not None:
        others = cycles.where("member <> head").join(told, F.col("head") == F.col("node")).select(F.col("member").alias("node"), "tree", "low", "high", "depth")
        # A cycle of which nothing hangs and whose head is alone has no walk.
        bare = cycles.join(told, F.col("head") == F.col("node"), "left_anti").select(F.col("member").alias("node"), F.col("head").alias("tree"), *_alone())
        told = told.unionByName(others).unionByName(bare)
    told = told.withColumnRenamed("node", "id")
    alone = everyone.join(told.select("id"), "id", "left_anti").select("id", F.col("id").alias("tree"), *_alone())
    return stored(told.unionByName(alone), "tree-labels")


def _alone():
    return F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).alias("depth")


def below(labels: DataFrame, root) -> DataFrame:
    """(member_id) of one root's tree: a range of one tree's numbers. Only the root's own row is broadcast."""
    span = labels.where(F.col("id") == root).select(F.col("tree").alias("_tree"), F.col("low").alias("_low"), F.col("high").alias("_high")).limit(1)
    return labels.join(F.broadcast(span), (F.col("tree") == F.col("_tree")) & F.col("low").between(F.col("_low"), F.col("_high"))).select(F.col("id").alias("member_id"))


def members(labels: DataFrame) -> DataFrame:
    """(root_id, member_id, depth) of all roots, for what needs every pair; nothing but the labels is stored. depth counts 0 between members of a cycle.

    A range is cut into the blocks of 1, 2, 4 ... numbers that cover it, at most two of a size, and a member is in one block of each size; so the join meets only
    pairs that are in the result."""
    widest = labels.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(widest).bit_length()))).alias("level")
    by_level = lambda c: F.expr(f"shiftright({c}, level)")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    spans = labels.select("id", "tree", "depth", "low", (F.col("high") + 1).alias("end"), levels).withColumn("upto", by_level("end"))
    spans = spans.withColumn("from", -F.expr("shiftright(-low, level)")).where(F.col("from") < F.col("upto"))
    blocks = F.array_compact(F.array(F.when(odd("from"), F.col("from")), F.when(odd("upto"), F.col("upto") - 1)))
    roots = spans.select(F.col("id").alias("root_id"), "tree", "level", F.col("depth").alias("_above"), F.explode(blocks).alias("block"))
    inside = labels.select(F.col("id").alias("member_id"), "tree", "depth", "low", levels).withColumn("block", by_level("low"))
    return roots.join(inside, ["tree", "level", "block"]).select("root_id", "member_id", (F.col("depth") - F.col("_above")).alias("depth"))


def tree_totals(facts: DataFrame, labels: DataFrame, measures: list[str], block: int = 65_536) -> DataFrame:
    """(root_id, rows, *measures): the number of facts and the sums of the measures below every root, 0 where it has none, without a row a pair.

    Facts are added up by session and then along the numbers of a tree, first within blocks of numbers and then over the blocks' sums; what lies below a
    root is the difference of two of these sums, so a chain takes as many rows as it has sessions. Measures are whole numbers; nulls count as 0."""
    names = ["rows", *measures]
    own = facts.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in measures])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    placed = labels.join(own, "id", "left").groupBy("tree", "low").agg(*[F.sum(zero(n)).alias(n) for n in names]).withColumn("_block", F.floor(F.col("low") / block))
    placed = stored(placed, "tree-places")
    before = Window.partitionBy("tree").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("tree", "_block").agg(*[F.sum(n).alias(n) for n in names])
    blocks = blocks.select("tree", "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
    within = Window.partitionBy("tree", "_block").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(blocks, ["tree", "_block"]).select("tree", "low", *[(F.sum(n).over(within) + F.col(f"_{n}")).alias(f"upto_{n}") for n in names], *[F.col(n).alias(f"own_{n}") for n in names])
    upto = stored(upto, "tree-sums")
    ends = upto.select("tree", F.col("low").alias("_at"), *[F.col(f"upto_{n}").alias(f"end_{n}") for n in names])
    # A cycle's members share a number, and the numbers of the others they stand for are not used, so the last number of a range is always there.
    spans = labels.join(upto, ["tree", "low"]).join(ends.withColumnRenamed("_at", "high"), ["tree", "high"])
    return spans.select(F.col("id").alias("root_id"), *[(F.col(f"end_{n}") - F.col(f"upto_{n}") + F.col(f"own_{n}")).cast("long").alias(n) for n in names])
