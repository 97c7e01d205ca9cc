"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Among all rates ``0 <= r_i <= cap`` whose words meet each source's target, entropy balancing takes those
nearest to 1 in relative entropy. Its convex dual has one multiplier a source, and the rates are the
exponential tilt ``r_i = min(cap, exp(lambda_s * size_i / mean_s))``. Newton steps, kept inside a bracket
that provably holds the root, run over the (source, size) histogram, not over documents. A fixed draw of
each document then rounds its rate to copies; one shift a source, and at last one document, bring the words taken to the target.

Nulls: a null text has size 0, a null source is a source of its own, ranked last; a null id draws like
any other value. Documents without words have rate 1, as the tilt says, and one copy, which takes no words. Rows that are equal in source, id and
size draw alike and get as many copies; those that share only the id do not. A source of no words has target 0. An empty
table gives an empty result. Columns of the input beyond those named stay in ``row`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, checkpoint, keep, measured, uniform

BINS = 4096


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n, source_size) to (source, source_size, mean, target): ``share`` of all sizes dealt by weight.

    The weights repeat over the sources in code-point order, null last. No target passes ``cap`` times
    its source's size; what is over is dealt again by weight until none is above. That is a water level:
    in the order of cap * size / weight the sources that stop come first.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    before = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("level", (F.lit(float(share)) * F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("stops", F.col("level") > F.col("ratio"))
        .withColumn("final", F.min(F.when(~F.col("stops"), F.struct("ratio", "k", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("stops") | F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("final")))
    return level.select("source", "source_size", (F.col("source_size") / F.col("n")).alias("mean"), target.alias("target"))


def _few(small: DataFrame, few: bool) -> DataFrame:
    """A table of at most a row a source, marked for broadcast if the sources, which are counted once, are few."""
    return F.broadcast(small) if few else small


def fit_mix(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, tolerance: float = 1e-6) -> DataFrame:
    """(id, source, size) to one row a source: source, source_size, mean, target, lam, shift.

    Newton steps go on until every source's words are within ``tolerance`` of its target, or its multiplier moves no more. A step
    that is outside the bracket, or follows one that did not halve the gap, is replaced by the bracket's middle, so the loop ends.

    Every query of the loop leaves plans and threads in the driver for a while. So the state goes with the histogram's rows into the sums: a step takes one
    broadcast and one shuffle."""
    histogram = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sizes = histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    most = F.lit(float(cap))
    state, sources = measured(
        targets(sizes, weights, share, cap)
        .withColumn("lam", F.lit(0.0))
        .withColumn("low", F.col("mean") * F.least(F.lit(0.0), F.log(F.try_divide("target", "source_size"))))  # a source of no words: 0
        .withColumn("high", F.col("mean") * F.log(most))
        .withColumn("gap", F.lit(2.0))
        .na.fill(0.0, ["mean", "low", "high"]),
        F.count("*"),
    )
    few = sources <= BROADCAST_ROWS
    while True:
        # Every source has rows in the histogram, those without words too: their sums are 0, and their multiplier stays.
        joined = histogram.join(_few(state.withColumnRenamed("source", "s"), few), F.col("source").eqNullSafe(F.col("s")))
        some = F.col("size") > 0
        tilt = F.when(some, F.exp(F.col("lam") * F.col("size") / F.col("mean")))
        mass = F.col("n") * F.col("size")
        sums = joined.groupBy(*state.columns).agg(
            F.sum(F.when(some, mass * F.least(most, tilt)).otherwise(0.0)).alias("value"),
            F.sum(F.when(tilt < most, mass * tilt * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("value") > F.col("target")
        stepped = (
            sums.withColumn("was", F.col("gap"))
            .withColumn("gap", F.when(F.col("target") >= cap * F.col("source_size"), 0.0).otherwise(F.coalesce(F.abs(F.col("value") - F.col("target")) / F.col("target"), F.lit(0.0))))
            .withColumn("low", F.when(over, F.col("low")).otherwise(F.col("lam")))
            .withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
            .withColumn("step", F.col("lam") - F.try_divide(F.col("value") - F.col("target"), F.col("slope")))
        )
        inside = (F.col("step") >= F.col("low")) & (F.col("step") <= F.col("high")) & (F.col("gap") <= F.col("was") / 2)
        lam = F.when(F.col("gap") <= tolerance, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        moving = (F.col("gap") > tolerance) & (lam != F.col("lam"))
        state, left = measured(stepped.select("source", "source_size", "mean", "target", lam.alias("lam"), "low", "high", "gap", moving.alias("moving")), F.count_if("moving"))
        if not left:
            break
        state = state.drop("moving")
    return _few(_with_last(sized, _with_shift(sized, state.select("source", "source_size", "mean", "target", "lam"), cap, few), cap, few), few)


def _rate(cap: int):
    full = F.col("target") >= cap * F.col("source_size")
    tilt = F.exp(F.col("lam") * F.col("size") / F.col("mean"))
    return F.when(F.col("size") == 0, F.lit(1.0)).when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def _at(k: int, rate):
    """The shift from which on a document gets its k-th copy."""
    return F.lit(float(k)) - rate - uniform("id")


def _with_shift(sized: DataFrame, fitted: DataFrame, cap: int, few: bool) -> DataFrame:
    """Finds for each source the shift at which the rounded words come nearest to its target, in two
    passes over a histogram of a fixed number of bins a source."""
    known = _few(fitted, few).select(F.col("source").alias("s"), "source_size", "mean", "target", "lam")
    events = sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(cap))
    events = events.select("s", "size", "target", F.explode(F.array(*[_at(k, F.col("rate")) for k in range(1, cap + 1)])).alias("at"))
    width = 2.0 * cap / BINS
    place = (F.col("at") + float(cap)) / width
    events = events.withColumn("bin", F.floor(place)).withColumn("sub", F.floor((place - F.floor(place)) * BINS))
    by_bin = Window.partitionBy("s").orderBy("bin")
    crossing = checkpoint(
        events.groupBy("s", "bin").agg(F.sum("size").alias("mass"), F.first("target").alias("target"))
        .withColumn("upto", F.sum("mass").over(by_bin))
        .withColumn("base", F.col("upto") - F.col("mass"))
        .where("upto >= target and base < target")
        .select("s", "bin", "base")
    )
    near = events.join(_few(crossing, few).select(F.col("s").alias("c"), F.col("bin").alias("cbin"), "base"), F.col("s").eqNullSafe(F.col("c")) & (F.col("bin") == F.col("cbin")))
    by_sub = Window.partitionBy("s").orderBy("sub")
    fine = (
        near.groupBy("s", "bin", "sub", "base", "target").agg(F.sum("size").alias("mass"))
        .withColumn("upto", F.col("base") + F.sum("mass").over(by_sub))
    )
    upto = F.struct(F.abs(F.col("upto") - F.col("target")).alias("miss"), ((F.col("bin") + (F.col("sub") + 1) / BINS) * width - cap).alias("shift"))
    bare = F.struct(F.abs(F.col("base") - F.col("target")).alias("miss"), (F.col("bin") * width - cap).alias("shift"))
    best = fine.groupBy("s").agg(F.min(F.least(upto, bare))["shift"].alias("found"))
    shift = F.coalesce("found", F.when(F.col("target") > 0, F.lit(cap + 1.0)).otherwise(F.lit(-cap - 1.0)))
    return checkpoint(fitted.join(_few(best, few), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("shift", shift).drop("s", "found"))


def _with_last(sized: DataFrame, fitted: DataFrame, cap: int, few: bool) -> DataFrame:
    """The shift leaves a source at most half a document off. One document, whose size is nearest to what is missing or
    over, gets a copy more or less, if that brings the source nearer: columns last_id, last_size and last_step. Where several rows are
    equal to it, all of them do, if that still brings it nearer."""
    kind = sized.schema["id"].dataType.simpleString()
    bare = fitted.withColumn("last_id", F.lit(None).cast(kind)).withColumn("last_size", F.lit(None).cast("long")).withColumn("last_step", F.lit(0))
    taken = apply_mix(sized, _few(bare, few), cap)
    gaps = checkpoint(taken.groupBy(F.col("source").alias("g"), "target").agg((F.col("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).drop("target"))
    rows = taken.join(_few(gaps, few), F.col("source").eqNullSafe(F.col("g")))
    free = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    off = F.abs(F.col("size") - F.abs("gap"))
    best = rows.where(free & (off < F.abs("gap")) & F.col("id").isNotNull()).groupBy(F.col("source").alias("s"), "gap").agg(F.min(F.struct(off.alias("off"), "id", "size")).alias("b"))
    best = checkpoint(best.select("s", "gap", F.col("b.id").alias("last_id"), F.col("b.size").alias("last_size")))
    equal = sized.join(_few(best, few), F.col("source").eqNullSafe(F.col("s")) & (F.col("id") == F.col("last_id")) & (F.col("size") == F.col("last_size")))
    counted = equal.groupBy("s", "gap", "last_id", "last_size").agg(F.count("*").alias("m"))
    last = counted.where(F.abs(F.col("m") * F.col("last_size") - F.abs("gap")) < F.abs("gap")).select("s", "last_id", "last_size", F.signum("gap").cast("int").alias("last_step"))
    return checkpoint(fitted.join(_few(last, few), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def apply_mix(sized: DataFrame, fitted: DataFrame, cap: int = 2) -> DataFrame:
    """Adds source_size, target, rate and copies to rows with id, source and size (other columns stay). ``fitted`` is marked for broadcast where it is small."""
    extra = ["source_size", "mean", "target", "lam", "shift", "last_id", "last_size", "last_step"]
    known = fitted.select(F.col("source").alias("_s"), *extra)
    rated = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", _rate(cap))
    copies = sum((_at(k, F.col("rate")) < F.col("shift")).cast("int") for k in range(1, cap + 1))
    last = F.when((F.col("id") == F.col("last_id")) & (F.col("size") == F.col("last_size")), F.col("last_step")).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0), copies + last)))
    return rated.withColumn("copies", copies).drop("_s", "lam", "mean", "shift", "last_id", "last_size", "last_step")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2) -> DataFrame:
    """Every document with its rate and copies: row (the input's columns), id, source, size, source_size, target, rate, copies."""
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")]
    fitted = fit_mix(keep(docs.select(*columns), "mix-sizes"), weights, share, cap)
    return apply_mix(docs.select(F.struct("*").alias("row"), *columns), fitted, cap)


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2) -> DataFrame:
    """As ``mix`` without ``row``: reads the texts once only."""
    sized = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    return apply_mix(sized, fit_mix(sized, weights, share, cap), cap)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, in the input's columns."""
    return mix(docs, **options).where("copies > 0").select(F.explode(F.sequence(F.lit(1), "copies")), "row").select("row.*")
