"""Change detection along an order, and operators over intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def transitions(df: DataFrame, partition: list[str], order: list[str], value: str, emit_first: bool = True) -> DataFrame:
    """Rows whose value differs from that of the row before; adds previous (null on the first)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("previous", F.lag(value).over(w)).withColumn("_nth", F.row_number().over(w))
    changed = (F.col("_nth") > 1) & ~F.col(value).eqNullSafe(F.col("previous"))
    return marked.where(changed | (F.col("_nth") == 1) if emit_first else changed).drop("_nth")


def config_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of a settings file's fingerprint: the first look is none. collection_stopped: the hooks were there and are gone."""
    w = Window.partitionBy("path").orderBy("observed_at_us")
    told = snapshots.withColumn("had_hooks", F.lag("hooks_present").over(w))
    return transitions(told, ["path"], ["observed_at_us"], "fingerprint", emit_first=False).withColumn("collection_stopped", F.coalesce(F.col("had_hooks") & ~F.col("hooks_present"), F.lit(False))).drop("had_hooks")


def pause_transitions(checks: DataFrame, host: str = "host") -> DataFrame:
    """Changes of the paused flag as events collection.paused and collection.resumed; not being paused at first is no change."""
    out = transitions(checks, [host], ["timestamp_us"], "paused").where(F.col("previous").isNotNull() | F.col("paused"))
    return out.withColumn("kind", F.when(F.col("paused"), "collection.paused").otherwise("collection.resumed")).drop("previous")


def canonical_json(column: str) -> Column:
    """JSON text with the keys of every object in order; arrays keep theirs. null for what is no JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(F.coalesce(F.col(column), F.lit("null")))), F.lit("null"))


def config_fingerprint(df: DataFrame, column: str = "hooks_json") -> DataFrame:
    canonical = canonical_json(column)
    return df.withColumn("fingerprint", F.sha2(canonical.cast("binary"), 256)).withColumn("hooks_present", canonical != "null")


def queue_waits(queue: DataFrame) -> DataFrame:
    """The n-th enqueue of a session paired with its n-th dequeue, and the wait between them."""
    w = Window.partitionBy("session_id", "operation").orderBy("timestamp_us", "id")
    nth = queue.where(F.col("operation").isin("enqueue", "dequeue")).withColumn("nth", F.row_number().over(w))
    pairs = nth.groupBy("session_id", "nth").agg(F.max(F.when(F.col("operation") == "enqueue", F.col("timestamp_us"))).alias("enqueued_us"), F.max(F.when(F.col("operation") == "dequeue", F.col("timestamp_us"))).alias("dequeued_us"))
    return pairs.where("enqueued_us is not null and dequeued_us >= enqueued_us").withColumn("wait_ms", F.floor((F.col("dequeued_us") - F.col("enqueued_us")) / 1000).cast("long"))


def posture_in_force(facts: DataFrame, postures: DataFrame) -> DataFrame:
    """Each fact with the session's last posture at or before it: one sort a session over slim rows."""
    both = facts.select("session_id", "timestamp_us", "id", F.lit(1).alias("is_fact"), F.lit(None).cast("string").alias("mode")).unionByName(postures.select("session_id", "timestamp_us", "id", F.lit(0).alias("is_fact"), "mode"))
    w = Window.partitionBy("session_id").orderBy("timestamp_us", "is_fact", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("mode", F.last("mode", ignorenulls=True).over(w)).where("is_fact = 1").drop("is_fact")


def activity_windows(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Spans of a session without a pause of ``gap``. On a stream a span is given once it is over and the watermark has passed it."""
    timed = events.withColumn("at", F.timestamp_micros("timestamp_us"))
    timed = timed.withWatermark("at", lateness) if timed.isStreaming else timed
    spans = timed.groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
    return spans.select("session_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


def collection_gaps(pauses: DataFrame, host: str = "host") -> DataFrame:
    """(host, paused_us, resumed_us): each pause up to the next event of the host; null if it lasts."""
    w = Window.partitionBy(host).orderBy("timestamp_us")
    return pauses.withColumn("resumed_us", F.lead("timestamp_us").over(w)).where("kind = 'collection.paused'").select(host, F.col("timestamp_us").alias("paused_us"), "resumed_us")


def activity_around_gaps(gaps: DataFrame, events: DataFrame, as_of_us: int, host: str = "host", width_us: int = HOUR_US) -> DataFrame:
    """Each gap (host, paused_us, resumed_us) with the host's events inside it, the last before it and the first from its end on; a gap that lasts ends at ``as_of_us``.

    Time is cut into buckets of ``width_us``. Events are summed up by host and bucket, before their one shuffle. A bucket that lies wholly inside a gap counts
    as summed; the events of the two buckets in which a gap begins and ends are met by an equi-join on host and bucket and compared exactly. The nearest
    events outside these are found among the sums, a row a bucket, so no task sorts a host's events. Gaps of one host may overlap; rows with a null host take no part."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width_us))
    end = F.coalesce("resumed_us", F.lit(as_of_us))
    told = gaps.where(F.col(host).isNotNull() & F.col("paused_us").isNotNull()).select(F.col(host).alias("_h"), "paused_us", "resumed_us", end.alias("_end")).distinct()
    told = told.withColumns({"_first": bucket("paused_us"), "_last": bucket("_end")})
    seen = events.where(F.col(host).isNotNull() & F.col("timestamp_us").isNotNull()).select(F.col(host).alias("_h"), "timestamp_us").withColumn("_b", bucket("timestamp_us"))
    sums = seen.groupBy("_h", "_b").agg(F.count("*").alias("_n"), F.min("timestamp_us").alias("_low"), F.max("timestamp_us").alias("_high"))
    gap = ["_h", "paused_us", "resumed_us"]
    none = F.lit(None).cast("long")
    parts = lambda df, inside=F.lit(0), before=none, after=none: df.select(*gap, inside.cast("long").alias("inside"), before.alias("before_us"), after.alias("after_us"))

    # The buckets at both ends, event by event.
    edges = told.withColumn("_b", F.explode(F.array_distinct(F.array("_first", "_last"))))
    at = F.col("timestamp_us")
    near = parts(edges.join(seen, ["_h", "_b"]), ((at >= F.col("paused_us")) & (at < F.col("_end"))).cast("long"), F.when(at < F.col("paused_us"), at), F.when(at >= F.col("_end"), at))
    # The buckets between them, by their sums.
    between = told.where("_last - _first > 1").withColumn("_b", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)))
    whole = parts(between.join(sums, ["_h", "_b"]), F.col("_n"))
    # The nearest sums before the first bucket and after the last, from one window over the sums and the gaps' ends.
    asked = edges.select("_h", "_b").distinct().withColumns({"_low": none, "_high": none, "_asked": F.lit(True)})
    both = sums.select("_h", "_b", "_low", "_high", F.lit(False).alias("_asked")).unionByName(asked)
    order = Window.partitionBy("_h").orderBy("_b")
    past, future = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(1, Window.unboundedFollowing)
    reach = both.withColumns({"_before": F.max("_high").over(past), "_after": F.min("_low").over(future)}).where("_asked").drop("_low", "_high", "_asked")
    left = parts(told.join(reach, (told["_h"] == reach["_h"]) & (told["_first"] == reach["_b"])).drop(reach["_h"]), before=F.col("_before"))
    right = parts(told.join(reach, (told["_h"] == reach["_h"]) & (told["_last"] == reach["_b"])).drop(reach["_h"]), after=F.col("_after"))
    every = near.unionByName(whole).unionByName(left).unionByName(right)
    return every.groupBy(*gap).agg(F.sum("inside").alias("inside"), F.max("before_us").alias("before_us"), F.min("after_us").alias("after_us")).withColumnRenamed("_h", host)
