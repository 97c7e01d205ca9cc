"""Sessions as partial states that merge.

A state keeps, for each column of a session, the value that counts together with the place in the order of arrival that made it count, so states are merged by
``min`` and ``max`` alone: in any order, of any split of the events, and more than once without harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of which the first, or the last, value told counts.
FIRST, LAST = ("agent_id", "project_id", "external_session_id"), ("transcript_path", "git_branch", "surface", "parent_session_id")
LEAST, MOST = ("started_us", *FIRST), ("ended", "life", *LAST)


def fold_sessions(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One state a session from events that are each there once."""

    def told(value, when=None):
        column = F.col(value) if value in events.columns else F.lit(None).cast("string")
        return F.when(column.isNotNull() if when is None else when, F.struct(F.col(order).alias("at"), column.alias("value")))

    life = F.col("kind").isin("session.started", "session.ended")
    return events.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.min("timestamp_us").alias("started_us"),
        *[F.min(told(c)).alias(c) for c in FIRST],
        F.max(told("timestamp_us", F.col("kind") == "session.ended")).alias("ended"),
        F.max(told("kind", life)).alias("life"),
        *[F.max(told(c)).alias(c) for c in LAST],
    )


def merge_folds(states: DataFrame) -> DataFrame:
    """One state a session from any number of them, combined before the shuffle."""
    return states.groupBy("id").agg(*[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST])


def sessions_of(states: DataFrame) -> DataFrame:
    """The sessions that merged states stand for, as ``build_sessions`` gives them."""
    value = lambda c: F.col(f"{c}.value")
    status = F.when(value("life") == "session.started", "active").when(value("life") == "session.ended", "ended").otherwise("unknown")
    duration = F.floor((value("ended") - F.col("started_us")) / 1000).cast("long")
    return states.select("id", *[value(c).alias(c) for c in FIRST], "started_us", value("ended").alias("ended_us"), *[value(c).alias(c) for c in LAST], status.alias("status"), duration.alias("duration_ms"))
