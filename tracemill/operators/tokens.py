"""Token reports: how many tokens, by whom, where, with which model, on which day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import AGENT_ALIASES, share

COUNTERS = {"input": "input_tokens", "cache_creation": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens", "output": "output_tokens"}
UNKNOWN = "(unknown)"


def in_range(df: DataFrame, from_us: int | None = None, to_us: int | None = None, column: str = "timestamp_us") -> DataFrame:
    """Half-open: from_us <= t < to_us. Of a table stored by event_date only the dates of the range are read."""
    day = 86_400_000_000
    by_date = column == "timestamp_us" and "event_date" in df.columns
    date = lambda us: F.lit(max(-(10**6), min(10**6, us // day))).cast("int")
    number = F.datediff(F.col("event_date"), F.lit("1970-01-01").cast("date")) if by_date else None
    if from_us is not None:
        df = df.where(F.col(column) >= from_us)
        df = df.where(number >= date(from_us)) if by_date else df
    if to_us is not None:
        df = df.where(F.col(column) < to_us)
        df = df.where(number <= date(to_us)) if by_date else df
    return df


def agent_filter(df: DataFrame, names=()) -> DataFrame:
    """The agents named, by id or alias; all where none is named."""
    return df.where(F.col("agent_id").isin([AGENT_ALIASES.get(n, n) for n in names])) if names else df


def _sums() -> list[Column]:
    counters = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in COUNTERS.items()]
    total = sum((F.coalesce(F.sum(c), F.lit(0)) for c in COUNTERS.values()), F.lit(0).cast("long"))
    return [*counters, F.count("*").alias("responses"), total.alias("total")]


def token_totals(usage: DataFrame, agent: str | None = None) -> DataFrame:
    """One row, of zeros where there is nothing."""
    return agent_filter(usage, [agent] if agent else ()).agg(*_sums())


def tokens_by(usage: DataFrame, by: str, projects: DataFrame | None = None) -> DataFrame:
    """label, the four counters, responses, total; by repository, project, model, provider or agent. Projects are a dimension
    (id, path, repository_root); facts without one are labelled unknown."""
    if by in ("repository", "project"):
        dims = projects.select(F.col("id").alias("_id"), "path", "repository_root")
        facts = usage.join(dims, F.col("project_id") == F.col("_id"), "left")
        key = F.coalesce("repository_root", F.col("project_id").cast("string")) if by == "repository" else F.col("project_id").cast("string")
        name = F.coalesce("repository_root", "path", F.lit(UNKNOWN)) if by == "repository" else F.coalesce("path", F.lit(UNKNOWN))
        return facts.groupBy(key.alias("_key")).agg(F.max(name).alias("label"), *_sums()).drop("_key")
    label = {"model": F.concat(F.col("provider"), F.lit("/"), F.coalesce("model", F.lit(UNKNOWN))), "provider": F.col("provider"), "agent": F.col("agent_id")}[by]
    return usage.groupBy(label.alias("label")).agg(*_sums())


def ranked(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Largest total first, then by label."""
    out = groups.orderBy(F.desc("total"), "label")
    return out if limit is None else out.limit(limit)


def ranked_with_rest(groups: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` groups, each with the number of groups that are not shown."""
    more = groups.select(F.greatest(F.count("*") - limit, F.lit(0))).scalar()
    return ranked(groups, limit).withColumn("more", more)


def tokens_by_day(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """By calendar day in a time zone, each row at its own offset."""
    local = F.from_utc_timestamp(F.timestamp_micros("timestamp_us"), tz) if tz != "UTC" else F.timestamp_micros("timestamp_us")
    return usage.groupBy(F.date_format(local, "yyyy-MM-dd").alias("label")).agg(*_sums())


def with_share(groups: DataFrame, column: str = "total", by: str = "sum") -> DataFrame:
    """Adds share: percent of the sum, or of the largest. The whole is a scalar subquery, so the rows stay where they are."""
    whole = groups.select((F.sum if by == "sum" else F.max)(column)).scalar()
    return groups.withColumn("share", share(column, whole))


def token_detail(usage: DataFrame) -> DataFrame:
    """By provider, what the provider's own usage object says besides the four counters."""
    get = lambda path: F.get_json_object("provider_usage", path).cast("long")
    reasoning = F.coalesce(get("$.output_tokens_details.thinking_tokens"), get("$.reasoning_output_tokens"))
    z = F.lit(0).cast("long")
    return usage.groupBy("provider").agg(
        F.coalesce(F.sum(reasoning), z).alias("reasoning"),
        F.coalesce(F.sum(get("$.cache_creation.ephemeral_5m_input_tokens")), z).alias("cache_5m"),
        F.coalesce(F.sum(get("$.cache_creation.ephemeral_1h_input_tokens")), z).alias("cache_1h"),
        F.coalesce(F.sum(get("$.server_tool_use.web_search_requests")), z).alias("web_searches"),
        F.coalesce(F.sum(get("$.server_tool_use.web_fetch_requests")), z).alias("web_fetches"),
        F.count(F.get_json_object("provider_usage", "$.cache_miss_reason")).alias("cache_misses"),
        F.coalesce(F.sum("output_tokens"), z).alias("output"),
        F.count("*").alias("responses"),
    )


def detail_ratios(detail: DataFrame) -> DataFrame:
    """Percentages of the detail; null where the whole is 0."""
    percent = lambda a, b: F.try_divide(a * 100.0, b)
    tiers = F.col("cache_5m") + F.col("cache_1h")
    empty = (F.col("reasoning") + tiers + F.col("web_searches") + F.col("web_fetches") + F.col("cache_misses")) == 0
    return detail.select("*", percent(F.col("reasoning"), F.col("output")).alias("reasoning_share"), percent(F.col("cache_1h"), tiers).alias("cache_1h_share"), percent(F.col("cache_misses"), F.col("responses")).alias("miss_share"), empty.alias("is_empty"))


def drift(source: DataFrame, stored: DataFrame, by: str | None = None) -> DataFrame:
    """Responses and tokens that the logs hold less those stored: clean, behind, or ahead (the logs were compacted)."""
    total = sum((F.col(c) for c in COUNTERS.values()), F.lit(0).cast("long"))
    tagged = source.select(*([by] if by else []), total.alias("t"), F.lit(1).alias("side")).unionByName(stored.select(*([by] if by else []), total.alias("t"), F.lit(-1).alias("side")))
    grouped = tagged.groupBy(by) if by else tagged.groupBy()
    out = grouped.agg(F.coalesce(F.sum("side"), F.lit(0)).cast("long").alias("responses_drift"), F.coalesce(F.sum(F.col("t") * F.col("side")), F.lit(0)).cast("long").alias("tokens_drift"))
    behind, ahead = (F.col("responses_drift") > 0) | (F.col("tokens_drift") > 0), (F.col("responses_drift") < 0) | (F.col("tokens_drift") < 0)
    return out.withColumn("state", F.when(ahead, "ahead").when(behind, "behind").otherwise("clean"))
