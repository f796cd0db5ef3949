"""De-duplication and look-ups against the per-URL state.

Items are reduced to one row per URL, combined on the map side, before they meet the state table: both
sides of these joins are unique on `norm_url`, so a URL listed everywhere is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.functions.status import is_archived_status, is_known_status, is_permanent
from feedtide.functions.urls import is_tracking_key, query_pairs, replay_link
from feedtide.params import Params


def tracking_params_report(items: DataFrame) -> DataFrame:
    """How often each tracking parameter was stripped, per source."""
    stripped = F.filter(query_pairs(F.col("url")), lambda pair: is_tracking_key(pair["key"]))
    return (
        items.select("source", F.explode(F.transform(stripped, lambda pair: pair["key"])).alias("param"))
        .groupBy("source", "param")
        .agg(F.count("*").alias("stripped"))
    )


def dedupe_first_wins(items: DataFrame) -> DataFrame:
    """The first item of each canonical URL in (source_ord, item_ord) order.

    An aggregate, not a window: copies of a hot URL are combined before they are shuffled."""
    place = F.struct("source_ord", "item_ord")
    rest = [c for c in items.columns if c not in ("run_id", "norm_url")]
    return (
        items.groupBy("run_id", "norm_url")
        .agg(F.min_by(F.struct(*rest), place).alias("first"))
        .select("run_id", "norm_url", *[F.col(f"first.{c}").alias(c) for c in rest])
    )


def capture_links(outcomes: DataFrame) -> DataFrame:
    """U4: replay link of every outcome; NULL unless it succeeded and both parts are present."""
    return outcomes.select(
        "norm_url",
        "seq",
        "kind",
        replay_link(F.col("kind"), F.col("capture_ts"), F.col("original_url")).alias("replay_url"),
    )


def status_lookup(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Status of each distinct URL, NULL when it was never seen. Both sides are unique on the key."""
    return items.select("norm_url").distinct().join(seen.select("norm_url", "status"), "norm_url", "left")


def new_urls(items: DataFrame, seen: DataFrame) -> DataFrame:
    """First item of each URL that is not known (never seen, or waiting for a retry)."""
    known = seen.filter(is_known_status(F.col("status"))).select("norm_url")
    return dedupe_first_wins(items).join(known, "norm_url", "left_anti")


def archived_urls(items: DataFrame, seen: DataFrame) -> DataFrame:
    """First item of each URL with a confirmed capture."""
    archived = seen.filter(is_archived_status(F.col("status"))).select("norm_url")
    return dedupe_first_wins(items).join(archived, "norm_url", "left_semi")


def retry_candidates(items: DataFrame, seen: DataFrame) -> DataFrame:
    """URLs waiting for a retry that are still listed; one that left its feed is never retried."""
    waiting = seen.filter(F.col("status") == "error_retry").select("norm_url", "attempts")
    return dedupe_first_wins(items).join(waiting, "norm_url", "inner")


def pending_leftovers(seen: DataFrame) -> DataFrame:
    """Captures still open from an earlier run."""
    return seen.filter((F.col("status") == "pending") & (F.col("job_id") != "")).select("norm_url", "job_id")


def stale_pending(seen: DataFrame, params: Params) -> DataFrame:
    """Pending rows first seen strictly before the limit. A missing first_seen is oldest of all."""
    limit = params.before(secs=params.pending_hours_limit * 3600.0)
    old = F.col("first_seen").isNull() | (F.col("first_seen") < limit)
    return seen.filter((F.col("status") == "pending") & old)


def error_classification(outcomes: DataFrame) -> DataFrame:
    """Finished captures with an error, permanent or transient."""
    return outcomes.filter(F.col("kind") == "job_error").select(
        "norm_url", "seq", "status_ext", is_permanent(F.col("status_ext")).alias("permanent")
    )


def outcomes_to_jobs(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """The answer of the status service for each open job. `answers` has one row per job_id.
    success and error resolve a job; any other status, or none, leaves it open."""
    state = F.when(F.col("answer") == "success", F.lit("success")).when(
        F.col("answer") == "error", F.lit("error")
    )
    return (
        jobs.join(answers.withColumnRenamed("status", "answer"), "job_id", "left")
        .withColumn("result", F.coalesce(state, F.lit("pending")))
        .drop("answer")
    )
