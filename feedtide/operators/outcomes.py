"""The outcome log: folding it into per-URL state and counting it per run.

The fold is a closed form over order-insensitive aggregates (min, max, count, last by sequence number), so
it is combined on the map side, can be merged incrementally and tolerates late or re-ordered input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedtide.functions.status import (
    ERROR_KINDS,
    PENDING_KINDS,
    STATE_KINDS,
    folded_status,
    is_retryable,
)
from feedtide.operators.skew import first_k_within, running_within
from feedtide.params import Params

SEEN_COLUMNS = [
    "norm_url", "first_seen", "job_id", "status", "attempts", "last_checked", "last_seq", "last_kind",
    "last_retryable", "job_seq",
]


def seen_status(params: Params) -> Column:
    return folded_status(
        F.col("last_kind"), F.col("last_retryable"), F.col("attempts"), params.attempts_limit
    )


def outcome_delta(outcomes: DataFrame, keys: Sequence[str] = ("norm_url",)) -> DataFrame:
    """Fold of the events per key, without the status."""
    has_job = F.col("job_id") != ""
    event = F.struct(
        F.col("kind").alias("kind"), is_retryable(F.col("kind"), F.col("status_ext")).alias("retryable")
    )
    return (
        outcomes.filter(F.col("kind").isin(*STATE_KINDS))
        .groupBy(*keys)
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_checked"),
            F.count_if(F.col("kind").isin(*ERROR_KINDS)).alias("attempts"),
            F.max("seq").alias("last_seq"),
            F.max_by(event, "seq").alias("_last"),
            F.max_by(F.when(has_job, F.col("job_id")), F.when(has_job, F.col("seq"))).alias("job_id"),
            F.max(F.when(has_job, F.col("seq"))).alias("job_seq"),
        )
        .withColumn("last_kind", F.col("_last.kind"))
        .withColumn("last_retryable", F.col("_last.retryable"))
        .drop("_last")
    )


DELTA = (
    "norm_url STRING, first_seen TIMESTAMP, last_checked TIMESTAMP, attempts BIGINT, last_seq BIGINT, job_id STRING, "
    "job_seq BIGINT, last_kind STRING, last_retryable BOOLEAN"
)


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """Folds of disjoint sets of events, folded into one per URL."""
    return (
        deltas.groupBy("norm_url")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_checked").alias("last_checked"),
            F.sum("attempts").alias("attempts"),
            F.max("last_seq").alias("last_seq"),
            F.max_by(F.struct("last_kind", "last_retryable"), "last_seq").alias("_last"),
            F.max_by("job_id", "job_seq").alias("job_id"),
            F.max("job_seq").alias("job_seq"),
        )
        .withColumn("last_kind", F.col("_last.last_kind"))
        .withColumn("last_retryable", F.col("_last.last_retryable"))
        .drop("_last")
    )


def seen_of_delta(delta: DataFrame, params: Params) -> DataFrame:
    return delta.withColumn("status", seen_status(params)).select(*SEEN_COLUMNS)


def seen_from_outcomes(outcomes: DataFrame, params: Params) -> DataFrame:
    """state of every URL after all events of the log."""
    return seen_of_delta(outcome_delta(outcomes), params)


def seen_merge(seen: DataFrame, outcomes: DataFrame, params: Params) -> DataFrame:
    """previous state plus new events. Attempts add up first, the status is derived last."""
    old, new = seen.alias("old"), outcome_delta(outcomes).alias("new")

    def o(name: str) -> Column:
        return F.col(f"old.{name}")

    def n(name: str) -> Column:
        return F.col(f"new.{name}")

    newer_event = o("norm_url").isNull() | (n("last_seq") > o("last_seq"))
    newer_job = n("job_seq").isNotNull() & (o("job_seq").isNull() | (n("job_seq") > o("job_seq")))

    def latest(name: str) -> Column:
        return F.when(newer_event, n(name)).otherwise(o(name)).alias(name)

    merged = old.join(new, F.col("old.norm_url") == F.col("new.norm_url"), "full_outer").select(
        F.coalesce(o("norm_url"), n("norm_url")).alias("norm_url"),
        F.least(o("first_seen"), n("first_seen")).alias("first_seen"),
        F.greatest(o("last_checked"), n("last_checked")).alias("last_checked"),
        (F.coalesce(o("attempts"), F.lit(0)) + F.coalesce(n("attempts"), F.lit(0))).alias("attempts"),
        F.greatest(o("last_seq"), n("last_seq")).alias("last_seq"),
        latest("last_kind"),
        latest("last_retryable"),
        F.when(newer_job, n("job_id")).otherwise(o("job_id")).alias("job_id"),
        F.greatest(o("job_seq"), n("job_seq")).alias("job_seq"),
        n("norm_url").isNull().alias("_untouched"),
        o("status").alias("_old_status"),
    )
    # rows without events keep their status as it is, so a changed attempts limit is not retroactive
    status = F.when(F.col("_untouched"), F.col("_old_status")).otherwise(seen_status(params))
    return merged.withColumn("status", status).select(*SEEN_COLUMNS)


def status_as_of(keys: DataFrame, outcomes: DataFrame, params: Params) -> DataFrame:
    """Status of each (run_id, norm_url) in `keys` from the events of earlier runs only.

    One sorted pass per URL over its per-run deltas and the requested runs, at most two rows per run.
    Run ids must sort in time order."""
    delta = outcome_delta(outcomes, ("norm_url", "run_id")).select(
        "norm_url",
        "run_id",
        F.lit(1).alias("is_event"),
        "attempts",
        F.struct("last_seq", "last_kind", "last_retryable").alias("last"),
    )
    probes = keys.select("norm_url", "run_id").distinct().withColumn("is_event", F.lit(0))
    so_far = (
        Window.partitionBy("norm_url")
        .orderBy("run_id", "is_event")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        delta.unionByName(probes, allowMissingColumns=True)
        .withColumn("attempts", F.sum("attempts").over(so_far))
        .withColumn("last", F.max("last").over(so_far))
        .filter((F.col("is_event") == 0) & F.col("last").isNotNull())
        .select("norm_url", "run_id", "attempts", "last.last_kind", "last.last_retryable")
        .select("norm_url", "run_id", seen_status(params).alias("status"))
    )


def attempts_timeline(
    outcomes: DataFrame, params: Params, seen: DataFrame | None = None
) -> DataFrame:
    """every state-changing event with the number of failures so far; `will_retry` on failures.
    `seen` is the state before the log, whose attempts count too.

    The running count is taken in blocks of `seq`, so one URL with very many events is no bottleneck."""
    failed = F.col("kind").isin(*ERROR_KINDS)
    counted = running_within(
        outcomes.filter(F.col("kind").isin(*STATE_KINDS)),
        ["norm_url"],
        "seq",
        failed.cast("bigint"),
        "attempt",
        start=None if seen is None else seen.select("norm_url", F.col("attempts").alias("start_value")),
    )
    again = is_retryable(F.col("kind"), F.col("status_ext")) & (F.col("attempt") < params.attempts_limit)
    return counted.withColumn("is_error", failed).withColumn("will_retry", F.when(failed, again))


def run_outcome_totals(
    outcomes: DataFrame, params: Params, seen: DataFrame | None = None
) -> DataFrame:
    """A3: outcome counts per run, leftovers and new URLs together, and the 429 answers of all outcomes (`rate_limited`).

    One conditional aggregate over the log counts everything but retries. Those are the retryable ones among a URL's first
    `attempts_limit - 1` failures (those in `seen` come first), so only the first few failures of each URL are ranked. A run
    without any outcome of state or pending kind has no row."""
    kind = F.col("kind")
    failed = kind.isin(*ERROR_KINDS)
    counts = outcomes.groupBy("run_id").agg(
        F.count_if(kind == "success").alias("success"),
        F.count_if(failed).alias("error"),
        F.count_if(kind.isin(*PENDING_KINDS)).alias("pending"),
        F.count_if(kind == "already_archived").alias("already_archived"),
        F.sum(F.col("n_rate_limited").cast("bigint")).alias("rate_limited"),
        F.count_if(kind.isin(*STATE_KINDS) | kind.isin(*PENDING_KINDS)).alias("_rows"),
    )
    failures = outcomes.filter(failed).select(
        "norm_url", "seq", "run_id", is_retryable(kind, F.col("status_ext")).alias("retryable")
    )
    limit = max(params.attempts_limit - 1, 0)
    first = first_k_within(failures, ["norm_url"], [F.col("seq")], max(limit, 1), spread=["seq"], name="attempt").filter(F.col("attempt") <= limit)
    if seen is not None:
        earlier = seen.select("norm_url", F.col("attempts").alias("_earlier"))
        first = first.join(earlier, "norm_url", "left").filter(F.col("attempt") + F.coalesce("_earlier", F.lit(0)) <= limit)
    retried = first.filter("retryable").groupBy("run_id").agg(F.count("*").alias("error_retry"))
    return (
        counts.filter("_rows > 0 OR rate_limited > 0")
        .join(retried, "run_id", "left")
        .select(
            "run_id", "success", "error", "pending", "already_archived",
            F.coalesce("error_retry", F.lit(0)).alias("error_retry"),
            (F.col("error") - F.coalesce("error_retry", F.lit(0))).alias("error_permanent"),
            "rate_limited",
        )
    )


def already_archived_by_source(outcomes: DataFrame) -> DataFrame:
    """A4: submits answered "already archived", per run and source."""
    return (
        outcomes.filter(F.col("kind") == "already_archived")
        .groupBy("run_id", "source")
        .agg(F.count("*").alias("already_archived_count"))
    )


def rate_limited_by_source(outcomes: DataFrame) -> DataFrame:
    """A5: 429 answers per run and source; one submit can add several."""
    return (
        outcomes.filter(F.col("n_rate_limited") > 0)
        .groupBy("run_id", "source")
        .agg(F.sum(F.col("n_rate_limited").cast("bigint")).alias("rate_limited_count"))
    )


RUN_COUNTERS = [
    "sources_processed", "discovered", "success", "error", "error_retry", "error_permanent",
    "already_archived", "pending", "rate_limited", "deferred", "purged",
]


def run_summary(runs: DataFrame, *counts: DataFrame) -> DataFrame:
    """One row per run. `runs` (with ts) and `counts` are tables of run_id and some of RUN_COUNTERS, one row per run."""
    joined = runs
    for table in counts:
        joined = joined.join(table, "run_id", "left")
    present = set(joined.columns)
    return joined.select(
        "run_id",
        "ts",
        *[
            F.coalesce(F.col(c) if c in present else F.lit(None), F.lit(0)).cast("bigint").alias(c)
            for c in RUN_COUNTERS
        ],
    )


def slot_capacity(accounts: DataFrame, params: Params) -> DataFrame:
    """Concurrent slots per account; an unknown availability means the configured number."""
    configured = F.lit(params.concurrent_captures)
    free = F.coalesce(F.col("available"), configured)
    return accounts.select("account", F.greatest(F.lit(1), F.least(configured, free)).alias("slots"))
