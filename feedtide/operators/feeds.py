"""Run-over-run comparison of feeds: what left them, and whether it was saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedtide.functions.status import drop_reason, is_archived_status, is_known_status
from feedtide.operators.extract import complete_listings
from feedtide.operators.skew import first_k_within, join_dimension
from feedtide.params import Params


def feed_runs(fetches: DataFrame, registry: DataFrame, params: Params) -> DataFrame:
    """(run_id, source, ts, exhaustive) of the runs whose feed counts as read.

    A feed that could not be read looks like an empty one and would report everything as dropped. By default a run counts
    for its source only if its listing is complete (`extract.complete_listings`); otherwise it is skipped and the previous snapshot stays.
    `ignore_failed_fetches=False` counts every run."""
    top = fetches.filter(F.col("parent_url").isNull())
    runs = top.groupBy("run_id", "source").agg(F.max("fetched_at").alias("ts"))
    if params.ignore_failed_fetches:
        runs = runs.join(complete_listings(fetches, registry), ["run_id", "source"], "left_semi")
    flags = registry.select("source", F.coalesce("exhaustive", F.lit(False)).alias("exhaustive"))
    return join_dimension(runs, flags, ["source"], spread=["run_id"], how="inner")


def feed_snapshots(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct URLs per run of rotating sources; exhaustive sources keep no snapshot."""
    rotating = runs.filter(~F.col("exhaustive")).select("run_id", "source")
    urls = items.select("run_id", "source", "norm_url").distinct()
    return join_dimension(urls, rotating, ["run_id", "source"], spread=["norm_url"], how="inner")


def feed_drops(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """URLs listed in one run of a rotating source and missing in its next run.

    Each run of a source learns its successor; then one window per (source, URL), at most one row per run,
    tells whether the URL's next listing is that successor. No self-join of the snapshots."""
    order = Window.partitionBy("source").orderBy("run_id")
    successors = (
        runs.filter(~F.col("exhaustive"))
        .select("run_id", "source")
        .distinct()
        .withColumn("next_run", F.lead("run_id").over(order))
    )
    listed = join_dimension(
        snapshots.select("run_id", "source", "norm_url").distinct(),
        successors,
        ["run_id", "source"],
        spread=["norm_url"],
        how="inner",
    )
    listings = Window.partitionBy("source", "norm_url").orderBy("run_id")
    return (
        listed.withColumn("next_listing", F.lead("run_id").over(listings))
        .filter(
            F.col("next_run").isNotNull()
            & (F.col("next_listing").isNull() | (F.col("next_listing") != F.col("next_run")))
        )
        .select(F.col("next_run").alias("run_id"), "source", "norm_url")
    )


def drops_with_status(drops: DataFrame, statuses: DataFrame) -> DataFrame:
    """Drops with the URL's status when it was found missing. `statuses` is keyed by norm_url, and by
    run_id too when it covers several runs."""
    keys = [c for c in ("run_id", "norm_url") if c in statuses.columns]
    return drops.join(statuses.select(*keys, "status"), keys, "left")


def dropped_unarchived(drops: DataFrame, statuses: DataFrame) -> DataFrame:
    """Drops without a confirmed capture, and why."""
    return (
        drops_with_status(drops, statuses)
        .filter(~is_archived_status(F.col("status")))
        .select("run_id", "source", "norm_url", drop_reason(F.col("status")).alias("reason"))
    )


def _dated() -> Column:
    return F.when(F.col("published_at") != "", F.col("published_at"))


def published_coverage(items: DataFrame) -> DataFrame:
    """A2: first and last non-empty date per run and source, in text order."""
    return items.groupBy("run_id", "source").agg(
        F.min(_dated()).alias("oldest_published_at"), F.max(_dated()).alias("newest_published_at")
    )


def feed_run_stats(
    items: DataFrame, runs: DataFrame, drops: DataFrame, statuses: DataFrame
) -> DataFrame:
    """A1: one row per run and source. Items are counted raw, drops as distinct URLs; drop counts of
    exhaustive sources are NULL (not tracked). Repeated items are combined before the status join."""
    keys = [c for c in ("run_id", "norm_url") if c in statuses.columns]
    per_url = items.groupBy("run_id", "source", "norm_url").agg(
        F.count("*").alias("n"), F.min(_dated()).alias("oldest"), F.max(_dated()).alias("newest")
    )
    counted = (
        per_url.join(statuses.select(*keys, "status"), keys, "left")
        .groupBy("run_id", "source")
        .agg(
            F.sum("n").alias("item_count"),
            F.sum(F.when(is_known_status(F.col("status")), F.lit(0)).otherwise(F.col("n"))).alias("new_count"),
            F.min("oldest").alias("oldest_published_at"),
            F.max("newest").alias("newest_published_at"),
        )
    )
    lost = (
        drops_with_status(drops, statuses)
        .groupBy("run_id", "source")
        .agg(
            F.count("*").alias("dropped"),
            F.count_if(~is_archived_status(F.col("status"))).alias("lost"),
        )
    )
    tracked = ~F.col("exhaustive")
    return (
        runs.select("run_id", "source", "ts", "exhaustive")
        .join(counted, ["run_id", "source"], "left")
        .join(lost, ["run_id", "source"], "left")
        .select(
            "run_id",
            "source",
            "ts",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            F.coalesce("new_count", F.lit(0)).alias("new_count"),
            F.when(tracked, F.coalesce("dropped", F.lit(0))).alias("dropped_count"),
            F.when(tracked, F.coalesce("lost", F.lit(0))).alias("dropped_unarchived_count"),
            "oldest_published_at",
            "newest_published_at",
            F.lit(0).cast("bigint").alias("already_archived_count"),
            F.lit(0).cast("bigint").alias("rate_limited_count"),
        )
    )


def attach_outcomes_to_stats(stats: DataFrame, archived: DataFrame, limited: DataFrame) -> DataFrame:
    """Adds the A4 and A5 counts to that run's row; counts without a row are ignored."""
    order = stats.columns
    return (
        stats.drop("already_archived_count", "rate_limited_count")
        .join(archived, ["run_id", "source"], "left")
        .join(limited, ["run_id", "source"], "left")
        .fillna(0, ["already_archived_count", "rate_limited_count"])
        .select(*order)
    )


def drop_reason_counts(dropped: DataFrame) -> DataFrame:
    """Losses per run, source and reason."""
    return dropped.groupBy("run_id", "source", "reason").agg(F.count("*").alias("losses"))


def dropped_count_by_run(dropped: DataFrame) -> DataFrame:
    """Losses per run; entries without a run id are left out."""
    return (
        dropped.filter(F.col("run_id") != "").groupBy("run_id").agg(F.count("*").alias("dropped_count"))
    )


def dropped_sample(dropped: DataFrame, size: int = 10) -> DataFrame:
    """The first `size` losses per run and source in URL order."""
    return first_k_within(
        dropped, ["run_id", "source"], [F.col("norm_url")], size, spread=["norm_url"], name="position"
    )


def recheck_dropped(dropped: DataFrame, availability: DataFrame) -> DataFrame:
    """The loss log without entries now confirmed captured. False and NULL (check failed) stay."""
    found = availability.filter(F.col("archived")).select("norm_url")
    return dropped.join(found, "norm_url", "left_anti")
