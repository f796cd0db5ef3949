"""Streaming jobs (T1-T7). Each reads streams of the batch tables and ends in a table of results.

A job stores what its batches add (items, folds, counts), which is small beside the input and does not depend on the order of
arrival. A batch does the work for its own rows and their partners only; late rows are never lost, no state store grows, and a job that
is called again with the same `root` continues. Only T3 has a horizon, which is its meaning.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.functions.status import ERROR_KINDS, PENDING_KINDS, is_retryable
from feedtide.operators.extract import (
    child_pages,
    document_rows,
    index_children_of,
    join_children,
    rss_items_of,
    sitemap_urls_of,
    url_pattern_filter,
    with_canonical_url,
)
from feedtide.operators.outcomes import DELTA, fold_deltas, outcome_delta, seen_of_delta, seen_status
from feedtide.operators.retention import purge_seen
from feedtide.operators.skew import first_k_within, join_dimension
from feedtide.params import Params
from feedtide.sources.state import folders, read_small, remove, write_small
from feedtide.streaming.sinks import append_to_table, drain, fold_batch, read_batches, read_folded, refold, sum_by, write_batch

COUNTS = "run_id STRING, success BIGINT, error BIGINT, pending BIGINT, already_archived BIGINT, rate_limited BIGINT"
FAILURES = "norm_url STRING, seq BIGINT, run_id STRING, retryable BOOLEAN"
RATES = "account STRING, window_start TIMESTAMP, submits BIGINT"
CHILDREN = "source STRING, source_ord BIGINT, index_url STRING, index_at TIMESTAMP, child_position INT, fetch_url STRING, run_id STRING"
PAGES = (
    "source STRING, fetch_url STRING, parent_url STRING, fetched_at TIMESTAMP, position INT, kind STRING, url STRING, title STRING, "
    "published_at STRING, run_id STRING"
)
COMPARED = "source STRING, run_id STRING, previous STRING"


def collect_discovered(fetches: DataFrame, registry: DataFrame, root: str, first_run: str | None = None) -> DataFrame:
    """The items of `discover` over all rows so far, however far apart an index and its children were fetched.

    A batch parses its documents once. Children that its indexes list meet the child documents stored before and those of the
    batch; its child documents meet the indexes stored before. Both stores lie by run, and only the runs of the batch are read. Runs before
    `first_run` are taken for finished: what was stored to match their documents is removed."""

    def store(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = document_rows(batch).persist()
        new_children, new_pages = index_children_of(rows, registry), child_pages(rows)
        write_batch(new_children, f"{root}/children", n, by="run_id")
        write_batch(new_pages, f"{root}/pages", n, by="run_id")
        runs = [r[0] for r in rows.select("run_id").distinct().collect()]
        old_children = read_batches(spark, f"{root}/children", CHILDREN, below=n).filter(F.col("run_id").isin(runs))
        old_pages = read_batches(spark, f"{root}/pages", PAGES, below=n).filter(F.col("run_id").isin(runs))
        both = new_pages.unionByName(old_pages.select(*new_pages.columns))
        below = join_children(new_children, both).unionByName(join_children(old_children, new_pages))
        listed = url_pattern_filter(sitemap_urls_of(rows, registry).unionByName(below), registry)
        write_batch(with_canonical_url(rss_items_of(rows, registry).unionByName(listed)), f"{root}/items", n)
        rows.unpersist()

    spark = fetches.sparkSession
    drain(fetches, root, store)
    if first_run is not None:
        for table in ("children", "pages"):
            for _, batch in folders(spark, f"{root}/{table}", "batch="):
                # run ids sort in time order, as folder names do
                remove(spark, [path for run, path in folders(spark, batch, "run_id=", number=str, finished=False) if run < first_run])
    items = read_batches(spark, f"{root}/items", schemas.DISCOVERED)
    return items.filter(F.col("norm_url").isNotNull())


def maintain_seen(outcomes: DataFrame, params: Params, root: str, purge: bool = False) -> DataFrame:
    """The state after all outcomes so far. A batch folds its events into the buckets of their URLs and rewrites no other.

    With `purge` a bucket that is rewritten loses the URLs that retention (R1) drops, and the result is without them."""

    def fold(deltas: DataFrame) -> DataFrame:
        folded = fold_deltas(deltas)
        return _unexpired(folded, params) if purge else folded

    drain(outcomes, root, lambda batch, n: fold_batch(outcome_delta(batch), f"{root}/deltas", DELTA, ["norm_url"], fold, n))
    seen = seen_of_delta(read_folded(outcomes.sparkSession, f"{root}/deltas", DELTA), params)
    return purge_seen(seen, params) if purge else seen


def _unexpired(folded: DataFrame, params: Params) -> DataFrame:
    return purge_seen(folded.withColumn("status", seen_status(params)), params).drop("status")


def compact_seen(spark: SparkSession, params: Params, root: str) -> None:
    """Drops what retention (R1) would from every bucket: URLs that are not pending and were first seen before the cutoff."""
    refold(spark, f"{root}/deltas", DELTA, ["norm_url"], lambda deltas: _unexpired(deltas, params))


def collect_unique(rows: DataFrame, horizon: str, root: str) -> DataFrame:
    """Each URL once within `horizon`; keeps the first row to arrive."""
    unique = rows.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["norm_url"])
    return append_to_table(unique.select("norm_url"), root)


def collect_rate(rows: DataFrame, window: str, slide: str, root: str) -> DataFrame:
    """T4: submits per account in sliding windows, a coarser form of the rate audit."""
    start = F.col("w.start").alias("window_start")

    def count(batch: DataFrame, n: int) -> None:
        counted = batch.groupBy("account", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("submits"))
        keys = ["account", "window_start"]
        fold_batch(counted.select("account", start, "submits"), f"{root}/counts", RATES, keys, lambda counts: sum_by(counts, keys), n)

    drain(rows, root, count)
    return read_folded(rows.sparkSession, f"{root}/counts", RATES)


def collect_drops(snapshots: DataFrame, complete: DataFrame, root: str) -> DataFrame:
    """T5: losses between complete runs. `complete` is the runs table (run_id, source, exhaustive) of the runs whose
    feeds have been read to the end, empty ones included; rows of other runs wait until it lists them.

    A call compares a run with its predecessor if the pair is new, or if rows of either arrived since; snapshots lie by run, and only the
    runs of such pairs are read. A pair that is compared again replaces what it said before."""
    spark = snapshots.sparkSession
    rows = snapshots.select("run_id", "source", "norm_url")
    drain(rows, root, lambda batch, n: write_batch(batch.distinct(), f"{root}/snapshots", n, by="run_id"))
    _compare_new(spark, complete, root)
    compared = _numbered(spark, f"{root}/compared", COMPARED)
    newest = compared.groupBy("source", "run_id").agg(F.max("call").alias("call"))
    losses = _numbered(spark, f"{root}/losses", schemas.FEED_SNAPSHOTS)
    return join_dimension(losses, newest, ["source", "run_id", "call"], spread=["norm_url"], how="inner").select("run_id", "source", "norm_url")


def _numbered(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows that finished calls wrote, with the call's number."""
    paths = [path for n, path in folders(spark, table, "call=")]
    if not paths:
        return spark.createDataFrame([], f"{schema}, call BIGINT")
    return spark.read.schema(f"{schema}, call BIGINT").option("basePath", table).parquet(*paths)


def _compare_new(spark: SparkSession, complete: DataFrame, root: str) -> None:
    batches = [n for n, _ in folders(spark, f"{root}/snapshots", "batch=")]
    done = json.loads(read_small(spark, f"{root}/_compared") or '{"call": 0, "batch": -1}')
    call = done["call"] + 1
    stored = "source STRING, norm_url STRING, run_id STRING"
    changed = read_batches(spark, f"{root}/snapshots", stored, after=done["batch"]).select("source", "run_id").distinct()
    order = Window.partitionBy("source").orderBy("run_id")
    rotating = complete.filter(~F.col("exhaustive")).select("source", "run_id").distinct()
    pairs = rotating.withColumn("previous", F.lag("run_id").over(order)).filter(F.col("previous").isNotNull())
    earlier = _numbered(spark, f"{root}/compared", COMPARED)
    earlier = earlier.groupBy("source", "run_id").agg(F.max_by("previous", "call").alias("compared_with"))
    touched = changed.withColumn("touched", F.lit(True))
    due = (
        pairs.join(earlier, ["source", "run_id"], "left")
        .join(touched, ["source", "run_id"], "left")
        .join(touched.toDF("source", "previous", "before_touched"), ["source", "previous"], "left")
        .filter((~F.col("previous").eqNullSafe(F.col("compared_with"))) | F.col("touched") | F.col("before_touched"))
        .select("source", "run_id", "previous")
    )
    due.write.mode("overwrite").parquet(f"{root}/compared/call={call:012d}")
    due = spark.read.schema(COMPARED).parquet(f"{root}/compared/call={call:012d}")
    runs = [r[0] for r in due.select(F.explode(F.array("run_id", "previous")).alias("run_id")).distinct().collect()]
    if runs:
        listed = read_batches(spark, f"{root}/snapshots", stored).filter(F.col("run_id").isin(runs))
        listed = listed.select("source", F.col("run_id").alias("listed_in"), "norm_url")
        before = join_dimension(listed, due.select("source", F.col("previous").alias("listed_in"), "run_id"), ["source", "listed_in"], spread=["norm_url"], how="inner")
        still = join_dimension(listed, due.select("source", F.col("run_id").alias("listed_in"), "run_id"), ["source", "listed_in"], spread=["norm_url"], how="inner")
        keys = ["run_id", "source", "norm_url"]
        lost = before.select(*keys).distinct().join(still.select(*keys), keys, "left_anti")
        lost.write.mode("overwrite").parquet(f"{root}/losses/call={call:012d}")
    write_small(spark, f"{root}/_compared", json.dumps({"call": call, "batch": batches[-1] if batches else -1}), overwrite=True)


def collect_stale(outcomes: DataFrame, params: Params, root: str) -> DataFrame:
    """URLs pending longer than the limit at the time of the newest event: E8 over the state of T2."""
    seen = maintain_seen(outcomes, params, root)
    clock = seen.agg(F.max("last_checked")).scalar()
    limit = clock - F.make_interval(secs=F.lit(params.pending_hours_limit * 3600.0))
    old = F.col("first_seen").isNull() | (F.col("first_seen") < limit)
    return seen.filter((F.col("status") == "pending") & old).select("norm_url", "first_seen")


def collect_run_totals(outcomes: DataFrame, params: Params, root: str) -> DataFrame:
    """Outcome totals per run.

    A batch adds its counts to its runs, and its failures to the first ones of their URLs: only a URL's first
    `attempts_limit - 1` failures can be retried."""
    limit = params.attempts_limit - 1

    def is_kind(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    def store(batch: DataFrame, n: int) -> None:
        batch.persist()
        counts = batch.groupBy("run_id").agg(
            is_kind("success").alias("success"),
            is_kind(*ERROR_KINDS).alias("error"),
            is_kind(*PENDING_KINDS).alias("pending"),
            is_kind("already_archived").alias("already_archived"),
            F.sum(F.col("n_rate_limited").cast("bigint")).alias("rate_limited"),
        )
        fold_batch(counts, f"{root}/counts", COUNTS, ["run_id"], lambda rows: sum_by(rows, ["run_id"]), n)
        failures = batch.filter(F.col("kind").isin(*ERROR_KINDS)).select(
            "norm_url", "seq", "run_id", is_retryable(F.col("kind"), F.col("status_ext")).alias("retryable")
        )
        fold_batch(failures, f"{root}/failures", FAILURES, ["norm_url"], lambda rows: _first_failures(rows, limit), n)
        batch.unpersist()

    drain(outcomes, root, store)
    spark = outcomes.sparkSession
    counts = read_folded(spark, f"{root}/counts", COUNTS)
    retried = read_folded(spark, f"{root}/failures", FAILURES).filter("retryable").groupBy("run_id").agg(F.count("*").alias("error_retry"))
    return (
        counts.join(retried, "run_id", "left")
        .fillna(0, ["error_retry"])
        .withColumn("error_permanent", F.col("error") - F.col("error_retry"))
    )


def _first_failures(failures: DataFrame, limit: int) -> DataFrame:
    if limit < 1:
        return failures.limit(0)
    return first_k_within(failures, ["norm_url"], [F.col("seq")], limit, spread=["seq"]).drop("k")
