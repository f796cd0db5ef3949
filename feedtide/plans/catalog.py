"""Named queries over the test tables: each operator applied to tables derived from a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.functions.status import is_known_status
from feedtide.functions.urls import normalize_url
from feedtide.operators import captures as cap
from feedtide.operators import extract, feeds, lookup, outcomes, planning, rate, reports, retention
from feedtide.params import Params
from feedtide.session import durable, fresh_path
from feedtide.sources import fetches as fetch_source
from feedtide.sources import registry as registry_source
from feedtide.sources import state
from feedtide.sources import testdata as td
from feedtide.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

PAGES = Params(as_of=td.RUN, run_budget_seconds=600, reserved_per_source=1)
EVENTS = Params(as_of=td.EVENTS_AS_OF, attempts_limit=5, retention_days=20)
CAPTURES = Params(as_of=td.CAPTURES_AS_OF, recapture_window="1w")
RATE_LIMIT, RATE_WINDOW = 3, 3600


def publish(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and BIGINT counts, as the tables are read by other engines."""
    casts = {"timestamp": "timestamp_ntz", "int": "bigint"}
    return df.select(
        *[F.col(name).cast(casts[t]).alias(name) if t in casts else F.col(name) for name, t in df.dtypes]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return publish(fn(spark, sf_dir))

    run.__doc__ = fn.__doc__
    CATALOG[fn.__name__] = run
    return run


# --- shared inputs ------------------------------------------------------------------------------


def _backlog(s: SparkSession, d: str) -> DataFrame:
    return durable(lookup.new_urls(td.page_items(s, d), td.page_seen(s, d)))


def _page_plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    backlog = _backlog(s, d)
    return backlog, planning.capture_plan(backlog, td.page_registry(s, d), PAGES)


def _drops(s: SparkSession, d: str) -> DataFrame:
    return feeds.feed_drops(td.event_snapshots(s, d), td.event_runs(s, d))


def _statuses(s: SparkSession, d: str, keys: DataFrame) -> DataFrame:
    return outcomes.status_as_of(keys, td.outcomes(s, d), EVENTS)


def _lost(s: SparkSession, d: str) -> DataFrame:
    drops = durable(_drops(s, d))
    return feeds.dropped_unarchived(drops, _statuses(s, d, drops))


def _loss_log(s: SparkSession, d: str) -> DataFrame:
    """The loss log; entries carry the time of their run."""
    return _lost(s, d).select(
        F.col("run_id").cast("timestamp").alias("ts"), "source", "norm_url", "reason", "run_id"
    )


def _stats(s: SparkSession, d: str) -> DataFrame:
    items, runs = durable(td.event_items(s, d)), td.event_runs(s, d)
    drops = durable(feeds.feed_drops(feeds.feed_snapshots(items, runs), runs))
    keys = items.select("run_id", "norm_url").unionByName(drops.select("run_id", "norm_url"))
    return feeds.feed_run_stats(items, runs, drops, _statuses(s, d, keys))


def _full_stats(s: SparkSession, d: str) -> DataFrame:
    log = td.outcomes(s, d)
    return feeds.attach_outcomes_to_stats(
        _stats(s, d), outcomes.already_archived_by_source(log), outcomes.rate_limited_by_source(log)
    )


def _history(s: SparkSession, d: str) -> DataFrame:
    """Run history: one row per day of events."""
    log, items, runs = td.outcomes(s, d), td.event_items(s, d), td.event_runs(s, d)
    listed = items.select("run_id", "norm_url").distinct()
    known = _statuses(s, d, listed).filter(is_known_status(F.col("status"))).select("run_id")
    unknown = listed.select("run_id", F.lit(1).alias("n")).unionByName(known.select("run_id", F.lit(-1).alias("n")))
    deferred = unknown.groupBy("run_id").agg(
        F.greatest(F.sum("n") - EVENTS.capacity, F.lit(0)).alias("deferred")
    )
    expiring = (
        outcomes.seen_from_outcomes(log, EVENTS)
        .filter(F.col("status") != "pending")
        .groupBy(F.date_format(F.date_add(F.to_date("first_seen"), EVENTS.retention_days), "yyyy-MM-dd").alias("run_id"))
        .agg(F.count("*").alias("purged"))
    )
    return outcomes.run_summary(
        runs.groupBy("run_id").agg(F.max("ts").alias("ts"), F.count("*").alias("sources_processed")),
        items.groupBy("run_id").agg(F.count("*").alias("discovered")),
        outcomes.run_outcome_totals(log, EVENTS),
        deferred,
        expiring,
    )


def _availability(s: SparkSession, d: str, log: DataFrame) -> DataFrame:
    return cap.capture_availability(log, td.captures(s, d), CAPTURES)


# --- sources and sinks --------------------------------------------------------------------------


@query
def scan_fetches(s, d):
    return fetch_source.scan_fetches(td.documents(s, d)).select("run_id", "source", "source_ord", "fetch_url", "parent_url", "http_status")


@query
def fetch_failures(s, d):
    return fetch_source.fetch_failures(td.documents(s, d), td.document_registry(s, d))


@query
def scan_state(s, d):
    root = fresh_path(s, "seen")
    state.write_state(td.page_seen(s, d), root, "norm_url")
    return state.scan_state(s, root, schemas.SEEN)


@query
def write_state(s, d):
    """Two versions; the second holds what stays after the purge and is what a reader gets."""
    root = fresh_path(s, "seen")
    state.write_state(td.page_seen(s, d), root, "norm_url")
    kept = retention.purge_seen(state.scan_state(s, root, schemas.SEEN), EVENTS)
    state.write_state(kept, root, "norm_url")
    return state.scan_state(s, root, schemas.SEEN)


@query
def append_log(s, d):
    root = fresh_path(s, "dropped")
    state.append_log(_loss_log(s, d), root)
    return state.scan_log(s, root, schemas.DROPPED_URLS).drop("run_date")


@query
def registry_violations(s, d):
    return registry_source.registry_violations(td.raw_registry(s, d))


# --- extraction ---------------------------------------------------------------------------------


@query
def rss_items(s, d):
    return extract.rss_items(td.documents(s, d), td.document_registry(s, d))


@query
def sitemap_urls(s, d):
    return extract.sitemap_urls(td.documents(s, d), td.document_registry(s, d))


@query
def sitemap_index_expand(s, d):
    return extract.sitemap_index_expand(td.documents(s, d), td.document_registry(s, d))


@query
def sitemap_frontier(s, d):
    return extract.sitemap_frontier(td.documents(s, d), td.document_registry(s, d))


@query
def url_pattern_filter(s, d):
    kept = extract.url_pattern_filter(td.page_items(s, d), td.page_registry(s, d))
    return kept.select("source", "item_ord", "url")


@query
def discover(s, d):
    return extract.discover(td.documents(s, d), td.document_registry(s, d))


@query
def pending_leftovers(s, d):
    return lookup.pending_leftovers(td.page_seen(s, d))


@query
def stale_pending(s, d):
    log = td.outcomes(s, d, per_day=True)
    return lookup.stale_pending(outcomes.seen_from_outcomes(log, EVENTS), EVENTS).select("norm_url", "first_seen", "job_id", "attempts")


# --- URLs ---------------------------------------------------------------------------------------


@query
def normalize_urls(s, d):
    return td.page_items(s, d).select("source", "item_ord", "url", "norm_url")


@query
def tracking_params_report(s, d):
    return lookup.tracking_params_report(td.page_items(s, d))


@query
def dedupe_first_wins(s, d):
    return lookup.dedupe_first_wins(td.page_items(s, d))


@query
def capture_links(s, d):
    return lookup.capture_links(td.outcomes(s, d))


# --- joins --------------------------------------------------------------------------------------


@query
def new_urls(s, d):
    return lookup.new_urls(td.page_items(s, d), td.page_seen(s, d))


@query
def archived_urls(s, d):
    return lookup.archived_urls(td.page_items(s, d), td.page_seen(s, d))


@query
def status_lookup(s, d):
    return lookup.status_lookup(td.page_items(s, d), td.page_seen(s, d))


@query
def feed_drops(s, d):
    return _drops(s, d)


@query
def feed_runs(s, d):
    """Runs that count as read, by the documents fetched in them."""
    return feeds.feed_runs(td.history_documents(s, d), td.history_registry(s, d), EVENTS)


@query
def document_drops(s, d):
    """J4 from documents to losses: cut, failed and missing documents report nothing as dropped."""
    fetches, registry = td.history_documents(s, d), td.history_registry(s, d)
    runs = durable(feeds.feed_runs(fetches, registry, EVENTS))
    return feeds.feed_drops(feeds.feed_snapshots(extract.discover(fetches, registry), runs), runs)


@query
def dropped_unarchived(s, d):
    return _lost(s, d)


@query
def capture_availability(s, d):
    return cap.capture_availability(td.captures(s, d), td.captures(s, d), CAPTURES)


@query
def indexed_availability(s, d):
    """J7 against a stored index: the captures of the URLs that events name."""
    root = fresh_path(s, "captures")
    cap.write_capture_index(td.captures(s, d), root, "all", prefixes=64)
    urls = durable(td.events(s, d).select(td.user_url().alias("norm_url")).distinct())
    return cap.capture_availability(urls, cap.captures_of(urls, root), CAPTURES)


@query
def recheck_dropped(s, d):
    log = durable(_loss_log(s, d))
    return feeds.recheck_dropped(log, _availability(s, d, log))


@query
def recapture_needed(s, d):
    urls = td.captures(s, d).select("norm_url").unionByName(td.page_items(s, d).select("norm_url"))
    return cap.recapture_needed(urls, td.captures(s, d), CAPTURES)


@query
def error_classification(s, d):
    return lookup.error_classification(td.outcomes(s, d))


@query
def outcomes_to_jobs(s, d):
    """Jobs of one day are answered by what happened to the same event number a day's worth later."""
    log = td.outcomes(s, d).filter(F.col("job_id").isNotNull())
    n = F.col("seq")
    answers = log.select(
        "job_id",
        F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit("error")).when(n % 5 == 2, F.lit("pending"))
        .otherwise(F.lit("success")).alias("status"),
        F.when(n % 5 == 1, F.lit("error:no-access")).alias("answer_ext"),
    )
    return lookup.outcomes_to_jobs(log.select("norm_url", "job_id"), answers)


# --- state folding ------------------------------------------------------------------------------


@query
def seen_from_outcomes(s, d):
    return outcomes.seen_from_outcomes(td.outcomes(s, d), EVENTS)


@query
def seen_merge(s, d):
    """The state holds the events before noon, those of the afternoon are merged in."""
    log = td.outcomes(s, d, per_day=True)
    before = outcomes.seen_from_outcomes(log.filter(F.hour("ts") < 12), EVENTS)
    return outcomes.seen_merge(before, log.filter(F.hour("ts") >= 12), EVENTS)


@query
def attempts_timeline(s, d):
    timeline = outcomes.attempts_timeline(td.outcomes(s, d, per_day=True), EVENTS)
    return timeline.filter("is_error").select("norm_url", "seq", "kind", "attempt", "will_retry")


@query
def retry_candidates(s, d):
    found = lookup.retry_candidates(td.page_items(s, d), td.page_seen(s, d))
    return found.select("norm_url", "source", "url", "attempts")


# --- aggregations -------------------------------------------------------------------------------


@query
def feed_run_stats(s, d):
    return _stats(s, d)


@query
def published_coverage(s, d):
    return feeds.published_coverage(td.event_items(s, d))


@query
def run_outcome_totals(s, d):
    return outcomes.run_outcome_totals(td.outcomes(s, d, per_day=True), EVENTS).drop("rate_limited")


@query
def already_archived_by_source(s, d):
    return outcomes.already_archived_by_source(td.outcomes(s, d))


@query
def rate_limited_by_source(s, d):
    return outcomes.rate_limited_by_source(td.outcomes(s, d))


@query
def drop_reason_counts(s, d):
    return feeds.drop_reason_counts(_lost(s, d))


@query
def run_summary(s, d):
    return _history(s, d)


@query
def attach_outcomes_to_stats(s, d):
    return _full_stats(s, d)


@query
def dropped_count_by_run(s, d):
    return feeds.dropped_count_by_run(_loss_log(s, d))


# --- capture plan -------------------------------------------------------------------------------

_RANKED = ["run_id", "source", "norm_url", "k"]


@query
def urgency_rank(s, d):
    return planning.urgency_rank(_backlog(s, d), PAGES).select(*_RANKED, "published_at", "item_ord")


@query
def reserved_floor(s, d):
    return planning.reserved_floor(_backlog(s, d), td.page_registry(s, d), PAGES).select(*_RANKED, "slot")


@query
def proportional_share(s, d):
    return planning.share_keys(_backlog(s, d), td.page_registry(s, d), PAGES).select(*_RANKED, "n", "share")


@query
def exhaustive_demotion(s, d):
    keyed = planning.share_keys(_backlog(s, d), td.page_registry(s, d), PAGES)
    return keyed.select(*_RANKED, "exhaustive", "phase", "tier")


@query
def capture_plan(s, d):
    return _page_plan(s, d)[1]


@query
def planned_vs_deferred(s, d):
    return planning.planned_vs_deferred(*_page_plan(s, d))


@query
def pacing(s, d):
    return planning.pacing(_page_plan(s, d)[1], PAGES).select("run_id", "slot", "norm_url", "minute")


@query
def rate_budget_audit(s, d):
    return rate.rate_budget_audit(td.submits(s, d), RATE_LIMIT, RATE_WINDOW)


@query
def slot_capacity(s, d):
    return outcomes.slot_capacity(td.accounts(s, d), EVENTS)


@query
def latest_per_source(s, d):
    return reports.latest_per_source(_full_stats(s, d))


@query
def dropped_sample(s, d):
    return feeds.dropped_sample(_lost(s, d))


# --- retention ----------------------------------------------------------------------------------


@query
def purge_seen(s, d):
    seen = outcomes.seen_from_outcomes(td.outcomes(s, d, per_day=True), EVENTS)
    total = retention.purged_seen_count(seen, EVENTS).scalar()
    kept = retention.purge_seen(seen, EVENTS).select("norm_url", "status", "first_seen")
    return kept.withColumn("purged", total)


@query
def purge_feed_stats(s, d):
    return retention.purge_by_time(_full_stats(s, d), EVENTS)


@query
def purge_dropped(s, d):
    return retention.purge_by_time(_loss_log(s, d), EVENTS)


@query
def purge_runs(s, d):
    return retention.purge_by_time(_history(s, d), EVENTS)


# --- monitoring ---------------------------------------------------------------------------------


@query
def run_health(s, d):
    return reports.run_health(_history(s, d))


@query
def coverage_alerts(s, d):
    return reports.coverage_alerts(_full_stats(s, d))


@query
def source_status(s, d):
    return reports.source_status(_full_stats(s, d))


@query
def run_trend(s, d):
    return reports.run_trend(_history(s, d))


@query
def recent_runs(s, d):
    return reports.recent_runs(_history(s, d), feeds.dropped_count_by_run(_loss_log(s, d)))


@query
def recent_dropped(s, d):
    return reports.recent_dropped(durable(_loss_log(s, d)))


@query
def data_freshness(s, d):
    return reports.data_freshness(_history(s, d), EVENTS)


@query
def recheck_worklist(s, d):
    log = durable(_loss_log(s, d))
    return reports.recheck_worklist(log, _availability(s, d, log))


# --- streaming ----------------------------------------------------------------------------------


@query
def stream_discover(s, d):
    """Documents written as files, read as a stream; the items must be those of `discover`."""
    root = fresh_path(s, "fetches")
    td.documents(s, d).write.parquet(f"{root}/in")
    found = fetch_source.stream_fetches(s, f"{root}/in")
    return jobs.collect_discovered(found, td.document_registry(s, d), f"{root}/job")


@query
def stream_seen_state(s, d):
    log = td.outcomes_of(td.events_stream(s, d), per_day=True)
    return jobs.maintain_seen(log, EVENTS, fresh_path(s, "stream-seen"))


@query
def stream_dedupe(s, d):
    rows = td.events_stream(s, d).select("ts", td.user_url().alias("norm_url"))
    return jobs.collect_unique(rows, "90 days", fresh_path(s, "stream-unique"))


@query
def stream_rate(s, d):
    rows = td.events_stream(s, d).select("ts", F.col("event_type").alias("account"))
    return jobs.collect_rate(rows, "1 hour", "10 minutes", fresh_path(s, "stream-rate"))


@query
def stream_feed_drops(s, d):
    rows = td.events_stream(s, d).select(
        F.col("day").alias("run_id"),
        F.col("event_type").alias("source"),
        normalize_url(td.user_url()).alias("norm_url"),
    )
    return jobs.collect_drops(rows, td.event_runs(s, d), fresh_path(s, "stream-drops"))


@query
def stream_stale_pending(s, d):
    log = td.outcomes_of(td.events_stream(s, d), per_day=True)
    return jobs.collect_stale(log, EVENTS, fresh_path(s, "stream-stale"))


@query
def stream_run_totals(s, d):
    log = td.outcomes_of(td.events_stream(s, d))
    return jobs.collect_run_totals(log, EVENTS, fresh_path(s, "stream-totals"))
