"""Table schemas (DDL strings) shared by readers, operators and tests."""

REGISTRY = (
    "source STRING, type STRING, url STRING, url_pattern STRING, exhaustive BOOLEAN, source_ord BIGINT"
)
RAW_REGISTRY = (
    "source_ord BIGINT, name STRING, type STRING, url STRING, url_pattern STRING, exhaustive STRING"
)
FETCHES = (
    "run_id STRING, source STRING, source_ord BIGINT, fetch_url STRING, parent_url STRING, "
    "http_status INT, fetched_at TIMESTAMP, body STRING"
)
DISCOVERED = (
    "run_id STRING, source STRING, source_ord BIGINT, item_ord BIGINT, url STRING, norm_url STRING, "
    "title STRING, published_at STRING"
)
OUTCOMES = (
    "run_id STRING, source STRING, norm_url STRING, seq BIGINT, ts TIMESTAMP, kind STRING, "
    "job_id STRING, status_ext STRING, message STRING, original_url STRING, capture_ts STRING, "
    "n_rate_limited INT"
)
SEEN = (
    "norm_url STRING, first_seen TIMESTAMP, job_id STRING, status STRING, attempts BIGINT, "
    "last_checked TIMESTAMP, last_seq BIGINT, last_kind STRING, last_retryable BOOLEAN, job_seq BIGINT"
)
CAPTURES = "norm_url STRING, captured_at TIMESTAMP, available BOOLEAN, check_failed BOOLEAN, checked_at TIMESTAMP"
FEED_SNAPSHOTS = "run_id STRING, source STRING, norm_url STRING"
FEED_RUN_STATS = (
    "run_id STRING, source STRING, ts TIMESTAMP, item_count BIGINT, new_count BIGINT, "
    "dropped_count BIGINT, dropped_unarchived_count BIGINT, oldest_published_at STRING, "
    "newest_published_at STRING, already_archived_count BIGINT, rate_limited_count BIGINT"
)
DROPPED_URLS = "ts TIMESTAMP, source STRING, norm_url STRING, reason STRING, run_id STRING"
RUN_HISTORY = (
    "run_id STRING, ts TIMESTAMP, sources_processed BIGINT, discovered BIGINT, success BIGINT, "
    "error BIGINT, error_retry BIGINT, error_permanent BIGINT, already_archived BIGINT, "
    "pending BIGINT, rate_limited BIGINT, deferred BIGINT, purged BIGINT"
)
