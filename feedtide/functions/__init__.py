"""Column to Column helpers; everything stays inside the JVM."""

from feedtide.functions.dates import feed_date, feed_date_text, stamp_to_timestamp
from feedtide.functions.status import drop_reason, is_archived_status, is_permanent, reason_label
from feedtide.functions.urls import normalize_url, query_pairs, replay_link, resolve_reference

__all__ = [
    "drop_reason",
    "feed_date",
    "feed_date_text",
    "is_archived_status",
    "is_permanent",
    "normalize_url",
    "query_pairs",
    "reason_label",
    "replay_link",
    "resolve_reference",
    "stamp_to_timestamp",
]
