"""Status domain of a URL and of its capture attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that confirm a capture.
ARCHIVED_STATUSES = ("success", "already_archived")

# Service error codes that never succeed on a retry; all other codes are transient.
PERMANENT_CODES = (
    "error:bad-request",
    "error:blocked",
    "error:blocked-client-ip",
    "error:blocked-url",
    "error:filesize-limit",
    "error:ftp-access-denied",
    "error:invalid-host-resolution",
    "error:invalid-url-syntax",
    "error:max-daily-bandwidth",
    "error:max-daily-bandwidth-from-ip",
    "error:max-daily-bandwidth-host",
    "error:method-not-allowed",
    "error:no-access",
    "error:not-found",
    "error:not-implemented",
    "error:too-many-daily-captures",
    "error:unauthorized",
)

# Why a URL left its feed without a capture, by its status at that time.
REASON_BY_STATUS = {
    "error": "gave_up",
    "error_retry": "still_retrying",
    "pending": "still_pending",
}

# Display labels of the reasons on the monitoring page.
REASON_LABELS = {
    "never_attempted": "jamais tentée",
    "gave_up": "abandon définitif",
    "still_retrying": "réessai en cours à la perte",
    "still_pending": "capture en cours à la perte",
}

ERROR_KINDS = ("job_error", "submit_error", "stale")
STATE_KINDS = ("submitted", "success", "already_archived", *ERROR_KINDS)
PENDING_KINDS = ("poll_failed", "poll_timeout")


def _relabel(value: Column, table: dict[str, str]) -> Column:
    pairs = list(table.items())
    mapped = F.when(value == pairs[0][0], F.lit(pairs[0][1]))
    for key, label in pairs[1:]:
        mapped = mapped.when(value == key, F.lit(label))
    return mapped.otherwise(value)


def is_permanent(status_ext: Column) -> Column:
    """False for NULL and unknown codes: those are worth a retry."""
    return F.coalesce(status_ext.isin(*PERMANENT_CODES), F.lit(False))


def is_archived_status(status: Column) -> Column:
    return F.coalesce(status.isin(*ARCHIVED_STATUSES), F.lit(False))


def is_known_status(status: Column) -> Column:
    """Known = has a state row that is not waiting for a retry."""
    return F.coalesce(status != "error_retry", F.lit(False))


def drop_reason(status: Column) -> Column:
    known = F.when(status == "", F.lit(None)).otherwise(status)
    return F.coalesce(_relabel(known, REASON_BY_STATUS), F.lit("never_attempted"))


def reason_label(reason: Column) -> Column:
    return _relabel(reason, REASON_LABELS)


def is_retryable(kind: Column, status_ext: Column) -> Column:
    """Failed submits and stale jobs may always be retried; finished jobs depend on their error code."""
    return F.when(kind == "job_error", ~is_permanent(status_ext)).otherwise(
        kind.isin("submit_error", "stale")
    )


def folded_status(kind: Column, retryable: Column, attempts: Column, attempts_limit: int) -> Column:
    """Status of a URL after its last event `kind` and `attempts` failures in total."""
    return (
        F.when(kind == "submitted", F.lit("pending"))
        .when(kind.isin(*ARCHIVED_STATUSES), kind)
        .when(retryable & (attempts < attempts_limit), F.lit("error_retry"))
        .otherwise(F.lit("error"))
    )
