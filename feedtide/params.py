"""Run parameters. They live on the driver and reach the plans as literals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Duration suffixes of the capture service (m = minutes, M = months, none = seconds).
DURATION_UNITS = {
    "": "secs",
    "s": "secs",
    "m": "mins",
    "h": "hours",
    "d": "days",
    "w": "weeks",
    "M": "months",
    "y": "years",
}


def split_duration(text: str) -> tuple[int, str]:
    found = re.fullmatch(r"([0-9]+)([smhdwMy]?)", text)
    if found is None:
        raise ValueError(f"not a duration: {text!r} (a number, then optionally one of s m h d w M y)")
    return int(found[1]), DURATION_UNITS[found[2]]


def parse_duration(text: str) -> Column:
    """'12h', '5d', '1M' or plain seconds, as an interval literal."""
    amount, unit = split_duration(text)
    return F.make_interval(**{unit: F.lit(float(amount) if unit == "secs" else amount)})


@dataclass(frozen=True)
class Params:
    """Knobs of one run. `as_of` replaces the wall clock, so a run can be repeated exactly."""

    as_of: str
    recapture_window: str = "1h"
    captures_per_minute: int = 7
    run_budget_seconds: int = 6000
    concurrent_captures: int = 10
    reserved_per_source: int = 1
    attempts_limit: int = 3
    retention_days: int = 90
    pending_hours_limit: float = 6.0
    settled_after_hours: float = 5.0
    ignore_failed_fetches: bool = True
    by_instant: bool = False

    def __post_init__(self) -> None:
        split_duration(self.recapture_window)

    @property
    def capacity(self) -> int:
        """Captures one run can submit: rate x time budget."""
        return self.captures_per_minute * self.run_budget_seconds // 60

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")

    def before(self, **interval: float) -> Column:
        return self.now() - F.make_interval(**{unit: F.lit(n) for unit, n in interval.items()})

    def first_day(self) -> str:
        """The day that retention begins on, as YYYY-MM-DD."""
        now = dt.datetime.fromisoformat(self.as_of.replace("Z", "+00:00"))
        return (now - dt.timedelta(days=self.retention_days)).date().isoformat()

    def retention_cutoff(self) -> Column:
        return self.before(days=self.retention_days)
