"""Small tables for the tests."""

from __future__ import annotations

import datetime as dt

from feedtide import schemas

COLUMNS = {
    name: [part.strip().split(" ")[0] for part in getattr(schemas, name).split(", ")]
    for name in ("REGISTRY", "RAW_REGISTRY", "FETCHES", "DISCOVERED", "OUTCOMES", "SEEN", "CAPTURES", "DROPPED_URLS", "RUN_HISTORY", "FEED_RUN_STATS", "FEED_SNAPSHOTS")
}


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


def make(spark, schema: str, *rows: dict):
    """A table of the named schema; fields left out are NULL."""
    names = COLUMNS[schema]
    for row in rows:
        assert set(row) <= set(names), set(row) - set(names)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], getattr(schemas, schema))


def values(df, *columns: str) -> list:
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=repr)


def by(df, key: str, value: str) -> dict:
    return {r[0]: r[1] for r in df.select(key, value).collect()}


def item(source: str, n: int, date: str | None = None, url: str | None = None, ord: int = 0, run: str = "r1"):
    link = url or f"https://{source}/{n}"
    return dict(run_id=run, source=source, source_ord=ord, item_ord=n, url=link, norm_url=link, published_at=date)
