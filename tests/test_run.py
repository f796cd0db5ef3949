import pytest
from helpers import at, make, values

from feedtide import schemas
from feedtide.operators.outcomes import RUN_COUNTERS
from feedtide.params import Params
from feedtide.plans.run import KEYED, LOGGED, after_capture, before_capture, close_run, open_run, run_batch
from feedtide.sources.state import scan_log, scan_state, write_state


def feed(*links):
    items = "".join(f"<item><link>{u}</link><pubDate>{d}</pubDate></item>" for u, d in links)
    return f'<rss version="2.0"><channel>{items}</channel></rss>'


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
D1, D2 = "Mon, 01 Jan 2024 10:00:00 GMT", "Tue, 02 Jan 2024 10:00:00 GMT"


def urlset(*urls):
    return f"<urlset {NS}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def fetch(run, source, ord, body, status=200):
    return dict(run_id=run, source=source, source_ord=ord, fetch_url=f"http://{source}/", http_status=status, fetched_at=at("2024-01-03T00:00:00"), body=body)


def test_two_runs(spark):
    registry = make(
        spark, "REGISTRY",
        dict(source="news", type="rss", exhaustive=False, source_ord=0),
        dict(source="all", type="sitemap", exhaustive=True, source_ord=1),
    )
    params = Params(as_of="2024-01-03T00:00:00Z", captures_per_minute=1, run_budget_seconds=180)
    inputs = {
        "registry": registry,
        "fetches": make(
            spark, "FETCHES",
            fetch("run1", "news", 0, feed(("http://n/1?utm_source=x", D1), ("http://n/2", D2))),
            fetch("run1", "all", 1, urlset("http://n/1", "http://s/1", "http://s/2")),
        ),
        "previous_snapshots": make(spark, "FEED_SNAPSHOTS"),
        "seen": make(spark, "SEEN"),
        "answers": make(spark, "OUTCOMES"),
        "dropped": make(spark, "DROPPED_URLS"),
        "captures": make(spark, "CAPTURES"),
        "stats": make(spark, "FEED_RUN_STATS"),
        "history": make(spark, "RUN_HISTORY"),
    }
    first = before_capture(inputs, params)
    assert values(first["plan"], "slot", "norm_url") == [(1, "http://n/1"), (2, "http://s/1"), (3, "http://n/2")]
    assert values(first["snapshots"], "source", "norm_url") == [("news", "http://n/1"), ("news", "http://n/2")]
    assert first["losses"].count() == 0
    log = make(
        spark, "OUTCOMES",
        dict(run_id="run1", source="news", norm_url="http://n/1", seq=1, ts=at("2024-01-03T00:01:00"), kind="submitted", job_id="j1"),
        dict(run_id="run1", source="news", norm_url="http://n/1", seq=2, ts=at("2024-01-03T00:02:00"), kind="poll_timeout"),
        dict(run_id="run1", source="all", norm_url="http://s/1", seq=3, ts=at("2024-01-03T00:03:00"), kind="already_archived"),
        dict(run_id="run1", source="news", norm_url="http://n/2", seq=4, ts=at("2024-01-03T00:04:00"), kind="submit_error", n_rate_limited=2),
    )
    closed = after_capture(first, inputs, log, params)
    assert values(closed["seen"], "norm_url", "status") == [("http://n/1", "pending"), ("http://n/2", "error_retry"), ("http://s/1", "already_archived")]
    row = closed["history"].first()
    assert {c: row[c] for c in RUN_COUNTERS} == dict(
        sources_processed=2, discovered=5, success=0, error=1, error_retry=1, error_permanent=0, already_archived=1,
        pending=1, rate_limited=2, deferred=1, purged=0,
    )
    assert values(closed["stats"], "source", "item_count", "new_count", "dropped_count", "already_archived_count", "rate_limited_count") == [
        ("all", 3, 3, None, 1, 0), ("news", 2, 2, 0, 0, 2),
    ]

    later = Params(as_of="2024-01-03T03:00:00Z", captures_per_minute=1, run_budget_seconds=180)
    second_inputs = dict(
        inputs,
        fetches=make(
            spark, "FETCHES",
            fetch("run2", "news", 0, feed(("http://n/3", D2))), fetch("run2", "all", 1, None, 503),
        ),
        previous_snapshots=first["snapshots"], seen=closed["seen"], dropped=closed["dropped"],
        stats=closed["stats"], history=closed["history"],
        answers=make(spark, "OUTCOMES", dict(run_id="run2", source="news", norm_url="http://n/1", seq=5, ts=at("2024-01-03T02:00:00"), kind="success", job_id="j1")),
    )
    second = before_capture(second_inputs, later)
    assert values(second["losses"], "run_id", "norm_url", "reason") == [("run2", "http://n/2", "still_retrying")]
    assert values(second["plan"], "norm_url") == [("http://n/3",)]
    done = run_batch(dict(second_inputs, outcomes=make(spark, "OUTCOMES")), later)
    assert values(done["snapshots"], "run_id", "norm_url") == [("run2", "http://n/3")]
    assert values(done["history"], "run_id", "success", "discovered") == [("run1", 0, 5), ("run2", 1, 1)]
    assert values(done["dropped"], "norm_url", "reason") == [("http://n/2", "still_retrying")]
    assert set(done["stats"].columns) == {c.strip().split(" ")[0] for c in schemas.FEED_RUN_STATS.split(",")}


def test_two_runs_through_folders_and_a_repeated_one(spark, tmp_path):
    root = str(tmp_path / "state")
    registry = make(spark, "REGISTRY", dict(source="news", type="rss", exhaustive=False, source_ord=0))
    none = dict(registry=registry, captures=make(spark, "CAPTURES"), answers=make(spark, "OUTCOMES"))

    def given(run, *links):
        return dict(none, fetches=make(spark, "FETCHES", fetch(run, "news", 0, feed(*links))))

    def outcome(run, url, seq, kind, minute):
        return dict(run_id=run, source="news", norm_url=url, seq=seq, kind=kind, ts=at(f"2024-01-03T00:{minute:02d}:00"), job_id="j")

    def stored():
        state = {name: sorted(map(str, scan_state(spark, f"{root}/{name}", schema).collect())) for name, schema in KEYED.items()}
        return state | {name: sorted(map(str, scan_log(spark, f"{root}/{name}", schema).collect())) for name, schema in LOGGED.items()}

    params = Params(as_of="2024-01-03T00:00:00Z")
    first = given("run1", ("http://n/1", D1), ("http://n/2", D2))
    opened = open_run(root, "run1", first, params)
    assert values(spark.read.parquet(f"{root}/plans/run=run1"), "slot", "norm_url") == [(1, "http://n/1"), (2, "http://n/2")]
    log = make(spark, "OUTCOMES", outcome("run1", "http://n/1", 1, "success", 1), outcome("run1", "http://n/2", 2, "submit_error", 2))
    close_run(root, "run1", first, log, params, opened)
    once = stored()
    assert len(once["seen"]) == 2 and len(once["history"]) == 1 and len(once["stats"]) == 1 and once["dropped"] == []

    open_run(root, "run1", first, params)  # the whole run again, in jobs of its own
    close_run(root, "run1", first, log, params)
    assert stored() == once

    later = Params(as_of="2024-01-03T03:00:00Z")
    second = given("run2", ("http://n/3", D2))
    opened = open_run(root, "run2", second, later)
    assert values(opened["losses"], "norm_url", "reason") == [("http://n/2", "still_retrying")]
    assert values(opened["plan"], "norm_url") == [("http://n/3",)]
    close_run(root, "run2", second, make(spark, "OUTCOMES", outcome("run2", "http://n/3", 3, "submitted", 3)), later)
    twice = stored()
    assert len(twice["seen"]) == 3 and len(twice["history"]) == 2 and len(twice["dropped"]) == 1
    close_run(root, "run2", second, make(spark, "OUTCOMES", outcome("run2", "http://n/3", 3, "submitted", 3)), later)
    assert stored() == twice
    assert [len(list((tmp_path / "state" / name).glob("v=*"))) for name in KEYED] == [2, 2, 2]


def test_a_run_that_died_half_way_is_finished(spark, tmp_path, monkeypatch):
    import feedtide.plans.run as run

    root, params = str(tmp_path / "state"), Params(as_of="2024-01-03T00:00:00Z")
    registry = make(spark, "REGISTRY", dict(source="news", type="rss", exhaustive=False, source_ord=0))
    given = dict(registry=registry, captures=make(spark, "CAPTURES"), answers=make(spark, "OUTCOMES"), fetches=make(spark, "FETCHES", fetch("r", "news", 0, feed(("http://n/1", D1)))))

    def dies(df, folder, *args, **options):
        if folder.endswith("/seen"):
            raise OSError("lost")
        return write_state(df, folder, *args, **options)

    monkeypatch.setattr(run, "write_state", dies)
    with pytest.raises(OSError):
        close_run(root, "r", given, make(spark, "OUTCOMES"), params)
    monkeypatch.undo()
    close_run(root, "r", given, make(spark, "OUTCOMES"), params)
    assert values(scan_state(spark, f"{root}/snapshots", schemas.FEED_SNAPSHOTS), "norm_url") == [("http://n/1",)]
    assert values(scan_log(spark, f"{root}/history", schemas.RUN_HISTORY), "run_id", "discovered") == [("r", 1)]
