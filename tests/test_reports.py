from helpers import at, make, values

from feedtide.operators import reports
from feedtide.params import Params


def history(spark, *rows):
    return make(spark, "RUN_HISTORY", *rows)


def run(n, **counts):
    return dict(run_id=f"r{n:02d}", ts=at(f"2024-01-{n:02d}T12:00:00"), success=0, error=0, **counts) if "success" not in counts else dict(run_id=f"r{n:02d}", ts=at(f"2024-01-{n:02d}T12:00:00"), **counts)


def test_run_health(spark):
    rows = [
        run(1, success=0, error=0), run(2, success=4, error=1, error_permanent=1), run(3, success=1, error=1, rate_limited=151),
        run(4, success=1, error=200, rate_limited=150, deferred=3), run(5, success=159, error=41),
    ]
    found = reports.run_health(history(spark, *rows))
    columns = ("run_id", "success_rate", "rate_class", "permanent_warn", "rate_limited_warn", "deferred")
    assert values(found, *columns) == [
        ("r01", 100, "ok", False, False, 0), ("r02", 80, "ok", True, False, 0), ("r03", 50, "warn", False, True, 0),
        ("r04", 0, "bad", False, False, 3), ("r05", 80, "ok", False, False, 0),
    ]


def stats(spark):
    def row(source, run_id, day, **rest):
        return dict(source=source, run_id=run_id, ts=at(f"2024-01-{day:02d}T00:00:00"), **rest)

    return make(
        spark, "FEED_RUN_STATS",
        row("b", "d1", 1, item_count=1, dropped_count=9, dropped_unarchived_count=9),
        row("b", "d2", 2, item_count=3, new_count=1, dropped_count=2, dropped_unarchived_count=0,
            oldest_published_at="2024-01-01T00:00:00Z", newest_published_at="2024-01-02T23:00:00Z"),
        row("a", "d2", 2, item_count=8, new_count=8),
        row("c", "d1", 1, item_count=0, new_count=0, dropped_count=1, dropped_unarchived_count=1,
            oldest_published_at="2024-01-01T00:00:00Z", newest_published_at="2024-01-03T12:00:00Z"),
    )


def test_source_status(spark):
    rows = [tuple(r) for r in reports.source_status(stats(spark)).select("source", "exhaustive", "new_pct", "dropped_pct", "span", "span_unit", "rate_limited_count").collect()]
    assert rows == [
        ("b", False, 33.3, 66.7, 47, "h", 0),
        ("c", False, None, None, 3, "d", 0),
        ("a", True, 100.0, None, None, None, 0),
    ]


def test_alerts_look_at_the_latest_run_only(spark):
    assert values(reports.coverage_alerts(stats(spark)), "source", "dropped_unarchived_count") == [("c", 1)]


def test_trend_needs_two_runs(spark):
    assert reports.run_trend(history(spark, run(1, success=1, error=0))).count() == 0
    trend = reports.run_trend(history(spark, run(1, success=1, error=0), run(2, success=2, error=0, deferred=4)))
    assert trend.count() == 14
    assert values(trend.filter("series = 'deferred'"), "run_id", "n") == [("r01", 0), ("r02", 4)]


def test_recent_runs(spark):
    rows = [run(n, success=n, error=0) for n in range(1, 26)]
    rows.append(dict(ts=at("2024-01-30T00:00:00"), success=0, error=0))
    losses = spark.createDataFrame([("r25", 4)], "run_id string, dropped_count bigint")
    found = [(r.run_id, r.dropped_count) for r in reports.recent_runs(history(spark, *rows), losses).collect()]
    assert found[:3] == [(None, None), ("r25", 4), ("r24", 0)] and len(found) == 20


def test_recent_dropped(spark):
    rows = [dict(ts=at(f"2024-01-{1 + i % 28:02d}T00:00:00"), source="s", norm_url=f"u{i:03d}", reason="gave_up") for i in range(120)]
    rows.append(dict(ts=at("2024-02-01T00:00:00"), source="s", norm_url="new", reason="odd"))
    found = reports.recent_dropped(make(spark, "DROPPED_URLS", *rows)).collect()
    assert len(found) == 100 and {r.total for r in found} == {121}
    assert {r.label for r in found} == {"abandon définitif", "odd"}


def test_freshness_units(spark):
    ages = {"2024-01-01T12:59:00Z": (59, "min"), "2024-01-01T13:00:00Z": (1, "h"), "2024-01-03T11:00:00Z": (47, "h"), "2024-01-03T12:00:00Z": (2, "d")}
    for as_of, expected in ages.items():
        row = reports.data_freshness(history(spark, run(1, success=0, error=0)), Params(as_of=as_of)).first()
        assert (row.age, row.unit) == expected


def test_recheck_worklist(spark):
    log = make(spark, "DROPPED_URLS", *[dict(norm_url=u) for u in "aabc"])
    answers = spark.createDataFrame([("a", None), ("b", True), ("c", False)], "norm_url string, archived boolean")
    assert values(reports.recheck_worklist(log, answers), "norm_url") == [("a",), ("c",)]
