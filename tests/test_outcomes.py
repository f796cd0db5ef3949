import random

from helpers import at, by, make, values

from feedtide.operators import outcomes as oc
from feedtide.params import Params
from feedtide.sources import testdata as td

PARAMS = Params(as_of="2024-01-31T00:00:00Z", attempts_limit=3)


def event(seq, kind, url="u", code=None, job=None, run="r1", source="s", limited=0):
    return dict(
        run_id=run, source=source, norm_url=url, seq=seq, ts=at(f"2024-01-01T{seq % 24:02d}:00:00"), kind=kind,
        status_ext=code, job_id=job, n_rate_limited=limited,
    )


def fold(spark, *events):
    return oc.seen_from_outcomes(make(spark, "OUTCOMES", *events), PARAMS)


def status(spark, *events):
    return [r.status for r in fold(spark, *events).collect()]


def test_status_of_the_last_event(spark):
    assert status(spark, event(1, "submitted", job="j")) == ["pending"]
    assert status(spark, event(1, "submitted"), event(2, "success")) == ["success"]
    assert status(spark, event(1, "already_archived")) == ["already_archived"]
    assert status(spark, event(1, "submitted"), event(2, "poll_timeout"), event(3, "poll_failed")) == ["pending"]


def test_errors_are_retried_until_the_limit(spark):
    errors = [event(i, "job_error", code="error:bad-gateway") for i in range(1, 4)]
    assert status(spark, *errors[:2]) == ["error_retry"]
    assert status(spark, *errors) == ["error"]
    assert status(spark, event(1, "job_error", code="error:no-access")) == ["error"]
    assert status(spark, event(1, "job_error")) == ["error_retry"]
    assert status(spark, event(1, "stale")) == ["error_retry"]
    assert status(spark, event(1, "submit_error", code="error:no-access")) == ["error_retry"]


def test_attempts_survive_success_and_resubmission(spark):
    row = fold(
        spark,
        event(1, "submitted", job="j1"), event(2, "job_error", code="x"), event(3, "submitted", job="j2"),
        event(4, "success"), event(5, "submit_error"), event(6, "submitted", job=""),
    ).first()
    assert (row.status, row.attempts, row.job_id, row.last_seq, row.job_seq) == ("pending", 2, "j2", 6, 3)
    assert (row.first_seen, row.last_checked) == (at("2024-01-01T01:00:00").replace(tzinfo=None), at("2024-01-01T06:00:00").replace(tzinfo=None))


def test_merging_any_split_in_any_order_equals_the_fold(spark):
    rnd = random.Random(5)
    kinds = ["submitted", "success", "already_archived", "job_error", "submit_error", "stale", "poll_failed"]
    log = [
        event(i, rnd.choice(kinds), url=f"u{rnd.randint(0, 9)}", code=rnd.choice([None, "error:blocked", "error:x"]), job=rnd.choice([None, "", f"j{i}"]))
        for i in range(150)
    ]
    whole = values(fold(spark, *log), *oc.SEEN_COLUMNS)
    for _ in range(2):
        rnd.shuffle(log)
        cut = sorted(rnd.sample(range(1, 150), 2))
        seen = make(spark, "SEEN")
        for part in (log[: cut[0]], log[cut[0] : cut[1]], log[cut[1] :]):
            seen = oc.seen_merge(seen, make(spark, "OUTCOMES", *part), PARAMS)
        assert values(seen, *oc.SEEN_COLUMNS) == whole


def test_rows_without_events_stay_as_they_are(spark):
    seen = make(spark, "SEEN", dict(norm_url="u", status="error_retry", attempts=7, last_kind="stale", last_retryable=True))
    assert values(oc.seen_merge(seen, make(spark, "OUTCOMES"), PARAMS), "status", "attempts") == [("error_retry", 7)]


def test_attempt_numbers(spark):
    log = [
        event(1, "job_error", code="x"), event(2, "success"), event(3, "stale"), event(4, "job_error", code="x"),
        event(1 << 21, "job_error", code="x"), event(7, "job_error", url="v", code="error:blocked"),
    ]
    found = oc.attempts_timeline(make(spark, "OUTCOMES", *log), PARAMS)
    assert values(found, "norm_url", "seq", "attempt", "will_retry") == sorted(
        [
            ("u", 1, 1, True), ("u", 2, 1, None), ("u", 3, 2, True), ("u", 4, 3, False),
            ("u", 1 << 21, 4, False), ("v", 7, 1, False),
        ],
        key=repr,
    )
    base = make(spark, "SEEN", dict(norm_url="u", attempts=2))
    later = oc.attempts_timeline(make(spark, "OUTCOMES", log[0]), PARAMS, base)
    assert values(later, "attempt", "will_retry") == [(3, False)]


def test_run_totals(spark):
    log = [
        event(1, "success"), event(2, "already_archived", url="v"), event(3, "poll_timeout", url="w"),
        event(4, "poll_failed", url="x"), event(5, "job_error", url="y", code="error:blocked"),
        event(6, "stale", url="z"), event(7, "submitted", url="q"), event(8, "success", run="r2"),
    ]
    found = oc.run_outcome_totals(make(spark, "OUTCOMES", *log), PARAMS)
    columns = ("run_id", "success", "error", "pending", "already_archived", "error_retry", "error_permanent")
    assert values(found, *columns) == [("r1", 1, 2, 2, 1, 1, 1), ("r2", 1, 0, 0, 0, 0, 0)]


def test_counts_by_source(spark):
    log = make(
        spark, "OUTCOMES",
        event(1, "already_archived"), event(2, "already_archived", source="t", limited=3),
        event(3, "submitted", source="t", limited=1), event(4, "success"),
    )
    assert values(oc.already_archived_by_source(log), "source", "already_archived_count") == [("s", 1), ("t", 1)]
    assert values(oc.rate_limited_by_source(log), "source", "rate_limited_count") == [("t", 4)]


def test_status_as_of_uses_earlier_runs_only(spark):
    log = make(
        spark, "OUTCOMES",
        event(1, "submitted", run="d1"), event(2, "success", run="d3"), event(3, "stale", url="v", run="d1"),
        event(4, "stale", url="v", run="d2"), event(5, "stale", url="v", run="d3"),
    )
    keys = spark.createDataFrame([(u, f"d{d}") for u in "uvw" for d in (1, 2, 3, 4)], "norm_url string, run_id string")
    found = oc.status_as_of(keys, log, PARAMS)
    assert values(found, "norm_url", "run_id", "status") == [
        ("u", "d2", "pending"), ("u", "d3", "pending"), ("u", "d4", "success"),
        ("v", "d2", "error_retry"), ("v", "d3", "error_retry"), ("v", "d4", "error"),
    ]


def test_capacity_of_an_account(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 0), ("c", 99), ("d", None)], "account string, available int")
    assert by(oc.slot_capacity(rows, PARAMS), "account", "slots") == {"a": 3, "b": 1, "c": 10, "d": 10}


def test_run_summary_fills_missing_counts(spark):
    runs = spark.createDataFrame([("r1", at("2024-01-01T00:00:00"))], "run_id string, ts timestamp")
    row = oc.run_summary(runs, spark.createDataFrame([("r2", 5)], "run_id string, discovered bigint")).first()
    assert row.discovered == 0 and row.purged == 0


def test_hot_url_is_not_one_task(spark, sf_dir):
    plan = oc.attempts_timeline(td.outcomes(spark, sf_dir), PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "Python" not in plan and "CartesianProduct" not in plan
