from helpers import at, by, item, make, values

from feedtide.operators import lookup
from feedtide.params import Params
from feedtide.sources.registry import registry_violations

STATUSES = ("success", "already_archived", "pending", "error", "error_retry")


def seen_table(spark):
    return make(spark, "SEEN", *[dict(norm_url=f"https://a/{i}", status=s, attempts=i) for i, s in enumerate(STATUSES)])


def items_table(spark):
    rows = [item("a", i) for i in range(6)]
    rows += [item("b", 0, url="https://a/5", ord=1), item("b", 1, url="https://a/4", ord=1)]
    return make(spark, "DISCOVERED", *rows)


def test_first_item_wins_in_registry_then_list_order(spark):
    rows = [
        item("late", 0, url="https://x", ord=2),
        item("early", 9, url="https://x", ord=1),
        item("early", 3, url="https://x", ord=1),
        item("late", 1, url="https://x", ord=2, run="r2"),
    ]
    kept = lookup.dedupe_first_wins(make(spark, "DISCOVERED", *rows))
    assert values(kept, "run_id", "source", "item_ord") == [("r1", "early", 3), ("r2", "late", 1)]
    assert set(kept.columns) == set(make(spark, "DISCOVERED").columns)


def test_known_archived_retry(spark):
    items, seen = items_table(spark), seen_table(spark)
    assert values(lookup.new_urls(items, seen), "norm_url", "source") == [("https://a/4", "a"), ("https://a/5", "a")]
    assert values(lookup.archived_urls(items, seen), "norm_url") == [("https://a/0",), ("https://a/1",)]
    assert values(lookup.retry_candidates(items, seen), "norm_url", "attempts") == [("https://a/4", 4)]
    assert by(lookup.status_lookup(items, seen), "norm_url", "status") == {
        **{f"https://a/{i}": s for i, s in enumerate(STATUSES)},
        "https://a/5": None,
    }


def test_a_url_that_left_its_feed_is_not_retried(spark):
    items = make(spark, "DISCOVERED", item("a", 0))
    assert lookup.retry_candidates(items, seen_table(spark)).count() == 0


def test_leftovers_need_a_job(spark):
    seen = make(
        spark,
        "SEEN",
        dict(norm_url="1", status="pending", job_id="j"),
        dict(norm_url="2", status="pending"),
        dict(norm_url="3", status="pending", job_id=""),
        dict(norm_url="4", status="success", job_id="k"),
    )
    assert values(lookup.pending_leftovers(seen), "norm_url", "job_id") == [("1", "j")]


def test_stale_counts_from_first_sight_strictly(spark):
    params = Params(as_of="2024-01-02T12:00:00Z", pending_hours_limit=6)
    seen = make(
        spark,
        "SEEN",
        dict(norm_url="edge", status="pending", first_seen=at("2024-01-02T06:00:00")),
        dict(norm_url="old", status="pending", first_seen=at("2024-01-02T05:59:59"), last_checked=at("2024-01-02T11:59:00")),
        dict(norm_url="young", status="pending", first_seen=at("2024-01-02T07:00:00")),
        dict(norm_url="done", status="success", first_seen=at("2024-01-01T00:00:00")),
        dict(norm_url="unknown", status="pending"),
    )
    assert values(lookup.stale_pending(seen, params), "norm_url") == [("old",), ("unknown",)]


def test_error_classes(spark):
    codes = ["error:not-found", "error:bad-gateway", "error:something-new", None]
    rows = [dict(norm_url=str(i), seq=i, kind="job_error", status_ext=c) for i, c in enumerate(codes)]
    rows.append(dict(norm_url="9", seq=9, kind="success", status_ext="error:blocked"))
    found = lookup.error_classification(make(spark, "OUTCOMES", *rows))
    assert by(found, "norm_url", "permanent") == {"0": True, "1": False, "2": False, "3": False}


def test_answers_resolve_jobs(spark):
    jobs = spark.createDataFrame([("u1", "1"), ("u2", "2"), ("u3", "3"), ("u4", "4"), ("u5", "5")], "norm_url string, job_id string")
    answers = spark.createDataFrame([("1", "success"), ("2", "error"), ("3", "pending"), ("4", None)], "job_id string, status string")
    found = by(lookup.outcomes_to_jobs(jobs, answers), "norm_url", "result")
    assert found == {"u1": "success", "u2": "error", "u3": "pending", "u4": "pending", "u5": "pending"}


def test_registry_rules(spark):
    rows = [
        dict(source_ord=0, name="a", type="rss", url="u", exhaustive="true"),
        dict(source_ord=1, name="a", type="sitemap", url="u", exhaustive="False"),
        dict(source_ord=2, name="a", type="rss", url="u"),
        dict(source_ord=3, name="b", type="json", url=""),
        dict(source_ord=4, name="", type="rss", url="u"),
        dict(source_ord=5, name="c", url="u", exhaustive="yes"),
    ]
    found = values(registry_violations(make(spark, "RAW_REGISTRY", *rows)), "source_ord", "rule")
    assert found == [
        (1, "duplicate_name"), (2, "duplicate_name"), (3, "invalid_type"), (3, "missing_url"),
        (4, "missing_name"), (5, "missing_type"), (5, "non_boolean_exhaustive"),
    ]
    assert values(registry_violations(make(spark, "RAW_REGISTRY")), "source_ord", "rule") == [(None, "empty_registry")]
