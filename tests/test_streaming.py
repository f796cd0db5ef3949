import subprocess
import sys

import pytest
from helpers import make, values
from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.operators import extract, feeds, lookup, retention
from feedtide.operators import outcomes as oc
from feedtide.operators.planning import _turn_taker
from feedtide.params import Params
from feedtide.sources import testdata as td
from feedtide.streaming import jobs, sinks

PARAMS = Params(as_of="2024-01-30T23:00:00Z", attempts_limit=3)


class Feed:
    """A folder that grows file by file, and a stream over it that takes one file per batch."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, str(root), schema

    def add(self, rows):
        rows.coalesce(1).write.mode("append").parquet(self.root)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.root)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return td.outcomes(spark, sf_dir, per_day=True)


def in_two_calls(spark, log, root, job, schema=schemas.OUTCOMES, by="seq"):
    """Calls the job twice: over two files that have nothing to do with time, then over a third one as well."""
    feed = Feed(spark, f"{root}/in", schema)
    third = F.pmod(F.xxhash64(by), F.lit(3))
    for n in (2, 0):
        feed.add(log.filter(third == n))
    job(feed.stream(), f"{root}/job").count()
    feed.add(log.filter(third == 1))
    return job(feed.stream(), f"{root}/job")


def test_discover(spark, sf_dir, tmp_path):
    docs, registry = td.documents(spark, sf_dir), td.document_registry(spark, sf_dir)
    found = in_two_calls(spark, docs, tmp_path, lambda s, root: jobs.collect_discovered(s, registry, root), schemas.FETCHES, "fetch_url")
    columns = ("source", "source_ord", "item_ord", "norm_url", "published_at")
    assert values(found, *columns) == values(extract.discover(docs, registry), *columns)


def test_index_children_that_come_much_later_are_found(spark, tmp_path):
    registry = make(spark, "REGISTRY", dict(source="s", source_ord=0, type="sitemap", url="http://x/i.xml"))
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = dict(run_id="r1", source="s", source_ord=0, fetch_url="http://x/i.xml", http_status=200, body=f"<sitemapindex {space}><sitemap><loc>http://x/c.xml</loc></sitemap></sitemapindex>", fetched_at=_at("2024-01-01T00:00:00"))
    child = dict(run_id="r1", source="s", source_ord=0, fetch_url="http://x/c.xml", parent_url="http://x/i.xml", http_status=200, body=f"<urlset {space}><url><loc>http://x/1</loc></url></urlset>", fetched_at=_at("2024-01-09T00:00:00"))
    feed = Feed(spark, tmp_path / "in", schemas.FETCHES)
    for row in (index, child):
        feed.add(make(spark, "FETCHES", row))
        found = jobs.collect_discovered(feed.stream(), registry, str(tmp_path / "job"))
    assert values(found, "norm_url") == [("http://x/1",)]


def _at(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


def test_seen_state_goes_on_after_a_restart(spark, log, tmp_path):
    found = in_two_calls(spark, log, tmp_path, lambda s, root: jobs.maintain_seen(s, PARAMS, root))
    expected = oc.seen_from_outcomes(log, PARAMS)
    assert values(found, *oc.SEEN_COLUMNS) == values(expected, *oc.SEEN_COLUMNS)


def test_compacted_state_is_the_purged_state(spark, log, tmp_path):
    params = Params(as_of="2024-01-30T23:00:00Z", attempts_limit=3, retention_days=20)
    feed = Feed(spark, tmp_path / "in", schemas.OUTCOMES)
    feed.add(log)
    root = str(tmp_path / "job")
    jobs.maintain_seen(feed.stream(), params, root).count()
    jobs.compact_seen(spark, params, root)
    jobs.compact_seen(spark, params, root)
    found = jobs.maintain_seen(feed.stream(), params, root)
    expected = retention.purge_seen(oc.seen_from_outcomes(log, params), params)
    assert values(found, "norm_url", "status", "attempts") == values(expected, "norm_url", "status", "attempts")


def test_state_purged_as_it_is_folded(spark, log, tmp_path):
    params = Params(as_of="2024-01-30T23:00:00Z", attempts_limit=3, retention_days=20)
    found = in_two_calls(spark, log.filter("seq % 3 != 0"), tmp_path, lambda s, root: jobs.maintain_seen(s, params, root, purge=True))
    expected = retention.purge_seen(oc.seen_from_outcomes(log.filter("seq % 3 != 0"), params), params)
    assert set(values(expected, "norm_url", "status")) <= set(values(found, "norm_url", "status"))
    assert found.filter((F.col("status") != "pending") & (F.col("first_seen") < params.retention_cutoff())).isEmpty()


def counts(spark, *rows):
    return spark.createDataFrame(rows, "name string, n bigint")


def fold_counts(spark, table, batch, *rows):
    sinks.fold_batch(counts(spark, *rows), table, "name string, n bigint", ["name"], lambda r: sinks.sum_by(r, ["name"]), batch)


def test_folds_stay_few_and_touch_only_their_buckets(spark, tmp_path):
    table, schema = str(tmp_path / "counts"), "name string, n bigint"
    for batch in range(20):
        fold_counts(spark, table, batch, ("always", 1), (f"name{batch}", 2))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list((tmp_path / "counts").glob("fold=*"))) <= 2 * buckets
    assert len(list((tmp_path / "counts").glob("fold=*/bucket=*"))) <= 2 * buckets
    expected = sorted([("always", 20)] + [(f"name{k}", 2) for k in range(20)])
    earlier = sinks.read_folded(spark, table, schema)
    fold_counts(spark, table, 19, ("always", 1), ("name19", 2))  # a batch that is run again
    assert values(sinks.read_folded(spark, table, schema), "name", "n") == expected
    fold_counts(spark, table, 20, ("always", 1))
    assert values(earlier, "name", "n") == expected  # a result that was built before the fold
    newest = max((tmp_path / "counts").glob("fold=*"))
    assert len(list(newest.glob("bucket=*"))) == 1
    fold_counts(spark, table, 21)  # an empty batch
    assert dict(values(sinks.read_folded(spark, table, schema), "name", "n"))["always"] == 21


def test_an_unfinished_fold_is_done_again_and_an_emptied_bucket_stays_empty(spark, tmp_path):
    table, schema = str(tmp_path / "counts"), "name string, n bigint"
    fold_counts(spark, table, 0, ("a", 1), ("b", 1))
    fold_counts(spark, table, 1, ("a", 1))
    (tmp_path / "counts" / "fold=000000000002" / "_buckets").unlink()  # died before its end
    assert values(sinks.read_folded(spark, table, schema), "name", "n") == [("a", 1), ("b", 1)]
    fold_counts(spark, table, 1, ("a", 1))
    assert values(sinks.read_folded(spark, table, schema), "name", "n") == [("a", 2), ("b", 1)]
    for _ in range(2):
        sinks.refold(spark, table, schema, ["name"], lambda rows: rows.filter("name != 'a'"))
    assert values(sinks.read_folded(spark, table, schema), "name", "n") == [("b", 1)]
    fold_counts(spark, table, 2, ("a", 5))
    assert values(sinks.read_folded(spark, table, schema), "name", "n") == [("a", 5), ("b", 1)]


def test_unique_urls(spark, log, tmp_path):
    found = in_two_calls(spark, log, tmp_path, lambda s, root: jobs.collect_unique(s, "90 days", root))
    assert values(found, "norm_url") == values(log.select("norm_url").distinct(), "norm_url")


@pytest.mark.parametrize("per_day", [True, False])
def test_run_totals(spark, sf_dir, tmp_path, per_day):
    """Also for URLs with many failures, which arrive in any order, and without any lateness limit."""
    log = td.outcomes(spark, sf_dir, per_day=per_day)
    found = in_two_calls(spark, log, tmp_path, lambda s, root: jobs.collect_run_totals(s, PARAMS, root))
    expected = oc.run_outcome_totals(log, PARAMS)
    columns = ("run_id", "success", "error", "pending", "already_archived", "error_retry", "error_permanent")
    assert values(found, *columns) == values(expected, *columns)


def shots(spark, *rows):
    return make(spark, "FEED_SNAPSHOTS", *[dict(run_id=r, source="s", norm_url=u) for r, u in rows])


def test_drops_equal_the_batch_form_out_of_order(spark, sf_dir, tmp_path):
    listed, runs = td.event_snapshots(spark, sf_dir), td.event_runs(spark, sf_dir)
    found = in_two_calls(spark, listed, tmp_path, lambda s, root: jobs.collect_drops(s, runs, root), schemas.FEED_SNAPSHOTS, "norm_url")
    assert values(found, "run_id", "source", "norm_url") == values(feeds.feed_drops(listed, runs), "run_id", "source", "norm_url")


def test_a_run_cut_across_files_and_an_empty_run(spark, tmp_path):
    def runs(*names):
        return spark.createDataFrame([(r, "s", False) for r in names], "run_id string, source string, exhaustive boolean")

    feed, root = Feed(spark, tmp_path / "in", schemas.FEED_SNAPSHOTS), str(tmp_path / "job")
    feed.add(shots(spark, ("d1", "a"), ("d1", "b"), ("d2", "a")))
    assert jobs.collect_drops(feed.stream(), runs("d1"), root).count() == 0  # d2 has not been read to its end
    feed.add(shots(spark, ("d2", "b"), ("d3", "a"), ("d3", "b")))
    assert jobs.collect_drops(feed.stream(), runs("d1", "d2", "d3"), root).count() == 0
    found = jobs.collect_drops(feed.stream(), runs("d1", "d2", "d2e", "d3"), root)  # d2e was read and is empty
    assert values(found, "run_id", "norm_url") == [("d2e", "a"), ("d2e", "b")]


def test_a_call_compares_only_what_is_new(spark, tmp_path):
    def runs(*names):
        return spark.createDataFrame([(r, "s", False) for r in names], "run_id string, source string, exhaustive boolean")

    feed, root = Feed(spark, tmp_path / "in", schemas.FEED_SNAPSHOTS), str(tmp_path / "job")

    def call(*names):
        found = jobs.collect_drops(feed.stream(), runs(*names), root)
        number = max((tmp_path / "job" / "compared").glob("call=*"))
        return values(found, "run_id", "norm_url"), values(spark.read.parquet(str(number)), "run_id", "previous")

    feed.add(shots(spark, ("d1", "a"), ("d1", "b"), ("d2", "a")))
    assert call("d1", "d2") == ([("d2", "b")], [("d2", "d1")])
    assert call("d1", "d2") == ([("d2", "b")], [])
    feed.add(shots(spark, ("d3", "c")))
    assert call("d1", "d2", "d3") == ([("d2", "b"), ("d3", "a")], [("d3", "d2")])
    feed.add(shots(spark, ("d2", "b")))  # a late row changes both pairs of its run
    assert call("d1", "d2", "d3") == ([("d3", "a"), ("d3", "b")], [("d2", "d1"), ("d3", "d2")])
    assert call("d1", "d3") == ([("d3", "a"), ("d3", "b")], [("d3", "d1")])


def test_stored_partners_of_finished_runs_are_removed(spark, tmp_path):
    registry = make(spark, "REGISTRY", dict(source="s", source_ord=0, type="sitemap", url="http://x/i.xml"))
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'

    def index(run):
        return dict(run_id=run, source="s", source_ord=0, fetch_url="i", http_status=200, body=f"<sitemapindex {space}><sitemap><loc>c</loc></sitemap></sitemapindex>")

    def child(run):
        return dict(run_id=run, source="s", source_ord=0, fetch_url="c", parent_url="i", http_status=200, body=f"<urlset {space}><url><loc>http://x/{run}</loc></url></urlset>")

    feed, root = Feed(spark, tmp_path / "in", schemas.FETCHES), str(tmp_path / "job")
    feed.add(make(spark, "FETCHES", index("r1"), index("r2")))
    assert jobs.collect_discovered(feed.stream(), registry, root, first_run="r2").count() == 0
    feed.add(make(spark, "FETCHES", child("r1"), child("r2")))
    found = jobs.collect_discovered(feed.stream(), registry, root, first_run="r2")
    assert values(found, "run_id", "norm_url") == [("r2", "http://x/r2")]
    assert not list((tmp_path / "job").glob("*/batch=*/run_id=r1"))


def test_stale_pending(spark, log, tmp_path):
    found = in_two_calls(spark, log, tmp_path, lambda s, root: jobs.collect_stale(s, PARAMS, root))
    end = log.filter(F.col("kind").isin(*oc.STATE_KINDS)).agg(F.max("ts").alias("t")).first().t
    at_end = Params(as_of=end.isoformat() + "Z", pending_hours_limit=6)
    expected = lookup.stale_pending(oc.seen_from_outcomes(log, at_end), at_end)
    assert values(found, "norm_url") == values(expected, "norm_url")


def test_rate_windows_count_late_rows(spark, log, tmp_path):
    rows = log.select("ts", F.col("kind").alias("account"), "seq")
    found = in_two_calls(spark, rows, tmp_path, lambda s, root: jobs.collect_rate(s, "1 hour", "10 minutes", root), "ts timestamp, account string, seq bigint")
    assert found.agg(F.sum("submits")).first()[0] == 6 * rows.count()
    assert found.groupBy("account", "window_start").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("made", [_turn_taker])
def test_workers_need_no_copy_of_the_package(made, tmp_path):
    """What is sent to the workers can be unpickled where the package cannot be imported."""
    path = tmp_path / "sent"
    path.write_bytes(cloudpickle.dumps(made()))
    code = f"import pickle, sys; pickle.load(open({str(path)!r}, 'rb')); assert 'feedtide' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
