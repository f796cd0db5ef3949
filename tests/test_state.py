import pytest
from helpers import at, make, values

from feedtide import schemas
from feedtide.session import fresh_path, is_local, shared_folder
from feedtide.sources import state


def test_absent_state_is_empty(spark, tmp_path):
    assert state.scan_state(spark, str(tmp_path / "none"), schemas.SEEN).count() == 0
    assert state.scan_log(spark, str(tmp_path / "none"), schemas.DROPPED_URLS).count() == 0


def test_versions_are_kept_apart(spark, tmp_path):
    root = str(tmp_path / "seen")
    first = make(spark, "SEEN", dict(norm_url="b", status="pending", attempts=1), dict(norm_url="a", status="error"))
    assert state.write_state(first, root, "norm_url") == 1
    update = state.scan_state(spark, root, schemas.SEEN).filter("norm_url = 'b'")
    assert state.write_state(update, root, "norm_url") == 2
    assert values(state.scan_state(spark, root, schemas.SEEN), "norm_url", "attempts") == [("b", 1)]
    assert state.scan_state(spark, root, schemas.SEEN, below=2).count() == 2


def test_unfinished_version_is_ignored(spark, tmp_path):
    root = tmp_path / "seen"
    state.write_state(make(spark, "SEEN", dict(norm_url="a")), str(root), "norm_url")
    (root / "v=000000000002").mkdir()
    assert state.latest_version(spark, str(root)) == 1


def test_corrupt_state_raises(spark, tmp_path):
    root = tmp_path / "seen"
    state.write_state(make(spark, "SEEN", dict(norm_url="a")), str(root), "norm_url")
    for f in (root / "v=000000000001").glob("*.parquet"):
        f.write_bytes(b"not parquet")
        f.with_name("." + f.name + ".crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        state.scan_state(spark, str(root), schemas.SEEN).collect()


def exchanges(frame, *words):
    """How many shuffles the plan has, and whether one lies above a scan whose path holds one of `words`."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    shuffles = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    over = []
    for k, line in enumerate(plan):
        if "FileScan" in line and any(w in line for w in words):
            above, d = [], depth[k]
            for i in range(k - 1, -1, -1):
                if depth[i] < d:
                    above.append(i)
                    d = depth[i]
            over += [i for i in above if i in shuffles]
    return len(shuffles), over


def test_joins_do_not_shuffle_the_state(spark, tmp_path, no_broadcast):
    from feedtide.operators.outcomes import seen_merge
    from feedtide.params import Params

    root = str(tmp_path / "seen")
    rows = [dict(norm_url=f"u{k}", status="pending", attempts=k, last_seq=k, first_seen=at("2024-01-01T00:00:00")) for k in range(200)]
    state.write_state(make(spark, "SEEN", *rows), root, "norm_url")
    state.write_state(make(spark, "SEEN", *rows[50:]), root, "norm_url")
    new, old = state.scan_state(spark, root, schemas.SEEN), state.scan_state(spark, root, schemas.SEEN, below=2)
    both = old.select("norm_url", "attempts").join(new.select("norm_url", "status"), "norm_url", "left")
    assert exchanges(both, "v=") == (0, []) and both.count() == 200
    log = make(spark, "OUTCOMES", *[dict(norm_url=f"u{k}", seq=1000 + k, kind="success", ts=at("2024-01-02T00:00:00")) for k in range(100, 300)])
    merged = seen_merge(new, log, Params(as_of="2024-01-03T00:00:00Z"))
    assert exchanges(merged, "v=") == (1, [])  # the new rows only
    assert values(merged.groupBy("status").count(), "status", "count") == [("pending", 50), ("success", 200)]


def test_old_versions_go_and_a_second_writer_fails(spark, tmp_path):
    root = str(tmp_path / "seen")
    one, two = (make(spark, "SEEN", dict(norm_url=u)) for u in "ab")
    assert [state.write_state(one, root, "norm_url", writer=w) for w in ("r1", "r2", "r2", "r3")] == [1, 2, 2, 3]
    assert sorted(p.name for p in (tmp_path / "seen").glob("v=*")) == ["v=000000000002", "v=000000000003"]
    (tmp_path / "seen" / "_claims" / "000000000004").write_text("r9")  # claimed, not finished
    with pytest.raises(state.StateConflict, match="r9"):
        state.write_state(two, root, "norm_url", writer="r4")
    assert state.write_state(two, root, "norm_url", writer="r9") == 4  # the claimant goes on
    assert values(state.scan_state(spark, root, schemas.SEEN, writer="r9"), "norm_url") == [("a",)]
    assert values(state.scan_state(spark, root, schemas.SEEN), "norm_url") == [("b",)]
    (tmp_path / "seen" / "_claims" / "000000000005").write_text("dead")
    state.release(spark, root, 5)
    assert state.write_state(one, root, "norm_url") == 5


def test_old_days_of_a_log_are_removed(spark, tmp_path):
    for entry in (None, "r1"):
        root = str(tmp_path / f"log-{entry}")
        rows = [dict(ts=at(f"2024-01-0{day}T10:00:00"), norm_url=str(day), run_id="r1") for day in (1, 2, 3)]
        state.append_log(make(spark, "DROPPED_URLS", *rows), root, entry=entry)
        state.purge_log(spark, root, "2024-01-02")
        assert values(state.scan_log(spark, root, schemas.DROPPED_URLS), "norm_url") == [("2",), ("3",)]
        assert state.scan_log(spark, root, schemas.DROPPED_URLS, without="r1").count() == (2 if entry is None else 0)
    state.purge_log(spark, str(tmp_path / "none"), "2024-01-02")


def test_log_is_appended_by_day(spark, tmp_path):
    root = str(tmp_path / "dropped")
    for day in (1, 2):
        state.append_log(make(spark, "DROPPED_URLS", dict(ts=at(f"2024-01-0{day}T10:00:00"), norm_url=str(day))), root)
    log = state.scan_log(spark, root, schemas.DROPPED_URLS)
    assert values(log, "norm_url") == [("1",), ("2",)]
    pruned = state.scan_log(spark, root, schemas.DROPPED_URLS, since="2024-01-02")
    assert "PartitionFilters: [isnotnull(run_date" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 1


def test_a_repeated_entry_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "dropped")
    for run, urls in (("r/1", "ab"), ("r2", "c"), ("r/1", "a")):
        state.append_log(make(spark, "DROPPED_URLS", *[dict(ts=at("2024-01-01T10:00:00"), norm_url=u, run_id=run) for u in urls]), root, entry=run)
    log = state.scan_log(spark, root, schemas.DROPPED_URLS)
    assert values(log, "norm_url", "run_id") == [("a", "r/1"), ("c", "r2")]
    new = make(spark, "DROPPED_URLS", dict(ts=at("2024-01-02T10:00:00"), norm_url="d", run_id="r3"))
    assert log.unionByName(new).count() == 3  # what is read composes with new rows


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert is_local("local[*]") and is_local("local") and not is_local("local-cluster[2,1,1024]")


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
