import random

from helpers import values
from pyspark.sql import functions as F

from feedtide.operators.rate import rate_budget_audit


def table(spark, rows):
    return spark.createDataFrame(rows, "account string, submit_id bigint, s double, kind string").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))
    )


def test_window_is_inclusive_and_skips_are_free(spark):
    rows = [("a", 1, 0.0, "submitted"), ("a", 2, 30.0, "already_archived"), ("a", 3, 60.0, "rate_limited"), ("a", 4, 60.5, "submitted")]
    found = rate_budget_audit(table(spark, rows), limit=2)
    assert values(found, "submit_id", "in_window", "over_limit") == [(1, 1, False), (3, 2, False), (4, 2, False)]
    waits = {r.submit_id: round(r.wait_seconds, 3) for r in found.collect()}
    assert waits == {1: 0.0, 3: 0.1, 4: 59.6}


def test_equals_brute_force_across_blocks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, float(rnd.randint(0, 4000)) / 2, "submitted") for i in range(800)]
    rows += [("hot", 1000 + i, 590.0 + i / 4, "submitted") for i in range(300)]
    found = {r.submit_id: (r.in_window, r.over_limit, round(r.wait_seconds, 6)) for r in rate_budget_audit(table(spark, rows), 7).collect()}
    assert len(found) == len(rows)
    for account, n, s, _ in rows:
        inside = [t for a, _, t, _ in rows if a == account and s - 60 <= t <= s]
        wait = 0.0 if len(inside) < 7 else max(0.0, 60 - (s - min(inside)) + 0.1)
        assert found[n] == (len(inside), len(inside) > 7, round(wait, 6))


def test_no_frame_moves_at_both_ends(spark):
    """Spark counts such a frame anew for every row, so that a dense hour costs the square of its rows."""
    plan = rate_budget_audit(table(spark, [("a", 1, 0.0, "submitted")]), limit=2)._jdf.queryExecution().optimizedPlan().toString()
    frames = plan.split("specifiedwindowframe(")[1:]
    assert frames and all("unboundedpreceding" in f.split(")")[0] for f in frames)
