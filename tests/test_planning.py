import random

from helpers import by, item, make, values

from feedtide.operators import planning
from feedtide.operators.skew import first_k_within, join_dimension, rank_within
from feedtide.params import Params
from pyspark.sql import functions as F


def params(reserved=1, per_minute=7, seconds=6000):
    return Params(as_of="2024-01-01T00:00:00Z", reserved_per_source=reserved, captures_per_minute=per_minute, run_budget_seconds=seconds)


def registry(spark, **exhaustive):
    rows = [dict(source=s, exhaustive=e, type="rss", source_ord=i) for i, (s, e) in enumerate(exhaustive.items())]
    return make(spark, "REGISTRY", *rows)


def picks(plan):
    return [(r.source, r.norm_url) for r in plan.orderBy("slot").collect()]


def sources(plan):
    return "".join(s for s, _ in picks(plan))


def backlog(spark, **sizes):
    """a=3 puts https://a/0 .. https://a/2 with rising dates into the backlog."""
    rows = [item(s, n, f"2024-01-{n + 1:02d}", ord=i) for i, (s, size) in enumerate(sizes.items()) for n in range(size)]
    return make(spark, "DISCOVERED", *rows)


def test_oldest_first_undated_last_ties_in_list_order(spark):
    dates = ["2024-03-01", None, "2024-01-01", "", "2024-01-01", None]
    items = make(spark, "DISCOVERED", *[item("a", n, d) for n, d in enumerate(dates)])
    order = [r.item_ord for r in planning.urgency_rank(items).orderBy("k").collect()]
    assert order == [3, 2, 4, 0, 1, 5]


def test_dates_compare_as_text_unless_by_instant(spark):
    rows = [item("a", 0, "2024-01-01T10:00:00+00:00"), item("a", 1, "2024-01-01T11:00:00+05:00")]
    items = make(spark, "DISCOVERED", *rows)
    assert by(planning.urgency_rank(items), "item_ord", "k") == {0: 1, 1: 2}
    instant = Params(as_of="2024-01-01T00:00:00Z", by_instant=True)
    assert by(planning.urgency_rank(items, instant), "item_ord", "k") == {0: 2, 1: 1}


def test_small_source_gets_its_floor(spark):
    plan = planning.capture_plan(backlog(spark, a=9, b=1), registry(spark, a=False, b=False), params(), 3)
    assert sources(plan) == "aba"


def test_shares_interleave_in_proportion(spark):
    plan = planning.capture_plan(backlog(spark, a=6, b=3), registry(spark, a=False, b=False), params(reserved=0))
    # a is at 2/6 when b is at 1/3: a tie, and a was served last
    assert sources(plan) == "ababaabaa"


def test_ties_take_turns(spark):
    plan = planning.capture_plan(backlog(spark, a=3, b=3, c=3), registry(spark, a=False, b=False, c=False), params(reserved=0))
    assert sources(plan) == "abcabcabc"


def test_exhaustive_sources_wait_but_get_floor_and_rest(spark):
    plan = planning.capture_plan(backlog(spark, a=4, b=2), registry(spark, a=True, b=False), params())
    assert sources(plan) == "abbaaa"


def test_zero_capacity_defers_all(spark):
    items = backlog(spark, a=2, b=1)
    plan = planning.capture_plan(items, registry(spark, a=False, b=False), params(), 0)
    assert plan.count() == 0
    found = planning.planned_vs_deferred(items, plan)
    assert values(found, "source", "queued", "planned", "deferred") == [("a", 2, 0, 2), ("b", 1, 0, 1)]


def test_source_turn_is_first_appearance_not_registry_place(spark):
    rows = [item("b", 0, "2024-01-01", ord=0), item("a", 1, "2024-01-01", ord=1)]
    plan = planning.capture_plan(make(spark, "DISCOVERED", *rows), registry(spark, a=False, b=False), params())
    assert sources(plan) == "ba"


def test_plan_captures_end_to_end(spark):
    rows = [item("a", 0, "2024-01-02"), item("a", 1, "2024-01-01"), item("b", 0, None, url="https://a/0", ord=1), item("b", 1, None, ord=1)]
    seen = make(spark, "SEEN", dict(norm_url="https://b/1", status="pending"))
    plan = planning.plan_captures(make(spark, "DISCOVERED", *rows), seen, registry(spark, a=False, b=False), params(per_minute=1, seconds=120))
    assert values(plan, "slot", "norm_url", "minute") == [(1, "https://a/1", 0), (2, "https://a/0", 1)]


def check_plan(plan, queues, exhaustive, reserved, capacity):
    """The rules, stated as properties of a finished plan [(source, k)]; sources take turns by name."""
    assert len(plan) == min(capacity, sum(queues.values()))
    for s in queues:
        mine = [k for source, k in plan if source == s]
        assert mine == list(range(1, len(mine) + 1)), "a queue is served from its front"
    floor = {(s, k) for s, n in queues.items() for k in range(1, min(reserved, n) + 1)}
    assert set(plan[: len(floor)]) == floor if capacity >= len(floor) else set(plan) <= floor
    assert [k for _, k in plan[: len(floor)]] == sorted(k for _, k in plan[: len(floor)]), "the floor goes round by round"
    rest = plan[len(floor) :]
    late = [exhaustive[s] for s, _ in rest]
    assert late == sorted(late), "exhaustive sources come last"
    for tier in (False, True):
        shares = [(k - 1) / queues[s] for s, k in rest if exhaustive[s] == tier]
        assert shares == sorted(shares), "each slot has the smallest share left"
    if len(plan) < sum(queues.values()) and rest:
        s, k = rest[-1]
        waiting = [(exhaustive[o], done / n) for o, n in queues.items() if (done := sum(x == o for x, _ in plan)) < n]
        assert min(waiting) >= (exhaustive[s], (k - 1) / queues[s]), "what waits has no smaller share"
    names = sorted(queues)
    start = 0
    while start < len(plan):  # equal shares: the turn goes on after the source served last
        same = lambda i: (i < len(floor), plan[i][1] if i < len(floor) else (exhaustive[plan[i][0]], (plan[i][1] - 1) / queues[plan[i][0]]))
        end = start
        while end < len(plan) and same(end) == same(start):
            end += 1
        last = names.index(plan[start - 1][0]) if start else -1
        turns = [(names.index(s) - last - 1) % len(names) for s, _ in plan[start:end]]
        assert turns == sorted(turns), "ties take turns"
        start = end


def test_random_plans_keep_the_rules(spark):
    """Many random cases at once: each is one run_id of the same tables."""
    rnd = random.Random(11)
    rows, cases, capacity = [], {}, 9
    flags = {f"s{i}": i in (1, 4) for i in range(6)}
    for case in range(150):
        run = f"case{case:03d}"
        cases[run] = {s: rnd.randint(1, 7) for s in sorted(rnd.sample(sorted(flags), rnd.randint(1, 6)))}
        for s, size in cases[run].items():
            rows += [item(s, n, None, url=f"{run}/{s}/{n}", ord=int(s[1]), run=run) for n in range(size)]
    items, flagged = make(spark, "DISCOVERED", *rows), registry(spark, **flags)
    for reserved in (1, 0, 3):
        found = {run: [] for run in cases}
        for r in planning.capture_plan(items, flagged, params(reserved=reserved), capacity).orderBy("run_id", "slot").collect():
            found[r.run_id].append((r.source, r.k))
        for run, queues in cases.items():
            check_plan(found[run], queues, flags, reserved, capacity)


def test_hot_source_rank_is_exact_over_many_blocks(spark):
    rows = spark.range(5000).select(
        F.lit("r").alias("run_id"),
        F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise(F.lit("hot")).alias("source"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"),
        "id",
    )
    ranked = rank_within(rows, ["run_id", "source"], [F.col("v").asc(), F.col("id").asc()]).toPandas()
    ranked = ranked.sort_values(["source", "v", "id"])
    assert (ranked["k"] == ranked.groupby("source").cumcount() + 1).all() and len(ranked) == 5000


def test_first_k_is_exact_and_limited_before_the_shuffle(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id")
    top = first_k_within(rows, ["g"], [F.col("v").asc(), F.col("id").asc()], 5, spread=["id"])
    pdf = rows.toPandas().sort_values(["g", "v", "id"])
    expected = pdf[pdf.groupby("g").cumcount() < 5]["id"].tolist()
    assert [r.id for r in top.orderBy("g", "k").collect()] == expected
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_first_k_beyond_the_group_limit_sends_no_group_to_one_task(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id")
    top = first_k_within(rows, ["g"], [F.col("v").asc(), F.col("id").asc()], 3000, spread=["id"])
    pdf = rows.toPandas().sort_values(["g", "v", "id"])
    assert [r.id for r in top.orderBy("g", "k").collect()] == pdf[pdf.groupby("g").cumcount() < 3000]["id"].tolist()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan.replace("hashpartitioning(g#0, _block", "") or "_block" in plan


def test_salted_join_equals_plain_join(spark, no_broadcast):
    rows = spark.range(500).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(1)).alias("key"))
    table = spark.range(0, 500, 5).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        assert values(join_dimension(rows, table, ["key"], ["id"], how), "id", "v") == values(rows.join(table, "key", how), "id", "v")


def test_plan_without_broadcast(spark, no_broadcast):
    plan = planning.capture_plan(backlog(spark, a=6, b=3), registry(spark, a=False, b=False), params(reserved=0), 5)
    assert sources(plan) == "ababa"
