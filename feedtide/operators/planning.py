"""The capture plan (W1-W7): in which order a run submits its backlog, and what it defers.

Order of one wave of submissions:
  phase 0  the first `reserved_per_source` items of every source, round by round;
  phase 1  then always the source with the smallest submitted/total share, sources that rotate before
           exhaustive ones; equal shares take turns, starting after the source served last.
Inside a source the oldest-dated item goes first, undated ones last.

Only `capacity` slots exist, so only the first `capacity` items of each source can be planned: they are
cut out before the shuffle. Shares grow along a source, hence the merge over sources is a sort by share,
and only ties need the sequential "after the last one served" rule: a fold over at most `capacity` rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedtide.functions.dates import feed_date
from feedtide.operators.lookup import new_urls
from feedtide.operators.skew import first_k_within, join_dimension, rank_within
from feedtide.params import Params
from feedtide.session import durable


def urgency_order(params: Params | None = None) -> list[Column]:
    """Oldest date first (as text: '' sorts before any date), NULL last, ties in list order."""
    if params is not None and params.by_instant:
        date = feed_date(F.col("published_at"))
    else:
        date = F.col("published_at")
    return [date.asc_nulls_last(), F.col("source_ord").asc(), F.col("item_ord").asc()]


def urgency_rank(backlog: DataFrame, params: Params | None = None) -> DataFrame:
    """Position `k` of every item in its source's queue, for sources of any size."""
    return rank_within(backlog, ["run_id", "source"], urgency_order(params))


def source_totals(backlog: DataFrame, registry: DataFrame) -> DataFrame:
    """Queue length per run and source, and the place of its first item, which orders the sources."""
    totals = backlog.groupBy("run_id", "source").agg(
        F.count("*").alias("n"), F.min(F.struct("source_ord", "item_ord")).alias("turn")
    )
    flags = registry.select("source", F.coalesce("exhaustive", F.lit(False)).alias("exhaustive"))
    return join_dimension(totals, flags, ["source"], spread=["run_id"]).fillna(False, ["exhaustive"])


def _keyed(ranked: DataFrame, totals: DataFrame, params: Params) -> DataFrame:
    reserved = F.col("k") <= params.reserved_per_source
    joined = join_dimension(ranked, totals, ["run_id", "source"], spread=["norm_url"], how="inner")
    return (
        joined.withColumn("phase", F.when(reserved, F.lit(0)).otherwise(F.lit(1)))
        .withColumn("tier", F.when(~reserved & F.col("exhaustive"), F.lit(1)).otherwise(F.lit(0)))
        .withColumn("share", (F.col("k") - 1) / F.col("n"))
        .withColumn("priority", F.when(reserved, F.col("k").cast("double")).otherwise(F.col("share")))
    )


def share_keys(backlog: DataFrame, registry: DataFrame, params: Params) -> DataFrame:
    """Rank, queue length, share, phase and tier of every item of the backlog."""
    ranked = urgency_rank(backlog, params)
    return _keyed(ranked, source_totals(ranked, registry), params)


def reserved_floor(backlog: DataFrame, registry: DataFrame, params: Params) -> DataFrame:
    """The guaranteed part of the plan: items of phase 0 with their slot."""
    guaranteed = first_k_within(
        backlog,
        ["run_id", "source"],
        urgency_order(params),
        params.reserved_per_source,
        spread=["norm_url"],
    )
    keyed = join_dimension(
        guaranteed, source_totals(backlog, registry), ["run_id", "source"], spread=["norm_url"], how="inner"
    )
    return rank_within(keyed, ["run_id"], [F.col("k").asc(), F.col("turn").asc()], name="slot")


def _turn_taker():
    """The fold over tie groups. A local function travels to the workers by value, so they need no copy
    of this package."""

    def take_turns(rows: pd.DataFrame) -> pd.DataFrame:
        """Slots of one run's complete tie groups: each group continues after the source served last."""
        rows = rows.sort_values(["phase", "tier", "priority", "turn_ord", "turn_item"], kind="stable")
        turn = list(zip(rows["turn_ord"], rows["turn_item"], strict=True))
        group = list(zip(rows["phase"], rows["tier"], rows["priority"], strict=True))
        served: tuple[int, int] | None = None
        order: list[int] = []
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and group[end] == group[start]:
                end += 1
            members = list(range(start, end))
            if served is not None:
                members.sort(key=lambda i: (turn[i] <= served, turn[i]))
            order.extend(members)
            served = turn[order[-1]]
            start = end
        out = rows.iloc[order][["run_id", "source", "k", "turn_ord", "turn_item"]]
        return out.assign(slot=range(1, len(out) + 1))

    return take_turns


def capture_plan(
    backlog: DataFrame, registry: DataFrame, params: Params, capacity: int | None = None
) -> DataFrame:
    """The first `capacity` submissions of each run, numbered by `slot`.

    Every collection is bounded by the capacity: candidates per source, tie groups per run, the fold, and
    the one group that does not fit completely, whose members are taken by a top-k from the turn on."""
    capacity = params.capacity if capacity is None else capacity
    ranked = first_k_within(
        backlog, ["run_id", "source"], urgency_order(params), max(capacity, 1), spread=["norm_url"]
    )
    # read several times below; much cheaper to keep than the backlog behind it is to compute again
    items = durable(_keyed(ranked, source_totals(backlog, registry), params))
    tie = ["run_id", "phase", "tier", "priority"]

    sizes = items.groupBy(*tie).agg(F.count("*").alias("size"))
    first_groups = first_k_within(
        sizes,
        ["run_id"],
        [F.col("phase"), F.col("tier"), F.col("priority")],
        max(capacity, 1),
        spread=["priority", "tier"],
        name="group_no",
    )
    so_far = (
        Window.partitionBy("run_id")
        .orderBy("group_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    groups = (
        first_groups.withColumn("before", F.sum("size").over(so_far) - F.col("size"))
        .filter(F.col("before") < capacity)
        .withColumn("complete", F.col("before") + F.col("size") <= capacity)
        .select(*tie, "before", "complete")
    )
    members = (
        join_dimension(items, groups, tie, spread=["source"], how="inner")
        .withColumn("turn_ord", F.col("turn.source_ord"))
        .withColumn("turn_item", F.col("turn.item_ord"))
    )
    key = "run_id string, source string, k bigint, turn_ord bigint, turn_item bigint, slot bigint"
    settled = (
        members.filter("complete")
        .select("run_id", "source", "k", "turn_ord", "turn_item", "phase", "tier", "priority")
        .groupBy("run_id")
        .applyInPandas(_turn_taker(), schema=key)
    )
    served = settled.groupBy("run_id").agg(
        F.max_by(F.struct("turn_ord", "turn_item"), "slot").alias("served")
    )
    split = join_dimension(members.filter(~F.col("complete")), served, ["run_id"], spread=["source"])
    waits = F.coalesce(F.struct("turn_ord", "turn_item") <= F.col("served"), F.lit(False))
    last_slots = (
        first_k_within(
            split.withColumn("waits", waits),
            ["run_id"],
            [F.col("waits").asc(), F.col("turn_ord").asc(), F.col("turn_item").asc()],
            max(capacity, 1),
            spread=["source"],
            name="taken",
        )
        .withColumn("slot", F.col("before") + F.col("taken"))
        .filter(F.col("slot") <= capacity)
    )
    slots = settled.select("run_id", "source", "k", "slot").unionByName(
        last_slots.select("run_id", "source", "k", "slot")
    )
    columns = ["run_id", "slot", "source", "k", "norm_url", "url", "published_at", "phase", "tier", "share"]
    return items.join(slots, ["run_id", "source", "k"]).select(*columns)


def planned_vs_deferred(backlog: DataFrame, plan: DataFrame) -> DataFrame:
    """Per run and source, how much of the backlog got a slot and how much waits for the next run."""
    queued = backlog.groupBy("run_id", "source").agg(F.count("*").alias("queued"))
    planned = plan.groupBy("run_id", "source").agg(F.count("*").alias("planned"))
    got = F.coalesce(F.col("planned"), F.lit(0))
    return queued.join(planned, ["run_id", "source"], "left").select(
        "run_id", "source", "queued", got.alias("planned"), (F.col("queued") - got).alias("deferred")
    )


def pacing(plan: DataFrame, params: Params) -> DataFrame:
    """The minute of the run in which each slot may be submitted."""
    minute = F.floor((F.col("slot") - 1) / F.lit(params.captures_per_minute)).cast("bigint")
    return plan.withColumn("minute", minute)


def plan_captures(
    items: DataFrame, seen: DataFrame, registry: DataFrame, params: Params, capacity: int | None = None
) -> DataFrame:
    """Discovered items to capture plan: canonical, de-duplicated, unknown, ordered, paced."""
    backlog = durable(new_urls(items, seen))
    return pacing(capture_plan(backlog, registry, params, capacity), params)
