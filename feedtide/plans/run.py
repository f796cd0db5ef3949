"""One whole run over tables: discovery, comparison, fold, plan, statistics and retention.

`before_capture` and `after_capture` go from frames to frames. `open_run` and `close_run` do the same over state that is stored in a
folder: `seen`, `snapshots` and `dropped` are versioned state, `stats` and `history` are logs with one entry per run. Everything is
written in the name of the run, so a run that is started again reads what it read before and changes nothing that it has finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.operators import captures, extract, feeds, lookup, outcomes, planning, retention
from feedtide.operators.skew import without_keys
from feedtide.params import Params
from feedtide.session import durable
from feedtide.sources.state import append_log, purge_log, scan_log, scan_state, write_state


def before_capture(inputs: dict[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """What is known before anything is submitted.

    Inputs: registry, fetches (of this run), previous_snapshots (the last one per source), seen, answers (outcomes of leftovers
    polled at the start of the run), dropped, captures. Returns discovered, snapshots, runs, seen, losses,
    stats, dropped and plan; `plan` goes to the capture system, whose outcomes close the run."""
    registry = inputs["registry"]
    availability = captures.capture_availability(inputs["dropped"], inputs["captures"], params)
    still_lost = feeds.recheck_dropped(inputs["dropped"], availability)
    seen = durable(outcomes.seen_merge(inputs["seen"], inputs["answers"], params))

    discovered = durable(extract.discover(inputs["fetches"], registry))
    runs = feeds.feed_runs(inputs["fetches"], registry, params)
    snapshots = feeds.feed_snapshots(discovered, runs)
    previous = inputs["previous_snapshots"]
    earlier = previous.select("run_id", "source").distinct().withColumn("exhaustive", F.lit(False))
    compared = runs.select("run_id", "source", "exhaustive").unionByName(earlier)
    drops = durable(feeds.feed_drops(previous.unionByName(snapshots), compared))
    statuses = seen.select("norm_url", "status")
    losses = feeds.dropped_unarchived(drops, statuses)
    backlog = durable(lookup.new_urls(discovered, seen))
    plan = planning.pacing(planning.capture_plan(backlog, registry, params), params)
    entries = losses.select(params.now().alias("ts"), "source", "norm_url", "reason", "run_id")
    read = runs.filter(~F.col("exhaustive"))
    untouched = without_keys(previous, read, ["source"], spread=["norm_url"])
    return {
        "discovered": discovered,
        "snapshots": snapshots.unionByName(untouched),
        "runs": runs,
        "seen": seen,
        "losses": losses,
        "stats": feeds.feed_run_stats(discovered, runs, drops, statuses),
        "dropped": still_lost.unionByName(entries),
        "backlog": backlog,
        "plan": plan,
        "coverage": planning.planned_vs_deferred(backlog, plan),
    }


def after_capture(
    opened: dict[str, DataFrame], inputs: dict[str, DataFrame], log: DataFrame, params: Params
) -> dict[str, DataFrame]:
    """Closes the run with `log`, the outcomes of its submissions: new state, statistics and history.

    Retention runs in the order statistics, losses, state (its count goes into the run's row), history."""
    seen = durable(outcomes.seen_merge(opened["seen"], log, params))
    stats = feeds.attach_outcomes_to_stats(
        opened["stats"],
        outcomes.already_archived_by_source(log),
        outcomes.rate_limited_by_source(log),
    )
    everything = inputs["answers"].unionByName(log)
    runs = opened["runs"].groupBy("run_id").agg(params.now().alias("ts"))
    run_ids = runs.select("run_id")
    purged = run_ids.withColumn("purged", retention.purged_seen_count(seen, params).scalar())
    sources = run_ids.withColumn(
        "sources_processed", inputs["registry"].agg(F.count("*")).scalar()
    )
    row = outcomes.run_summary(
        runs,
        sources,
        opened["discovered"].groupBy("run_id").agg(F.count("*").alias("discovered")),
        outcomes.run_outcome_totals(everything, params, inputs["seen"]),
        opened["coverage"].groupBy("run_id").agg(F.sum("deferred").alias("deferred")),
        purged,
    )
    return {
        "stats": retention.purge_by_time(inputs["stats"].unionByName(stats), params),
        "dropped": retention.purge_by_time(opened["dropped"], params),
        "seen": retention.purge_seen(seen, params),
        "history": retention.purge_by_time(inputs["history"].unionByName(row), params),
    }


def run_batch(inputs: dict[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """A run whose submissions are already done: `inputs` also holds their `outcomes`. The result is the
    state after it, with what was discovered, lost and planned."""
    opened = before_capture(inputs, params)
    return {**opened, **after_capture(opened, inputs, inputs["outcomes"], params)}


KEYED = {"seen": schemas.SEEN, "snapshots": schemas.FEED_SNAPSHOTS, "dropped": schemas.DROPPED_URLS}
LOGGED = {"stats": schemas.FEED_RUN_STATS, "history": schemas.RUN_HISTORY}


def stored_inputs(root: str, run_id: str, given: dict[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """The inputs of `before_capture`: `given` (registry, fetches, answers, captures) and the state as it was before this run."""
    spark = given["fetches"].sparkSession
    first_day = params.first_day()
    state = {name: scan_state(spark, f"{root}/{name}", schema, writer=run_id) for name, schema in KEYED.items()}
    logs = {name: scan_log(spark, f"{root}/{name}", schema, since=first_day, without=run_id) for name, schema in LOGGED.items()}
    return {**given, **logs, "seen": state["seen"], "dropped": state["dropped"], "previous_snapshots": state["snapshots"]}


def open_run(root: str, run_id: str, given: dict[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """First half of a run over stored state. The plan is also written to `plans/run=<run_id>` for the capture system."""
    opened = before_capture(stored_inputs(root, run_id, given, params), params)
    opened["plan"].write.mode("overwrite").parquet(f"{root}/plans/run={run_id}")
    return opened


def close_run(root: str, run_id: str, given: dict[str, DataFrame], log: DataFrame, params: Params, opened: dict[str, DataFrame] | None = None) -> None:
    """Second half, once `log` holds the outcomes. A job of its own computes the first half again from the same state; within one job
    `opened` saves that."""
    inputs = stored_inputs(root, run_id, given, params)
    opened = opened or before_capture(inputs, params)
    closed = after_capture(opened, inputs, log, params)
    for name, schema in LOGGED.items():
        columns = [part.strip().split(" ")[0] for part in schema.split(",")]
        append_log(closed[name].filter(F.col("run_id") == run_id).select(*columns), f"{root}/{name}", entry=run_id)
        purge_log(log.sparkSession, f"{root}/{name}", before=params.first_day())
    write_state(opened["snapshots"], f"{root}/snapshots", "norm_url", writer=run_id)
    write_state(closed["dropped"], f"{root}/dropped", "norm_url", writer=run_id)
    write_state(closed["seen"], f"{root}/seen", "norm_url", writer=run_id)
