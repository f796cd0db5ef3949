"""Questions to the capture index.

Captures may be any table of the schema. Stored as an index (`write_capture_index`) they lie by a hash prefix of their URL, and a question
reads only the prefixes of the URLs it asks for.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.params import Params, parse_duration
from feedtide.sources.state import read_small, write_small

PREFIXES = 1024


def _prefix(prefixes: int) -> Column:
    return F.pmod(F.xxhash64("norm_url"), F.lit(prefixes)).cast("int")


def write_capture_index(captures: DataFrame, root: str, entry: str, prefixes: int = PREFIXES) -> None:
    """Adds captures to an index; the same entry written again replaces itself. The first entry decides the number of prefixes."""
    spark = captures.sparkSession
    write_small(spark, f"{root}/_prefixes", str(prefixes), overwrite=False)
    laid = captures.withColumn("prefix", _prefix(int(read_small(spark, f"{root}/_prefixes"))))
    laid.repartition("prefix").sortWithinPartitions("prefix", "norm_url").write.mode("overwrite").partitionBy("prefix").parquet(f"{root}/entry={quote(entry, safe='')}")


def captures_of(urls: DataFrame, root: str) -> DataFrame:
    """The part of an index that lies under the prefixes of `urls`. The prefixes asked for, at most as many as the index has, are
    found by one aggregate over the URLs; the folders of all others are not opened."""
    spark = urls.sparkSession
    prefixes = int(read_small(spark, f"{root}/_prefixes"))
    asked = [r[0] for r in urls.select(_prefix(prefixes).alias("prefix")).distinct().collect()]
    index = spark.read.schema(f"{schemas.CAPTURES}, entry STRING, prefix INT").parquet(root)
    return index.filter(F.col("prefix").isin(asked)).drop("entry", "prefix")


def capture_availability(urls: DataFrame, captures: DataFrame, params: Params) -> DataFrame:
    """`archived` per URL, three-valued.

    Only the latest capture counts. False: none, unavailable, or younger than the settling time (a fresh
    one hides an older one). True also when its time is unknown. NULL: the latest check failed. A row was checked at
    `checked_at`, or else when it was captured; checks and captures after `as_of` do not exist yet. The index is cut to the
    URLs asked for, then combined on the map side; max(struct) also keeps a latest row without a timestamp."""
    checked = F.coalesce(F.col("checked_at"), F.col("captured_at"))
    known = asked_for(urls, captures).filter(
        F.coalesce(checked <= params.now(), F.lit(True)) & F.coalesce(F.col("captured_at") <= params.now(), F.lit(True))
    )
    latest = known.groupBy("norm_url").agg(
        F.max(F.when(~_failed(), F.struct("captured_at", "available"))).alias("last"),
        F.max(F.struct(checked.alias("checked"), _failed().alias("failed"))).alias("check"),
    )
    fresh = F.col("last.captured_at") > params.before(secs=params.settled_after_hours * 3600.0)
    return (
        urls.select("norm_url")
        .distinct()
        .join(latest, "norm_url", "left")
        .select(
            "norm_url",
            F.when(F.coalesce("check.failed", F.lit(False)), F.lit(None).cast("boolean"))
            .when(~F.coalesce(F.col("last.available"), F.lit(False)), F.lit(False))
            .otherwise(~F.coalesce(fresh, F.lit(False)))
            .alias("archived"),
        )
    )


def asked_for(urls: DataFrame, captures: DataFrame) -> DataFrame:
    """The part of the index that answers for `urls`."""
    return captures.join(urls.select("norm_url"), "norm_url", "left_semi")


def _failed():
    return F.coalesce(F.col("check_failed"), F.lit(False))


def recapture_needed(urls: DataFrame, captures: DataFrame, params: Params) -> DataFrame:
    """URLs without a capture inside the re-capture window that ends at as_of."""
    latest = (
        asked_for(urls, captures.filter(F.col("captured_at") <= params.now()))
        .groupBy("norm_url")
        .agg(F.max("captured_at").alias("last_capture"))
    )
    oldest_allowed = params.now() - parse_duration(params.recapture_window)
    return (
        urls.select("norm_url")
        .distinct()
        .join(latest, "norm_url", "left")
        .select(
            "norm_url",
            "last_capture",
            F.coalesce(F.col("last_capture") < oldest_allowed, F.lit(True)).alias("needs_capture"),
        )
    )
