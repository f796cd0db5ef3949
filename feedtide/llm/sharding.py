"""Sharding by histogram sort: near-equal bytes per shard, in key order.

The sort key is (hash of the text, doc_id), so equal texts are neighbours. Splitters are found without moving
a row: in each round every partition counts the bytes between the probe keys, the counts are summed, and each
splitter's bracket shrinks to the two probes around its target. When all splitters are within tolerance the
rows are exchanged once, each range to its own part of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, store, text_or_empty

SIGN = 1 << 63
LOW = (1 << 64) - 1
TOP = 1 << 128


def _packed(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """(key, tie) as 16 bytes whose order is the order of the pair."""
    pair = np.empty((len(key), 2), dtype=">u8")
    pair[:, 0] = key.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    pair[:, 1] = tie.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return pair.view("S16").ravel()


def _as_probes(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(16, "big") for n in numbers], dtype="S16")


def _count(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bucket (number of probes <= key) -> bytes, rows, smallest and largest key. At most one row per bucket
    reaches the driver."""
    limits = _as_probes(probes)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            packed = _packed(batch["key"].to_numpy(), batch["tie"].to_numpy())
            order = np.argsort(packed, kind="stable")
            packed, sizes = packed[order], batch["size"].to_numpy()[order]
            bucket = np.searchsorted(limits, packed, side="right")
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            last = np.r_[first[1:], len(bucket)] - 1
            yield pd.DataFrame(
                {
                    "bucket": bucket[first].astype(np.int64),
                    "bytes": np.add.reduceat(sizes, first),
                    "n": last - first + 1,
                    "low": [bytes(x).ljust(16, b"\0") for x in packed[first]],
                    "high": [bytes(x).ljust(16, b"\0") for x in packed[last]],
                }
            )

    counted = (
        rows.select("key", "tie", "size")
        .mapInPandas(tally, "bucket bigint, bytes bigint, n bigint, low binary, high binary")
        .groupBy("bucket")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    return {r.bucket: (r.bytes, r.n, int.from_bytes(r.low, "big"), int.from_bytes(r.high, "big")) for r in counted}


def find_splitters(
    rows: DataFrame, parts: int, tolerance: float = 0.001, group_tolerance: float = 0.01, probes: int = 48
) -> list[int]:
    """The parts - 1 splitters of (key, tie) as 128-bit numbers; a row belongs right of every splitter <= its key.

    A splitter stands between two different keys if that puts its target within `group_tolerance` of a part;
    only a larger group of equal keys is cut, by `tie`. Each round costs one pass over (key, tie, size) and
    brings at most parts * probes sums to the driver.
    """
    everything = _count(rows, [])
    if not everything:
        return [TOP - 1] * (parts - 1)
    total, _, low, high = everything[0]
    share = total / parts
    found: dict[int, int] = {}
    # number of splitter -> (smallest key in the bracket, largest, bytes below the bracket, bytes up to its end)
    open_: dict[int, tuple[int, int, int, int]] = {s: (low, high, 0, total) for s in range(1, parts)}
    while open_:
        candidates: set[int] = set()
        for s, (lo, hi, below, upto) in list(open_.items()):
            target = share * s
            edges = ((abs(below - target), lo), (abs(upto - target), hi + 1))
            error, edge = min(edges)
            alone = lo >> 64 == hi >> 64
            if error <= share * (group_tolerance if alone else tolerance) or lo == hi:
                found[s] = min(edge, TOP - 1)
                del open_[s]
                continue
            candidates |= {lo, min(hi + 1, TOP - 1)}
            if alone:  # one key: split by tie
                candidates |= {lo + 1 + (hi - lo) * k // (probes + 1) for k in range(probes + 1)}
            else:
                a, b = lo >> 64, hi >> 64
                candidates |= {(a + 1 + (b - a) * k // (probes + 1)) << 64 for k in range(probes + 1)}
        if not open_:
            break
        ordered = sorted(candidates)
        counted = _count(rows, ordered)
        ends = []
        running = 0
        for bucket in sorted(counted):
            size, _, lo, hi = counted[bucket]
            ends.append((running, running + size, lo, hi))
            running += size
        for s in open_:
            target = share * s
            below, upto, lo, hi = next(e for e in ends if e[1] >= target)
            open_[s] = (lo, hi, below, upto)
    return [found[s] for s in range(1, parts)]


def shard_rows(rows: DataFrame, shards: int = 8, parts_per_shard: int = 8, tolerance: float = 0.001) -> DataFrame:
    """Adds `shard` and `slot` (gapless from 0 in a shard, in key order) to rows with long columns `key`, `tie`, `size`.

    `key` and `tie` must not be null; rows equal in both share a part. An empty table stays empty. `size` must be
    at least 0. `rows` is read once per round, so it should be a stored table. Columns named shard, slot, part are replaced.
    """
    parts = shards * parts_per_shard
    splitters = find_splitters(rows, parts, tolerance)
    limits = _as_probes(splitters)

    counted = _count(rows, sorted(set(splitters)))
    rank = {b: sum(s <= v for s in splitters) for b, v in enumerate([-1, *sorted(set(splitters))])}
    n = [0] * parts
    for bucket, (_, count, _, _) in counted.items():
        n[rank[bucket]] += count
    before = [sum(n[p - p % parts_per_shard : p]) for p in range(parts)]

    @F.pandas_udf("int")
    def part_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, _packed(key.to_numpy(), tie.to_numpy()), side="right").astype(np.int32))

    inside = Window.partitionBy("part").orderBy("key", "tie")
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("part") + 1)
    return (
        rows.drop("shard", "slot", "part")
        .withColumn("part", part_of("key", "tie"))
        .withColumn("slot", start + F.row_number().over(inside) - 1)
        .withColumn("shard", F.floor(F.col("part") / parts_per_shard).cast("int"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    Null or empty texts have size 1. Null doc_ids sort before all others. Repeated rows are separate documents;
    rows equal in text and doc_id stay in one part. Other columns are not looked at.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.xxhash64(text_or_empty()).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
    )
    return shard_rows(store(narrow, "shard-sizes"), shards, tolerance=tolerance).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
