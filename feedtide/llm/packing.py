"""Packing documents into sequences of a fixed number of tokens, by linear grouping.

Lengths are integers up to the capacity, so the whole problem is a histogram of at most `capacity` counts. The plan is made
on it: large lengths are rounded up within groups of equal cardinality, a linear program over bin configurations of the
few rounded sizes is solved by column generation, the configurations are filled with actual lengths, and everything left goes
to the fullest bin that has room. The plan says for each length which ranks go where; a rank is a document's number among those
of its length, counted by Spark.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, store, text_or_empty
from feedtide.llm.tokens import vocabulary, word_encoder

CAPACITY = 4096
GROUPS = 24
LARGE = 8  # lengths over capacity / LARGE are large
END = 1  # id after each document
RANK_BITS = 48


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; and block, nth: the piece's number among those of its length in its partition."""
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seen, block = word_encoder(path), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(part), block, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, NAMES, strict=True)], NAMES)

    NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, nth bigint"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary")).mapInArrow(cut, schema)


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin configurations (how many of each size) and how often to use each: the rounded-down optimum of the linear program
    that covers `need` with the fewest bins. Columns come from a knapsack over the dual prices."""
    k = len(sizes)
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = list(range(k))
    demand = np.array(need, dtype=float)
    inverse = np.diag([1.0 / columns[i][i] for i in range(k)])
    amount = inverse @ demand
    layers = capacity // min(sizes)
    for _ in range(60 * k):
        price = inverse.sum(axis=0)
        column = _best_bin(sizes, price, capacity, layers)
        if price @ column <= 1 + 1e-9:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-12, amount / np.where(move > 1e-12, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        amount = amount - step * move
        amount[out] = step
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        columns.append(column)
        basis[out] = len(columns) - 1
    return [(tuple(int(x) for x in columns[b]), int(a + 1e-6)) for b, a in zip(basis, amount, strict=True) if a >= 1 - 1e-6]


def _best_bin(sizes: list[int], price: np.ndarray, capacity: int, layers: int) -> np.ndarray:
    """The most valuable multiset of sizes that fits."""
    value, picks = np.zeros(capacity + 1), []
    for _ in range(layers):
        best, which = value.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if price[i] > 1e-12:
                shifted = value[:-s] + price[i]
                better = shifted > best[s:] + 1e-12
                best[s:][better] = shifted[better]
                which[s:][better] = i
        picks.append(which)
        if not (which >= 0).any():
            break
        value = best
    column, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for which in reversed(picks):
        if which[room] >= 0:
            column[which[room]] += 1
            room -= sizes[which[room]]
    return column


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, list[int]]]:
    """[(how many sequences, their lengths)] for counts of lengths 1..capacity."""
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n}
    bins: list[tuple[int, list[int]]] = []
    if capacity in left:
        bins.append((left.pop(capacity), [capacity]))
    big = [(length, n) for length, n in left.items() if length * large > capacity]

    # linear grouping: cut the descending list of large lengths at equal counts; runs of one length may be cut, too
    share = -(-sum(n for _, n in big) // groups) if big else 0
    runs: list[list[list[int]]] = []
    filled = share
    for length, n in big:
        while n:
            if filled >= share or len(big) <= groups and runs[-1][-1][0] != length:  # few lengths need no rounding
                runs.append([])
                filled = 0
            part = min(n, share - filled)
            runs[-1].append([length, part])
            filled += part
            n -= part
    sizes = [group[0][0] for group in runs]
    need = [sum(n for _, n in group) for group in runs]

    # actual lengths take the places of the rounded ones
    for column, times in configurations(sizes, need, capacity) if sizes else []:
        while times and (slots := [(g, a) for g, a in enumerate(column) if a and runs[g]]):
            lengths: list[int] = []
            if all(runs[g][0][1] >= a for g, a in slots):
                m = min(times, *(runs[g][0][1] // a for g, a in slots))
                for g, a in slots:
                    lengths += [runs[g][0][0]] * a
                    runs[g][0][1] -= m * a
                    left[runs[g][0][0]] -= m * a
            else:  # runs end inside this bin
                m = 1
                for g, a in slots:
                    for _ in range(a):
                        while runs[g] and not runs[g][0][1]:
                            runs[g].pop(0)
                        if runs[g]:
                            lengths.append(runs[g][0][0])
                            runs[g][0][1] -= 1
                            left[runs[g][0][0]] -= 1
            for g, _ in slots:
                while runs[g] and not runs[g][0][1]:
                    runs[g].pop(0)
            bins.append((m, lengths))
            times -= m

    # best fit, longest first; bins of one content are handled together
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for m, lengths in bins:
        by_room[capacity - sum(lengths)].append((m, lengths))
    rooms = sorted(r for r in by_room if r)

    def put(room: int, m: int, lengths: list[int]) -> None:
        if room and not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append((m, lengths))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                m, lengths = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                room, m, lengths = capacity, -(-n // (capacity // length)), []
            each = min(room // length, n)
            used = min(m, n // each)
            put(room - each * length, used, lengths + [length] * each)
            if m > used:
                put(room, m - used, lengths)
            n -= each * used
    return [x for entries in by_room.values() for x in entries if x[1]]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Only documents longer than the capacity are cut. Null and empty texts are one piece of one token. Repeated rows are
    packed each. An empty table gives an empty result. The driver sees at most `capacity` counts; the plan that is broadcast has a
    bounded number of entries for each length, whatever the number of documents.
    """
    cut = store(pieces(docs, path, capacity), "pack-pieces")
    by_block = store(cut.groupBy("length", "block").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    entries, next_rank, sequence = [], defaultdict(int), 0
    for m, lengths in packing_plan(counts, capacity):
        offset = 0
        for length in lengths:
            entries.append((length << RANK_BITS | next_rank[length], sequence, offset))
            next_rank[length] += m
            offset += length
        sequence += m
    entries.sort()
    plan = docs.sparkSession.sparkContext.broadcast(np.array(entries, dtype=np.int64).reshape(-1, 3))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << RANK_BITS) | rank.to_numpy()
        entry = plan.value[np.searchsorted(plan.value[:, 0], key, side="right") - 1]
        return pd.DataFrame({"sequence_id": entry[:, 1] + key - entry[:, 0], "offset": entry[:, 2]})

    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = by_block.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = cut.join(before, ["length", "block"]).withColumn("at", place("length", F.col("nth") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
