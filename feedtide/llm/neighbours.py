"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. A query visits cells in the order of their summed
distance, taken from a heap, until the visited cells hold a given share of all vectors, and the entries of these cells are ranked by
their exact inner product. Equal vectors are one entry with its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import bounded_sample, store

CENTROIDS = 32  # of each half
SAMPLE = 8192  # bound of the training sample, different vectors
ROUNDS = 12
VISIT = 0.65  # share of the entries that a query's cells hold at least
NEAREST = 20
CHUNK = 16_384  # entries of a chunk, about
BLOCK = 4096  # queries of a block
STEP = 256  # queries scored at once


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, nearest: int) -> DataFrame:
    """vector (doubles), ids: each different vector with its nearest + 1 smallest ids, ascending."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= nearest + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def half_centroids(sample: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centroids**2).sum(axis=1) - 2 * sample @ centroids.T, axis=1)
        count = np.bincount(nearest, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def cells_of(matrix: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    middle = matrix.shape[1] // 2
    codes = [np.argmin((c**2).sum(axis=1) - 2 * part @ c.T, axis=1) for part, c in zip((matrix[:, :middle], matrix[:, middle:]), halves, strict=True)]
    return codes[0] * len(halves[1]) + codes[1]


def visited_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by ascending first[i] + second[j] until they hold `wanted` entries: the multi-sequence walk over two sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    cells = (a[:, None] * len(b) + b[None, :]).tolist()
    held = counts.tolist()
    heap, done, taken, total = [(x[0] + y[0], 0, 0)], [0] * len(x), [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        taken.append(cells[i][j])
        total += held[cells[i][j]]
        # a pair enters once both pairs before it have been taken
        if i + 1 < len(x) and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return taken


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def search(
    vectors: DataFrame, every: int = 20, nearest: int = NEAREST, centroids: int = CENTROIDS, visit: float = VISIT, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the `nearest` other rows found, by inner
    product, ties to the smaller id.

    Rows with a null vec_id, and vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do vectors whose
    dimension is not the most common one. Rows that repeat a vec_id are one query, never candidates of it. Other columns are not looked at.
    """
    known = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = known.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension = int(common["d"])
    known = known.filter(F.size("embedding") == dimension)
    distinct = store(entries(known, nearest), "ann-entries")

    chosen = bounded_sample(distinct.select("vector"), ["vector"], sample).collect()
    matrix = np.array([r["vector"] for r in chosen], dtype=np.float64)
    k = min(centroids, len(matrix))
    middle = dimension // 2
    halves = (half_centroids(matrix[:, :middle], k, ROUNDS), half_centroids(matrix[:, middle:], k, ROUNDS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(_matrix(batch.column(0), dimension), halves)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["vector", "ids", "cell"])

    coded = store(distinct.mapInArrow(encode, "vector array<double>, ids array<bigint>, cell int"), "ann-cells")
    counts = np.zeros(k * k, dtype=np.int64)
    for row in coded.groupBy("cell").count().collect():  # at most centroids^2 rows
        counts[row["cell"]] = row["count"]
    total = int(counts.sum())

    # cells in order fill chunks; a large cell is cut by the hash of its vectors
    pieces = np.maximum(1, -(-counts // CHUNK))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) // CHUNK
    first_chunk = starts + np.concatenate([[0], np.cumsum(pieces - 1)[:-1]])
    chunks_of = [list(range(int(f), int(f + p))) for f, p in zip(first_chunk, pieces, strict=True)]
    n_pieces, n_first = pieces.tolist(), first_chunk.tolist()

    queries = known.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    queries = queries.dropDuplicates(["query_id"])
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // BLOCK))
    wanted = max(int(np.ceil(visit * total)), 4 * (nearest + 1))  # few entries: all of them

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), dimension)
            first, second = -q[:, :middle] @ halves[0].T, -q[:, middle:] @ halves[1].T
            bits, chunks = [], []
            for i in range(len(q)):
                cells = visited_cells(first[i], second[i], counts, wanted)
                mask = np.zeros(k * k, dtype=bool)
                mask[cells] = True
                bits.append(np.packbits(mask).tobytes())
                chunks.append(sorted({c for cell in cells if counts[cell] for c in chunks_of[cell]}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary()), pa.array(chunks, pa.list_(pa.int32()))], ["query_id", "vector", "cells", "chunks"])

    routed = queries.mapInArrow(route, "query_id bigint, vector array<double>, cells binary, chunks array<int>")
    asked = routed.select("query_id", "vector", "cells", F.explode("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))

    @F.pandas_udf("int")
    def chunk_of(cell: pd.Series, salt: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series((np.array(n_first)[c] + salt.to_numpy() % np.array(n_pieces)[c]).astype(np.int32))

    salt = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    held = coded.withColumn("chunk", chunk_of("cell", salt)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            q, e = _matrix(left["vector"].combine_chunks(), dimension), _matrix(right["vector"].combine_chunks(), dimension)
            asked_by = left["query_id"].to_pylist()
            visited = np.unpackbits(np.array([np.frombuffer(b, dtype=np.uint8) for b in left["cells"].to_pylist()]), axis=1)[:, : k * k].astype(bool)
            cell, ids = right["cell"].to_numpy(), right["ids"].to_pylist()
            most = min(nearest + 1, len(e))
            for at in range(0, len(q), STEP):
                scores = np.where(visited[at : at + STEP][:, cell], q[at : at + STEP] @ e.T, -np.inf)
                limit = np.partition(scores, len(e) - most, axis=1)[:, len(e) - most]
                for i, row in enumerate(scores):
                    near = np.flatnonzero((row >= limit[i] - 1e-9) & np.isfinite(row))
                    exact = (e[near] * q[at + i]).sum(axis=1)
                    own = asked_by[at + i]
                    ranked = sorted((-s, v) for s, n in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[n] if v != own)
                    found += [(own, v, -s) for s, v in ranked[:nearest]]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    parts = asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
