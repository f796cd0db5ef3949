"""Harmonic packing: sequences of a fixed capacity from pieces of reciprocal-capacity classes.

A length l belongs to class k = capacity div l, so k pieces of class k always fit one sequence. Documents may be cut, so the last
part of a document is cut to the longest length of a class (capacity div k) wherever the class is coarse: its sequences are then
full but for capacity mod k tokens. Each worker fills its own sequences, k pieces for class k, with no exchange between
workers. What is left open when a worker ends (fewer than k pieces in each class) is laid end to end, cut at the capacity, and its
last, shorter run cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import documents, text_or_empty
from feedtide.llm.tokens import vocabulary

BYTE_BPE = "byte_bpe_50k.json"
CAPACITY = 2048
FINE = 16  # classes from here on lose less than capacity / FINE per sequence and are not cut
END = 1  # id after each document
NUMBER_BITS = 33  # of a sequence number within its worker
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, size_class int"

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of its document


def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> its ids. The vocabulary file of a byte-level BPE, run by tiktoken, whose ids for it are the same at a quarter of the time."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    as_byte = {chr(b if b in plain else next(other)): b for b in range(256)}  # the alphabet of byte-level BPE
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {bytes(map(as_byte.__getitem__, token)): i for token, i in described["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.array(encoding.encode(text, allowed_special="all"), dtype="<u4")


def lengths_of(tokens: int, capacity: int = CAPACITY, fine: int = FINE) -> list[int]:
    """How a document of so many tokens is cut: whole sequences, then the longest lengths of finer and finer classes."""
    lengths = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        k = capacity // left
        length = left if k >= fine or left == capacity // k else capacity // (k + 1)
        lengths.append(length)
        left -= length
    return lengths


class Worker:
    """The open sequences of one worker: at most one for each class."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.number = capacity, first
        self.open: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Piece], size_class: int) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.number, offset, size_class))
            offset += len(ids)
        self.number += 1

    def put(self, piece: Piece) -> None:
        size_class = self.capacity // len(piece[2])
        pieces = self.open.setdefault(size_class, [])
        pieces.append(piece)
        if len(pieces) == size_class:
            self._close(self.open.pop(size_class), size_class)

    def end(self) -> None:
        """Lay what is open end to end; it is shorter than one sequence for each class."""
        rest = [piece for size_class in sorted(self.open) for piece in self.open[size_class]]
        self.open = {}
        total = sum(len(ids) for _, _, ids, _ in rest)
        rooms = [self.capacity] * (total // self.capacity)
        rooms += [1 << bit for bit in reversed(range(self.capacity.bit_length())) if total % self.capacity >> bit & 1]
        for room in rooms:
            inside = []
            while room:
                doc_id, start, ids, tokens = rest.pop(0)
                inside.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], tokens))
                room -= len(inside[-1][2])
            self._close(inside, 0)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack_harmonic(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, fine: int = FINE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, size_class (0: laid end to end) for every piece.

    Every id of every document, and id 1 after it, lies in exactly one piece. Null and empty texts are that one id. Repeated rows
    and rows without a doc_id are documents of their own. Other columns are not looked at. An empty table gives an empty
    result. A worker holds one document and less than one sequence for each class. Nothing is shuffled; a worker that is lost is run again
    and gives the same rows as long as `docs` reads stored files.
    """
    path = path or vocabulary(BYTE_BPE)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        worker = Worker(capacity, TaskContext.get().partitionId() << NUMBER_BITS)
        names = [column.split() for column in SCHEMA.split(", ")]
        schema = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in names])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.array([END], dtype="<u4"))
                start = 0
                for length in lengths_of(len(ids), capacity, fine):
                    worker.put((doc_id, start, ids[start : start + length], len(ids)))
                    start += length
                if len(worker.rows) > 10_000:
                    yield worker.batch(schema)
            yield worker.batch(schema)
        worker.end()
        yield worker.batch(schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(fill, SCHEMA)


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; see `pack_harmonic`."""
    return pack_harmonic(documents(spark, sf_dir))
