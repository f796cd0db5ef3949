"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks; a block's postings of one term are one row. The items' terms are dealt to a few owners, rarest terms
first. A bundle of items visits the owners one after another: at each, the bundle's sparse accumulators of a block (item, documents,
scores) are cogrouped with the owner's postings of that block, and the integer contributions are added. An accumulator
is dropped only when all that later owners can add leaves it below ten others of its item in the same block, which is exact. After the
last owner each block keeps its best documents of each item, and the final selection ranks these.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, store, text_or_empty

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
OWNERS = 4
BLOCK_DOCUMENTS = 4096
BLOCK_POSTINGS = 1 << 20  # a block ends with the document that reaches one of the two
BUNDLE_ITEMS = 128
FILTER_BITS = 1 << 20  # of the broadcast that says which terms may be asked for: 128 KB, however many items there are
BLOCK_BITS = 33
SCALE = 1_000_000_000
TERM_LIMIT = SCALE // 1000  # a term's weight times this is more than it can add
TERMS_KEPT = 500_000  # answers of the filter that a task remembers
INDEX = "block bigint, term string, docs array<int>, tfs array<int>, ns array<int>, ids array<bigint>"
CARRIED = "block bigint, bundle int, item_id bigint, docs array<int>, scores array<bigint>"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each."""
    found = F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(TERM), 0)
    return items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """One bit for each value of crc32 modulo FILTER_BITS; a set bit means that some item may ask for the term."""
    bit = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS).cast("int")
    words = terms.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(crc32(cast(term as binary)) % 32 as int))")).alias("bits"))
    filled = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in words.collect():  # at most FILTER_BITS / 32
        filled[row["word"]] = row["bits"]
    return filled


def block_writer(asked: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> rows of INDEX: for each block one row per term, and one without a term that lists the documents."""

    class Asked(dict):
        def __missing__(self, term: bytes) -> bool:
            if len(self) >= TERMS_KEPT:
                self.clear()
            h = zlib.crc32(term) % FILTER_BITS
            self[term] = known = bool(asked[h >> 5] >> np.uint32(h & 31) & np.uint32(1))
            return known

    letters = set(string.ascii_letters.encode() + string.digits.encode()) | set(range(128, 256))
    table = bytes(b if b in letters else 32 for b in range(256)).lower()

    def closed(block: int, ids: list[int | None], ns: list[int], postings: dict[bytes, tuple[list[int], list[int]]]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))  # documents are numbered by doc_id, nulls last
        number, sizes = np.empty(len(ids), dtype=np.int32), np.array(ns, dtype=np.int32)
        number[order] = np.arange(len(ids), dtype=np.int32)
        terms = list(postings)
        docs = [np.array(postings[t][0], dtype=np.int32) for t in terms]
        columns = [
            pa.array([block] * (len(terms) + 1), pa.int64()),
            pa.array([*(t.decode("utf-8", "replace") for t in terms), None], pa.string()),
            pa.array([*(number[d] for d in docs), None], pa.list_(pa.int32())),
            pa.array([*(np.array(postings[t][1], dtype=np.int32) for t in terms), None], pa.list_(pa.int32())),
            pa.array([*(sizes[d] for d in docs), sizes[order]], pa.list_(pa.int32())),
            pa.array([*[None] * len(terms), [ids[k] for k in order]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = Asked(), TaskContext.get().partitionId() << BLOCK_BITS
        ids, ns, postings, held = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.translate(table).split()
                for term, tf in Counter(filter(known.__getitem__, words)).items():
                    entry = postings.get(term)
                    if entry is None:
                        entry = postings[term] = ([], [])
                    entry[0].append(len(ids))
                    entry[1].append(tf)
                    held += 1
                ids.append(doc_id)
                ns.append(len(words))
                if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_POSTINGS:
                    yield closed(block, ids, ns, postings)
                    block += 1
                    ids, ns, postings, held = [], [], {}, 0
        if ids:
            yield closed(block, ids, ns, postings)

    return write


def owner_bounds(weighed: DataFrame, owners: int) -> list[int]:
    """Least document frequencies of the owners after the first, so that owners hold about equally many postings. Frequencies are
    told apart by their number of bits: at most 64 sums reach the driver."""
    bits = F.length(F.bin("df"))
    load = sorted((r["bits"], r["load"]) for r in weighed.groupBy(bits.alias("bits")).agg(F.sum("df").alias("load")).collect())
    total, sum_so_far, bounds = sum(n for _, n in load), 0, []
    for bit, n in load:
        while len(bounds) < owners - 1 and sum_so_far and sum_so_far >= total * (len(bounds) + 1) / owners:
            bounds.append(1 << bit - 1)
        sum_so_far += n
    return bounds


def search_plan(terms: DataFrame, index: DataFrame, n_documents: int, owners: int, bundles: int) -> DataFrame:
    """owner, bundle, term, w, items: who owns a term, its weight, and the items of the bundle that ask for it, each with what the
    owners after this one can add to a document at most."""
    df = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = store(terms.join(df, "term").withColumn("w", w), "search-terms")
    owner = sum((F.when(F.col("df") >= b, 1).otherwise(0) for b in owner_bounds(weighed.select("term", "df").distinct(), owners)), F.lit(0))
    owned = weighed.withColumn("owner", owner.cast("int"))
    later = Window.partitionBy("item_id").orderBy(F.col("owner").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = owned.groupBy("item_id", "owner").agg((F.sum("w") * TERM_LIMIT).alias("most"))
    rest = rest.select("item_id", "owner", F.coalesce(F.sum("most").over(later), F.lit(0)).alias("rest"))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int")
    return owned.join(rest, ["item_id", "owner"]).groupBy("owner", bundle.alias("bundle"), "term", "w").agg(F.collect_list(F.struct("item_id", "rest")).alias("items"))


def stage(n_documents: int, n_terms: int, best: int, last: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """One owner's work on a bundle and a block."""

    def threshold(scores: np.ndarray) -> int:
        return int(np.partition(scores, len(scores) - best)[len(scores) - best]) if len(scores) >= best else 0

    def add(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        block, bundle = key[0].as_py(), key[1].as_py()
        held = {
            item: (np.asarray(docs.values), np.asarray(scores.values))
            for item, docs, scores in zip(carried["item_id"].to_pylist(), carried["docs"], carried["scores"], strict=True)
        }
        rows = [
            (w, items, np.asarray(docs.values), np.asarray(tfs.values).astype(np.int64), np.asarray(ns.values).astype(np.int64))
            for w, items, docs, tfs, ns in zip(postings["w"].to_pylist(), postings["items"].to_pylist(), postings["docs"], postings["tfs"], postings["ns"], strict=True)
        ]
        size = 1 + max([int(d.max()) for d, _ in held.values()] + [int(r[2].max()) for r in rows])
        rest: dict[int, int] = {}
        here: Counter = Counter()
        for w, items, *_ in rows:
            for entry in items:
                rest[entry["item_id"]] = entry["rest"]
                here[entry["item_id"]] += w * TERM_LIMIT
        scores_of, only = {}, {}
        for item in rest.keys() | held.keys():
            scores_of[item] = total = np.zeros(size, dtype=np.int64)
            if item in held:
                docs, scores = held[item]
                total[docs] = scores
                if item in rest and rest[item] + here[item] < threshold(scores):  # a document that is new here cannot be among the best
                    only[item] = total > 0
        for w, items, docs, tf, n in rows:
            gain = w * (SCALE * tf // (1000 * tf + 8 * (10 + 90 * n * n_documents // n_terms)))
            for entry in items:
                item = entry["item_id"]
                scores_of[item][docs] += gain if item not in only else gain * only[item][docs]
        out = []
        for item, total in scores_of.items():
            docs = np.flatnonzero(total).astype(np.int32)
            scores = total[docs]
            if last:
                order = np.lexsort((docs, -scores))[:best]
                docs, scores = docs[order], scores[order]
            elif item in rest:
                kept = scores + rest[item] >= threshold(scores)
                docs, scores = docs[kept], scores[kept]
            if len(docs):
                out.append((block, bundle, item, docs, scores))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CARRIED.split(", ")])

    return add


def search(docs: DataFrame, items: DataFrame, best: int = BEST, owners: int = OWNERS) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` highest-scoring documents with a score above 0 of every item.

    Null and empty texts have no terms; a document without terms is not counted. An item is an item_id: repeated rows of one
    add their terms together, rows without an item_id are left out. Repeated documents are documents of their own. Equal scores rank by
    ascending doc_id, null last. An empty table on either side gives an empty result. Other columns are not looked at. `docs` must
    read stored files: a block is known by its task.
    """
    spark = docs.sparkSession
    terms = store(item_terms(items), "search-items")
    write = block_writer(term_filter(terms))
    index = store(docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary")).mapInArrow(write, INDEX), "search-index")
    listed = index.filter("term is null")
    sizes = listed.select(F.explode("ns").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum(F.col("n").cast("long")).alias("terms")).first()
    n_documents, n_terms = sizes["documents"], max(sizes["terms"] or 0, 1)
    bundles = -(-terms.select("item_id").distinct().count() // BUNDLE_ITEMS) or 1
    plan = store(search_plan(terms, index, n_documents, owners, bundles), "search-plan")

    carried = spark.createDataFrame([], CARRIED)
    for owner in range(owners):
        owned = plan.filter(F.col("owner") == owner).drop("owner")
        postings = index.filter("term is not null").join(owned, "term").select("block", "bundle", "w", "items", "docs", "tfs", "ns")
        add = stage(n_documents, n_terms, best, owner == owners - 1)
        carried = carried.groupBy("block", "bundle").cogroup(postings.groupBy("block", "bundle")).applyInArrow(add, CARRIED)
    found = carried.select("block", "item_id", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("block", "item_id", F.col("x.docs").alias("doc"), F.col("x.scores").alias("score"))
    names = listed.select("block", F.posexplode("ids").alias("doc", "doc_id"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.join(names, ["block", "doc"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item; see `search`."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
