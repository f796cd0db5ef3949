"""Order MinHash fingerprints, in DataFrame functions only.

A text is its sequence of words. Its k-mers (K words) get occurrence numbers, so that every element of the sequence of
k-mers is distinct. Signature i takes the ELEMENTS minimal elements under the i-th permutation of the hash space, puts them back in
text order and hashes that tuple. The permutations are rotations of one 64-bit hash, x -> x - i * 2^64 / SIGNATURES: the minimal
elements are those that follow a fixed point on the circle of sorted hashes, so one sort serves all signatures. Two texts agree in a
signature if they share the elements and their order: the share of agreeing signatures falls with the edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, numbered, store, text_or_empty

K = 3
ELEMENTS = 2
SIGNATURES = 64  # a power of two
PLACE_BITS = 30  # of an element: its place in the text; the other 34 are its hash
PLACE = (1 << PLACE_BITS) - 1
ARC = 1 << 58  # 2^64 / SIGNATURES
NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once, even inside functions of arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _element(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(~PLACE).bitwiseOR(place.cast("long"))


def _identity(element: Column) -> Column:
    return F.shiftright(element, PLACE_BITS)


def _numbered(sorted_: Column, n: Column) -> Column:
    """Elements of (k-mer, occurrence number) from the sorted k-mers; equal ones stand together, in text order."""
    fresh = lambda j: ~_identity(F.get(sorted_, j)).eqNullSafe(_identity(F.get(sorted_, j - 1)))

    def with_number(v: Column, occurrence: Column) -> Column:
        return _element(F.xxhash64(_identity(v), occurrence), v.bitwiseAND(PLACE))

    def each(starts: Column) -> Column:
        runs = F.transform(
            starts,
            lambda start, a: F.transform(
                F.sequence(start, F.coalesce(F.get(starts, a + 1), n) - 1), lambda j: with_number(F.get(sorted_, j), j - start)
            ),
        )
        return F.when(F.size(starts) == n, F.transform(sorted_, lambda v: with_number(v, F.lit(0)))).otherwise(F.flatten(runs))

    return let(F.filter(F.sequence(F.lit(0), n - 1), fresh), each)


def _signatures(elements: Column, n: Column) -> Column:
    points = F.array(*[F.lit(i * ARC - (1 << 63)) for i in range(SIGNATURES)])

    def one(circle: Column, first: Column) -> Column:
        a, b = F.get(circle, first % n), F.get(circle, (first + 1) % n)
        in_order = a.bitwiseAND(PLACE) <= b.bitwiseAND(PLACE)
        pair = F.when(in_order, F.xxhash64(_identity(a), _identity(b))).otherwise(F.xxhash64(_identity(b), _identity(a)))
        return F.shiftright(pair, 32).cast("int")

    def all_(circle: Column) -> Column:
        def from_points(merged: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), n + (SIGNATURES - 1)), lambda j: F.get(merged, j).bitwiseAND(ARC - 1) == 0)
            return F.transform(at, lambda j, i: one(circle, j - i))

        return let(F.sort_array(F.concat(circle, points)), from_points)

    return let(F.sort_array(elements), all_)


def fingerprint(text: Column) -> Column:
    """SIGNATURES ints for a text that is not null. Fewer than K words make one k-mer; no word at all makes the empty word one."""

    def of_words(words: Column) -> Column:
        few = F.size(words) < K
        n = F.greatest(F.size(words) - (K - 1), F.lit(1))
        kmer = lambda i: _element(F.xxhash64(*[F.get(words, i + d) for d in range(K)]), i)
        kmers = F.when(few, F.array(_element(F.xxhash64(words), F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), kmer))
        return let(F.sort_array(kmers), lambda s: let(_numbered(s, n), lambda e: _signatures(e, n)))

    return let(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), of_words)


def likeness(a: Column, b: Column) -> Column:
    same = F.filter(F.sequence(F.lit(0), F.lit(SIGNATURES - 1)), lambda i: F.get(a, i) == F.get(b, i))
    return F.size(same) / F.lit(float(SIGNATURES))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def next_ids(docs: DataFrame) -> DataFrame:
    """key, need, next_key: each doc_id (null: the smallest), half its longest text, and the next larger id, cyclically."""
    ids = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")).agg(F.max(F.floor(F.length(text_or_empty()) / 2)).cast("int").alias("need"))
    placed = store(numbered(ids, [F.col("key").asc()], "n", "omh-order"), "omh-ids")
    n = max(placed.count(), 1)
    following = placed.select(F.col("key").alias("next_key"), F.col("n").alias("m"))
    return placed.withColumn("m", (F.col("n") + 1) % n).join(following, "m").select("key", "need", "next_key")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    Null texts are empty. A null doc_id is the smallest id. Rows that repeat a doc_id all have the next larger id's document as their
    next; where that id repeats, its smallest text counts. A lone document is its own next. Other columns are not looked at. An empty
    table gives an empty result. Texts are shuffled once, and of the next ones only the part that is put in.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), text_or_empty().alias("text")).withColumn("fp", fingerprint(F.col("text")))
    # lag, not row_number: both uses of `base` then read the same exchange
    first = base.withColumn("earlier", F.lag("text").over(Window.partitionBy("key").orderBy("text"))).filter("earlier is null")
    heads = (
        next_ids(docs)
        .join(first.select(F.col("key").alias("next_key"), "text", "fp"), "next_key")
        .select("key", F.col("text").substr(F.lit(1), F.col("need")).alias("head"), F.col("fp").alias("next_fp"))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    joined = base.join(heads, "key").withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("head").substr(F.lit(1), half)))
    printed = joined.withColumn("edited_fp", fingerprint(F.col("edited")))
    return printed.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
