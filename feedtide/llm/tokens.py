"""Token ids of whole texts, and exact length histograms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, text_or_empty

WORD_BPE = "word_bpe_49k.json"
CACHED = 400_000  # pieces of text whose ids a task remembers
CACHED_BYTES = 48  # longer ones are encoded each time
SUFFIX_BLOCK = 8  # bits of a length that are summed within a block


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """text (UTF-8) -> its ids as little-endian uint32.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its white-space
    separated pieces. Pieces repeat: their ids are remembered. A piece of Latin-1 letters, then plain punctuation, goes
    to the BPE model directly (NFC and lower-casing change nothing but the case there); any other takes the whole route.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    as_letter = {b: b if b in plain else next(other) for b in range(256)}  # the byte alphabet of byte-level BPE
    simple = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
    pieces: dict[bytes, bytes] = {}
    words: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def word(text: str) -> bytes:
        known = words.get(text)
        if known is None:
            known = packed([t.id for t in model.tokenize(text.encode().decode("latin-1").translate(as_letter))])
            if len(words) >= CACHED:
                words.clear()
            words[text] = known
        return known

    def piece(chunk: bytes) -> bytes:
        text = chunk.decode()
        match = simple.fullmatch(text)
        if match:
            ids = word(match[1].lower()) + (word(match[2]) if match[2] else b"")
        else:
            ids = packed(tokenizer.encode(text, add_special_tokens=False).ids)
        if len(chunk) <= CACHED_BYTES:
            pieces[chunk] = ids
        return ids

    def encode(text: bytes) -> bytes:
        if len(pieces) >= CACHED:
            pieces.clear()
        chunks = text.split()
        ids = list(map(pieces.get, chunks))
        if None in ids:
            ids = [pieces.get(c) or piece(c) for c in chunks]
        return b"".join(ids)

    return encode


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def length_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, documents: how many documents have so many tokens. Each task counts its own documents first.

    Null and empty texts have length 0. Repeated rows count each time. An empty table has no row.
    """
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = word_encoder(path), Counter()
        for batch in batches:
            found.update(len(encode(t)) // 4 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "documents"])

    counted = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(count, "length bigint, documents bigint")
    return counted.groupBy("length").agg(F.sum("documents").alias("documents"))


def limit_answers(counts: DataFrame) -> DataFrame:
    """For every length that occurs, taken as the context limit:

    length, documents, fitting (documents within the limit), longer (documents beyond it), share_fitting (the limit is this
    quantile of the lengths), tokens (of documents within the limit), truncated_tokens (of all, cut to the limit),
    lost_tokens. Sums run from the longest length down in blocks of 256 lengths, then over the block totals.
    """
    block = F.shiftright("length", SUFFIX_BLOCK)
    rows = counts.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), block.alias("block"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")))
    total = rows.agg(F.sum("documents").alias("all_documents"), F.sum("tokens").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = (
        rows.join(blocks, "block")
        .withColumn("longer", F.col("d_after") + F.coalesce(F.sum("documents").over(inside), F.lit(0)))
        .withColumn("longer_tokens", F.col("t_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(F.broadcast(total))  # one row
    )
    lost = F.col("longer_tokens") - F.col("length") * F.col("longer")
    fitting = F.col("all_documents") - F.col("longer")
    return suffix.select(
        "length",
        "documents",
        fitting.alias("fitting"),
        "longer",
        (fitting / F.col("all_documents")).alias("share_fitting"),
        (F.col("all_tokens") - F.col("longer_tokens")).alias("tokens"),
        (F.col("all_tokens") - lost).alias("truncated_tokens"),
        lost.alias("lost_tokens"),
    )


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return answers.select(asked.alias("share"), "length", "share_fitting").filter("share_fitting >= share").groupBy("share").agg(F.min("length").alias("length"))


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """limit, fitting, longer, share_fitting, tokens, truncated_tokens, lost_tokens for any limits of at least 0, also those that are
    no document's length: the sums stand at the largest length within the limit. Without documents there is no row."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))]))
    within = F.when(F.col("length") <= F.col("limit"), F.col("length"))
    found = (
        answers.select("*", asked.alias("limit"))
        .groupBy("limit")
        .agg(
            F.coalesce(F.max_by("fitting", within), F.lit(0)).alias("fitting"),
            F.coalesce(F.max_by("tokens", within), F.lit(0)).alias("tokens"),
            F.max("fitting").alias("all_documents"),
            F.max("tokens").alias("all_tokens"),
        )
        .withColumn("longer", F.col("all_documents") - F.col("fitting"))
        .withColumn("truncated_tokens", F.col("tokens") + F.col("limit") * F.col("longer"))
    )
    share, lost = F.col("fitting") / F.col("all_documents"), F.col("all_tokens") - F.col("truncated_tokens")
    return found.select("limit", "fitting", "longer", share.alias("share_fitting"), "tokens", "truncated_tokens", lost.alias("lost_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_answers(length_counts(documents(spark, sf_dir)))
