"""Mixing against a plain water-filling, sharding against sorted sums."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from feedtide.llm import mixing, sharding


def plain_targets(sizes):
    """The rule as stated: share out, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    rest = 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "é": 20, None: 300}, {"z": 5}, {"a": 0, "b": 7}, {"x": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and set(got) == set(sizes)


def test_mix_of_awkward_rows(docs, labels):
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs, labels).collect()), key=repr)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size


def test_taken_words_come_near_the_targets(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).alias("size"), F.lit(1.0).alias("weight")
    )
    taken = mixing.choose(rows, mixing.source_targets(rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    for r in taken.collect():
        assert abs(r.taken - r.target) <= 5


def test_heavier_documents_are_taken_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("bigint").alias("size"), F.when(F.col("id") % 4 < 2, 2.0).otherwise(1.0).alias("weight"))
    targets = mixing.source_targets(rows, share=0.5)
    share = {r.weight: r.share for r in mixing.choose(rows, targets).join(rows.select("doc_id", "weight"), "doc_id").groupBy("weight").agg(F.avg("copies").alias("share")).collect()}
    assert share[2.0] > share[1.0] + 0.1


def test_mixed_documents_keep_their_columns(docs, labels, none):
    out = mixing.mixed_documents(docs, labels)
    assert out.columns == docs.columns
    copies = sum(r.copies for r in mixing.mix(docs, labels).collect())
    assert abs(out.count() - copies) <= 2  # rows equal in id, source and size are taken alike
    assert mixing.mix(none, labels).count() == 0 and mixing.mixed_documents(none).count() == 0


def check_shards(rows, shards=8):
    for shard, group in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert 0 <= shard < shards
        assert [r.slot for r in group] == list(range(len([r for r in rows if r.shard == shard])))


def test_shards_of_awkward_rows(docs, none):
    rows = sharding.shard_documents(docs).collect()
    texts = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.size, r.text_crc32) for r in rows) == texts
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check_shards(rows)
    assert sharding.shard_documents(none).count() == 0


def test_shards_are_even_and_cut_only_large_groups(spark):
    text = F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), (1 + F.pmod(F.xxhash64("id"), F.lit(7))).cast("int")))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = sharding.shard_documents(docs).collect()
    check_shards(rows)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8
    few = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 200).alias("text"))
    where = {}
    for r in sharding.shard_documents(few, tolerance=0.001).collect():
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 7


@pytest.mark.parametrize("copies", [1, 7, 200])
def test_repeated_rows_are_taken_one_by_one(spark, copies):
    """Rows that are equal in every column are rows of their own: each source comes within one document of its target."""
    rows = [(k, "word " * (10 + k % 5), s) for s in "abc" for k in range(20)] + [(777, "word " * 12, s) for s in "abc" for _ in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for s in "abc":
        mine = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 14
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in found)
    per_source = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert per_source == {s: n for s in "abc" if (n := sum(r.copies for r in found if r.source == s))}
