"""The stages in order over the small test table, and what their decisions must leave."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedtide.llm import jaccard, mixing, packing, substrings, toxicity
from feedtide.llm.catalog import QUERIES, SQL
from feedtide.llm.common import documents, store


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = documents(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, sf_dir), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps, spark, sf_dir):
    columns = documents(spark, sf_dir).columns
    assert [n for n, _, _ in steps] == ["toxicity", "near copies", "repeated passages", "source mixing", "packing"]
    assert all(after.columns == columns for _, _, after in steps[:-1])


def test_toxic_documents_go_and_others_stay(steps, spark, sf_dir):
    _, before, after = steps[0]
    model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(before, model).filter("score >= 0.7").collect()}
    assert ids(after) == sorted(set(ids(before)) - rejected) and rejected
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
    assert len(clean & rejected) <= 0.01 * len(clean)


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    assert ids(after) == sorted({r.component_id for r in jaccard.link(before).collect()})
    assert jaccard.link(after).filter("doc_id != component_id").count() == 0


def test_no_passage_stays_twice(steps):
    _, before, after = steps[2]
    passages = substrings.repeated_passages(before).collect()
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r.text for r in after.collect()}
    cut = {r.doc_id for r in passages}
    assert all(new[k] == old[k] for k in old if k not in cut)
    assert all(len((new.get(k) or "").split()) < len(old[k].split()) for k in cut)


def test_mix_and_pack(steps, spark, sf_dir):
    _, before, after = steps[3]
    taken = {r.doc_id: r.copies for r in mixing.mix(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    expected = sorted(k for k, n in taken.items() for _ in range(n))
    assert ids(after) == expected
    _, before, packed = steps[4]
    assert packed.filter("start = 0").count() == before.count()
    assert packed.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_columns_that_clash_with_work_columns_are_kept(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("score", F.lit(42.0)).withColumn("spans", F.lit("mine"))
    after = corpus_pipeline.without_toxic(spark, docs, sf_dir)
    assert after.dtypes == docs.dtypes and after.filter("score != 42.0 OR spans != 'mine'").isEmpty() and after.count() > 0
