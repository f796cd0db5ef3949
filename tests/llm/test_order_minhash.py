"""Order MinHash against a plain restatement, and the shape of its plan."""

import hashlib

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from feedtide.llm import order_minhash as omh


def test_edited_texts_of_awkward_rows(docs):
    rows = omh.edited_pairs(docs).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted({i for i, _ in given}, key=lambda i: (i is not None, i or 0))
    smallest = {i: min(t for j, t in given if j == i) for i in order}
    expected = []
    for i, text in given:
        following = smallest[order[(order.index(i) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(expected, key=repr)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[1].near_next == 1.0
    assert by_id[6].fingerprint == by_id[7].fingerprint


def test_empty_and_lone(spark, none):
    assert omh.edited_pairs(none).count() == 0
    row = omh.edited_pairs(spark.createDataFrame([(5, "a b c d")], "doc_id int, text string")).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", omh.fingerprint(F.col("text")).alias("fp"))
    return {r.i: r.fp for r in df.collect()}


def share(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / omh.SIGNATURES


def test_signatures_follow_their_definition(spark):
    """Occurrence numbers, circular minima, text order: computed again from Spark's hash alone."""
    texts = ["", "a", "a b", "a b c", "x y " * 9, prose(3, 150), "w " * 40 + prose(4, 30), prose(5, 40) + " " + prose(5, 40)]
    got = prints(spark, texts)

    def hashes(rows, schema):
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(F.xxhash64(*names)).collect()]

    def top(h):
        return (h & ~omh.PLACE) >> omh.PLACE_BITS

    for i, text in enumerate(texts):
        words = text.split() or [""]
        if len(words) < 3:
            kmers = [top(hashes([(words,)], "w array<string>")[0])]
        else:
            kmers = [top(h) for h in hashes([tuple(words[k : k + 3]) for k in range(len(words) - 2)], "a string, b string, c string")]
        seen, numbered = {}, []
        for k in kmers:
            numbered.append((k, seen.get(k, 0)))
            seen[k] = seen.get(k, 0) + 1
        elements = sorted((top(h), place) for place, h in enumerate(hashes(numbered, "k bigint, o int")))
        pairs = []
        for s in range(omh.SIGNATURES):
            point = (s * omh.ARC - (1 << 63)) >> omh.PLACE_BITS
            at = sum(e < (point, 0) for e in elements)
            two = sorted((elements[at % len(elements)], elements[(at + 1) % len(elements)]), key=lambda e: e[1])
            pairs.append((two[0][0], two[1][0]))
        assert got[i] == [h >> 32 for h in hashes(pairs, "a bigint, b bigint")], i


def test_likeness_falls_with_the_edit_distance(spark):
    base = prose(1, 400).split()
    moved = base[200:] + base[:200]
    texts = [base, base[:390] + ["x"] * 10, base[:300] + prose(2, 100).split(), base[:100] + prose(3, 300).split(), prose(9, 400).split(), sorted(base), moved]
    fp = prints(spark, [" ".join(t) for t in texts])
    near = [share(fp[0], fp[k]) for k in range(7)]
    assert near[0] == 1.0 and near[1] > near[2] > near[3] >= near[4] and near[4] < 0.05 and near[5] < 0.05
    # the same k-mers in another order: k-mer sets hardly differ, half the pairs change places
    assert 0.2 < near[6] < 0.85


def test_main_path_has_no_python_and_reads_the_texts_once(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = omh.edited_pairs(docs)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", ["a b", " a\t\nb\x0b", "\x0ca  b"])
def test_white_space_does_not_matter(spark, text):
    fp = prints(spark, ["a b", text])
    assert fp[0] == fp[1]
