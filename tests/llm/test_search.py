"""Pipelined search against the formula computed plainly, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_helpers import prose

from feedtide.llm import search as S
from feedtide.llm.oracle import SEARCH

DOCS = "doc_id bigint, text string, score string, item_id int, term string"
ITEMS = "item_id bigint, text string, rank int, block string"


def terms_of(text):
    return re.findall(S.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=10):
    texts = [(doc_id, terms_of(text)) for doc_id, text in docs]
    n_docs, total = sum(1 for _, t in texts if t), sum(len(t) for _, t in texts)
    df = Counter(term for _, t in texts for term in set(t))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc_id, words in texts:
            tf, score = Counter(words), 0
            for term in terms & tf.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                m = 100 - 90 + 90 * len(words) * n_docs // total
                score += w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", 1, "the") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 5, "b") for i, t in items], ITEMS)
    found = S.search(S.store(frame, "docs"), asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("size,bundle,owners", [(4096, 128, 4), (4, 1, 3), (15, 2, 1)])
def test_same_as_the_formula(spark, monkeypatch, size, bundle, owners):
    monkeypatch.setattr(S, "BLOCK_DOCUMENTS", size)
    monkeypatch.setattr(S, "BUNDLE_ITEMS", bundle)
    rnd = random.Random(size)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for k in range(120)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(12))) for k in range(7)]
    assert ours(spark, docs, items, owners=owners) == plain(docs, items)


def test_nulls_ties_repeats_and_odd_texts(spark):
    docs = [(1, "Über ÜBER straße x1"), (2, None), (3, ""), (4, " . , "), (None, "über alles"), (5, "cat cat dog"), (5, "cat cat dog"), (6, "cat cat dog"), (None, "cat cat dog")]
    docs += [(100, "cat " * 40_000 + prose(1, 20_000)), (101, "日本語 cat🙂dog"), (102, "a\x00b\x7fc_d")] + [(200 + k, prose(k, 30)) for k in range(20)]
    items = [(1, "CAT dog"), (1, "alles?"), (2, None), (3, ""), (None, "cat"), (4, "Über 日本語 b d"), (5, "nowhere"), (6, prose(3, 10)), (6, prose(3, 10))]
    found = ours(spark, docs, items)
    assert found == plain(docs, items)
    assert {r[0] for r in found} == {1, 4, 6}


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "cat")]) == [] and ours(spark, [(1, "cat")], []) == [] and ours(spark, [(1, None)], [(1, "cat")]) == []


def test_the_filter_is_exact_enough_to_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_BITS", 64)  # nearly every term passes
    docs, items = [(k, prose(k, 60)) for k in range(30)], [(k, prose(k + 50, 20)) for k in range(3)]
    assert ours(spark, docs, items) == plain(docs, items)


def test_whole_table(spark, sf_dir):
    found = S.op11_pipelined_search(spark, sf_dir)
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(connection.execute(SEARCH).fetchall())
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
