"""Token ids, histograms and packing against the tokenizer and plain sums."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedtide.llm import packing, tokens

CAP = 64


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello, World!", "don't they'RE 12345 x1y2", "ÀÉÎõü straße ÿŸ ǅ Σίσυφος ΣΑΣ", "a b c\x1fd\x85e", "é Å Å ﬁ", "日本語 текст 🙂🙂 ok", "x" * 500 + "," * 60, "<|endoftext|>a <|startoftext|>", "İstanbul ŉ ª º µ", "a,b.c;d e, f. g!? 'll 's"],
)
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    encode = tokens.word_encoder(tokens.vocabulary())
    for _ in range(2):  # also from the cache
        assert np.frombuffer(encode(text.encode()), dtype="<u4").tolist() == ids_of(tokenizer, text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_and_is_close_to_the_bound(seed):
    rnd = random.Random(seed)
    lengths = Counter(min(4096, max(1, int(rnd.lognormvariate(6.3, 1.1)))) for _ in range(rnd.choice([1, 30, 3000])))
    plan = packing.packing_plan(dict(lengths))
    used = Counter()
    for m, inside in plan:
        assert m > 0 and sum(inside) <= 4096
        for n in inside:
            used[n] += m
    assert used == lengths
    bins, total = sum(m for m, _ in plan), sum(k * v for k, v in lengths.items())
    big = sum(v for k, v in lengths.items() if k > 2048)
    assert bins <= max(-(-total // 4096), big) * 1.05 + 1


def test_plan_does_not_grow_with_the_counts():
    rnd = random.Random(1)
    few = Counter(min(4096, max(1, int(rnd.lognormvariate(6.3, 1.1)))) for _ in range(5000))
    many = packing.packing_plan({k: v * 100_000 for k, v in few.items()})
    assert len(many) < 20_000 and packing.packing_plan({}) == []


def test_configurations_cover_hard_halves():
    # 2049 does not pair with itself, 1366 not in threes: only mixing fills the bins
    plan = packing.packing_plan({2049: 300, 2047: 300, 1366: 90, 1365: 180})
    assert sum(m for m, _ in plan) <= 392


def test_pieces_and_places(docs, tokenizer):
    rows = packing.pack(docs, capacity=CAP).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*ids_of(tokenizer, r.text), 1]
        for k in range(0, len(ids), CAP):
            part = ids[k : k + CAP]
            expected[(r.doc_id, k // CAP, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAP
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // CAP) + 2


def test_empty_table(none):
    assert packing.pack(none).count() == 0
    assert tokens.limit_answers(tokens.length_counts(none)).count() == 0


def test_answers_for_every_limit(spark):
    lengths = [random.Random(4).choice([0, 1, 5, 255, 256, 257, 700, 5000]) for _ in range(200)]
    counts = spark.createDataFrame(list(Counter(lengths).items()), "length bigint, documents bigint")
    answers = tokens.limit_answers(counts)
    for r in answers.collect():
        assert r.fitting == sum(n <= r.length for n in lengths) and r.longer == sum(n > r.length for n in lengths)
        assert r.tokens == sum(n for n in lengths if n <= r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_tokens
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    ordered = sorted(lengths)
    got = {r.share: r.length for r in tokens.quantiles(answers, shares).collect()}
    assert got == {s: ordered[bisect.bisect_left(range(1, 201), s * 200 - 1e-9)] for s in shares}


def test_length_counts(docs, tokenizer):
    expected = Counter(len(ids_of(tokenizer, r.text)) for r in docs.select(F.col("text")).collect())
    assert {r.length: r.documents for r in tokens.length_counts(docs).collect()} == expected
