"""Harmonic packing against the tokenizer: every id in one piece, full classes, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import prose
from tokenizers import Tokenizer

from feedtide.llm import harmonic, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary(harmonic.BYTE_BPE))


@pytest.fixture(scope="module")
def encode():
    return harmonic.byte_encoder(tokens.vocabulary(harmonic.BYTE_BPE))


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello, World!", "don't they'RE 12345 x1y2", "  two  spaces \n\n\tand tabs  ", "a b c\x1fd\x85e\x00", "日本語 текст 🙂🙂 ok", "x" * 500 + "," * 60, "<|endoftext|>a <|endoftext|> b", "é ﬁ İ", "　 x"],
)
def test_ids_are_those_of_the_tokenizer(tokenizer, encode, text):
    assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_word_of_the_vocabulary_is_encoded_alike(tokenizer, encode):
    words = [t for t in (tokenizer.decode([i], skip_special_tokens=False) for i in range(50257)) if "�" not in t]
    ids = [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [encode(w).tolist() for w in words] == ids


@pytest.mark.parametrize("capacity,fine", [(2048, 16), (64, 4), (8, 2), (1, 16)])
def test_cuts_hit_the_tops_of_coarse_classes(capacity, fine):
    for n in range(1, 5000, 7):
        lengths = harmonic.lengths_of(n, capacity, fine)
        assert sum(lengths) == n and max(lengths) <= capacity and len(lengths) <= n // capacity + fine
        for length in lengths:
            k = capacity // length
            assert k >= fine or length == capacity // k


def check(rows, docs, tokenizer, capacity):
    """Every id once, sequences gapless; returns the padding and all tokens."""
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    copies, covered, sequences = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for doc_id, _ in docs:
        copies[doc_id] += 1
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        for at in range(r.start, r.start + r.length):
            covered[r.doc_id][at] += 1
        sequences[r.sequence_id].append((r.offset, r.length, r.size_class))
    for doc_id, n in copies.items():
        assert covered[doc_id] == dict.fromkeys(range(len(ids[doc_id])), n)
    padding = total = 0
    for pieces in sequences.values():
        end = 0
        for offset, length, size_class in sorted(pieces):
            assert offset == end
            end += length
            assert size_class == pieces[0][2] and (not size_class or len(pieces) == size_class == capacity // length)
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
        total += end
    return padding, total


@pytest.mark.parametrize("capacity", [2048, 64])
def test_each_id_once_and_little_padding(spark, tokenizer, capacity):
    texts = [prose(k, 3 + k * 37 % 900) for k in range(150)] + [None, "", " ", prose(999, 9000)]
    docs = [(k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    padding, total = check(harmonic.pack_harmonic(frame, capacity=capacity).collect(), docs, tokenizer, capacity)
    assert padding <= 0.01 * total


def test_nulls_repeats_and_clashing_columns(spark, docs, none, tokenizer):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(harmonic.pack_harmonic(docs.withColumn("start", docs.text).withColumn("sequence_id", docs.lang)).collect(), rows, tokenizer, 2048)
    assert harmonic.pack_harmonic(none).collect() == []


def test_whole_table(spark, sf_dir, tokenizer):
    frame = harmonic.op12_harmonic_packing(spark, sf_dir)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    padding, total = check(frame.collect(), docs, tokenizer, 2048)
    assert padding <= 0.01 * total
