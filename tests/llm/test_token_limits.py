"""Answers for context limits that are no document's length."""

import pytest

from feedtide.llm import tokens


def test_any_limit_equals_a_count_over_all_lengths(spark):
    lengths = [3, 3, 3, 10, 255, 256, 257, 5000]
    counts = spark.createDataFrame([(n, lengths.count(n)) for n in sorted(set(lengths))], "length bigint, documents bigint")
    limits = [0, 2, 3, 4, 9, 256, 1000, 5000, 9000, 9000]
    rows = {r.limit: r for r in tokens.at_limits(tokens.limit_answers(counts), limits).collect()}
    assert set(rows) == set(limits)
    for limit, r in rows.items():
        fit = [n for n in lengths if n <= limit]
        cut = sum(min(n, limit) for n in lengths)
        assert (r.fitting, r.longer, r.tokens) == (len(fit), len(lengths) - len(fit), sum(fit))
        assert (r.truncated_tokens, r.lost_tokens) == (cut, sum(lengths) - cut)
        assert r.share_fitting == pytest.approx(len(fit) / len(lengths))


def test_no_documents_have_no_answer(spark):
    none = spark.createDataFrame([], "length bigint, documents bigint")
    assert tokens.at_limits(tokens.limit_answers(none), [1, 2]).count() == 0
