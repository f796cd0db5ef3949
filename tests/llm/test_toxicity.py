"""Forward-backward against enumeration, and held-out accuracy."""

import itertools
import math
import random

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from feedtide.llm import toxicity

MODEL = toxicity.Model({"idio": 3.0, "idiot": 1.5, "fool": 2.0, "nice": -2.0}, bias=-1.5, to_toxic=-1.0, to_clean=0.3, stay=0.8, document=(-3.0, 2.0, 4.0))


def enumerated(tokens):
    """Marginals by summing over all taggings."""
    scores = [MODEL.bias + sum(MODEL.weights.get(f, 0) for f in toxicity.features_of(t)) for t in tokens]
    step = {(0, 0): 0, (0, 1): MODEL.to_toxic, (1, 0): MODEL.to_clean, (1, 1): MODEL.stay}
    total, toxic = 0.0, [0.0] * len(tokens)
    for tags in itertools.product((0, 1), repeat=len(tokens)):
        p = math.exp(sum(s for s, t in zip(scores, tags, strict=True) if t) + sum(step[a, b] for a, b in itertools.pairwise(tags)))
        total += p
        for i, t in enumerate(tags):
            toxic[i] += p * t
    return [x / total for x in toxic]


@pytest.mark.parametrize("seed", range(12))
def test_marginals_equal_enumeration(seed):
    rnd = random.Random(seed)
    tokens = [rnd.choice(["plain", "Idiot!", "fools", "nicely", "of", "x"]) for _ in range(rnd.randint(1, 11))]
    places, marginals, n = toxicity.tagger(MODEL)(" ".join(tokens).encode())
    expected = enumerated(tokens)
    assert n == len(tokens) and places == [i for i, t in enumerate(tokens) if any(f in MODEL.weights for f in toxicity.features_of(t))]
    assert marginals == pytest.approx([expected[i] for i in places], abs=1e-9)


def test_long_neutral_runs_stay_finite():
    places, marginals, _ = toxicity.tagger(MODEL)(("idiot " + "of " * 200_000 + "idiot").encode())
    assert places == [0, 200_001] and all(0 < m < 1 for m in marginals)


def test_spans_are_code_point_offsets(spark):
    text = "é É idiot fools, ok\nidiot"
    rows = toxicity.score(spark.createDataFrame([(1, text, 0.5)], "doc_id int, text string, score double"), MODEL, 0.3).collect()
    assert [text[s.start : s.end] for s in rows[0].spans] == ["idiot fools,", "idiot"]


def test_awkward_rows_get_a_score_and_keep_their_columns(docs, none):
    scored = toxicity.score(docs, MODEL)
    assert scored.columns == [*docs.columns, "score", "spans"]
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    plain = {r.score for r in rows if not (r.text or "").strip()}
    assert len(plain) == 1 and toxicity.score(none, MODEL).count() == 0


def test_without_usable_labels_nothing_is_rejected(docs, labels):
    for given in (labels.limit(0), labels):
        model = toxicity.train(docs, given)
        assert all(r.score < 0.7 for r in toxicity.score(docs, model).collect())


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        words = prose(k, 60).split()
        if k % 4 == 0:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(60)] = rnd.choice(["grumble", "blorbish", "Blorbs,", "snarf", "snarfly"])
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), toxicity.Fit(rounds=80))
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id")))
    test = scored.filter("held").select("toxic", (F.col("score") >= 0.7).cast("int").alias("p")).collect()
    assert len(test) > 150
    assert sum(r.toxic == r.p for r in test) / len(test) > 0.97


def test_held_out_rows_and_their_labels_do_not_reach_the_model(spark):
    rows = [(k, "vile words here" if k % 2 else "calm words here", k % 2) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    held = docs.filter(toxicity.held_out(F.col("doc_id")))
    sampled = toxicity.sample(docs.select("doc_id", "text"), held.select("doc_id", "toxic"), toxicity.Fit())
    assert sampled.count() == 0 and held.count() > 10
