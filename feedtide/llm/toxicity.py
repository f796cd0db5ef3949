"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two tags per token, toxic or not. A token's features are the prefixes of its lower-cased core; features are chosen and weights
fitted on a bounded sample of labelled documents. Tokens that carry no chosen feature all have the same potentials, so the
forward and backward passes step over a run of them with one matrix power: exact, and cheap for clean text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import bounded_sample, documents, store, text_or_empty

PREFIXES = (4, 5, 6)
SEGMENT = 64  # tokens of a training sequence
CACHED = 400_000
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass
class Fit:
    """Bounds and settings of the fit."""

    documents_per_class: int = 6000  # the labelled documents with the smallest hashes of each class
    features: int = 4000
    least_documents: int = 3  # toxic documents that hold a feature
    least_share: float = 0.5  # of the documents that hold it, weighed by class, are toxic
    least_z: float = 4.0
    segments: int = 6000
    rounds: int = 200
    decay: float = 1e-3


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    to_toxic: float = 0.0  # transition clean -> toxic
    to_clean: float = 0.0
    stay: float = 0.0  # toxic -> toxic
    document: tuple[float, ...] = (-2.0, 0.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features_of(token: str) -> list[str]:
    core = token.lower().strip(".,;:!?\"'()[]{}<>*#%&$-_")
    return [core[:n] for n in PREFIXES if len(core) >= n]


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """text, toxic of at most `documents_per_class` labelled documents per class, none of them held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    taken = [bounded_sample(one.filter(F.col("toxic") == c), ["doc_id"], fit.documents_per_class) for c in (0, 1)]
    ids = F.broadcast(taken[0].unionByName(taken[1]))  # bounded by the two limits
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(ids, "doc_id").select("text", "toxic")


def choose_features(sampled: DataFrame, clean: int, toxic: int, fit: Fit) -> list[str]:
    """Features whose documents are toxic more often than chance allows, strongest first."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label].update({f for t in set(text.split()) for f in features_of(t)})
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([counts[c][n] for n in names], pa.int64()) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    counted = sampled.select("text", F.col("toxic").cast("int")).mapInArrow(distinct, "feature string, clean bigint, toxic bigint")
    p, q = F.col("toxic") / F.lit(float(max(toxic, 1))), F.col("clean") / F.lit(float(max(clean, 1)))
    both = (F.col("toxic") + F.col("clean")) / F.lit(float(max(clean + toxic, 1)))
    z = (p - q) / F.sqrt(both * (1 - both) * F.lit(1 / max(toxic, 1) + 1 / max(clean, 1)) + 1e-12)
    summed = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = summed.filter(F.col("toxic") >= fit.least_documents).withColumn("z", z).filter((F.col("z") >= fit.least_z) & (p * toxic / (p * toxic + q * clean) >= fit.least_share))
    return [r["feature"] for r in kept.orderBy(F.col("z").desc(), "feature").limit(fit.features).collect()]


def segments(sampled: DataFrame, names: list[str], fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (0: none), tags and mask of bounded training sequences. A token of a toxic document is tagged toxic if it has a
    chosen feature, all others are clean."""
    number = {f: i + 1 for i, f in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = [[number[f] for f in features_of(t) if f in number] for t in text.split()]
                for at in range(0, len(tokens), SEGMENT):
                    part = tokens[at : at + SEGMENT]
                    flat = [i for t in part for i in (t + [0] * len(PREFIXES))[: len(PREFIXES)]]
                    rows.append((flat, label, any(part)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_())], ["flat", "label", "told"])

    rows = sampled.select("text", F.col("toxic").cast("int")).mapInArrow(cut, "flat array<int>, label int, told boolean")
    order = [F.xxhash64("flat", "label"), F.col("label")]
    taken = [r for told in (True, False) for r in rows.filter(F.col("told") == told).orderBy(*order).limit(fit.segments // 2).collect()]
    x = np.zeros((len(taken), SEGMENT, len(PREFIXES)), dtype=np.int64)
    mask = np.zeros((len(taken), SEGMENT), dtype=bool)
    for i, row in enumerate(taken):
        n = len(row["flat"]) // len(PREFIXES)
        x[i, :n] = np.reshape(row["flat"], (n, len(PREFIXES)))
        mask[i, :n] = True
    y = x.any(axis=2) & np.array([bool(r["label"]) for r in taken], dtype=bool).reshape(-1, 1)
    return x, y, mask


def fit_field(x: np.ndarray, y: np.ndarray, mask: np.ndarray, names: list[str], fit: Fit) -> Model:
    """Gradient ascent on the likelihood of the tags; expectations by forward-backward over all sequences at once."""
    if not len(x) or not names:
        return Model()
    weights = np.zeros(len(names) + 1)
    other = np.array([-3.0, 0.0, 0.0, 0.0])  # bias, clean->toxic, toxic->clean, toxic->toxic
    length = x.shape[1]
    state = {"m": np.zeros(len(weights) + 4), "v": np.zeros(len(weights) + 4)}
    pair = mask[:, 1:]
    seen = np.array([(y & mask).sum(), (~y[:, :-1] & y[:, 1:] & pair).sum(), (y[:, :-1] & ~y[:, 1:] & pair).sum(), (y[:, :-1] & y[:, 1:] & pair).sum()], dtype=float)
    for step in range(1, fit.rounds + 1):
        weights[0] = 0
        emit = np.exp(np.clip(weights[x].sum(axis=2) + other[0], -30, 30))
        a = np.exp(np.array([[0, other[1]], [other[2], other[3]]]))
        forward, backward = np.ones((length, len(x), 2)), np.ones((length, len(x), 2))
        forward[0, :, 1] = emit[:, 0]
        forward[0] /= forward[0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            new = forward[t - 1] @ a
            new[:, 1] *= emit[:, t]
            forward[t] = np.where(mask[:, t : t + 1], new / new.sum(axis=1, keepdims=True), forward[t - 1])
        for t in range(length - 2, -1, -1):
            back = backward[t + 1].copy()
            back[:, 1] *= emit[:, t + 1]
            back = back @ a.T
            backward[t] = np.where(mask[:, t + 1 : t + 2], back / back.sum(axis=1, keepdims=True), backward[t + 1])
        both = forward * backward
        marginal = (both[:, :, 1] / both.sum(axis=2)).T * mask
        ahead = backward[1:].copy()
        ahead[:, :, 1] *= emit.T[1:]
        joint = forward[:-1, :, :, None] * a * ahead[:, :, None, :]
        joint = (joint / joint.sum(axis=(2, 3), keepdims=True)) * pair.T[:, :, None, None]
        expected = np.array([marginal.sum(), joint[:, :, 0, 1].sum(), joint[:, :, 1, 0].sum(), joint[:, :, 1, 1].sum()])
        error = (y * mask - marginal)[:, :, None] * np.ones(x.shape[2])
        slope = np.bincount(x.ravel(), weights=error.ravel(), minlength=len(weights)) / len(x) - fit.decay * weights
        slope = np.r_[slope, (seen - expected) / len(x) - fit.decay * other]
        state["m"] = 0.9 * state["m"] + 0.1 * slope
        state["v"] = 0.99 * state["v"] + 0.01 * slope**2
        change = 0.15 * (state["m"] / (1 - 0.9**step)) / (np.sqrt(state["v"] / (1 - 0.99**step)) + 1e-8)
        weights += change[:-4]
        other += change[-4:]
    return Model({n: float(w) for n, w in zip(names, weights[1:], strict=True)}, *(float(v) for v in other))


def tagger(model: Model):
    """text (UTF-8) -> (places, marginals) of the tokens that carry a feature, by exact forward-backward."""
    cache: dict[bytes, float] = {}
    a = np.exp(np.array([[0, model.to_toxic], [model.to_clean, model.stay]]))
    neutral = a * np.array([1.0, math.exp(model.bias)])
    # powers of the 2 x 2 matrix, up to a factor: N^k ~ u1 v1 + r^k u2 v2
    values, right = np.linalg.eig(neutral)
    top = int(np.argmax(values.real))
    left = np.linalg.inv(right)
    main = np.outer(right[:, top], left[top]).real
    rest = np.outer(right[:, 1 - top], left[1 - top]).real
    ratio = float(values[1 - top].real / values[top].real)
    (m00, m01), (m10, m11) = main.tolist()
    (r00, r01), (r10, r11) = rest.tolist()
    (a00, a01), (a10, a11) = a.tolist()
    neutral_odds = math.exp(model.bias)

    def odds(chunk: bytes) -> float:
        """exp of the token's score, or 0 if it carries no feature."""
        told = [model.weights[f] for f in features_of(chunk.decode()) if f in model.weights]
        value = math.exp(max(-30.0, min(30.0, model.bias + sum(told)))) if told else 0.0
        if len(cache) >= CACHED:
            cache.clear()
        if len(chunk) <= 64:
            cache[chunk] = value
        return value

    def run(x: float, y: float, k: int, transposed: bool) -> tuple[float, float]:
        """The vector times N^k (or N^k times it), scaled to sum 1."""
        f = ratio**k
        p00, p01, p10, p11 = m00 + f * r00, m01 + f * r01, m10 + f * r10, m11 + f * r11
        x, y = (p00 * x + p01 * y, p10 * x + p11 * y) if transposed else (x * p00 + y * p10, x * p01 + y * p11)
        s = x + y
        return x / s, y / s

    def tag(text: bytes) -> tuple[list[int], list[float], int]:
        chunks = text.split()
        found = list(map(cache.get, chunks))
        if None in found:
            found = [odds(c) if v is None else v for c, v in zip(chunks, found, strict=True)]
        places = [i for i, v in enumerate(found) if v]
        if not places:
            return places, [], len(chunks)
        forward, x, y, before = [], 1.0, neutral_odds, 0
        for place in places:
            if place == 0:
                x, y = 1.0, found[0]
            else:
                # from token `before` over the neutral tokens up to the one before `place`, then into `place`
                if place - before > 1:
                    x, y = run(x, y, place - before - 1, False)
                x, y = x * a00 + y * a10, (x * a01 + y * a11) * found[place]
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
            before = place
        marginals, x, y, after = [], 1.0, 1.0, len(chunks) - 1
        for place, (fx, fy) in zip(reversed(places), reversed(forward), strict=True):
            if after == len(chunks) - 1 and not marginals:
                if after > place:
                    x, y = run(x, y, after - place, True)
            else:
                y *= found[after]
                x, y = a00 * x + a01 * y, a10 * x + a11 * y
                if after - place > 1:
                    x, y = run(x, y, after - place - 1, True)
            s = x + y
            x, y = x / s, y / s
            marginals.append(fy * y / (fx * x + fy * y))
            after = place
        return places, marginals[::-1], len(chunks)

    return tag


def document_features(marginals: list[float]) -> tuple[float, float]:
    return math.log1p(sum(marginals)), max(marginals, default=0.0)


def calibrate(sampled: DataFrame, model: Model, clean_weight: float, toxic_weight: float) -> tuple[float, ...]:
    """Weights of a logistic document score on the marginals, by Newton steps with a ridge; classes weigh as in the labels."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(model)
        for batch in batches:
            rows = [document_features(tag(t)[1]) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["total", "most", "toxic"])

    rows = sampled.select(F.col("text").cast("binary"), F.col("toxic").cast("int")).mapInArrow(measure, "total double, most double, toxic int")
    grouped = rows.groupBy(F.round("total", 2).alias("total"), F.round("most", 2).alias("most"), "toxic").count().collect()
    if not grouped:
        return Model().document
    x = np.array([[1.0, r["total"], r["most"]] for r in grouped])
    y = np.array([float(r["toxic"]) for r in grouped])
    n = np.array([r["count"] * (toxic_weight if r["toxic"] else clean_weight) for r in grouped])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.1 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> Model:
    """A model from labelled rows that are not held out; without usable rows one that scores every text alike, below 0.5."""
    fit = fit or Fit()
    sampled = store(sample(docs, labels, fit), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    known = {r["toxic"]: r["count"] for r in labels.filter(~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    names = choose_features(sampled, clean, toxic, fit)
    model = fit_field(*segments(sampled, names, fit), names, fit)
    model.document = calibrate(sampled, model, known.get(0, 0) / max(clean, 1), known.get(1, 0) / max(toxic, 1))
    return model


def score(docs: DataFrame, model: Model, span_from: float = 0.5, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """The rows of `docs` with `score` and `spans`: code-point offsets [start, end) of tokens whose toxic marginal is at least `span_from`,
    neighbours joined. The two columns have the names `names`; columns of `docs` that are called so are replaced.

    Null, empty and blank texts have the score of a text without toxic words and no span. Repeated rows get equal scores.
    """

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, (b0, b1, b2) = tagger(model), model.document
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                places, marginals, _ = tag(text)
                total, most = document_features(marginals)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * total + b2 * most)))))
                spans.append(offsets(text, [i for i, m in zip(places, marginals, strict=True) if m >= span_from]))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array(spans, SPANS)], [*batch.schema.names[:-1], *names])

    SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("*", text_or_empty().cast("binary").alias("_utf8")).mapInArrow(tagged, f"{schema}, `{names[0]}` double, `{names[1]}` array<struct<start:bigint,end:bigint>>")


def offsets(text: bytes, tokens: list[int]) -> list[dict[str, int]]:
    if not tokens:
        return []
    wanted, spans, last = set(tokens), [], -2
    for i, match in enumerate(TOKEN.finditer(text)):
        if i in wanted:
            start = len(text[: match.start()].decode())
            end = start + len(match[0].decode())
            if i == last + 1:
                spans[-1]["end"] = end
            else:
                spans.append({"start": start, "end": end})
            last = i
    return spans


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )
