"""Near-duplicate passages by the first tokens of stretches.

The tokens of a text are its 5-word shingles. Of two stretches of WINDOW tokens that share SHARED, the COMMON smallest shared tokens are among the FIRST
smallest of both. So only places are dealt out that hold such a token of one of their stretches (three in ten), and a stretch can be repeated only
where COMMON of its places are shared with another text. The other parts of a text, most of a corpus, go no further.

What is left is cut into pieces, whose tokens are dealt out in full. A token's list has the texts that hold it, smallest class first. Each text is
compared with the first LEADERS texts of all its lists at once: the places it shares with one of them show the passages that this one repeats.

Stretches of which enough tokens occur in smaller texts, though no passage covers them yet, are compared with every smaller text that has one of their
rarest tokens: a text that repeats the stretch lacks WINDOW - SHARED of its tokens at most, so it has one of any WINDOW - SHARED + 1. A sketch of the tokens
around this one shows which texts lack more of them, such as those that only have a common line. The lists are read in parts that
grow, and a stretch that is covered meanwhile leaves them. So a group of n copies costs a few n comparisons.

Rows go between tasks by the thousand, as columns packed in a binary value for each hash bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import discard, documents, store, text_or_empty
from feedtide.llm.shingles import WIDTH, distinct, few_at_once, mixed, runs, word_hasher

WINDOW = 46  # shingles: 50 words
SHARED = 40  # of WINDOW shingles, so that two stretches of equal length have a similarity of 0.75: 40 / (2 * 46 - 40)
COMMON = 4  # first tokens that two near stretches share
FIRST = WINDOW - SHARED + COMMON  # tokens of a stretch that are looked at first
LEADERS = 3  # texts of a list that all others are compared with
RANKS = 64  # texts of a list that open stretches are compared with in the first round, and
FURTHER = 64  # times as many in the next
TOGETHER = 8  # places: open stretches that begin in one such block ask for texts together
SKETCH = 4  # 64-bit words of a sketch of tokens
SHARES = (1, 1, 2, 4)  # of a token that a stretch has 1, 2, 4 or 8 times at least, and so lacks as often
PIECE = 512  # places of a piece, which has the tokens of all stretches that begin there
PAIRS = 1 << 17  # pairs that are made at once
FUNCTIONS = 6
BUCKETS = 1 << 20
ASKED = 1 << 24  # hash buckets of the tokens that are asked for
COUNTERS = 1 << 17  # of tokens by hash
STRETCHES = 4096  # that are looked at together


def stretch_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Per row, the minimum of every stretch of `width` columns, from running minima of blocks."""
    rows, n = hashes.shape
    blocks = np.full((rows, -(-n // width) * width), np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:, :n] = hashes
    blocks = blocks.reshape(rows, -1, width)
    ahead = np.minimum.accumulate(blocks, axis=2).reshape(rows, -1)
    back = np.minimum.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    return np.minimum(back[:, : n - width + 1], ahead[:, width - 1 : n])


def compact_windows(tokens: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value, start, end (inclusive) of all compact windows of at least `width` tokens; the function's number is the value's low 3 bits."""
    if len(tokens) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        seeds = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64))
        hashes = mixed(tokens[None, :] ^ seeds[:, None]) & ~np.uint64(7) | np.arange(FUNCTIONS, dtype=np.uint64)[:, None]
    minima = stretch_minima(hashes, width)
    changes = np.ones(minima.shape, dtype=bool)
    changes[:, 1:] = minima[:, 1:] != minima[:, :-1]
    first = np.flatnonzero(changes)
    last = np.r_[first[1:], minima.size] - 1
    return minima.ravel()[first], first % minima.shape[1], last % minima.shape[1] + width - 1


def text_class(words: np.ndarray) -> int:
    """A hash of the sequence of words, for texts with at least one."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return int(mixed(mixed(words + mixed(place)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def first_places(order: np.ndarray, width: int = WINDOW, few: int = FIRST) -> np.ndarray:
    """Whether a place holds one of the `few` smallest different numbers of a stretch of `width` that it lies in."""
    if len(order) < width:
        return np.zeros(len(order), dtype=bool)
    stretches = np.lib.stride_tricks.sliding_window_view(order, width)
    limit = np.empty(len(stretches), dtype=np.uint64)
    for at in range(0, len(stretches), STRETCHES):
        limit[at : at + STRETCHES] = np.partition(stretches[at : at + STRETCHES], few - 1, axis=1)[:, few - 1]
    twice = with_repeats(order, width)
    for at in range(0, len(twice), STRETCHES):
        some = twice[at : at + STRETCHES]
        ordered = np.sort(stretches[some], axis=1)
        nth = np.concatenate([np.ones((len(some), 1), dtype=np.int64), 1 + np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)], axis=1)
        limit[some] = ordered[np.arange(len(some)), np.minimum((nth < few).sum(axis=1), width - 1)]
    around = np.zeros(width - 1, dtype=np.uint64)
    return order <= ~stretch_minima(~np.concatenate([around, limit, around])[None, :], width)[0]


def with_repeats(order: np.ndarray, width: int) -> np.ndarray:
    """The stretches of `width` in which a number occurs twice."""
    if len(distinct(order)) == len(order):
        return np.zeros(0, dtype=np.int64)
    at = np.argsort(order, kind="stable")
    near = (order[at[1:]] == order[at[:-1]]) & (at[1:] - at[:-1] < width)
    last = len(order) - width
    change = np.zeros(len(order) + 1, dtype=np.int64)
    begin, end = np.maximum(at[1:][near] - width + 1, 0), np.minimum(at[:-1][near], last) + 1
    np.add.at(change, begin[begin < end], 1)
    np.add.at(change, end[begin < end], -1)
    return np.flatnonzero(np.cumsum(change)[: last + 1])


def first_tokens(order: np.ndarray, width: int = WINDOW, least: int = SHARED) -> np.ndarray:
    """The tokens, as their order, that are among the first width - least + 1 of a stretch of `width`."""
    return distinct(order[first_places(order, width, width - least + 1)])


def full_stretches(places: np.ndarray, size: int, width: int = WINDOW, least: int = SHARED) -> np.ndarray:
    """Where the stretches of `width` begin that have `least` of these places (sorted, different), in a text of `size` places."""
    if len(places) < least:
        return np.zeros(0, dtype=np.int64)
    low = max(int(places[0]) - width + 1, 0)
    hit = np.zeros(min(int(places[-1]) + width, size) - low, dtype=np.int64)
    hit[places - low] = 1
    total = np.concatenate([[0], np.cumsum(hit)])
    return low + np.flatnonzero(total[width:] - total[:-width] >= least)


def passages_of(places: np.ndarray, size: int, width: int = WINDOW, least: int = SHARED) -> list[tuple[int, int]]:
    """[start, end) of the stretches of `width` that have `least` of these places; overlapping stretches are one, and begin and end with one of the places."""
    good = full_stretches(places, size, width, least)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > width)
    found = []
    for first, last in zip(good[np.r_[0, breaks + 1]], good[np.r_[breaks, len(good) - 1]], strict=True):
        inside = places[np.searchsorted(places, first) : np.searchsorted(places, last + width)]
        found.append((int(inside[0]), int(inside[-1] + 1)))
    return found


def still_open(begins: np.ndarray, start: int, end: int) -> np.ndarray:
    """Whether the stretches that begin there share less than SHARED tokens with the passage."""
    return (begins + WINDOW - SHARED < start) | (begins + SHARED > end)


def chosen(begins: np.ndarray, offers: list[tuple[int, list[tuple[int, int]]]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """leader, start, end of the passages that are listed, and the stretches that none of them covers. Offered are the passages of leaders, the
    likeliest leader first; one that covers no further stretch is left out."""
    listed = []
    for leader, passages in offers:
        if not len(begins):
            break
        for start, end in passages:
            kept = still_open(begins, start, end)
            if not kept.all():
                listed.append((leader, start, end))
                begins = begins[kept]
    return listed, begins


def sketch_bits(tokens: np.ndarray) -> np.ndarray:
    """A bit of SKETCH words for each token; a set has those of its tokens."""
    bit = (tokens >> np.uint64(30)).astype(np.int64) % (64 * SKETCH)
    words = np.zeros((len(tokens), SKETCH), dtype=np.uint64)
    words[np.arange(len(tokens)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    return words


def sketches_around(tokens: np.ndarray, places: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The sketch of all stretches of `width` that have the place."""
    around = np.zeros((width - 1, SKETCH), dtype=np.uint64)
    bits = np.concatenate([around, sketch_bits(tokens), around])
    return np.bitwise_or.reduce(np.lib.stride_tricks.sliding_window_view(bits, 2 * width - 1, axis=0)[places], axis=2)


def asks_of(begins: np.ndarray, places: np.ndarray, tokens: np.ndarray, rare: np.ndarray) -> list[tuple[int, int, bytes]]:
    """token, first stretch, slack and sketches: what is asked for stretches that are open. In each of them, of its WINDOW - SHARED + 1 rarest
    places, those that other texts have, which are `places`: a text that repeats the stretch has one of these tokens. The stretches that begin in a
    block of TOGETHER places ask together: a text that repeats one of them lacks `slack` places at most of those that all of them have. The sketches are of the tokens that these have 1, 2, 4 and 8 times."""
    few, out = WINDOW - SHARED + 1, []
    block = begins // TOGETHER
    for at in np.flatnonzero(starts_of(block)).tolist():
        some = begins[at : at + TOGETHER][block[at : at + TOGETHER] == block[at]]
        asked = set()
        for begin in some.tolist():
            i, j = np.searchsorted(places, begin), np.searchsorted(places, begin + WINDOW)
            least = few - (WINDOW - (j - i))  # places that no other text has come first
            asked.update((i + np.argpartition(rare[i:j], least - 1)[:least]).tolist())
        first, last = int(some[0]), int(some[-1])
        i, j = np.searchsorted(places, last), np.searchsorted(places, first + WINDOW)
        slack = WINDOW - SHARED - (first + WINDOW - last - (j - i))
        values, times = np.unique(tokens[i:j], return_counts=True)
        bits, least = sketch_bits(values), np.cumsum(SHARES)
        sketch = bytes([slack]) + b"".join(np.bitwise_or.reduce(bits[times >= n], axis=0).tobytes() for n in least.tolist())
        out += [(token, first, sketch) for token in {int(tokens[k].view(np.int64)) for k in asked}]
    return out


def joined(passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping passages as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(passages):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def ranges(numbers: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(numbers) > 1)
    return list(zip(numbers[np.r_[0, breaks + 1]].tolist(), numbers[np.r_[breaks, len(numbers) - 1]].tolist(), strict=True)) if len(numbers) else []


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(numbers.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets


def packed(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that occur, and for each the values of its rows, column by column."""
    order = np.argsort(bucket, kind="stable")
    columns = tuple(c[order] for c in columns)
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else order
    ends = np.r_[cuts[1:], len(order)] if len(order) else order
    return bucket[order][cuts], [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]


def unpacked(values: list[bytes], *types: str) -> list[np.ndarray]:
    """The columns of all packed values."""
    widths = [np.dtype(t).itemsize for t in types]
    counts = [len(v) // sum(widths) for v in values]
    out, before = [], 0
    for kind, width in zip(types, widths, strict=True):
        parts = [np.frombuffer(v, kind, n, before * n) for v, n in zip(values, counts, strict=True)]
        out.append(np.concatenate(parts) if parts else np.zeros(0, kind))
        before += width
    return out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def table_of(types: dict[str, pa.DataType], rows: int, **columns: object) -> pa.RecordBatch:
    """Columns that are not given are null."""
    arrays = [pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))




def matching_stretches(tokens: np.ndarray, others: np.ndarray, width: int = WINDOW, least: int = SHARED) -> list[tuple[int, int]]:
    """[start, end) of the tokens in stretches of `width` of which `least` occur among `others`; overlapping stretches are one, and
    begin and end with a token that occurs."""
    if len(tokens) < width:
        return []
    known = distinct(others)
    hit = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
    total = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(total[width:] - total[:-width] >= least)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > width)
    found = []
    for first, last in zip(good[np.r_[0, breaks + 1]], good[np.r_[breaks, len(good) - 1]], strict=True):
        inside = np.flatnonzero(hit[first : last + width])
        found.append((int(first + inside[0]), int(first + inside[-1] + 1)))
    return found


def token_order(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A number per token, equal for equal tokens: frequent ones last, otherwise by hash."""
    last = frequent[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
    with np.errstate(over="ignore"):
        return mixed(tokens) >> np.uint64(1) | last.astype(np.uint64) << np.uint64(63)


def with_key_leader(dealt: DataFrame) -> DataFrame:
    """The rows of keys with an open window and a second text, each with the key's smallest text that has an open window."""
    open_class = F.when(F.col("open"), F.col("class"))
    # the count keeps Spark from dropping a distinct() below one of the two uses of `dealt`, so that both read one exchange
    leaders = dealt.groupBy("key").agg(F.min(open_class).alias("leader"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(open_class).alias("n")).filter("n > 0 and lo < hi")
    return dealt.join(leaders.select("key", "leader"), "key")


def texts_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, text of the documents whose id is a `rep` of `asked`, and a few others: a table of hash buckets of ids, at most BUCKETS rows, keeps
    the rest out of the shuffle."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().cast("binary").alias("text"))
    return rows.withColumn("bucket", bucket("rep")).join(F.broadcast(asked.select(bucket("rep").alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")


def buckets_of(spark: SparkSession) -> int:
    """Hash buckets for packed rows: two to a task, so that tasks are alike."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


ZONES = {"doc_id": pa.int64(), "class": pa.int64(), "n_words": pa.int64(), "start": pa.int64(), "end": pa.int64(), "bucket": pa.int32(), "packed": pa.binary()}
ZONES_SQL = "doc_id bigint, class bigint, n_words bigint, start bigint, end bigint, bucket int, packed binary"


def classes_and_zones(docs: DataFrame) -> DataFrame:
    """doc_id, class, n_words of the documents that have words. And class, start, end: the parts of texts that may be repeated, those in which COMMON
    of the first places of a stretch are shared with other texts."""
    buckets = buckets_of(docs.sparkSession)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = word_hasher(), set()
        for batch in few_at_once(batches):
            ids, classes, counts = [], [], []
            tokens, owners, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                hashed = words(text)
                if not len(hashed):
                    continue
                c = text_class(hashed)
                ids.append(doc_id)
                classes.append(c)
                counts.append(len(hashed))
                if len(hashed) >= WINDOW + WIDTH - 1 and c not in done:  # a task deals out a class once, so exact copies cost nothing
                    done.add(c)
                    mine = runs(hashed)
                    at = np.flatnonzero(first_places(mine))
                    tokens.append(mine[at])
                    owners.append(np.full(len(at), c, dtype=np.int64))
                    places.append(at.astype(np.uint32))
            spread = bucket_of(np.array(classes, dtype=np.int64), buckets)
            yield table_of(ZONES, len(ids), doc_id=ids, n_words=counts, bucket=spread, **{"class": classes})
            token = np.concatenate(tokens)
            # half of a hash tells the tokens of a bucket apart; two that it doesn't are told apart by the pieces
            bucket, values = packed(bucket_of(token, buckets), token.astype("<u4"), np.concatenate(owners), np.concatenate(places))
            yield table_of(ZONES, len(bucket), bucket=bucket, packed=values)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for batch in batches:
            yield batch.filter(batch.column("class").is_valid())
            for bucket, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed")), strict=True):
                if value is not None:
                    by_bucket.setdefault(bucket, []).append(value)
        kept = [(np.zeros(0, "<i8"), np.zeros(0, "<u4"))]
        for values in by_bucket.values():
            token, owner, place = unpacked(values, "<u4", "<i8", "<u4")
            order = np.argsort(token, kind="stable")
            token, owner, place = token[order], owner[order], place[order]
            first = np.flatnonzero(starts_of(token))
            several = np.repeat(np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first), np.diff(np.r_[first, len(token)]))
            kept.append((owner[several], place[several]))
        owner, place = (np.concatenate(c) for c in zip(*kept, strict=True))
        bucket, out = packed(bucket_of(owner, buckets), owner, place)
        yield table_of(ZONES, len(bucket), bucket=bucket, packed=out)

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = []
        for batch in batches:
            yield batch.filter(batch.column("class").is_valid())
            values += batch.column("packed").drop_null().to_pylist()
        owner, place = unpacked(values, "<i8", "<u4")
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order].astype(np.int64)
        once = starts_of(owner, place)  # other tasks may have met the class, too
        owner, place = owner[once], place[once]
        at = np.arange(max(len(place) - COMMON + 1, 0))
        at = at[(owner[at] == owner[at + COMMON - 1]) & (place[at + COMMON - 1] - place[at] < WINDOW)]
        owner, start, end = owner[at], np.maximum(place[at + COMMON - 1] - WINDOW + 1, 0), place[at] + WINDOW
        new = starts_of(owner)
        new[1:] |= start[1:] > end[:-1]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(owner)] - 1
        yield table_of(ZONES, len(first), start=start[first], end=end[last] if len(first) else end, **{"class": owner[first]})

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary"))
    dealt = rows.mapInArrow(profile, ZONES_SQL).repartition("bucket").mapInArrow(shared, ZONES_SQL)
    return dealt.repartition("bucket").mapInArrow(zones, ZONES_SQL).drop("bucket", "packed")


def pieces_of(zones: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """class, size (places of the text), start, own, tokens: the zones in pieces. A piece has the tokens from `start` on, the first `own` of them for
    itself; the others, which make up its last stretches, are those of the next piece, too."""
    asked = store(zones.groupBy("class").agg(F.collect_list(F.struct("start", "end")).alias("zones")).join(reps.select("class", "rep"), "class"), "substring-asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_hasher()
        for batch in few_at_once(batches):
            rows = []
            for text, cls, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "class", "zones")), strict=True):
                hashed = words(text)
                if not len(hashed) or text_class(hashed) != cls:
                    continue  # another document may have the same id
                tokens = runs(hashed)
                for zone in wanted:
                    end = min(zone["end"], len(tokens))
                    for start in range(zone["start"], end, PIECE):
                        rows.append((cls, len(tokens), start, min(PIECE, end - start), tokens[start : min(start + PIECE + WINDOW - 1, end)].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["class", "size", "start", "own", "tokens"])

    texts = asked.join(texts_of(asked, docs), "rep").select("text", "class", "zones")
    pieces = store(texts.mapInArrow(cut, "class bigint, size bigint, start bigint, own bigint, tokens binary"), "substring-pieces")
    discard(asked)
    return pieces


FOUND = {"kind": pa.int32(), "class": pa.int64(), "other": pa.int64(), "start": pa.int64(), "end": pa.int64(), "sketch": pa.binary()}
FOUND_SQL = "kind int, class bigint, other bigint, start bigint, end bigint, sketch binary"
PASSAGE, OPEN, ASK, OFFER = range(4)  # other: the leader, -, a token, the leader; start, end: the passage, first and last stretch, the first stretch that asks, the passage


def found_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((*row, None)[: len(FOUND)] for row in rows), strict=True)) or [()] * len(FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)], list(FOUND))


def first_passages(pieces: DataFrame) -> DataFrame:
    """PASSAGE: what texts repeat of the first LEADERS texts in the lists of their tokens. OPEN: the stretches that no such passage covers though SHARED
    of their tokens are in smaller texts. ASK: their rarest tokens."""
    buckets = buckets_of(pieces.sparkSession)
    leader_types = ["<i8"] * LEADERS
    kinds = {"bucket": pa.int32(), "packed": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches):
            tokens = [np.frombuffer(t, "<u8", n) for t, n in zip(batch.column("tokens").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            if not tokens:
                continue
            counts = np.array([len(t) for t in tokens])
            token = np.concatenate(tokens)
            place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(batch.column("start").to_numpy(), counts)
            owner, size = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("class", "size"))
            bucket, values = packed(bucket_of(token, buckets), token, owner, place.astype("<u4"), size.astype("<u4"))
            yield table_of(kinds, len(bucket), bucket=bucket, packed=values)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed")), strict=True):
                by_bucket.setdefault(bucket, []).append(value)
        kept = [[] for _ in range(5 + LEADERS)]
        for values in by_bucket.values():
            token, owner, place, size = unpacked(values, "<u8", "<i8", "<u4", "<u4")
            order = np.lexsort((place, owner, token))
            token, owner, place, size = token[order], owner[order], place[order], size[order]
            once = starts_of(token, owner, place)
            token, owner, place, size = token[once], owner[once], place[once], size[once]
            new, member = starts_of(token), starts_of(token, owner)
            heads = owner[member]  # the texts of each list, one after the other
            at = np.cumsum(member) - 1
            begin = at[new][np.cumsum(new) - 1]  # where the list of a row begins in `heads`
            texts = np.diff(np.r_[at[new], len(heads)])[np.cumsum(new) - 1]
            later = np.flatnonzero(at > begin)
            rank, begin = (at - begin)[later], begin[later]
            leaders = [np.where(rank > n, heads[np.minimum(begin + n, len(heads) - 1)], 0) for n in range(LEADERS)]
            columns = (owner[later], place[later], size[later], token[later], np.minimum(texts[later], 65535).astype("<u2"), *leaders)
            for parts, column in zip(kept, columns, strict=True):
                parts.append(column)
        if by_bucket:
            owner, *others = (np.concatenate(parts) for parts in kept)
            bucket, out = packed(bucket_of(owner, buckets), owner, *others)
            yield table_of(kinds, len(bucket), bucket=bucket, packed=out)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed")), strict=True):
                by_bucket.setdefault(bucket, []).append(value)
        for values in by_bucket.values():
            owner, place, size, token, texts, *leaders = unpacked(values, "<i8", "<u4", "<u4", "<u8", "<u2", *leader_types)
            order = np.lexsort((place, owner))
            owner, place, size, token, texts = owner[order], place[order].astype(np.int64), size[order], token[order], texts[order]
            leading = np.stack([x[order] for x in leaders], axis=1)
            enough = np.zeros(len(owner), dtype=bool)
            enough[: -(SHARED - 1)] = (owner[SHARED - 1 :] == owner[: -(SHARED - 1)]) & (place[SHARED - 1 :] - place[: -(SHARED - 1)] < WINDOW)
            cuts = np.flatnonzero(starts_of(owner))
            ends = np.r_[cuts[1:], len(owner)]
            able = np.logical_or.reduceat(enough, cuts) if len(cuts) else cuts
            rows = []
            for i, j in zip(cuts[able].tolist(), ends[able].tolist(), strict=True):
                cls, n, mine, by = int(owner[i]), int(size[i]), place[i:j], leading[i:j]
                begins = full_stretches(mine, n)
                if not len(begins):
                    continue
                names, counts = np.unique(by, return_counts=True)
                likely = [(int(names[k]), int(counts[k])) for k in np.argsort(-counts, kind="stable") if names[k] and counts[k] >= SHARED]
                offers = ((leader, passages_of(mine[(by == leader).any(axis=1)], n)) for leader, _ in likely)
                listed, begins = chosen(begins, offers)
                rows += [(PASSAGE, cls, leader, start, end) for leader, start, end in listed]
                if len(begins):
                    rows += [(OPEN, cls, 0, first, last) for first, last in ranges(begins)]
                    rare = texts[i:j].astype(np.uint64) << np.uint64(48) | token[i:j] >> np.uint64(16)
                    rows += [(ASK, cls, token_, begin, 0, sketch) for token_, begin, sketch in asks_of(begins, mine, token[i:j], rare)]
            yield found_rows(rows)

    dealt = pieces.mapInArrow(deal, "bucket int, packed binary").repartition("bucket").mapInArrow(lists, "bucket int, packed binary")
    return dealt.repartition("bucket").mapInArrow(passages, FOUND_SQL)


def asked_pairs(pieces: DataFrame, asks: DataFrame, low: int, high: int) -> DataFrame:
    """class, start, other, lead_start: open stretches that ask for a token, each with the pieces of smaller texts that have it and whose sketch allows it that they
    repeat the stretch: of the texts from `low` up to `high` in the token's list. And the asks in whose lists there are more texts."""
    spark = pieces.sparkSession
    buckets = buckets_of(spark)
    asked = np.zeros(ASKED, dtype=bool)
    asked[asks.select(F.col("other").bitwiseAND(ASKED - 1).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()] = True  # at most ASKED rows
    asked = np.packbits(asked)
    kinds = {"bucket": pa.int32(), "ask": pa.bool_(), "packed": pa.binary()}
    names = "bucket int, ask boolean, packed binary"
    out_kinds = FOUND | {"lead_start": pa.int64()}
    words = ["<u8"] * SKETCH

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(asked).astype(bool)
        for batch in few_at_once(batches):
            tokens = [np.frombuffer(x, "<u8") for x in batch.column("tokens").to_pylist()]
            if not tokens:
                continue
            places = [np.flatnonzero(wanted[(t & np.uint64(ASKED - 1)).astype(np.int64)]) for t in tokens]
            counts = [len(p) for p in places]
            token = np.concatenate([t[p] for t, p in zip(tokens, places, strict=True)])
            rows = np.repeat(np.arange(len(tokens)), counts)
            sketch = np.concatenate([sketches_around(t, p) if len(p) else np.zeros((0, SKETCH), dtype=np.uint64) for t, p in zip(tokens, places, strict=True)])
            owner, start = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("class", "start"))
            order = np.lexsort((token, rows))  # a token that a piece has several times counts once, with all that is around it
            first = np.flatnonzero(starts_of(rows[order], token[order]))
            sketch = np.bitwise_or.reduceat(sketch[order], first, axis=0) if len(first) else sketch
            token, owner, start = token[order][first], owner[order][first], start[order][first]
            bucket, values = packed(bucket_of(token, buckets), token, owner, start.astype("<u4"), *sketch.T)
            yield table_of(kinds, len(bucket), bucket=bucket, ask=[False] * len(bucket), packed=values)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, owner, begin = (batch.column(c).to_numpy() for c in ("other", "class", "start"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=[("slack", "u1"), ("words", "<u8", (len(SHARES) * SKETCH,))])
            bucket, values = packed(bucket_of(token, buckets), token, owner, begin.astype("<u4"), sketch["slack"], *sketch["words"].T)
            yield table_of(kinds, len(bucket), bucket=bucket, ask=[True] * len(bucket), packed=values)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for bucket, is_ask, value in zip(*(batch.column(c).to_pylist() for c in kinds), strict=True):
                by_bucket.setdefault(bucket, ([], []))[is_ask].append(value)
        for there, wanting in by_bucket.values():
            if not wanting:
                continue
            token, owner, start, *sketch = unpacked(there, "<u8", "<i8", "<u4", *words)
            order = np.lexsort((start, owner, token))
            order = order[starts_of(*(c[order] for c in (token, owner, start)))]
            token, owner, start, sketch = token[order], owner[order], start[order].astype(np.int64), np.stack([w[order] for w in sketch], axis=1)
            new, member = starts_of(token), starts_of(token, owner)
            heads = np.r_[np.flatnonzero(member), len(token)]  # the first rows of texts in lists
            at = np.cumsum(member) - 1
            listed = at[new]  # the number of the first text of each list
            a_token, a_owner, a_begin, slack, *a_words = unpacked(wanting, "<i8", "<i8", "<u4", "u1", *words * len(SHARES))
            a_begin, a_sketch = a_begin.astype(np.int64), np.stack(a_words, axis=1)
            first = listed[np.searchsorted(token[new], a_token.view(np.uint64))]
            # the row of the piece in which the stretch begins
            row = np.empty(len(token), dtype=[("t", "<u8"), ("c", "<i8"), ("s", "<i8")])
            row["t"], row["c"], row["s"] = token, owner, start
            key = np.empty(len(a_token), dtype=row.dtype)
            key["t"], key["c"], key["s"] = a_token.view(np.uint64), a_owner, 0
            rank = at[np.searchsorted(row, key)] - first
            begin = heads[first + np.minimum(low, rank)]
            counts = heads[first + np.minimum(high, rank)] - begin
            total = np.cumsum(counts)
            for part in np.split(np.arange(len(key)), np.searchsorted(total, np.arange(PAIRS, int(total[-1]), PAIRS), "right")):
                for offset in range(0, int(counts[part].max(initial=0)), PAIRS):  # more than one turn only for a single long list
                    n = np.clip(counts[part] - offset, 0, PAIRS)
                    who = np.repeat(part, n)
                    whom = np.repeat(begin[part] + offset - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    lacks = np.zeros(len(who), dtype=np.int64)
                    for k, share in enumerate(SHARES):
                        for w in range(SKETCH):
                            lacks += share * np.bitwise_count(a_sketch[who, k * SKETCH + w] & ~sketch[whom, w]).astype(np.int64)
                        ok = lacks <= slack[who]
                        who, whom, lacks = who[ok], whom[ok], lacks[ok]
                    found = np.unique(np.stack([a_owner[who], a_begin[who], owner[whom], start[whom]], axis=1), axis=0)
                    yield table_of(out_kinds, len(found), kind=np.full(len(found), OFFER), start=found[:, 1], other=found[:, 2], lead_start=found[:, 3], **{"class": found[:, 0]})
            more = np.flatnonzero(rank > high)
            texts = [bytes([s]) + w.tobytes() for s, w in zip(slack[more].tolist(), a_sketch[more], strict=True)]
            rest = {"other": a_token[more], "start": a_begin[more], "class": a_owner[more], "sketch": texts}
            yield table_of(out_kinds, len(more), kind=np.full(len(more), ASK), **rest)

    both = pieces.mapInArrow(index, names).unionByName(asks.select("other", "class", "start", "sketch").mapInArrow(ask, names))
    return both.repartition("bucket").mapInArrow(pairs, FOUND_SQL + ", lead_start bigint")


def offered(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """OFFER: the passages that the piece in which a stretch begins repeats of another."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches):
            rows = []
            for cls, start, leader, tokens, others in zip(*(batch.column(n).to_pylist() for n in ("class", "start", "other", "tokens", "others")), strict=True):
                a, b = np.frombuffer(tokens, dtype=np.uint64), np.frombuffer(others, dtype=np.uint64)
                rows += [(OFFER, cls, leader, start + x, start + y) for x, y in matching_stretches(a, b)]
            yield found_rows(rows)

    # a block of stretches may begin in one piece and end in the next
    homes = pieces.select("class", "own", F.col("start").alias("piece"))
    begins = pairs.select("class", "start").distinct().join(homes, "class").filter((F.col("piece") < F.col("start") + TOGETHER) & (F.col("start") < F.col("piece") + F.col("own")))
    placed = pairs.join(begins, ["class", "start"]).select("class", F.col("piece").alias("start"), "other", "lead_start").distinct()
    mine = pieces.select("class", "start", "tokens")
    theirs = pieces.select(F.col("class").alias("other"), F.col("start").alias("lead_start"), F.col("tokens").alias("others"))
    both = placed.join(theirs, ["other", "lead_start"]).join(mine, ["class", "start"])
    return both.select("class", "start", "other", "tokens", "others").mapInArrow(compare, FOUND_SQL)


def settled(rows: DataFrame) -> DataFrame:
    """From OFFER, OPEN and ASK, class by class: PASSAGE, the stretches that are still OPEN, and what is asked for them."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class: dict[int, tuple[list, ...]] = {}
        for batch in batches:
            for kind, cls, *row in zip(*(batch.column(n).to_pylist() for n in FOUND), strict=True):
                by_class.setdefault(cls, ([], [], [], []))[kind].append(row)
        for cls, (_, opened, asks, offers) in by_class.items():
            begins = np.unique(np.concatenate([np.arange(first, last + 1) for _, first, last, _ in opened])) if opened else np.zeros(0, dtype=np.int64)
            by_leader: dict[int, list[tuple[int, int]]] = {}
            for leader, start, end in {tuple(row[:3]) for row in offers}:
                by_leader.setdefault(leader, []).append((start, end))
            merged = [(leader, joined(p)) for leader, p in by_leader.items()]
            merged.sort(key=lambda x: (-sum(end - start for start, end in x[1]), x[0]))
            listed, begins = chosen(begins, merged)
            rows = [(PASSAGE, cls, leader, start, end) for leader, start, end in listed]
            if len(begins):
                rows += [(OPEN, cls, 0, first, last) for first, last in ranges(begins)]
                blocks = set((begins // TOGETHER).tolist())
                rows += [(ASK, cls, *ask) for ask in asks if ask[1] // TOGETHER in blocks]
            yield found_rows(rows)

    return rows.repartition("class").mapInArrow(settle, FOUND_SQL)


def all_passages(pieces: DataFrame) -> DataFrame:
    """class, leader, start, end: the listed passages in tokens of `class`, end exclusive."""
    state = store(first_passages(pieces), "substring-first")
    found, low, high = [state], 0, RANKS
    while not state.filter(F.col("kind") == ASK).isEmpty():
        pairs = store(asked_pairs(pieces, state.filter(F.col("kind") == ASK), low, high), "substring-pairs")
        offers = offered(pairs.filter(F.col("kind") == OFFER).select("class", "start", "other", "lead_start").distinct(), pieces)
        rows = offers.unionByName(state.filter(F.col("kind") == OPEN)).unionByName(pairs.filter(F.col("kind") == ASK).drop("lead_start"))
        state = store(settled(rows), "substring-next")
        found.append(state)
        discard(pairs)
        low, high = high, high * FURTHER
    passages = [f.filter(F.col("kind") == PASSAGE).select("class", F.col("other").alias("leader"), "start", "end") for f in found]
    return reduce(DataFrame.unionByName, passages)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), source_doc_id, text_class: passages of at least 50 words that repeat in another document.

    In every 50 words of a passage at least 40 of the 46 five-word shingles (a similarity of 0.75) occur in the passage of the source. Texts of
    equal words are one class: all its documents but the one with the smallest id repeat it as a whole; that one stands for
    the class in all other rows. Of two texts the one with the smaller class hash is the source. A stretch that a listed passage
    covers need not be listed again for each further text that holds it; any other is compared with every text it may repeat. Shorter, null, empty
    and blank texts have no passage. A null doc_id stands for its class only if it has no other. Repeated rows are copies of each other.
    Other columns are not looked at. An empty table gives an empty result.
    """
    profiled = store(classes_and_zones(docs), "substring-classes")
    known = profiled.filter("n_words is not null").select("doc_id", "class", "n_words")
    reps = store(known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n_words").alias("n_words")), "substring-reps")
    pieces = pieces_of(profiled.filter("n_words is null").select("class", "start", "end"), reps, docs)
    found = all_passages(pieces)
    discard(pieces)
    name = lambda c, out: reps.select(F.col("class").alias(c), F.col("rep").alias(out))
    near = (
        found.join(name("class", "doc_id"), "class")
        .join(name("leader", "source_doc_id"), "leader")
        .select("doc_id", F.col("start").alias("start_word"), (F.col("end") + (WIDTH - 1)).alias("end_word"), "source_doc_id", F.col("class").alias("text_class"))
        .distinct()
    )
    longer = reps.filter((F.col("copies") > 1) & (F.col("n_words") >= WINDOW + WIDTH - 1)).select("class", "rep")
    copies = known.join(longer, "class").filter(~F.col("doc_id").eqNullSafe(F.col("rep")))
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.col("rep").alias("source_doc_id"), F.col("class").alias("text_class"))
    return near.unionByName(whole)


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans [start, end), each with the white space after it."""
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    kept, at = [], 0
    for start, end in sorted(spans):
        if starts[start] > at:
            kept.append(text[at : starts[start]])
        at = max(at, starts[end])
    return b"".join([*kept, text[at:]])


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """`docs` with the passages cut out and n_chars counted anew. A document of which no word is left goes; one that
    had none before stays as it is. Columns keep their names and types."""
    spans = passages.groupBy(F.col("doc_id").alias("_id"), F.col("text_class").alias("_class")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    names, schema = docs.columns, docs.schema
    # a document is changed if both its id and its words are those of the passage
    listed = spans.groupBy("_id").agg(F.collect_list(F.struct("_class", "_spans")).alias("_found"))
    joined = docs.join(listed, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_hasher()
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [True] * len(texts)
            for i, found in enumerate(batch.column("_found").to_pylist()):
                for entry in found or ():
                    utf8 = texts[i].encode() if texts[i] else b""
                    if utf8.strip() and text_class(words(utf8)) == entry["_class"]:
                        rest = without_words(utf8, [(s["start_word"], s["end_word"]) for s in entry["_spans"]])
                        texts[i], keep[i] = rest.decode(), bool(rest.split())
                        break
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
