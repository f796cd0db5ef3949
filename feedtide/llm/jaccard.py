"""Similarity join of documents on the Jaccard similarity of their word shingles, by count vectors in an R-tree.

A document's shingles are hashed into GROUPS groups; its point has the number of shingles in each group. Two documents share at most the
sum of the coordinate-wise minima of their points, so an R-tree over points prunes pairs of nodes by the minima of their upper corners,
and pairs of documents by their points. Points of unrelated texts are far apart only in many dimensions, where one tree over everything
prunes little. Therefore the trees are built over documents that share a token of their prefixes (the 25 % of a set that any set with
similarity 0.75 must meet): no pair is lost, and a tree compares only documents with something in common.

A point has at least as many groups as the set has shingles, up to TREE_GROUPS groups, so that the minima come close to the overlap itself. Sets that may link differ by a third in size at most, so a set meets those of its own number of groups, and
those of half as many with its groups added up in twos.

Texts with equal sets are one class. First each class is compared with a class of like size that leads one of its lists, which joins groups
of copies into stars; while that finds links for a good share of the pairs it is done again with other leaders. Then the trees look for links between
classes that are still in different components. At first a tree gives only a spanning forest of its pairs, the likeliest first: where all of
these are links, the pairs left out lie within one component. Where some are not, the entries that were in any pair come into trees once more, and
these give all pairs between the components that are left. So a group of n near copies costs a few n comparisons, not n^2, and every link between components is found.

A tree also looks at where the shared token stands in the two prefixes: if it is the first one that the sets share, they share at most what
follows it in each. A pair that fails this has an earlier token in common, whose tree decides, or is no link. Entries that cannot pass
it even with the smallest set of their list are left out of the trees.

A pair that passes is bounded once more by finer points, whose number of groups has no limit, before any text is fetched for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import discard, documents, store, text_or_empty
from feedtide.llm.components import components
from feedtide.llm.shingles import few_at_once, mixed, shingle_set, word_hasher

GROUPS = 256  # of a point at least; a power of 2
TREE_GROUPS = 1024  # of a point in a tree at most
PER_GROUP = 1  # shingles in a group of a finer point, on average and at most
COUNTERS = 1 << 17  # of shingles by hash: shows which ones are frequent
FREQUENT = 8.0  # standard deviations above the mean counter
FAN = 16  # entries of a tree node
LIST_BLOCK = 2048  # longer lists are joined block by block
TREE_BYTES = 1 << 23  # of the points of a tree, about
CORNERS = 1 << 23  # coordinates that are compared at once
BUCKETS = 1 << 20  # of document ids, for picking texts
ROUNDS = 6  # of stars at most; the trees find whatever is left
WORTH = 10  # a further round needs links for one pair in so many


def class_of(shingles: np.ndarray) -> int:
    """A hash of the set: the sum of its members, which are hashes themselves."""
    with np.errstate(over="ignore"):
        return int(mixed(shingles.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def counts_of(shingles: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles fall in each of `groups` groups, a power of 2. Groups 2 i and 2 i + 1 are group i of half as many."""
    return np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine_groups(n: int) -> int:
    """Groups of the finer point of n shingles: a power of 2, GROUPS at least."""
    return max(GROUPS, 1 << (-(-n // PER_GROUP) - 1).bit_length())


def tree_groups(n: int) -> int:
    return min(fine_groups(n), TREE_GROUPS)


def point_of(shingles: np.ndarray, groups: int) -> bytes:
    """Counts in bytes, or in four bytes each if one of them needs more."""
    counts = counts_of(shingles, groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def fine_point(shingles: np.ndarray) -> bytes:
    return point_of(shingles, fine_groups(len(shingles)))


def fine_overlap(p: bytes, n: int, q: bytes, m: int) -> int:
    """Upper bound on the overlap of sets of n and m shingles by their finer points: the sum of minima in the coarser groups of the two."""
    a, b = (np.frombuffer(x, dtype="u1" if len(x) == fine_groups(k) else "<u4") for x, k in ((p, n), (q, m)))
    groups = min(len(a), len(b))
    return int(np.minimum(a.reshape(groups, -1).sum(axis=1), b.reshape(groups, -1).sum(axis=1)).sum())


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, class, n_shingles, point (null if it is the finer one), fine for each document, and bucket, hits: how many shingles of all documents fall on a counter."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counters = word_hasher(), np.zeros(COUNTERS, dtype=np.int64)

        def emit(ids: list, classes: list, sizes: list, points: list, fine: list, buckets: list, hits: list) -> pa.RecordBatch:
            arrays = [pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), pa.array(buckets, pa.int32()), pa.array(hits, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "class", "n_shingles", "point", "fine", "bucket", "hits"])

        for batch in few_at_once(batches):
            classes, sizes, points, fine, seen = [], [], [], [], [np.zeros(0, dtype=np.uint64)]
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(words(text))
                seen.append(shingles)
                classes.append(class_of(shingles) if len(shingles) else None)
                sizes.append(len(shingles))
                fine.append(fine_point(shingles))
                points.append(point_of(shingles, TREE_GROUPS) if fine_groups(len(shingles)) > TREE_GROUPS else None)
            counters += np.bincount((np.concatenate(seen) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            none = [None] * len(sizes)
            yield emit(batch.column(0).to_pylist(), classes, sizes, points, fine, none, none)
        some = np.flatnonzero(counters)
        none = [None] * len(some)
        yield emit(none, none, none, none, none, some.tolist(), counters[some].tolist())

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary"))
    return rows.mapInArrow(profile, "doc_id bigint, class bigint, n_shingles bigint, point binary, fine binary, bucket int, hits bigint")


def frequent_counters(profiled: DataFrame) -> np.ndarray:
    """Which counters stand out. Any set gives right results: it only orders tokens, frequent ones last."""
    hits = np.zeros(COUNTERS, dtype=np.int64)
    table = profiled.filter("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toArrow()  # at most COUNTERS rows
    hits[table["bucket"].to_numpy()] = table["hits"].to_numpy()
    mean = hits.mean()
    return hits > mean + FREQUENT * np.sqrt(mean) + FREQUENT


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles in the order (frequent, hash): sets with similarity 0.75 share one of them."""
    last = frequent[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    n = len(shingles)
    return np.concatenate([shingles[~last], shingles[last]])[: n - (3 * n + 3) // 4 + 1]


def postings(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """token, class, rest (shingles of the set from the token on): the prefixes. A task emits a class once, so exact copies cost nothing."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = word_hasher(), set()
        for batch in few_at_once(batches):
            tokens, classes, rests = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(words(text))
                if len(shingles) and (c := class_of(shingles)) not in done:
                    done.add(c)
                    tokens.append(prefix(shingles, frequent))
                    classes.append(np.full(len(tokens[-1]), c, dtype=np.int64))
                    rests.append(len(shingles) - np.arange(len(tokens[-1])))
            columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(rests))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "class", "rest"])

    return docs.select(text_or_empty().cast("binary")).mapInArrow(emit, "token bigint, class bigint, rest bigint")


def _enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an overlap of sets of sizes a and b may mean a similarity of 0.75: 100 o >= 75 (a + b - o)."""
    return 7 * overlap >= 3 * (a + b)


def tree_join(
    key: np.ndarray, side: np.ndarray, group: np.ndarray, size: np.ndarray, point: np.ndarray, rest: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal key, different group, sides that meet (0 with 1, 2 with 2) and sufficient bounds on their overlap: the sum of
    the minima of their points, and the smaller rest (without `rest`, a set may share all its shingles).

    The tree is packed bottom-up over rows sorted by key, size and point; a node has the range of its keys, its smallest size, its largest rest
    and the upper corner of its points. Both sides of the join go down the tree together, one level at a time.
    """
    rest = size if rest is None else rest
    order = np.lexsort((point[:, 0], size, key))
    levels = [(key[order], key[order], size[order].astype(np.int64), rest[order].astype(np.int64), point[order])]
    while len(levels[-1][0]) > 1:
        low, high, least, most, corner = levels[-1]
        cuts = np.arange(0, len(low), FAN)
        levels.append((low[cuts], high[np.minimum(cuts + FAN, len(low)) - 1], np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(corner, cuts, axis=0)))
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    child, at_once = np.arange(FAN), max(1, CORNERS // point.shape[1])
    for depth in range(len(levels) - 1, -1, -1):
        low, high, least, most, corner = levels[depth]
        kept_left, kept_right = [left[:0]], [right[:0]]
        for start in range(0, len(left), at_once):  # pairs of nodes are opened a few at a time
            i, j = left[start : start + at_once], right[start : start + at_once]
            if depth < len(levels) - 1:
                i, j = np.broadcast_arrays(i[:, None, None] * FAN + child[:, None], j[:, None, None] * FAN + child)
                i, j = i.ravel(), j.ravel()
            ok = (i < len(low)) & (j < len(low)) & (i <= j)
            i, j = i[ok], j[ok]
            ok = (low[i] <= high[j]) & (low[j] <= high[i]) & _enough(np.minimum(most[i], most[j]), least[i], least[j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), at_once):
                p, q = i[at : at + at_once], j[at : at + at_once]
                ok = _enough(np.minimum(corner[p], corner[q]).sum(axis=1, dtype=np.int64), least[p], least[q])
                kept_left.append(p[ok])
                kept_right.append(q[ok])
        left, right = np.concatenate(kept_left), np.concatenate(kept_right)
    left, right = order[left], order[right]
    meet = (group[left] != group[right]) & ((side[left] == 2) | (side[left] != side[right]))
    return left[meet], right[meet]


def unpacked(point: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(point, dtype="u1" if len(point) == groups else "<u4")


def spanning_forest(a: np.ndarray, b: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) that join what edges of a larger margin leave apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    chosen = []
    order = np.argsort(-margin, kind="stable")
    for at, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if (x := top(x)) != (y := top(y)):
            above[x] = y
            chosen.append(at)
    return np.array(chosen, dtype=np.int64)


def joined_by_size(
    key: np.ndarray, side: np.ndarray, group: np.ndarray, size: np.ndarray, points: list[bytes], rest: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    left, right, _ = with_margins(key, side, group, size, points, rest)
    return left, right


def with_margins(
    key: np.ndarray, side: np.ndarray, group: np.ndarray, size: np.ndarray, points: list[bytes], rest: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, and by how much their bound exceeds what a link needs, as a share of their sizes: `tree_join` over one tree for each number of groups. Sets with twice as many come into it with their groups added up in twos
    if they are small enough for a link with a set of the tree; two of those are not compared here."""
    rest = size if rest is None else rest
    groups = np.array([tree_groups(int(n)) for n in size], dtype=np.int64)
    narrow = np.array([len(p) for p in points], dtype=np.int64) == groups  # a byte a count
    left, right, margins = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for g in np.unique(groups).tolist():
        own, finer = np.flatnonzero(groups == g), np.flatnonzero((groups == 2 * g) & (3 * size <= 4 * PER_GROUP * g))
        rows = np.concatenate([own, finer])
        point = np.empty((len(rows), g), dtype=np.int32)
        if narrow[rows].all():
            point = point.astype(np.uint16)  # sums of two bytes
        for k, row in enumerate(rows.tolist()):
            counts = unpacked(points[row], int(groups[row]))
            point[k] = counts if k < len(own) else counts.reshape(g, 2).sum(axis=1)
        if point.dtype == np.uint16 and point.max(initial=0) < 256:
            point = point.astype(np.uint8)
        i, j = tree_join(key[rows], side[rows], group[rows], size[rows], point, rest[rows])
        ok = (i < len(own)) | (j < len(own))
        i, j = i[ok], j[ok]
        left.append(rows[i])
        right.append(rows[j])
        for at in range(0, len(i), step := max(1, CORNERS // g)):
            p, q = i[at : at + step], j[at : at + step]
            margins.append(np.minimum(point[p], point[q]).sum(axis=1, dtype=np.int64) / (size[rows[p]] + size[rows[q]]))
    return np.concatenate(left), np.concatenate(right), np.concatenate(margins)


def star_pairs(lists: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """a, b: each class with one leader of its lists, the one it shares most tokens with. The leaders of a list are one class for each
    range of sizes, another one each turn."""
    labelled = lists.withColumn("group", F.col("class")) if labels is None else _labelled(lists, labels)
    ranged = labelled.withColumn("range", F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(4 / 3))).cast("int"))
    leader = F.min(F.struct(F.xxhash64("class", F.lit(turn)), F.col("class").alias("leader"), F.col("group").alias("of"))).alias("first")
    leaders = ranged.groupBy("token", "range").agg(leader, F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    shared = ranged.join(leaders.select("token", "range", "first.leader", "first.of"), ["token", "range"]).filter("group != of")
    counted = shared.groupBy("class", "leader").agg(F.count("*").alias("n"))
    return counted.groupBy("class").agg(F.max_by("leader", F.struct("n", "leader")).alias("b")).select(F.col("class").alias("a"), "b")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, lists["class"] == labels["node"], "left").withColumn("group", F.coalesce("root", "class")).drop("node", "root")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a similarity of 0.75 or more: first by their finer points, then by their texts."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n, q, m = (batch.column(c).to_pylist() for c in ("fine_a", "n_a", "fine_b", "n_b"))
            most = np.fromiter(map(fine_overlap, p, n, q, m), dtype=np.int64, count=len(p))
            ok = _enough(most, np.array(n, dtype=np.int64), np.array(m, dtype=np.int64))
            yield batch.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(ok))

    near = store(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(bound, "a bigint, b bigint, rep_a bigint, rep_b bigint"),
        "jaccard-near",
    )
    # texts of the documents in question: a table of hash buckets, at most BUCKETS rows, keeps the others out of the shuffle
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    asked = near.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().cast("binary").alias("text"))
    few = rows.withColumn("bucket", bucket("rep")).join(F.broadcast(asked.select(bucket("rep").alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, text (compressed): each class once per task."""
        import zstandard

        words, done, squeeze = word_hasher(), set(), zstandard.ZstdCompressor(level=3).compress
        for batch in few_at_once(batches):
            classes, texts = [], []
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(words(text))
                if len(shingles) and (c := class_of(shingles)) not in done:
                    done.add(c)
                    classes.append(c)
                    texts.append(squeeze(text))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(texts, pa.binary())], ["class", "text"])

    texts = store(few.select("text").mapInArrow(own, "class bigint, text binary"), "jaccard-texts")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, expand = word_hasher(), zstandard.ZstdDecompressor().decompress
        for batch in few_at_once(batches):
            ok, last, shared = [], None, None
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if t != last:
                    last, shared = t, shingle_set(words(expand(t)))
                mine = shingle_set(words(expand(s)))
                common = len(np.intersect1d(mine, shared, assume_unique=True))
                ok.append(100 * common >= 75 * (len(mine) + len(shared) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = near.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    links = store(both.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a bigint, b bigint"), "jaccard-links")
    discard(near, texts)
    return links


def tree_entries(multi: DataFrame, classes: DataFrame) -> DataFrame:
    """token, n, class, rest, n_shingles: the entries of the trees, n to a token."""
    # what a set can share from this token on must do for the smallest set of the list
    smallest = multi.groupBy("token").agg(F.min("n_shingles").alias("smallest"))
    able = multi.join(smallest, "token").filter(7 * F.col("rest") >= 3 * (F.col("n_shingles") + F.greatest("smallest", F.ceil(F.col("n_shingles") * 3 / 4))))
    counted = able.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    return able.join(counted, "token").select("token", "n", "class", "rest")


def tree_pairs(entries: DataFrame, labels: DataFrame, classes: DataFrame, forest: bool = False) -> DataFrame:
    """a, b: pairs of classes in different components that share a token and whose points allow a link; as a `forest`, of each tree
    the pairs that join the same components as all its pairs would. And token, n, class, rest of the entries that are in any such pair, whether
    the forest has it or not."""
    labelled = store(_labelled(entries, labels), "jaccard-able")
    open_ = labelled.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    # a long list is joined block by block: an entry of block i goes to all pairs of blocks with i
    blocks = F.ceil(F.col("n") / LIST_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class"), blocks).cast("int")
    spread = labelled.join(open_.select("token"), "token").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumn("key", F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn(
        "side", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    )
    spread = store(spread.join(classes.select("class", "n_shingles", "point"), "class").select("token", "n", "key", "side", "class", "group", "n_shingles", "rest", "point"), "jaccard-entries")
    discard(labelled)
    trees = 1 + (spread.agg(F.sum(F.octet_length("point"))).first()[0] or 0) // TREE_BYTES

    def join(table: pa.Table) -> pa.Table:
        names = ("key", "side", "group", "n_shingles", "rest", "class")
        key, side, group, size, rest, cls = (table[c].to_numpy() for c in names)
        i, j, margin = with_margins(key, side, group, size, table["point"].to_pylist(), rest)
        met = table.select(["token", "n", "class", "rest"]).take(pa.array(np.union1d(i, j)))
        if forest:
            few = spanning_forest(group[i], group[j], margin)
            i, j = i[few], j[few]
        found = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1), axis=0)
        pairs = pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})
        return pa.concat_tables([pairs, met], promote_options="default").select(["a", "b", "token", "n", "class", "rest"])

    grouped = spread.withColumn("tree", F.pmod(F.xxhash64("key"), F.lit(trees))).groupBy("tree")
    found = store(grouped.applyInArrow(join, "a bigint, b bigint, token bigint, n bigint, class bigint, rest bigint"), "jaccard-met")
    discard(spread)
    return found


def tree_candidates(found: DataFrame) -> DataFrame:
    """The pairs that `tree_pairs` found, each once."""
    return store(found.filter("a is not null").select("a", "b").distinct(), "jaccard-pairs")


def entries_met(found: DataFrame) -> DataFrame:
    """The entries that `tree_pairs` found in pairs. Once some components are joined, what is left to compare is among them."""
    return found.filter("a is null").select("token", "n", "class", "rest").distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links are 100 * intersection >= 75 * union of the sets of 5-word shingles.

    A text of fewer than five words is one shingle; null, empty and blank texts have none and link with nothing: their component is
    themselves. Documents with a null doc_id take part, but are not the smallest id of a component unless it has no other. Repeated
    rows are kept. Other columns are not looked at. An empty table gives an empty result.
    """
    profiled = store(profiles(docs), "jaccard-profiles")
    rows = profiled.filter("n_shingles is not null").select("doc_id", "class", "n_shingles", F.coalesce("point", "fine").alias("point"), "fine")
    classes = store(
        rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("point").alias("point"), F.min("fine").alias("fine")),
        "jaccard-classes",
    )
    dealt = postings(docs, frequent_counters(profiled)).repartition("token")  # both uses below read this one exchange
    # `rest` is used here, too, so that neither use leaves out a column and makes an exchange of its own
    shared = dealt.groupBy("token").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.min("rest").alias("least")).filter("first < last and least > 0")
    lists = dealt.join(shared.select("token"), "token").distinct().join(classes.select("class", "n_shingles"), "class", "left")  # an inner join would put a filter below one of the two uses of `dealt`
    multi = store(lists.select("token", "class", "n_shingles", "rest"), "jaccard-lists")

    labels, links = None, []
    for turn in range(ROUNDS):
        pairs = store(star_pairs(multi, labels, turn), "jaccard-stars")
        links.append(verify(pairs, classes, docs))
        tried, linked = pairs.count(), links[-1].count()
        discard(pairs)
        if linked or labels is None:
            labels = components(reduce(DataFrame.unionByName, links), "jaccard-stars")
        if linked * WORTH < tried or not tried:
            break
    entries, found = tree_entries(multi, classes), []
    for forest in (True, False):
        found.append(tree_pairs(entries, labels, classes, forest))
        pairs, entries = tree_candidates(found[-1]), entries_met(found[-1])
        links.append(verify(pairs, classes, docs))
        tried, linked = pairs.count(), links[-1].count()
        discard(pairs)
        if linked:
            labels = components(reduce(DataFrame.unionByName, links), "jaccard-all")
        if linked == tried:
            break  # the pairs that the forest leaves out join nothing more
    discard(multi, *found)

    named = classes.join(labels, classes["class"] == labels["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "rep")
    named = named.select("class", "root").join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("class", "component_id")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is that of their component; rows that repeat doc_id and text are one. Rows without
    words stay, and so do rows with a null doc_id that nothing else with an id is linked to."""
    kept = link(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))
