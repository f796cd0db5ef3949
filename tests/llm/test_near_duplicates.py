"""Jaccard join, components and substring dedup against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose

from feedtide.llm import jaccard, shingles, substrings
from feedtide.llm.components import components


def shingle_sets(rows):
    out = []
    for text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    return out


def brute_components(rows):
    sets = shingle_sets([t for _, t in rows])
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=repr)


def test_links_of_awkward_rows(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == brute_components(rows)


def test_links_equal_brute_force_and_shortcuts_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(100 + family, rnd.randint(12, 80)).split()
        for copy in range(rnd.randint(1, 9)):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
            rows.append((family * 100 + copy, " ".join(words) + " a line that very many of the texts share with each other"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute_components(rows)
    assert found(docs) == expected
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 5)  # long lists go block by block
    monkeypatch.setattr(jaccard, "FREQUENT", 1e9)  # no token counts as frequent
    monkeypatch.setattr(jaccard, "TREE_BYTES", 40 * jaccard.GROUPS)
    assert found(docs) == expected


def test_tree_join_finds_every_pair_its_bound_allows():
    rng = np.random.default_rng(3)
    n = 300
    key, side, group = rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 40, n)
    point = rng.integers(0, 6, (n, jaccard.GROUPS)).astype(np.int64)
    point[100:200] = point[:100] + rng.integers(0, 2, (100, jaccard.GROUPS))
    size = point.sum(axis=1)
    i, j = jaccard.tree_join(key, side, group, size, point)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    expected = {
        (a, b)
        for a, b in itertools.combinations(range(n), 2)
        if key[a] == key[b] and group[a] != group[b] and (side[a] == side[b] == 2 or (side[a] != side[b]))
        and 7 * np.minimum(point[a], point[b]).sum() >= 3 * (size[a] + size[b])
    }
    assert {p for p in expected if not (2 in (side[p[0]], side[p[1]]) and side[p[0]] != side[p[1]])} <= got
    assert got <= expected


def test_empty_table(none):
    assert jaccard.link(none).count() == 0 and substrings.repeated_passages(none).count() == 0
    assert jaccard.one_per_component(none).columns == none.columns


def test_one_document_per_component(docs):
    kept = sorted((r.doc_id for r in jaccard.one_per_component(docs).collect()), key=repr)
    assert kept == sorted([1, 4, 5, 6, 7, 8, 9, 11, 12, None, 13], key=repr)


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1040)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("n,width", [(46, 46), (47, 46), (200, 46), (333, 50)])
def test_compact_windows_cover_every_stretch_once(n, width):
    tokens = np.random.default_rng(n).integers(0, 40 if n == 333 else 1 << 60, n).astype(np.uint64)
    value, start, end = substrings.compact_windows(tokens, width)
    number = (value & np.uint64(7)).astype(int)
    for f in range(substrings.FUNCTIONS):
        mine = [(s, e, v) for s, e, v, k in zip(start, end, value, number, strict=True) if k == f]
        for at in range(n - width + 1):
            inside = [v for s, e, v in mine if s <= at and at + width - 1 <= e]
            assert inside, "a stretch lies in a window"
        for (_, _, v), (_, _, w) in itertools.pairwise(mine):
            assert v != w


def test_passages_of_awkward_rows(docs):
    rows = substrings.repeated_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.source_doc_id)) for r in rows}
    assert frozenset((1, 2)) in pairs and frozenset((4, 5)) in pairs
    assert any(3 in p and p & {1, 2} for p in pairs)
    ids = {i for p in pairs for i in p}
    assert ids <= {1, 2, 3, 4, 5, 12}
    for r in rows:
        if {r.doc_id, r.source_doc_id} == {4, 5}:
            assert 66 <= r.end_word - r.start_word <= 74


def test_every_repeated_stretch_is_found_in_all_texts_but_one(spark):
    rnd = random.Random(9)
    passages = [prose(500 + k, rnd.randint(55, 90)) for k in range(6)]
    rows = [(k, prose(k, 60) + " " + rnd.choice(passages) + " " + prose(1000 + k, 40)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flagged = {r.doc_id for r in substrings.repeated_passages(docs).collect()}
    for p in passages:
        assert len([k for k, t in rows if p in t and k not in flagged]) <= 1


def test_removal_keeps_the_rest_and_one_copy(spark, docs):
    before = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    after = substrings.remove_passages(docs, substrings.repeated_passages(docs))
    assert after.schema == docs.schema
    rows = [r for r in after.collect() if r.doc_id is not None]
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    for k in (6, 7, 8, 9, 10, 11, 13):
        assert texts[k] == before[k]
    assert len({1, 2} & set(texts)) <= 1  # exact copies: one stays, unless a near copy stands for both
    assert {1, 2, 3} & set(texts)
    whole = [k for k in (4, 5) if texts[k] == before[k]]
    assert len(whole) == 1 and len(texts[9 - whole[0]].split()) in range(86, 95)


def test_words_are_split_and_lowered_as_stated():
    hashes = shingles.word_hasher()
    assert (hashes("Ab\x0bÉ x\r\ncd".encode()) == hashes("aB É x CD".encode())).all()
    assert len(hashes("Ab\x0bÉ x\r\ncd".encode())) == 3
    assert hashes("É".encode()) != hashes("é".encode())


def test_finer_points_bound_the_overlap():
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    base = draw(3000)
    crowded = np.arange(1000, dtype=np.uint64)  # all in one group: counts beyond a byte
    sets = [base, base[:2400], np.union1d(base[:2600], draw(300)), draw(3000), draw(40), base[:60], crowded, crowded[:800], base[:0]]
    for a, b in itertools.product(sets, sets):
        most = jaccard.fine_overlap(jaccard.fine_point(a), len(a), jaccard.fine_point(b), len(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    unlike = jaccard.fine_overlap(jaccard.fine_point(base), len(base), jaccard.fine_point(sets[3]), len(sets[3]))
    assert 7 * unlike < 3 * (len(base) + len(sets[3]))  # and tells unlike texts of any length apart


def test_points_of_different_numbers_of_groups_meet():
    """Sets around the sizes at which the number of groups doubles: no similar pair is lost."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (200, 250, 256, 257, 300, 340, 512, 513, 600, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n * 2).astype(np.uint64) * np.uint64(2))[:n]
        for share in (0.0, 0.05, 0.12, 0.3):
            own = np.concatenate([base[int(share * n) :], rng.integers(0, 1 << 63, int(share * n * rng.random())).astype(np.uint64)])
            sets.append(np.unique(own))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    points = [jaccard.point_of(s, jaccard.tree_groups(len(s))) for s in sets]
    same = np.zeros(len(sets), dtype=np.int64)
    i, j = jaccard.joined_by_size(same, same + 2, np.arange(len(sets)), size, points)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert (a, b) in got or 100 * common < 75 * (size[a] + size[b] - common)
    assert len(got) < len(sets) * 4  # other families are not candidates


def test_many_near_copies_need_few_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    base, rows = prose(77, 60).split(), []
    for copy in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"y{rnd.randrange(1000)}"
        rows.append((copy, " ".join(words)))
    tried = []
    original = jaccard.tree_candidates
    monkeypatch.setattr(jaccard, "tree_candidates", lambda *args: tried.append(original(*args)) or tried[-1])
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_components(rows)
    assert tried[0].count() < 10 * len(rows)


def test_rest_bound_keeps_every_link_in_the_list_of_the_first_shared_token():
    """Prefix entries of random families: each similar pair leaves the trees, and a pair leaves fewer of them than tokens it shares."""
    rng = np.random.default_rng(21)
    sets = []
    for n in (8, 60, 90, 250, 400):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for share in (0.0, 0.04, 0.08, 0.15, 0.24):
            own = np.concatenate([base[rng.random(len(base)) >= share], rng.integers(0, 1 << 63, int(share * n * rng.random())).astype(np.uint64)])
            sets.append(np.unique(own))
    frequent = rng.random(jaccard.COUNTERS) < 0.3
    entries = [(t, k, len(s) - at) for k, s in enumerate(sets) for at, t in enumerate(jaccard.prefix(s, frequent).tolist())]
    key = np.array([t for t, _, _ in entries], dtype=np.uint64).view(np.int64)
    row = np.array([k for _, k, _ in entries])
    rest = np.array([r for _, _, r in entries])
    size = np.array([len(sets[k]) for k in row], dtype=np.int64)
    points = [jaccard.point_of(sets[k], jaccard.tree_groups(len(sets[k]))) for k in row]
    side = np.full(len(row), 2)
    bounded = jaccard.joined_by_size(key, side, row, size, points, rest)
    loose = jaccard.joined_by_size(key, side, row, size, points)
    got = {(min(row[a], row[b]), max(row[a], row[b])) for a, b in zip(*bounded, strict=True)}
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert (a, b) in got or 100 * common < 75 * (len(sets[a]) + len(sets[b]) - common)
    assert len(bounded[0]) < 0.7 * len(loose[0])


def test_forest_joins_what_all_edges_join():
    rng = np.random.default_rng(5)
    a, b, margin = rng.integers(0, 60, 300), rng.integers(0, 60, 300) + 1000 * rng.integers(0, 2, 300), rng.random(300)
    few = jaccard.spanning_forest(a, b, margin)

    def sets(edges):
        root = {}
        top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
        for x, y in edges:
            root[top(x)] = top(y)
        return {frozenset(n for n in root if top(n) == t) for t in {top(n) for n in root}}

    edges = list(zip(a.tolist(), b.tolist(), strict=True))
    whole, chosen = sets(e for e in edges if e[0] != e[1]), sets(edges[k] for k in few)
    assert whole - {s for s in whole if len(s) == 1} == chosen
    assert len(few) == sum(len(s) - 1 for s in chosen)
    assert len(jaccard.spanning_forest(a[:0], b[:0], margin[:0])) == 0


def test_copies_with_one_change_each_need_few_pairs(spark, monkeypatch):
    """Two copies link only if their changes are close, so that no leader has links to most of its group."""
    base, rows = prose(78, 60).split(), []
    for copy in range(240):
        words = list(base)
        words[copy % 60] = f"z{copy}"
        rows.append((copy, " ".join(words)))
    tried = []
    original = jaccard.tree_candidates
    monkeypatch.setattr(jaccard, "tree_candidates", lambda *args: tried.append(original(*args)) or tried[-1])
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_components(rows)
    counts = [t.count() for t in tried]
    assert sum(counts) < 4 * len(rows), counts


def test_passages_are_found_behind_many_smaller_texts_of_their_lists(spark):
    """Other texts hold either half of a passage, so that its lists begin with them: only two texts hold all of it."""
    rows, expected = [], []
    for k in range(8):
        passage = prose(2000 + k, 52).split()
        at = len(rows)
        for n in range(30):
            half = passage[:28] if n % 2 else passage[24:]
            own = prose(3000 + 100 * k + n, 60).split()
            rows.append((len(rows), " ".join(own[:30] + half + own[30:])))
        for n in range(2):
            own = prose(9000 + 10 * k + n, 60).split()
            rows.append((len(rows), " ".join(own[:30] + passage + own[30:])))
        expected.append(frozenset((at + 30, at + 31)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {frozenset((r.doc_id, r.source_doc_id)): r.end_word - r.start_word for r in substrings.repeated_passages(docs).collect()}
    assert set(found) == set(expected)
    assert all(51 <= n <= 53 for n in found.values())


@pytest.mark.parametrize("n,width", [(46, 46), (91, 46), (5000, 46)])
def test_near_stretches_share_one_of_their_first_tokens(n, width):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 1 << 62, n).astype(np.uint64)
    for share in (0.0, 0.5):
        order = substrings.token_order(tokens, rng.random(substrings.COUNTERS) < share)
        for at in range(0, n - width + 1, 97):
            near = order[at : at + width].copy()
            near[rng.choice(width, width - substrings.SHARED, replace=False)] = rng.integers(0, 1 << 62, width - substrings.SHARED)
            assert len(np.intersect1d(substrings.first_tokens(order), substrings.first_tokens(near)))


def test_hashing_words_keeps_nothing_of_them():
    hashes = shingles.word_hasher()
    hashes(b"first")
    tracemalloc.start()
    for at in range(0, 300_000, 1000):
        hashes(" ".join(f"word{n}" for n in range(at, at + 1000)).encode())
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 2_000_000


def test_workers_take_few_texts_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], ["n"])
    parts = list(shingles.few_at_once(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= shingles.AT_ONCE
    assert [n for p in parts for n in p.column(0).to_pylist()] == [*range(5000), 0, 1, 2]


def test_distinct_numbers():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 500):
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 64))
        assert (shingles.distinct(x) == np.unique(x)).all()


def test_second_trees_have_only_entries_that_were_in_pairs(spark, monkeypatch):
    """Pairs that just fail: a few pass the bounds and are no links, so the trees are made again, for these."""
    rows = []
    for n in range(200):
        words = prose(6000 + n, 60).split()
        rows.append((2 * n, " ".join(words)))
        words[30], words[34] = "changed", "again"
        rows.append((2 * n + 1, " ".join(words)))
    came = []
    original = jaccard.tree_pairs
    monkeypatch.setattr(jaccard, "tree_pairs", lambda entries, *args: came.append({r["class"] for r in entries.select("class").collect()}) or original(entries, *args))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_components(rows)
    assert len(came) == 2 and 0 < 2 * len(came[1]) < len(came[0])


def test_keys_of_one_text_are_left_out(spark):
    """Only keys that two texts have, one of them with an open window, go on to the rounds of the rest."""
    row = "key bigint, value bigint, class bigint, span bigint, open boolean"
    rows = [(1, 8, 5, 0, True), (2, 8, 5, 0, True), (2, 8, 6, 0, False), (2, 8, 4, 0, False), (3, 8, 5, 0, False), (3, 8, 6, 0, False), (4, 8, 7, 0, True), (4, 8, 7, 9, True)]
    marked = substrings.with_key_leader(spark.createDataFrame(rows, row)).collect()
    assert sorted((r.key, r["class"], r.leader) for r in marked) == [(2, 4, 5), (2, 5, 5), (2, 6, 5)]


def near_rows(seed):
    """Families of texts: passages in other surroundings, words changed, halves of passages, common lines, words that repeat."""
    rnd = random.Random(seed)
    line, texts = prose(7777, 22), []
    for family in range(10):
        passage = prose(8000 + 10 * seed + family, rnd.randint(52, 130)).split()
        for _ in range(rnd.randint(2, 9)):
            words = list(passage)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(6)}"
            at = rnd.randint(0, len(words) // 2)
            own = [prose(rnd.randrange(10**6), rnd.randint(0, 60)), prose(rnd.randrange(10**6), rnd.randint(5, 60))]
            parts = [own[0], " ".join(words[at:] if rnd.random() < 0.3 else words), rnd.choice([line, "", "so it is " * rnd.randint(0, 30)]), own[1]]
            rnd.shuffle(parts)
            texts.append(" ".join(parts))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,leaders,ranks", [(1, 3, 64), (2, 1, 1), (3, 1, 2)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, leaders, ranks):
    """Every stretch that a smaller text repeats is covered, and whatever is listed is repeated."""
    for name, value in (("LEADERS", leaders), ("RANKS", ranks), ("FURTHER", 2), ("PIECE", 60)):
        monkeypatch.setattr(substrings, name, value)
    rows, hashes = near_rows(seed), shingles.word_hasher()
    words = {k: hashes(t.encode()) for k, t in rows}
    tokens, classes = {k: shingles.runs(w) for k, w in words.items()}, {k: substrings.text_class(w) for k, w in words.items()}
    listed = {}
    for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        start, end = r.start_word, r.end_word - 4
        listed.setdefault(r.doc_id, []).append((start, end))
        assert classes[r.source_doc_id] < classes[r.doc_id]
        assert sum(t in set(tokens[r.source_doc_id].tolist()) for t in tokens[r.doc_id][start:end].tolist()) >= 40
    assert listed
    stretches = lambda t: [t[k : k + 46].tolist() for k in range(len(t) - 45)]
    for a, b in itertools.permutations(tokens, 2):
        if classes[a] < classes[b] or len(np.intersect1d(tokens[a], tokens[b])) < 2:
            continue
        theirs = [set(v) for v in stretches(tokens[b])]
        for k, mine in enumerate(stretches(tokens[a])):
            if any(min(e, k + 46) - max(s, k) >= 40 for s, e in listed.get(a, [])):
                continue
            assert not any(sum(t in v for t in mine) >= 40 and sum(t in set(mine) for t in v) >= 40 for v in theirs), (a, b, k)


def test_a_covered_stretch_is_listed_once(spark):
    """A text of a large group lists each stretch once, not again for each other text of the group."""
    base, rows = prose(79, 300).split(), []
    for copy in range(60):
        words = list(base)
        for at in (copy * 5 % 300, copy * 83 % 300):
            words[at] = f"w{copy}"
        rows.append((copy, " ".join(words)))
    listed = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r.doc_id for r in listed}) == 59 and len(listed) < 4 * len(rows), len(listed)


def test_texts_with_only_a_common_line_are_not_dealt_in_full(spark, monkeypatch):
    """Windows and keys of all texts were stored before, several times the size of the texts."""
    line = prose(4242, 14)
    rows = [(k, prose(70_000 + k, 150) + " " + line + " " + prose(90_000 + k, 150)) for k in range(300)]
    sizes, original = [], substrings.store

    def store(df, label):
        sizes.append(0 if label.endswith(("-classes", "-reps")) else df.count())
        return original(df, label)

    monkeypatch.setattr(substrings, "store", store)
    assert substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0
    assert sum(sizes) < 4 * len(rows), sizes


@pytest.mark.parametrize("alike", [1 << 60, 30])
def test_first_places_of_all_stretches(alike):
    tokens = np.random.default_rng(alike % 97).integers(0, alike, 300).astype(np.uint64)
    expected = np.zeros(300, dtype=bool)
    for at in range(255):
        expected[at : at + 46] |= np.isin(tokens[at : at + 46], np.unique(tokens[at : at + 46])[:10])
    got = substrings.first_places(tokens, 46, 10)
    assert (got >= expected).all()
    limits = [np.unique(tokens[max(k, 0) : k + 46])[:10].max() for k in range(255)]
    assert (got == [t <= max(limits[max(k - 45, 0) : k + 1]) for k, t in enumerate(tokens)]).all()
