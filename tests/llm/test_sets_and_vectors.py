"""Similarity joins against comparisons of all pairs."""

import random
import re

import numpy as np

from flowspark.llm import components, ngram_join, vector_join

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)]))


def _least_reachable(n, links, ids):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def _corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 90, 150]))]
        for copy in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [f"{passage} " + " ".join(rng.choice(words) for _ in range(20)) for _ in range(8)]
    rows += [None, "", " \n ", "one two", "ONE two", "one", rows[0], rows[0].upper()]
    return rows


def test_ngram_join_finds_the_links_of_all_pairs(spark, docs):
    texts = _corpus()
    ids = [1000 - 3 * i for i in range(len(texts))]
    ids[3] = None
    for words, percent in ((3, 90), (5, 80), (3, 50)):
        sets = [_shingles(t, words) for t in texts]
        links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a]
                 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        least = _least_reachable(len(sets), links, ids)
        got = sorted(map(tuple, ngram_join.similar_groups(docs(zip(ids, texts)), words, percent).select(
            "doc_id", "n_shingles", "component_id").collect()), key=str)
        want = sorted(((i, len(s), c) for i, s, c in zip(ids, sets, least)), key=str)
        assert got == want


def test_ngram_join_counts_every_link(spark, docs):
    texts = _corpus()
    ids = list(range(len(texts)))
    for words, percent, tile in ((3, 90, 1024), (3, 50, 2)):
        sets = [_shingles(t, words) for t in texts]
        links = {(a, b) for a in ids for b in ids if a != b and sets[a]
                 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = ngram_join.similar_links(docs(zip(ids, texts)), words, percent, tile).collect()
        assert {r["doc_id"]: r["n_links"] for r in got} == {i: sum(a == i for a, _ in links) for i in ids}
    members, pairs = ngram_join.similar_pairs(docs(zip(ids, texts)), words, percent, tile)
    named = [(r["doc_id"], r["id"]) for r in members.where("id is not null").collect()]
    pairs = list(map(tuple, pairs.collect()))
    assert len(pairs) == len(set(pairs))
    assert {(a, b) for a, i in named for b, j in named if a != b and (i == j or (min(i, j), max(i, j)) in pairs)} == links


def test_a_pair_that_shares_many_tokens_is_taken_once(spark):
    def rows(start, skip=()):
        return [(t, start, 300, 30, i, i) for i, t in enumerate(t for t in range(1, 31) if t not in skip)]

    # 1 and 2 share all tokens; 3 lacks the first ones, so that its first shared token is not its first place in 1
    postings = spark.createDataFrame(rows(1) + rows(2) + rows(3, (1, 2)) + [(99, 4, 300, 1, 0, 0)],
                                     "token long, id long, n int, width int, free int, pos int")
    classes = spark.createDataFrame([(i, [0, 0, 0, 0]) for i in range(1, 5)], "id long, parity array<long>")
    parts = spark.createDataFrame([], "node long, component long")
    pairs, _ = ngram_join._cross_pairs(postings, classes, parts, 90)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]


def test_one_row_of_every_group_stays(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (2, text + " more"), (None, text), (9, "other words here now five six"), (7, None), (8, None)]
    kept = ngram_join.keep_one_of_each_group(docs(rows)).collect()
    assert sorted((r["doc_id"] for r in kept)) == [2, 7, 8, 9]
    same = ngram_join.keep_one_of_each_group(docs([(5, text), (5, text)])).collect()
    assert [(r["doc_id"], r["line"]) for r in same] == [(5, "y")]


def test_ngram_join_of_an_empty_table(spark, docs):
    assert ngram_join.similar_groups(docs([])).count() == 0
    assert ngram_join.keep_one_of_each_group(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def _vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(6):
            base = rng.normal(size=12)
            for _ in range(4):
                rows.append((label, (base + 0.12 * rng.normal(size=12)).tolist()))
    rows += [(0, rows[0][1]), (0, rows[0][1]), (1, None), (1, []), (1, [0.0] * 12), (1, [float("nan")] * 12),
             (0, [None] * 12), (0, [float("inf")] + [0.0] * 11), (0, rows[0][1][:5]), (0, [2 * x for x in rows[0][1]])]
    return rows


def test_vector_join_finds_the_links_of_all_pairs(spark):
    rows = _vectors()
    ids = [500 - i for i in range(len(rows))]
    ids[1] = None

    def unit(label, v):
        if label is None or not v or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(*r) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if units[a] is not None and units[b] is not None and rows[a][0] == rows[b][0]
             and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93]
    assert len(links) > 20
    least = _least_reachable(len(rows), links, ids)
    degree = [sum(i in pair for pair in links) for i in range(len(rows))]
    table = spark.createDataFrame(
        [(i, r[1], r[0], "z") for i, r in zip(ids, rows)], "vec_id long, embedding array<double>, label int, dim string")
    for tile in (1024, 3):
        got = vector_join.near_vectors(table, tile=tile).collect()
        want = [(i, d, c, i is not None and i == c) for i, d, c in zip(ids, degree, least)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert vector_join.near_vectors(table.limit(0)).count() == 0


def test_survivors_never_lose_a_pair():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 20)) * np.linspace(3, 0.2, 20)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    i, j = vector_join.survivors(a, a, 0.5)
    assert set(zip(*np.nonzero(a @ a.T >= 0.5))) == set(zip(i, j))


def test_vectors_of_any_finite_size_link(spark):
    rows = [(1, 0, [1e200, 1e200]), (2, 0, [1e200, 1e200]), (3, 0, [1e-200, 1e-200]), (4, 0, [2.0, 2.0]), (5, 0, [5e-324, 0.0]),
            (6, 0, [1e308, 0.0]), (7, 0, [0.0, 0.0]), (8, 0, [float("inf"), 1.0]), (9, 0, [float("nan"), 1.0]), (10, 1, [1e200, 1e200])]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.near_vectors(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10)}
