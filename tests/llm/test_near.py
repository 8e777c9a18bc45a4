"""op2, op9 and their components against brute force, also with tiny blocks, lists and limits."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pagestrata.llm import graph, op2_vectors, op9_jaccard
from pagestrata.llm.graph import components, labels
from pagestrata.llm.op2_vectors import near_vectors
from pagestrata.llm.op9_jaccard import PERCENT, bitmap_of, jaccard_components, may_link, prefix, similar, tile_links

from .helpers import LONG, ask, docs


def groups_of(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_labels():
    draw = random.Random(1)
    for n in (1, 5, 60):
        links = [(draw.randrange(n), draw.randrange(n)) for _ in range(n)]
        nodes, found = labels(np.array([a for a, _ in links]), np.array([b for _, b in links]))
        want = groups_of(n, links)
        assert found.tolist() == [want[x] for x in nodes.tolist()]


@pytest.mark.parametrize("limit", [graph.ONE_TASK, 5])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "ONE_TASK", limit)
    draw = random.Random(2)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    want = groups_of(131, links)
    got = ask(components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "component")
    assert got == sorted(((x, want[x]) for x in {y for pair in links for y in pair}), key=repr)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- op9 --


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_jaccard(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [(i, len(s), g) for i, (s, g) in enumerate(zip(sets, groups_of(len(sets), links)))], links


def near_copies(seed=3, groups=12, size=14):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = draw.choices(words, k=60)
    texts = []
    for _ in range(groups):
        base = draw.choices(words, k=draw.choice((6, 12, 40, 130, 400)))
        for _ in range(draw.randint(1, size)):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 1, 2, 6))):
                own[draw.randrange(len(own))] = draw.choice(words)
            if draw.random() < 0.2:
                own = own[: len(own) * 9 // 10]
            texts.append(" ".join(own + (passage if draw.random() < 0.3 else [])))
    texts += ["one two", "One TWO", "one two three", "", None, " \n\t ", "Été à la mode", "été à la mode", LONG, LONG]
    draw.shuffle(texts)
    return texts


def test_pieces_of_the_join():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.randint(1, 60)
        a = np.unique(np.array([draw.randrange(1 << 60) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[: draw.randint(0, n)], np.array([draw.randrange(1 << 60) for _ in range(draw.randint(1, 12))], np.uint64)]))
        alike = 100 * len(np.intersect1d(a, b)) >= PERCENT * len(np.union1d(a, b))
        assert similar(a, b, PERCENT) == alike
        late = np.sort(np.array(draw.sample(a.tolist(), k=len(a) // 2), np.uint64))
        if alike:
            assert may_link(bitmap_of(a), len(a), bitmap_of(b), len(b), PERCENT)
            for order in (late, np.empty(0, np.uint64)):
                assert len(np.intersect1d(prefix(a, order, PERCENT), prefix(b, order, PERCENT)))
        x, _ = tile_links(np.array([1, 2]), [a, b], np.zeros(2, np.int64), PERCENT)
        assert len(x) == alike


@pytest.mark.parametrize("weight, pair_weight, hot", [(op9_jaccard.BLOCK_WEIGHT, op9_jaccard.PAIR_WEIGHT, op9_jaccard.HOT), (700, 2000, 2), (300, 300, 1)])
def test_join(spark, monkeypatch, weight, pair_weight, hot):
    monkeypatch.setattr(op9_jaccard, "BLOCK_WEIGHT", weight)
    monkeypatch.setattr(op9_jaccard, "PAIR_WEIGHT", pair_weight)
    monkeypatch.setattr(op9_jaccard, "HOT", hot)
    if hot < 10:
        monkeypatch.setattr(op9_jaccard, "FREQUENT", 2)
        monkeypatch.setattr(op9_jaccard, "LEAST_WEIGHT", 16)
    texts = near_copies()
    want, links = brute_jaccard(texts)
    assert len(links) > 60
    assert ask(jaccard_components(docs(spark, texts, clash=True)), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_join_edge_cases(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "other words here at last too"), (3, None), (3, None)]
    got = ask(jaccard_components(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 2, None), (3, 0, 3), (3, 0, 3)], key=repr)
    assert jaccard_components(docs(spark, ["x"]).limit(0)).count() == 0


# -- op2 --


def brute_vectors(rows):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if usable(v, label) else None for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    n = Counter(x for pair in links for x in pair)
    group = groups_of(len(rows), links)
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return sorted(((r[0], n[i], least[group[i]], r[0] == least[group[i]]) for i, r in enumerate(rows)), key=repr), len(links)


@pytest.mark.parametrize("block, aim", [(op2_vectors.BLOCK, op2_vectors.LIST_SIZE), (16, 20)])
def test_vectors(spark, monkeypatch, block, aim):
    monkeypatch.setattr(op2_vectors, "BLOCK", block)
    monkeypatch.setattr(op2_vectors, "LIST_SIZE", aim)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        center = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            v = center + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    odd = [None, [], [0.0] * 16, [1.0, None, *[0.0] * 14], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [1e30] * 16, [1e-30] * 16, [1.0] * 8, [2.0] * 8]
    rows += [(len(rows) + i, v, 1) for i, v in enumerate(odd)]
    rows += [(len(rows) + i, [1.0] * 16, None) for i in range(2)]
    want, n = brute_vectors(rows)
    assert n > 100
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, node int")
    assert ask(near_vectors(table), "vec_id", "n_links", "component_id", "kept") == want


@pytest.mark.parametrize("shapes", [op2_vectors.SHAPES, 1])
def test_double_vectors_and_many_lengths(spark, monkeypatch, shapes):
    monkeypatch.setattr(op2_vectors, "SHAPES", shapes)
    rng = np.random.default_rng(6)
    rows = []
    for size in (3, 5, 9, 9):
        center = rng.normal(size=size)
        rows += [(len(rows) + i, (center + rng.normal(size=size) * 0.2).tolist(), 7) for i in range(12)]
    near = [1.0, 0.0], [0.93, math.sqrt(1 - 0.93**2)], [0.93 - 1e-12, math.sqrt(1 - (0.93 - 1e-12) ** 2)]  # on either side in double precision only
    rows += [(len(rows) + i, list(v), 8) for i, v in enumerate((near[0], near[2]))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")
    assert ask(near_vectors(table), "vec_id", "n_links", "component_id", "kept") == brute_vectors(rows)[0]


def test_vectors_edge_cases(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (9, [0.0, 1.0], 1), (None, None, 1)]
    got = ask(near_vectors(spark.createDataFrame(rows, kind)), "vec_id", "n_links", "component_id")
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 0, 9), (None, 0, None)], key=repr)
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0
