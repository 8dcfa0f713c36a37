"""Jaccard join against brute force, and its edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from transitframe.llm import jaccard
from transitframe.llm.components import components


def shingles(text, size):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return sorted((doc, len(sets[i]), min(least[find(i)])) for i, (doc, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 60]))))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150, 300]))))
    return texts


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_matches_brute_force(spark, size, percent):
    rows = list(enumerate(corpus(size, 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, words=size, percent=percent).collect())
    assert got == brute(rows, size, percent)


def test_every_linked_pair_shares_a_tile():
    rng = np.random.RandomState(0)
    for percent in (50, 80, 85, 95):
        borders = jaccard._bands(percent, 4000)
        for _ in range(400):
            n = int(np.exp(rng.uniform(0, 7)))
            base = np.unique(rng.randint(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            drop, extra = rng.randint(0, n // 4 + 1), rng.randint(0, n // 4 + 1)
            other = np.unique(np.concatenate([rng.permutation(base)[: max(1, n - drop)], rng.randint(0, 2**63, extra).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            if 100 * common >= percent * (len(base) + len(other) - common):
                keys = [jaccard.tile_keys(x, borders, percent) for x in (base, other)]
                assert len(np.intersect1d(*keys)), (percent, len(base), len(other), common)
                gap = np.bitwise_count(np.frombuffer(jaccard._bitmap(base), np.uint64) ^ np.frombuffer(jaccard._bitmap(other), np.uint64)).sum()
                assert jaccard.bound_passes(np.array(len(base)), np.array(len(other)), np.array(int(gap)), percent)


def test_edge_cases(spark):
    long_text = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "one two", 5), (5, "ONE  two", 6), (6, "two one", 7), (7, long_text, 0), (8, long_text + " y", 0),
            (8, long_text + " y", 0), (None, "one two", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumnsRenamed({"key": "set_class"})
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, words=4, percent=85).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 59_997, 7), (8, 59_998, 7), (8, 59_998, 7), (None, 1, 4), (None, 0, None)], key=str)
    kept = jaccard.first_of_each(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


def near(n, changed):
    """A text of 60 words with ``changed`` of its words replaced, counted from either end."""
    words = [f"w{i}" for i in range(60)]
    for at in changed:
        words[at] = f"other{n}"
    return " ".join(words)


def test_links_through_texts_without_an_id(spark):
    """1 and 2 are linked only by way of a text whose rows have no id."""
    rows = [(1, near(1, [0, 1, 2])), (None, near(0, [])), (None, near(0, [])), (2, near(2, [57, 58, 59])), (3, "apart " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, words=4, percent=88).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in got) == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 3)]
    assert [(r.doc_id, r.text) for r in jaccard.first_of_each(docs, words=4, percent=88).orderBy("doc_id").collect()] == [rows[0], rows[4]]


def test_only_the_near_text_of_an_id_goes(spark):
    rows = [(1, near(0, [])), (5, near(1, [0])), (5, "an unrelated clean text of one and the same id"), (5, near(1, [0])), (6, ""), (None, near(2, [59])), (None, "no id at all here"), (7, None)]
    rows += [(8, f"one of many texts of an id {i} with words {i * 7} and {i * 11}") for i in range(30)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, rows int")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.first_of_each(docs, words=4, percent=85).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[4], rows[6], rows[7], *rows[8:]], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(docs).collect() == []
    assert jaccard.first_of_each(docs).collect() == []


def test_large_group_gives_few_pairs(spark):
    """Near copies of one text: links are found without listing the pairs of the group."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(200)] = f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, words=4, percent=80).collect())
    assert got == brute(rows, 4, 80)


def test_shingle_sets_of_slices_and_chunks():
    texts = ["a b c d e", None, "", "É b C d é", "a b c d e"] * 3
    column = pa.array(texts)[2:13]
    sets = list(jaccard.shingle_sets(column, 4))
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts[2:13]]
    assert (sets[1] != sets[2]).any() if len(sets[1]) == len(sets[2]) else True


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert len({got[i] for i in range(41)}) == 1
    assert len({got[100 + i] for i in range(50)}) == 1
    assert got[199] == got[200] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keys_per_shingle():
    """A set's tile keys follow from its own size: fewer than 0.55 keys a shingle."""
    rng = np.random.RandomState(2)
    borders = jaccard._bands(80, 4000)
    sizes = np.unique(np.geomspace(300, 2700, 60).astype(int))
    keys = sum(len(jaccard.tile_keys(np.unique(rng.randint(0, 2**63, n).astype(np.uint64)), borders, 80)) for n in sizes)
    assert keys < 0.55 * sizes.sum()
