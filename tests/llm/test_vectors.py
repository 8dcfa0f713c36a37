"""Embedding near-duplicates against brute force, recall, and edge cases."""

import numpy as np

from transitframe.llm.vectors import near_vectors


def brute(ids, rows, least=0.95):
    x = np.array(rows, float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min(label[np.append(np.flatnonzero(near[i]), i)]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    root = {k: min(ids[i] for i in range(len(ids)) if label[i] == k) for k in set(label)}
    return sorted((ids[i], int(near[i].sum()), root[label[i]]) for i in range(len(ids)))


def test_matches_brute_force(spark):
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(12, 32))
    rows = [c + rng.normal(size=32) * 0.08 for c in centres for _ in range(rng.randint(1, 9))] + list(rng.normal(size=(60, 32)))
    rows += [rows[0], rows[0], rows[3] * 2.5]
    ids = list(rng.permutation(len(rows)).tolist())
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in zip(ids, rows)], "vec_id long, embedding array<double>, label string").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == brute(ids, rows)


def test_group_beyond_one_block(spark):
    rng = np.random.RandomState(2)
    rows = rng.normal(size=64) + rng.normal(size=(2300, 64)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got = near_vectors(df).collect()
    exact = dict((a, b) for a, b, _ in brute(list(range(len(rows))), np.array(rows, np.float32).astype(float)))
    assert {r.component_id for r in got} == {0}
    assert sum(r.n_links for r in got) >= 0.98 * sum(exact.values())
    assert all(r.n_links <= exact[r.vec_id] for r in got)
    assert sum(r.kept for r in got) == 1


def test_recall_near_the_threshold(spark):
    rng = np.random.RandomState(3)
    rows = []
    for _ in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= a * (a @ b)
        cosine = rng.uniform(0.951, 0.97)
        rows += [a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in near_vectors(df).collect()) / 600 >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, 0.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1e-200]), (12, [1e200, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as key", "vec_id as id")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert got == sorted([*alone, (7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (10, 1, 10, True), (11, 1, 10, False), (12, 4, 7, False), (None, 4, 7, True)], key=str)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
