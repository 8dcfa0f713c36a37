"""Similarity joins inside groups: middling groups meet directly, in cells, and huge ones through keys; all find every pair."""

from difflib import SequenceMatcher

import pytest

from test_candidates import names
from transitframe.operators import candidates


def within(a, b):
    return len(a) >= 8 and (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.7


@pytest.mark.parametrize("most,cell", [(4_096, 2_000), (4_096, 60), (100, 60)])
def test_groups_of_two_hundred_rows(spark, monkeypatch, most, cell):
    monkeypatch.setattr(candidates, "_DIRECT_GROUP", most)
    monkeypatch.setattr(candidates, "_CELL_ROWS", cell)
    keyed, plain = [], candidates._grid_join

    def counted(left, right, keys, *rest):
        if keys != ["g"]:
            keyed.append(left.count() + right.count())
        return plain(left, right, keys, *rest)

    monkeypatch.setattr(candidates, "_grid_join", counted)
    left, right = names(5, 60), names(6, 200)
    l = spark.createDataFrame([("x", n) for n in left] + [("y", n) for n in left[:9]], "g string, t string")
    r = spark.createDataFrame([("x", n) for n in right] + [("y", n) for n in right[:9]], "g string, t string")
    pairs = [("x", a, b) for a in left for b in right] + [("y", a, b) for a in left[:9] for b in right[:9]]
    got = [(p.g, p.l_t, p.r_t) for p in candidates.ratio_join(l, r, "t", 0.82, on=["g"]).collect()]
    assert sorted(got) == sorted(p for p in pairs if SequenceMatcher(None, p[1], p[2]).ratio() >= 0.82)
    got = [(p.g, p.l_t, p.r_t) for p in candidates.containment_join(l, r, "t", on=["g"]).collect()]
    assert sorted(got) == sorted(p for p in pairs if within(p[1], p[2]))
    # no row is copied for keys unless a group is huge
    assert (sum(keyed) > 0) == (most == 100)
