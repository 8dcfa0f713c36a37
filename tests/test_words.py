"""Rows of positioned words against a plain loop."""

from __future__ import annotations

import random

from transitframe.sources import words


def greedy(tops, tolerance=2.5):
    """Row of every height: it stays in the row while it is within reach of the row's first word."""
    rows, row = {}, None
    for top in sorted(set(tops)):
        if row is None or abs(top - row) > tolerance:
            row = top
        rows[top] = row
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, top double, x0 double, text string")


def found(df):
    return {(r.doc, r.page, r.row): [c.text for c in r.cells] for r in words._gap_rows(df).collect()}


def test_gap_rows_match_a_loop(spark):
    rng = random.Random(5)
    tops = {
        ("even", 1): [100 + i * 2.5 for i in range(40)], ("even", 2): [100 + i * 0.1 for i in range(200)], ("even", 3): [i * 10.0 for i in range(30)],
        ("tie", 1): [7.0] * 5, ("decimals", 1): [102.34, 104.84, 107.34, 104.839, 104.841, 109.84],
        **{("random", p): [round(rng.uniform(0, 300), rng.choice([0, 1, 2, 3])) for _ in range(rng.randint(1, 400))] for p in range(12)},
    }
    rows = [(doc, page, top, float(i), f"w{i}") for (doc, page), heights in tops.items() for i, top in enumerate(heights)]
    want = {}
    for (doc, page), heights in tops.items():
        start = greedy(heights)
        for i, top in enumerate(heights):
            want.setdefault((doc, page, start[top]), []).append(f"w{i}")
    got = found(table(spark, [*rows, ("even", 1, None, 1.0, "nowhere")]))
    assert got == want
    assert found(table(spark, [])) == {}


def test_gap_rows_of_a_page_with_a_hundred_thousand_words(spark):
    rng = random.Random(6)
    tops = [round(rng.uniform(0, 1000), 3) for _ in range(100_000)]
    got = words._gap_rows(table(spark, [("d", 1, top, float(i), "w") for i, top in enumerate(tops)]))
    start = greedy(tops)
    want: dict = {}
    for top in tops:
        want[start[top]] = want.get(start[top], 0) + 1
    assert {r.row: len(r.cells) for r in got.collect()} == want
