"""Token counts, mixing and licence scans against plain computations, and their edge cases."""

import os
import random
from collections import Counter, defaultdict

import pytest

from transitframe.llm import licences, mixing, tokens

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer file")


def test_suffix_sums_answer_every_limit(spark):
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 5, 255, 256, 257, 1000, rng.randint(0, 5000)]) for _ in range(500)]
    histogram = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    sums = tokens.suffix_sums(histogram)
    for r in sums.collect():
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert abs(r.share_up_to - sum(x <= r.n_tokens for x in lengths) / 500) < 1e-12
        assert (r.docs_all, r.tokens_all) == (500, sum(lengths))
    limits = [0, 1, 100, 256, 10_000]
    assert {r.max_tokens: r.truncated_total for r in tokens.truncated_totals(sums, limits).collect()} == {m: sum(min(x, m) for x in lengths) for m in limits}
    ordered = sorted(lengths)
    assert [r.n_tokens for r in tokens.quantiles(sums, [0.1, 0.5, 1.0]).collect()] == [ordered[49], ordered[249], ordered[-1]]


def test_sums_of_nothing(spark):
    sums = tokens.suffix_sums(spark.createDataFrame([], "n_tokens long, n_docs long"))
    assert sums.collect() == []
    assert tokens.truncated_totals(sums, [5]).first().truncated_total == 0
    assert tokens.quantiles(sums, [0.5]).first().n_tokens is None


@needs_tokenizer
def test_encoded_lengths(spark):
    texts = ["hello world", None, "", "don't  stop\n\n", "é" * 50, "<|endoftext|>", "a b " * 50_000, "hello world"]
    got = {r.n_tokens: r.n_docs for r in tokens.length_histogram(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int").repartition(3)).collect()}
    encoder = tokens.encoder(tokens.TOKENIZER)
    assert got == dict(Counter(len(encoder.encode_ordinary(t or "")) for t in texts))
    assert encoder.decode(encoder.encode_ordinary(texts[3])) == texts[3]


def mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(4)
    out = mixing.mix(docs, **options)
    assert out.columns[:4] == docs.columns
    return out.collect()


def rows_of(seed, sizes):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), source, i))
            i += 1
    return rows


@pytest.mark.parametrize(("share", "limit"), [(1.0, 1.25), (0.4, 1.0), (3.0, 4.0)])
def test_mixing_meets_its_quotas(spark, share, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rows = rows_of(3, {"big": 400, "mid": 90, "small": 25, None: 40})
    tokens_of = defaultdict(int)
    for _, text, source, _ in rows:
        tokens_of[source] += len(text.split())
    total = sum(tokens_of.values())
    out = mixed(spark, rows, budget_share=share, repetitions=limit)
    got, copies = defaultdict(int), defaultdict(Counter)
    for r in out:
        got[r.source] += len(r.text.split())
        copies[r.source][r.doc_id] += 1
    # the exponent: the smallest that keeps the limit
    low, high = 0.0, 1.0
    for _ in range(40):
        a = (low + high) / 2
        z = sum(t**a for t in tokens_of.values())
        low, high = (low, a) if max(share * total * t**a / z / t for t in tokens_of.values()) <= limit else (a, high)
    z = sum(t**high for t in tokens_of.values())
    for source, t in tokens_of.items():
        quota = share * total * t**high / z
        assert quota - 31 <= got[source] <= quota + 2
        spread = {copies[source][i] for i, _, s, _ in rows if s == source}
        assert max(spread) - min(spread) <= 1
    assert len({(r.doc_id, r.mix_copy) for r in out}) == len(out)
    by_copy = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.mix_copy, r.mix_block, r.mix_order)):
        if r.source == "big":
            by_copy[r.mix_copy].append(r.doc_id)
    assert by_copy[0] != sorted(by_copy[0])
    if len(by_copy) > 1:
        both = set(by_copy[0]) & set(by_copy[1])
        assert [i for i in by_copy[0] if i in both] != [i for i in by_copy[1] if i in both]


def test_target_entropy(spark):
    import math

    sources = spark.createDataFrame([("a", 10, 900), ("b", 5, 90), ("c", 1, 10), ("d", 3, 0)], "source_key string, docs long, tokens long")
    a = mixing.find_exponent(sources, 1000.0, entropy=0.8)
    power = [t**a for t in (900, 90, 10)]
    p = [x / sum(power) for x in power]
    assert abs(-sum(x * math.log(x) for x in p) - 0.8) < 1e-4
    assert mixing.find_exponent(sources, 1000.0, entropy=2.0) == 0.0
    assert mixing.find_exponent(sources, 1000.0, entropy=0.0) == 1.0


def test_mixing_edge_cases(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, "a", 1), (2, "", "a", 1)]) == []
    assert mixed(spark, [(1, "x y", "a", 1)], budget_share=0.0) == []
    rows = [(1, "x y", "a", 1), (1, "x y", "a", 1), (None, "z", None, 1), (2, "w " * 60_000, "b", 2), (3, None, "b", 3)]
    out = mixed(spark, rows, budget_share=1.0)
    assert {r.doc_id for r in out} <= {1, 2, 3, None} and sum(r.doc_id == 1 for r in out) % 2 == 0


def test_mixing_rows_without_ids(spark):
    """Rows without an id are told apart by their texts, so a quota is met to within a row."""
    rows = [(None, f"text {i} " + "word " * (i % 9), f"s{i % 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, budget_share=0.5, repetitions=1.0).collect()
    budget = sum(len(r[1].split()) for r in rows) // 2
    assert budget - 2 * 11 <= sum(len(r.text.split()) for r in out) <= budget
    assert len({r.text for r in out}) == len(out)


def test_licences(spark):
    mit = licences._MIT
    noisy = "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + mit.upper().replace('"', "``").replace("SUBLICENSE", "sub-licence")
    rows = [(1, mit, "x"), (2, noisy, "x"), (3, mit + " extra", "x"), (4, "Some words\nreleased under the  mit LICENCE\nmore", "x"), (5, None, None), (6, "", "x"),
            (7, "Copyright 2020 X", "x"), (1, mit, "x"), (None, "Licensed under CC BY-NC 4.0.", "x"), (8, "word\n" * 60_000 + "Licensed under the Apache License, Version 2.0.", "x"),
            (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string").selectExpr("*", "licence as digest", "licence as lines")
    got = sorted(((r.doc_id, r.licence, r.line_licences) for r in licences.scan(docs.repartition(3), licences.known_licences(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "MIT"), (5, None, ""), (6, None, ""), (7, None, ""), (1, "MIT", ""), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
                          (8, None, "Apache-2.0"), (9, None, "CC-BY-NC-4.0,MIT")], key=str)
    assert licences.scan(docs.limit(0), licences.known_licences(spark)).collect() == []
    none = licences.scan(docs, licences.known_licences(spark).limit(0)).collect()
    assert len(none) == len(rows) and all(r.licence is None and r.line_licences == "" for r in none)
