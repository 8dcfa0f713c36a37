"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from transitframe.llm import crc, spelling

SCHEMA = "doc_id long, text string, word string, n int, id long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def naive_vocabulary(docs, least=6, count=5):
    seen = Counter()
    for doc_id, text, *_ in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive(docs):
    words = naive_vocabulary(docs)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def texts(seed, docs):
    rng = random.Random(seed)
    base = ["streetcar", "terminal", "avenida", "corredor", "éclairage", "ÉCOLES", "bananas", "×÷letters", "short", "integrated"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("xy") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words), "x", 1, 2))
    return out


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_neighbourhoods_are_complete_and_without_repeats(block, monkeypatch):
    monkeypatch.setattr(spelling, "_BLOCK", block)
    rng = random.Random(3)

    def key(word, symbols):
        if not word:
            return int(spelling._finished(np.zeros(1, np.uint64), 0)[0])
        return int(next(spelling.neighbour_keys(np.array([word], np.uint64), symbols))[1][0])

    for symbols in (2, 3, 8):
        for length in (1, 2, 5):
            words = [[rng.randrange(symbols) for _ in range(length)] for _ in range(5)]
            got = {}
            for rows, keys in spelling.neighbour_keys(np.array(words, np.uint64), symbols):
                for row, k in zip(rows, keys, strict=True):
                    got.setdefault(int(row), []).append(int(k))
            for row, w in enumerate(words):
                want = {tuple(w)} | {tuple(w[:i] + w[i + 1 :]) for i in range(length)}
                want |= {tuple(w[:i] + [s] + w[i + 1 :]) for i in range(length) for s in range(symbols)}
                want |= {tuple(w[:i] + [s] + w[i:]) for i in range(length + 1) for s in range(symbols)}
                assert sorted(got[row]) == sorted(key(list(x), symbols) for x in want)


def test_variants_equal_the_definition(spark, monkeypatch):
    docs = texts(1, 150)
    docs += [docs[3]] * 30 + [(None, "sÃ£o avenida avenidas " * 9, None, None, None), (900, None, None, None, None), (901, "", None, None, None), (902, "12 34 !!", None, None, None)]
    docs += [(903, "longword" * 20_000 + " " + "avenida " * 4000, None, None, None)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == naive_vocabulary(docs)
    got = spelling.variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == naive(docs)
    assert any(r[1] is not None for r in rows) and any(r[4] > 1 for r in rows)


def test_chains_of_forms_end_at_their_root(spark):
    counts = {"abcdefgh": 5, "abcdefgi": 30, "abcdefji": 200, "abcdeyji": 1500}
    docs = [(i, " ".join([w] * n), None, None, None) for i, (w, n) in enumerate(counts.items())]
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(docs, SCHEMA), typo=0).collect()}
    assert {w: r.root for w, r in rows.items()} == dict.fromkeys(counts, "abcdeyji")
    assert rows["abcdefgh"].form == "abcdefgi" and rows["abcdeyji"].form is None


def test_a_word_longer_than_a_block_and_long_near_words(spark):
    word = "".join(random.Random(8).choices("abcdefghij", k=5000))
    docs = [(1, f"{word} " * 6, None, None, None), (2, f"{word[:2500]}z{word[2500:]} " * 40, None, None, None)]
    rows = {len(r.word): r for r in spelling.variants(spark.createDataFrame(docs, SCHEMA), typo=0).collect()}
    assert rows[5000].n_near == 1 and len(rows[5000].form) == 5001 and rows[5001].form is None


def test_pieces_of_long_rows_keep_letters_whole(monkeypatch, spark):
    monkeypatch.setattr(crc.word_pieces, "__defaults__", (0, 16))
    docs = [(1, "ééééàààà üüüüüü naïveté façades", None, None, None)] * 7
    import pyarrow as pa

    counted = Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([str(d[0]) for d in docs]), pa.array([d[1] for d in docs])], ["id", "text"])
    for out in spelling._word_counts(6, 199)(iter([batch])):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            counted[w] += n
    assert {w: n for w, n in counted.items() if n >= 5} == naive_vocabulary(docs)


def test_no_texts_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect() == []


def test_keys_are_not_broadcast(spark, tmp_path):
    rows = [(i, w, 5) for i, w in enumerate(["abcdefgh", "abcdefgi", "zyxwvuts"])]
    spark.createDataFrame(rows, "id long, word string, n long").write.parquet(f"{tmp_path}/words")
    pairs = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
    assert {(r.id, r.near) for r in pairs.collect()} == {(0, "abcdefgi"), (1, "abcdefgh")}
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join [key#" in line)
