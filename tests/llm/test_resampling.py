"""Prefix CRCs and importance resampling against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from transitframe.llm import crc, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, _place int, weight string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_every_substring_has_its_crc():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(70_000)), np.uint8)
    registers = crc.running(data)
    starts = np.array([rng.randrange(len(data)) for _ in range(300)])
    ends = np.minimum(len(data), starts + np.array([rng.choice([0, 1, 7, 40, 9000]) for _ in starts]))
    got = crc.substring_crc(registers, starts, ends)
    assert [int(x) for x in got] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert int(crc.running(np.zeros(0, np.uint8))[0]) == 0


@pytest.mark.parametrize("limit", [32, 2 << 20])  # a short limit cuts rows into pieces between words
def test_features_are_the_crcs_of_joined_words(limit, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " ,;", "A bc  D,e", "x", "éa B\tc é2", "word" * 40]
    texts += [" ".join(rng.choice(["Foo", "bar", "é", "1"]) + rng.choice(["", ",", "..!"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    monkeypatch.setattr(crc.word_pieces, "__defaults__", (0, limit))
    got = Counter()
    for rows, buckets, words in resampling.features(pa.array(texts), 3, 10_000):
        got.update((int(r), int(b), words) for r, b in zip(rows, buckets, strict=True))
    want = Counter()
    for row, text in enumerate(texts):
        words = WORD.findall(lower(text))
        for n in (1, 2, 3):
            want.update((row, zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000, n) for i in range(len(words) - n + 1))
    assert got == want


def naive(docs, targets, percent=10, buckets=10_000, least=20):
    def hashed(text):
        return [zlib.crc32(w.encode()) % buckets for w in WORD.findall(lower(text))]

    s, t = (Counter(b for text in texts for b in hashed(text)) for texts in ([d[1] for d in docs], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text, *_ in docs:
        own = hashed(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = Counter()
    ranks = {}
    for place, row in enumerate(order[: len(order) * percent // 100], 1):
        ranks.setdefault(row, []).append(place)
    out = []
    for row in rows:
        out.append((*row, ranks[row][drawn[row]] if drawn[row] < len(ranks.get(row, ())) else None))
        drawn[row] += 1
    return sorted(out, key=repr)


def test_resampling_equals_the_definition(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "x", 1, "y") for i in range(300)]
    docs += [docs[7]] * 120 + [(7, "another text " * 15, None, None, None), (None, "no id " * 15, None, None, None)]
    docs += [(900, None, None, None, None), (901, "", None, None, None), (902, "... !", None, None, None), (903, "A" * 100_000 + " b" * 50_000, None, None, None)]
    targets = [" ".join(rng.choices(vocabulary[:10], k=30)), None, ""]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = resampling.resample(frame, spark.createDataFrame([(x,) for x in targets], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == naive(docs, targets)
    favoured = [r for r in rows if r[4] is not None]
    assert np.mean([r[2] for r in favoured]) > np.mean([r[2] for r in rows if r[1] >= 20])


def test_resampling_without_documents_or_targets(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_text = spark.createDataFrame([], "text string")
    assert resampling.resample(none, no_text).collect() == []
    docs = [(i, "one two three " * 9, None, None, None) for i in range(40)]
    rows = [tuple(r) for r in resampling.resample(spark.createDataFrame(docs, SCHEMA), no_text).collect()]
    assert sorted(rows, key=repr) == naive(docs, [])
    assert sorted(r[4] for r in rows if r[4]) == [1, 2, 3, 4]
