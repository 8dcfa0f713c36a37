"""Order MinHash fingerprints against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from transitframe.llm import fingerprints as fp
from transitframe.llm.common import mix

SCHEMA = "doc_id long, text string, n_chars string, edge int, part string"
M64 = (1 << 64) - 1


def naive_components(text, k=6, size=2, sketches=64):
    if not text:
        return [0] * sketches
    k = min(k, len(text))
    one = lambda x: int(mix(np.array([x & M64], np.uint64))[0])
    hashes = []
    for i in range(len(text) - k + 1):
        value = 0
        for c in text[i : i + k]:
            value = (value * 0xD1342543DE82EF95 + ord(c)) & M64
        hashes.append(one(value + k))
    seen, ranks = {}, []
    for h in hashes:
        occurrence = seen.get(h >> 22, 0)
        seen[h >> 22] = occurrence + 1
        x = ((h + occurrence * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95) & M64
        ranks.append(((x ^ (x >> 29)) >> 16) & 0xFFFFFFFF)
    out = []
    for factor in fp.multipliers(sketches).tolist():
        least = sorted(range(len(ranks)), key=lambda i: (ranks[i] * factor & 0xFFFFFFFF, i))[:size]
        value = 0
        for i in sorted(least):
            value = one(value * 0xD1342543DE82EF95 + hashes[i])
        out.append(max(1, value >> 48))
    return out


def as_hex(parts):
    return "".join(f"{x:04x}" for x in parts)


TEXTS = ["a", "ab", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaaaaaa", "é€😀 mixed code points 😀😀😀", "the quick brown fox jumps over the lazy dog " * 7]


@pytest.mark.parametrize("text", TEXTS)
def test_components_equal_the_definition(text):
    assert fp.components(text).tolist() == naive_components(text)
    assert fp.components(text, 4, 3, 16).tolist() == naive_components(text, 4, 3, 16)


def test_runs_and_blocks_do_not_change_the_result(monkeypatch):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta"], k=400))
    whole = fp.components(text).tolist()
    assert whole == naive_components(text)
    monkeypatch.setattr(fp, "_CHUNK", 100)
    assert fp.components(text).tolist() == whole
    hashes = np.array([random.Random(i % 7).getrandbits(64) for i in range(5000)], np.uint64)
    numbers = fp.occurrence_numbers(hashes)
    monkeypatch.setattr(fp, "_POSITION_BITS", 8)
    assert fp.occurrence_numbers(hashes).tolist() == numbers.tolist() == [i // 7 for i in range(5000)]


def test_likeness_follows_edits():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "oro", "ili", "ent", "ust")]
    text = " ".join(rng.choices(words, k=500))
    other = " ".join(rng.choices(words, k=500))
    half = len(text) // 2
    own = fp.components(text, sketches=256)
    little = fp.likeness(own, fp.components(text[: half - 10] + "changed" + text[half:], sketches=256))
    much = fp.likeness(own, fp.components(fp.edited(text, other), sketches=256))
    moved = fp.likeness(own, fp.components(text[half:] + text[:half], sketches=256))
    none = fp.likeness(own, fp.components(other, sketches=256))
    assert 1 > little > 0.8 > moved > much > none
    assert moved < 0.75  # the same k-mers in another order: half of the pairs change places


def naive_rows(docs):
    texts = sorted(((d[0], d[1] or "") for d in docs), key=lambda d: -d[0])
    rows = []
    for place, (doc_id, text) in enumerate(texts):
        following = texts[(place + 1) % len(texts)][1]
        changed = fp.edited(text, following)
        own, other, nxt = (np.array(naive_components(x)) for x in (text, changed, following))
        rows.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_hex(own), as_hex(other), float(np.mean(own == other)), float(np.mean(own == nxt))))
    return sorted(rows)


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(6)
    docs = [(i * 3, " ".join(rng.choices(["lorem", "ipsum", "dolor", "é€😀"], k=rng.randint(0, 25))), "x", 1, "p") for i in range(90)]
    docs += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, docs[5][1], None, None, None), (1003, docs[5][1], None, None, None)]
    got = fp.fingerprints(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == naive_rows(docs)
    near = {r[0]: r for r in rows}
    assert near[1003][6] == 1.0 and near[1003][3] == near[1002][3] == near[15][3]
    assert near[1001][6] == near[1001][5] == 1.0  # empty beside empty
    assert near[1002][6] == 0.0  # a text beside the empty one


def test_null_and_repeated_ids_empty_and_single_tables(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = fp.fingerprints(spark.createDataFrame([(4, "only text here", None, None, None)], SCHEMA)).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"only te" + b"only te").hexdigest()
    docs = [(None, "without id", None, None, None)] * 3 + [(8, "same text of one id", None, None, None)] * 40 + [(8, "another one", None, None, None)]
    rows = fp.fingerprints(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert len(rows) == len(docs)
    assert sorted(r.n_chars for r in rows) == sorted(len(d[1]) for d in docs)
    assert sum(r.near_next == 1.0 for r in rows) == 2 + 39  # all but the ends of the three runs of equal texts
    long = "0123456789" * 40_000
    (row,) = fp.fingerprints(spark.createDataFrame([(1, long, None, None, None)], SCHEMA)).collect()
    assert row.n_chars == 400_000 and row.edited_sha256 == hashlib.sha256((long[:200_000] * 2).encode()).hexdigest()
