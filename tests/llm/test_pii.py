"""Personal data: base spans against the plain patterns, the random field, and edge cases."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from transitframe.llm import pii

DOCUMENTS = Path("/root/testdata/sf0.1/documents.parquet")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute(text):
    spans = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(spans)


@pytest.fixture(scope="module")
def field():
    return pii.train()


@pytest.mark.parametrize("alphabet", ["ab1@.+ -()9 4é", "12345 -", "1.2.255 ", "a@b.c-_%", "+1 (9)."])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(text)) == brute(text), text


def test_field_learns_its_table_and_generalises(field):
    right = total = 0
    for row in pii.TRAINING:
        tokens, labels = pii._labelled(row)
        scores, lengths = field.scores([pii.token_features(tokens)])
        right += (field.viterbi(scores, lengths)[0] == labels).sum()
        total += len(labels)
    assert right / total > 0.97
    texts = ['x token = "0123abcd4567ef890123abcd4567ef8901234567" y', "mail bob.lee [at] site [dot] net now", "tel 040 7654321 or fax", "In 2014 we met 35 people at 10:45.", "version 3.1"]
    found = [[texts[k][a:b] for _, a, b in spans] for k, spans in enumerate(pii.field_spans(texts, field))]
    assert found == [["0123abcd4567ef890123abcd4567ef8901234567"], ["bob.lee [at] site [dot] net"], ["040 7654321"], [], []]


def test_viterbi_is_the_best_path(field):
    rng = np.random.RandomState(0)
    labels = len(pii.LABELS)
    scores = rng.normal(size=(3, 3, labels)) * 3
    lengths = np.array([3, 2, 1])
    for k, path in enumerate(field.viterbi(scores, lengths)):
        n = lengths[k]
        best = max(np.ndindex(*[labels] * n), key=lambda p: field.first[p[0]] + scores[k, range(n), p].sum() + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
        assert tuple(path) == best


def test_find_and_mask(spark, field):
    card = "4111 1111 1111 1111"
    text = f"é a.b@c.de 10.0.0.1 300.1.1.1 no {card} +1 (212) 555-0199 end"
    rows = [(1, text, 1), (2, None, 2), (3, "", 3), (1, text, 1), (None, "x@y.z", 4), (4, "9" * 120_000 + " a@b.c", 5), (5, "word " * 60_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long").repartition(3)
    got = pii.find(docs, {"doc_id": F.col("doc_id"), "extra": F.col("spans")}, field=field).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[1].n_email, by[1].n_ip, by[1].n_card, by[1].n_phone) == (1, 1, 1, 1)
    base = pii.joined(brute(text))
    assert by[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(by[1].spans.split(","))
    for i in (2, 3, 5):
        assert by[i].spans == "" and by[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].spans == "email:120001:120006"
    out = {r.spans: r.text for r in pii.mask(docs, field=field).collect()}
    assert out[1] == "é [EMAIL] [IP] 300.1.1.1 no [CARD] [PHONE] end"
    assert out[2] is None and out[3] == "" and out[4] == "[EMAIL]" and out[6] == "word " * 60_000
    assert pii.find(docs.limit(0), {"doc_id": F.col("doc_id")}, field=field).collect() == []
    assert pii.mask(docs.limit(0), field=field).collect() == []


def unmarked(row):
    return pii._MARKED.sub(lambda m: m.group(2), row), [(pii.KINDS.index(m.group(1)), m.group(2)) for m in pii._MARKED.finditer(row)]


def test_every_training_row_is_found_in_texts(field):
    rows = [unmarked(row) for row in pii.TRAINING]
    quiet = "and some more plain words of a long letter that nobody marks " * 60
    for before, after in (("", ""), (quiet, ""), ("", " " + quiet), (quiet, " " + quiet)):
        texts = [before + text + after for text, _ in rows]
        for text, spans, (_, want) in zip(texts, pii.field_spans(texts, field), rows, strict=True):
            assert [(k, text[a:b]) for k, a, b in spans] == want


def test_addresses_in_words_without_digits(field):
    texts = ["write to jane.doe at example dot com before noon", "mail max [ at ] posteo [ dot ] de now", "mail MAX (AT) POSTEO (DOT) DE now", "meet me at the dotted line"]
    found = [[text[a:b] for _, a, b in spans] for text, spans in zip(texts, pii.field_spans(texts, field), strict=True)]
    assert found == [["jane.doe at example dot com"], ["max [ at ] posteo [ dot ] de"], ["MAX (AT) POSTEO (DOT) DE"], []]
    assert pii.masked(texts[0], pii.all_spans(texts, field)[0][1]) == "write to [EMAIL] before noon"


def test_gate_and_runs_hold_every_plausible_span():
    rng = random.Random(5)
    parts = ["at", "At", "dot", "DOT", "[", "]", "(", ")", "@", ".", ":", " ", " ", "\n", "x", "ab.c", "x-dot.y", "İat", "dotİ", "17", "word", "_", "-"]
    seen = 0
    for _ in range(40_000):
        piece = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))).strip()
        if any(pii._plausible(kind, piece) for kind in pii.KINDS):
            seen += 1
            tokens = pii._TOKEN.findall(piece)
            assert pii._GATE.search(piece) and pii._near(np.array([pii._telling(t) for t in tokens]), 0), piece
    assert seen > 3000


def test_scores_of_runs_are_the_fields(field):
    scorer = pii.Scorer(field)
    for row in pii.TRAINING:
        tokens = pii._labelled(row)[0]
        ids = np.array([0, 0, *map(scorer.kind, tokens), 0, 0])
        mine, before, after, second, shape, _ = scorer.tables()
        x, y = ids[2:-2], ids[1:-3]
        scores = mine[x] + before[y] + after[ids[3:-1]] + second[ids[:-4]] + scorer.pairs[shape[x], shape[y]]
        assert np.allclose(scores, field.scores([pii.token_features(tokens)])[0][0])


@pytest.mark.parametrize("gap", [380, 390, 396, 399, 400, 401])
def test_spans_across_many_tokens_are_whole(field, gap):
    text = "7 and " * (gap // 2) + "mail bob.lee [at] site [dot] net now"
    assert "bob.lee [at] site [dot] net" in [text[a:b] for _, a, b in pii.field_spans([text], field)[0]]


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="no documents")
def test_training_values_are_not_taken_from_the_documents():
    values = [v for row in pii.TRAINING for v in re.findall(r"[0-9A-Za-z]{16,}", unmarked(row)[0]) if re.search("[0-9]", v)]
    texts = [t.lower() for t in pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist() if t]
    assert len(values) >= 8 and [v for v in values if any(v.lower() in t for t in texts)] == []
