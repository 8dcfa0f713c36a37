"""The registered queries over a small folder of tables, against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import test_decontaminate
import test_jaccard
import test_pii
import test_vectors

from transitframe.llm import pii, queries, tokens

BAD = ["scum", "moron", "trash", "idiot"]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    common = {"en": "the of and to in is".split(), "de": "der die und in den von".split()}
    docs, labels = [], []
    for i in range(500):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(common[lang]) if rng.random() < 0.4 else f"{lang}{rng.randrange(900)}" for _ in range(rng.randint(8, 90))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.8
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words if good else [w.upper() + "###" for w in words])
        if i % 50 == 7:
            text += f" mail u{i}@x.de or 10.0.0.{i % 250} now"
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    for i in range(500, 560):
        words = docs[rng.randrange(40)][1].split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words), "en", "s0", 0))
    docs += [(560, None, None, None, None), (561, "", "en", "s1", 0), (562, "?!", "en", "s1", 2)]
    items = [(1, docs[3][1]), (2, "q w e r t z u i o p a s"), (3, docs[9][1][:40])]
    random_vectors = np.random.RandomState(1)
    centres = random_vectors.normal(size=(20, 32))
    vectors = [(i, [float(x) for x in centres[i % 20] + random_vectors.normal(size=32) * (0.05 if i < 60 else 2.0)], i % 4) for i in range(150)]
    return {"documents": docs, "labels": labels, "benchmark": items, "embeddings": vectors}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for name, schema in schemas.items():
        spark.createDataFrame(tables[name], schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def run(spark, folder, number):
    (name,) = [q for q in queries.QUERIES if q.startswith(f"op{number}_")]
    return queries.QUERIES[name](spark, folder).collect()


def fold(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_language(spark, folder, tables):
    rows = run(spark, folder, 1)
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in tables["documents"])
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    lang = {d[0]: d[2] for d in tables["documents"][:500]}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert {r.lang_pred for r in rows if r.doc_id >= 560} == {"und"}


@pytest.mark.parametrize(("number", "place", "cut"), [(2, 1, 0.3), (3, 2, 0.5)])
def test_scores(spark, folder, tables, number, place, cut):
    rows = run(spark, folder, number)
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in tables["documents"])
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    label = {x[0]: x[place] for x in tables["labels"]}
    assert np.mean([r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]) > 0.9


def test_near_vectors(spark, folder, tables):
    rows = run(spark, folder, 4)
    stored = [np.array(v, np.float32).astype(float) for _, v, _ in tables["embeddings"]]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == test_vectors.brute([v[0] for v in tables["embeddings"]], stored)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_decontamination(spark, folder, tables):
    want = test_decontaminate.brute([d[:2] for d in tables["documents"]], tables["benchmark"])
    assert sorted((tuple(r) for r in run(spark, folder, 5)), key=str) == want


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer file")
def test_token_counts(spark, folder, tables):
    lengths = Counter(len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(d[1] or "")) for d in tables["documents"])
    rows = run(spark, folder, 6)
    assert {r.n_tokens: r.n_docs for r in rows} == lengths
    assert all(r.truncated_total == sum(min(x, r.n_tokens) * n for x, n in lengths.items()) for r in rows)


def test_personal_data(spark, folder, tables):
    rows = {r.doc_id: r for r in run(spark, folder, 7)}
    for doc, text, *_ in tables["documents"]:
        base = test_pii.brute(text or "")
        counts = Counter(k for k, *_ in base)
        r = rows[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_mixing(spark, folder, tables):
    size = {d[0]: len((d[1] or "").split()) for d in tables["documents"]}
    source = {d[0]: d[3] for d in tables["documents"]}
    have, got = defaultdict(int), defaultdict(int)
    for doc, n in size.items():
        have[source[doc]] += n
    rows = run(spark, folder, 8)
    assert all(r.n_tokens == size[r.doc_id] and r.source == source[r.doc_id] for r in rows)
    for r in rows:
        got[r.source] += r.n_tokens
    assert sum(got.values()) <= sum(have.values()) and sum(got.values()) > 0.9 * sum(have.values())
    assert all(got[s] <= 1.25 * have[s] + 1 for s in have) and len({(r.doc_id, r.mix_copy) for r in rows}) == len(rows)


def test_jaccard_join(spark, folder, tables):
    got = sorted(tuple(r) for r in run(spark, folder, 9))
    assert got == test_jaccard.brute([d[:2] for d in tables["documents"]], 4, 85)


def test_licences(spark, folder, tables):
    rows = run(spark, folder, 10)
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in tables["documents"])
    assert all(r.licence is None and r.line_licences == "" for r in rows)


def test_whole_licences_and_notices(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = {x.stem: x.read_text() for x in (Path(queries.__file__).parent / "licence_texts").iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    bsd = """Copyright (c) 1999, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this
  list of conditions and the following disclaimer in the documentation and/or
  other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    third = "* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n"
    whole = [(name, text) for name, text in texts.items()] + [(name, " ".join(text.upper().split())) for name, text in texts.items()]
    whole += [("BSD-2-Clause", bsd.format(third="")), ("BSD-3-Clause", bsd.format(third=third)), ("GPL-2.0", texts["GPL-2.0"].split("How to Apply")[0])]
    whole.append(("Apache-2.0", texts["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Jane Doe")))
    notices = [
        ("Apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
        ("LGPL-2.1", "Released under the LGPL v2.1."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("BSD-3-Clause", "This project is licensed under the New BSD Licence"),
        ("AGPL-3.0", "License: GNU Affero General Public License, version 3"),
    ]
    rows = [(text, name, None) for name, text in whole] + [(f"some words\n{text}\nmore", None, name) for name, text in notices]
    rows += [(texts["GPL-3.0"].replace("You may not", "You may"), None, None), ("the apache helicopter, version 2.0", None, None)]
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in run(spark, tmp_path, 10)}
    assert len(got) == len(rows)
    for i, (text, licence, notice) in enumerate(rows):
        assert got[i].licence == licence, text[:80]
        assert notice is None or got[i].line_licences == notice, text
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op10_licences"]).fetchall()
    assert {tuple(r) for r in got.values()} == set(want) and len(want) == len(rows)
