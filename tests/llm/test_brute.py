"""Every operator's query against brute force: nulls, ties, repeats, long texts, several blocks and clashing columns."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import brute  # noqa: E402

from quirepack.llm import decontaminate, jaccard, licenses, pieces, pii, quality, queries, sharding, substrings, token_files, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept long, __hit long, __row string, c0 string, f_length long, hit_words string, n_words string"
LONG = " ".join(f"l{i % 7001}" for i in range(20000))
PASSAGE = [f"p{i}" for i in range(70)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, 1, "r", "c", 3, "h", "w") for i, t in rows], SCHEMA).repartition(parts)


def words(dice, n, most=3000):
    return [f"w{dice.randint(0, most)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(3)
    rows = []
    for i in range(160):
        body = words(dice, dice.randint(0, 120))
        if i % 2:
            at = dice.randint(0, 35)
            body += PASSAGE[at : at + dice.randint(30, 70)] + words(dice, dice.randint(0, 60))
        rows.append((i, " ".join(body)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    for i in range(60):  # near copies, some just over the rule and some just under
        body = rows[i][1].split()
        for _ in range(dice.randint(0, 4)):
            if body:
                body[dice.randrange(len(body))] = "new"
        rows.append((2000 + i, " ".join(body)))
    return [*rows, (None, None), (None, "no id"), (7, ""), (7, ""), (8, "z " * 200), (9, "a b " * 300), (10, " ".join(f"q{i % 50}" for i in range(500))), (11, LONG), (12, LONG + " more"), (13, " \n\t")]


def test_jaccard(spark, texts):
    assert Counter(map(tuple, jaccard.op1(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())) == brute.components(texts, 4, 85, 100)


def test_jaccard_of_many_near_copies_in_long_lists(spark):
    dice = random.Random(8)
    core = words(dice, 60)
    rows = []
    for i in range(150):  # a group whose members differ in places of their own, and sets that share a few shingles only
        body = list(core)
        for _ in range(i % 4):
            body[dice.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(body)))
        rows.append((500 + i, " ".join(core[:6] + words(dice, 20 + i % 30))))
    assert Counter(map(tuple, jaccard.op1(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())) == brute.components(rows, 4, 85, 100)


@pytest.mark.parametrize("most_runs", [1 << 14, 16, 1])
def test_substrings(spark, texts, most_runs):
    got = substrings.with_kept(frame(spark, texts), most_runs=most_runs)
    assert tuple(got.select("key", "__row", "c0", "hit_words").first()) == ("k", "r", "c", "h")
    assert Counter(map(tuple, got.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)").collect())) == brute.substrings(texts)


def test_longest_matches_are_those_of_a_plain_search():
    dice = random.Random(4)
    runs = [[dice.randint(0, 2) for _ in range(dice.randint(1, 26))] for _ in range(60)]
    run_of = np.repeat(np.arange(len(runs)), list(map(len, runs)))
    hashes = np.array(sum(runs, []), np.uint64)
    own = substrings.Reference(np.zeros(len(hashes), np.uint64), run_of, hashes)

    def common(x, y):
        n = 0
        while max(x, y) + n < len(hashes) and run_of[x + n] == run_of[x] and run_of[y + n] == run_of[y] and hashes[x + n] == hashes[y + n]:
            n += 1
        return n

    for x in range(len(hashes)):
        assert own.longest[x] == max(common(x, y) for y in range(len(hashes)) if y != x)
        assert not own.longest[x] or common(x, own.match[x]) == own.longest[x] and own.match[x] != x


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_decontamination(spark, texts, block_bytes):
    dice = random.Random(5)
    few = ["a", "b", "c", "É", "d1"]
    docs = texts + [(3000 + i, " ".join(dice.choices(few, k=dice.randint(0, 60)))) for i in range(100)] + [(4000, "a " * 20000)]
    bench = [(i % 40, " ".join(dice.choices(few, k=dice.randint(0, 40)))) for i in range(50)] + [(None, "b c"), (77, None), (78, "!!"), (79, " ".join(dice.choices(few, k=400))), (79, "x"), (80, " ".join(PASSAGE).upper())]
    found = decontaminate.find(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes)
    items = "sha2(cast(array_join(array_sort(hit_items), ',') as binary), 256)"
    got = found.selectExpr("doc_id", "n_words", "size(hit_words)", "size(hit_items)", items, "size(hit_words) > 0 and 20 * size(hit_words) >= n_words")
    assert Counter(map(tuple, got.collect())) == brute.contamination(docs, bench)


def test_clean_rows_keep_their_columns(spark):
    rows = frame(spark, [(1, "clean text"), (2, " ".join(PASSAGE)), (None, None)])
    got = decontaminate.decontaminate(rows, spark.createDataFrame([(1, " ".join(PASSAGE))], "item_id long, text string"))
    assert got.columns == rows.columns and {(r["doc_id"], r["hit_words"], r["n_words"], r["__hit"]) for r in got.collect()} == {(1, "h", "w", 1), (None, "h", "w", 1)}


def test_judged_rows_keep_their_columns(spark):
    got = quality.judge(frame(spark, [(i, " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(60 + i % 40))) for i in range(90)]))
    assert got.where("kept and f_length = 3 and c0 = 'c' and d2 is not null and n_words >= 60 and estimate_depth = 2").count() == 90


def test_no_benchmark(spark, texts):
    got = decontaminate.op2(frame(spark, texts), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(texts) and not any(r["contaminated"] or r["n_items"] for r in got)


def test_shards(spark, texts):
    rows = sharding.shard(frame(spark, texts), "doc_id", "text", [1.0] * 16, [1.0] * 17).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute.shard_of(i, [1.0] * 16), brute.shard_of(i, [1.0] * 17)) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_heavier_shards_get_more(spark):
    rows = sharding.shard(frame(spark, [(i, "") for i in range(4000)]), "doc_id", "text", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    counts = {r["shard"]: r["count"] for r in rows}
    assert set(counts) == {0, 1} and 2700 < counts[1] < 3300


def archived(pages):
    best = {}
    for i, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = Counter()
    for i, h in pages:
        data, to = (h or "").encode(), best.get(h or "")
        revisit = to is not None and i != to
        out[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


@pytest.mark.parametrize("file_bytes", [24 << 20, 3000])
def test_archives(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    pages = [(i, f"<html><body>page {i % 30} {'text ' * (i % 9)}</body></html>") for i in range(90)] + [(200, None), (201, ""), (None, "lone"), (None, None), (300, "é" * 40000), (5, "again"), (5, "again"), (6, "again")]
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in pages], "page_id long, url string, html string, payload string").repartition(2)
    got = Counter(map(tuple, warc.op5(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == archived(pages)


def test_no_pages(spark):
    assert warc.op5(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("count", [1, 5, 60])
def test_each_archive_has_a_dictionary_that_its_records_need(count):
    import struct

    import zstandard

    own = [warc.record(i, "http://a.example/", b"<html>some page with words</html>" * 3 + bytes([i]), None) for i in range(count)]
    parts = list(warc.file_parts(own))
    magic, size = struct.unpack("<II", parts[0][:8])
    assert magic == 0x184D2A5D and size == len(parts[0]) - 8 > 0 and len(parts) == count + 1
    assert list(warc.records(b"".join(parts))) == own
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(parts[1])
    assert sum(map(len, parts[1:])) < sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in own)


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").repartition(1)
    manifest = warc.write(pages, str(tmp_path))
    (tmp_path / "part-0000000-00009.warc.zst").write_bytes(b"".join(warc.file_parts([warc.record(77, "u", b"stale", None)])))
    assert {r["page_id"] for r in warc.read(spark, str(tmp_path), manifest).collect()} == set(range(20))
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path), manifest.selectExpr("concat('x', file) as file", "records"))
    with pytest.raises(Exception, match="not whole"):
        warc.read(spark, str(tmp_path), manifest.selectExpr("file", "records + 1 as records")).collect()


def test_token_files(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), dict(x for x in texts if x[0] is not None)
    own |= {-5: "É é İ don't <|endoftext|> ﬁne \x85 ǅ٣12", -4: "CAFÉ ÑANDÚ Größe"}
    want, at = [], 0
    for i in sorted(own):
        ids = np.array([*tokenizer.encode(own[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    monkeypatch.setattr(token_files, "FILE_BYTES", 20000)
    docs = frame(spark, own.items())
    assert sorted(map(tuple, token_files.op7(docs, path).collect())) == want
    # documents are found by the index alone, with the dictionary of their file
    manifest = token_files.write(docs, str(tmp_path), path, 2).collect()
    assert len(manifest) > 3 and sum(r["documents"] for r in manifest) == len(own)
    for r in manifest:
        data = (tmp_path / r["file"]).read_bytes()
        file = token_files.IdFile(data)
        assert len(file) == r["documents"] and file.total == r["ids"]
        key, offset, length, n = file.entry(len(file) - 1)
        assert file.document(len(file) - 1).tolist() == [*tokenizer.encode(own[key] or "", add_special_tokens=False).ids, 2] and n == len(file.document(len(file) - 1))
        assert int.from_bytes(data[12:16], "little") > 0
        with pytest.raises(ValueError, match="hash"):
            token_files.IdFile(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_pieces(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in texts:
        ids = model.encode(t or "")
        want[i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(model.decode(ids))] += 1
    assert Counter(map(tuple, pieces.op8(frame(spark, texts), path).collect())) == want
    assert {r["doc_id"]: list(r["ids"]) for r in pieces.encoded(frame(spark, [(1, "ab c"), (2, None)]), path).collect()} == {1: model.encode("ab c"), 2: []}


@pytest.fixture(scope="module")
def personal():
    dice = random.Random(1)
    parts = ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (626) 555-5759", "é", "😀", "\n", "x", "12", "..", "@", "+", "(", ")", "-", "1.2.3.4.5.6.7.8", "bob@localhost", "999.1.1.1", "q@w.e.r", "0004.010.7.255"]
    rows = [(i, "".join(dice.choice(parts) + dice.choice([" ", "", ". ", "  "]) for _ in range(dice.randint(0, 60)))) for i in range(150)]
    rows += [(500, " ".join(f"w{i}1" for i in range(20000))), (501, " ".join(dice.choices(parts, k=20000))), (502, None), (503, ""), (504, "0." * 5000), (505, "+1" * 5000), (506, "a@" * 5000)]
    return rows + [(None, rows[3][1]), (3, rows[3][1])]


def test_base_spans_and_redaction(spark, personal):
    docs = frame(spark, personal)
    want = Counter()
    for i, t in personal:
        spans = brute.base_spans(t)
        want[i, *(sum(s[3] == k for s in spans) for k in brute.KINDS), brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))] += 1
    got = pii.op9(docs)
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    for r in pii.redact(docs.where("doc_id < 100 or doc_id = 501 or doc_id = 502")).collect():
        text, out, at = r["text"], "", 0
        original = dict(personal)[r["doc_id"]]
        if original is None:
            assert text is None
            continue
        for s in filter(None, spans[r["doc_id"]].split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += original[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert text == out + original[at:] and (r["key"], r["__row"], r["c0"], r["n_words"]) == ("k", "r", "c", "w")


def test_patterns_bootstrap_from_instances_to_further_patterns(spark):
    rows = [(i, f"Reach account: user{i}@mail{i}.example.com today") for i in range(6)]
    rows += [(10 + i, f"account: ZX-{i}001 and then client ZX-{i}001 here") for i in range(4)]
    rows += [(20, "the client QQ-999 there"), (21, "account: bob@localhost yes"), (22, "no label 4711 here"), (23, "client\nRR-1 after a line end")]
    rows += [(30 + i, f"call phone: +1 (626) 555-57{i}9 now") for i in range(9)] + [(40, "my phone: (555) 123-4567 ok"), (41, "phone:555 123 4567 ok"), (42, "phone " + "x" * 300 + "phone 12 34")]
    found = {r["doc_id"]: r["spans"] for r in pii.op9(frame(spark, rows)).collect()}
    # the second round: 'client' stands before instances that only 'account' has shown
    assert found[10] == "email:9:16,email:33:40" and found[20] == "email:11:17"
    assert found[21] == "email:9:22" and found[22] == found[23] == ""
    assert found[40] == "phone:10:24" and found[41] == "phone:6:18" and found[42] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert text[40] == "my phone: [PHONE] ok" and text[20] == "the client [EMAIL] there" and text[22] == "no label 4711 here"


def test_base_statistics(spark, texts):
    rows = texts + [(6000, "a\n\n a\na \nb\nb\nb"), (6001, "# * $ %&|<> é# " * 20), (6002, "x y z " * 30 + "\n"), (6003, "\f\v one\ntwo \n")]
    got = quality.op10(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute.statistics(t)) for i, t in rows)


def test_estimates_equal_a_plain_version(spark):
    dice = random.Random(6)
    rows = []
    for i in range(260):
        size = dice.randint(60, 400)
        body = ["".join(dice.choices("abcdefgh", k=dice.randint(2, 9))) for _ in range(size)]
        if i % 11 == 0:
            body = [w + "#" * dice.randint(0, 3) for w in body]
        lang, source = ("en", "a") if i < 100 else ("en", "few") if i < 130 else ("de", "b") if i < 150 else ("fr", None)
        rows.append((i, "\n".join(" ".join(body[k : k + 12]) for k in range(0, size, 12)), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    points = {i: brute.features(brute.statistics(t)) for i, t, *_ in rows if not brute.statistics(t)[5]}
    p = len(quality.FEATURES)
    settings = (quality.FLOORS, quality.STARTS, quality.STEPS, quality.SEARCH_STEPS, quality.COVERAGE, (quality.RIM, quality.chi_square(quality.RIM, p)), lambda share: quality.consistency(share, p))
    group = {i: (x, s) for i, _, x, s in rows}
    # a source of its own, a small source by its language, a small language by all rows
    for own, depth, of in ((("en", "a"), 2, lambda i: group[i] == ("en", "a")), (("en", "few"), 1, lambda i: group[i][0] == "en"), (("de", "b"), 0, lambda i: True), (("fr", None), 2, lambda i: group[i] == ("fr", None))):
        fitted = [i for i in points if of(i)]
        near = dict(zip(fitted, brute.mcd_distances([points[i] for i in fitted], *settings)))
        for i in points:
            if group[i] == own:
                assert got[i]["estimate_depth"] == depth
                assert got[i]["d2"] == pytest.approx(near[i], rel=1e-6, abs=1e-6)
    assert any(not r["kept"] and not r["base_failed"] for r in got.values()) or max(r["d2"] or 0 for r in got.values()) > 20


def test_chi_square_quantiles():
    # table values
    assert quality.chi_square(0.5, 5) == pytest.approx(4.3515, abs=1e-4) and quality.chi_square(0.999, 5) == pytest.approx(20.515, abs=1e-3) and quality.chi_square(0.975, 5) == pytest.approx(12.8325, abs=1e-4)


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2015, The Foo Project
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of The Foo Project nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Copyright 2019 Some One
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import x
"""
AGPL = """/* foo
 * Copyright (C) 2020 A
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU Affero General Public License for more details.
 */"""
GPL2 = AGPL.replace("Affero ", "").replace("Foundation, either version 3", "Foundation; either version 2")
ISC = """Copyright 2001 X

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
LICENSED = [
    (1, MIT, "MIT"), (2, BSD3, "BSD-3-Clause"), (3, BSD, "BSD-2-Clause"), (4, APACHE, "Apache-2.0"), (5, AGPL, "AGPL-3.0-or-later"), (6, GPL2, "GPL-2.0-or-later"), (7, ISC, "ISC"),
    (8, "// SPDX-License-Identifier: MIT\nint x;", "MIT"), (9, MIT + "\n\n" + BSD3, "BSD-3-Clause,MIT"), (10, MIT[:300], ""), (11, None, ""), (12, "", ""), (13, "x " * 50000 + "\nReleased under the MIT License.\nfoo", "MIT"),
    (14, "some text\nLicensed under CC BY-NC 4.0.\nmore", "CC-BY-NC-4.0"), (15, "/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), (16, BSD3 + "\n" + BSD, "BSD-2-Clause,BSD-3-Clause"), (17, MPL, "MPL-2.0"), (17, MPL, "MPL-2.0"),
    (18, "We like the permission to copy, and the licence of poets.", ""), (None, "Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
]


def test_licences(spark):
    got = licenses.op6(frame(spark, [(i, t) for i, t, _ in LICENSED])).collect()
    assert Counter((r["doc_id"], r["licenses"]) for r in got) == Counter((i, x) for i, _, x in LICENSED)


def test_earlier_rules_take_sentences_from_later_ones(spark):
    sentences, text = {"a": ("Alpha licence.",), "b": ("Beta licence.",)}, "Alpha licence. Beta licence. Alpha licence."
    both, one = ("Both", ["a", "b"]), ("One", ["a"])
    for rules, want in (([both, one], ["Both", "One"]), ([one, both], ["One"])):
        assert licenses.scan(frame(spark, [(1, text)]), rules=rules, sentences=sentences).first()["licenses"] == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    got = queries.queries()[name](spark, folder)
    with duckdb.connect() as db:
        for table in ("documents", "pages", "benchmark"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        rows = lambda table: sorted(map(repr, table))
        assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
