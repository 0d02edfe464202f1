"""Empty tables, personal data, outliers and bitmaps on small fixtures; test_brute.py has the comparisons with brute force."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quirepack.llm import decontaminate, jaccard, licenses, pieces, pii, quality, sharding, substrings, token_files  # noqa: E402

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, LONG), (6, LONG + " tail"), (7, "x " + LONG), (8, LONG), (9, "z " * 90),
    (10, "Mail bob.x@mail.example.com, 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 +1 (626) 555-5759.\tÉ\u2581 \U0001f600"),
    (11, "Released under the MIT License.\n" + " ".join(f"q{i}" for i in range(36))), (None, "no id"), (12, " \n"), (12, " \n"),
    (13, " ".join(f"v{i}" for i in range(10))), (14, " ".join(f"v{i}" for i in range(11))), (15, " ".join(f"v{i}" for i in range(1, 13))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, kept long").repartition(3)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    for out in (jaccard.op1(none), decontaminate.op2(docs, bench).where("contaminated"), sharding.shard(none, "doc_id", "text", [1.0] * 16), substrings.op4(none), licenses.op6(none), token_files.op7(none, public_tokenizers.path("word_bpe_49k.json")), pieces.op8(none, model), pii.op9(none), quality.op10(none)):
        assert out.count() == 0









def test_personal_data(docs):
    row = pii.op9(docs).where("doc_id = 10").first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    text = pii.redact(docs).where("doc_id = 10").first()["text"]
    assert text.startswith("Mail [EMAIL], 10.0.0.256 [IP] card [CARD] [PHONE].")


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Reach account: user{i}@mail{i}.example.com today") for i in range(6)] + [(9, "Reach account: AB-77123 today")]
    found = {r["doc_id"]: r["spans"] for r in pii.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[9] == "email:15:23"



def test_outliers_are_rejected(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997}" for k in range(60 + i % 40)), "en", "s") for i in range(200)]
    rows += [(900 + i, " ".join(f"w{k}###$$$%%%" for k in range(80)), "en", "s") for i in range(5)]
    kept = {r["doc_id"] for r in quality.op10(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(200))


def test_copies_of_junk_do_not_mask_outliers(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997}" + "x" * (k < i % 60) for k in range(60 + i % 40)), "en", "s") for i in range(120)]
    rows += [(900 + i, " ".join(f"w{k}###$$$%%%" for k in range(80)), "en", "s") for i in range(65)]
    rows += [(990 + i, " ".join(f"v{k}{'#' * (9 + i)}" for k in range(70 + i)), "en", "s") for i in range(6)]
    rows += [(2000 + i, " ".join(f"word{(i * 7 + k) % 997}" + "x" * (k < i % 60) for k in range(60 + i % 40)), "en", "t") for i in range(120)]
    rows += [(2900 + i, " ".join(f"v{k}" + "#" * (2 + (k + i) % 3) for k in range(60 + i % 35)), "en", "t") for i in range(80)]
    kept = {r["doc_id"] for r in quality.op10(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {*range(120), *range(2000, 2120)}


def test_moderate_symbols_and_table_junk_are_rejected(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997}" + "x" * (k < i % 60) for k in range(60 + i % 40)), "en", "s") for i in range(200)]
    rows += [(900 + i, " ".join(f"word{(i * 7 + k) % 997}" + "#" * (k % 2) for k in range(70 + i)), "en", "s") for i in range(5)]
    rows += [(950 + i, "\n".join(f"cell{i * 7 + k} row{k} |" for k in range(40 + i)), "en", "s") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.op10(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, r in got.items() if r["kept"]} == set(range(200))
    assert all(92 < r["d2"] < 400 for i, r in got.items() if i >= 900)


def test_parity_bitmaps_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64 - 1, 4000, dtype=np.uint64, endpoint=True)
    sets = [np.sort(rng.choice(pool, k, replace=False)) for k in (0, 1, 5, 60, 200, 350, 1100, 3000)]
    raw, ends, folds = jaccard.parities(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    whole = [raw[a:b].view(np.uint64) for a, b in zip(ends[:-1], ends[1:])]
    assert [len(w) * 64 for w in whole] == [256, 256, 256, 256, 256, 512, 2048, 4096]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = len(set(x.tolist()) ^ set(y.tolist()))
            folded = int(np.bitwise_count((folds[i] ^ folds[j]).view(np.uint64)).sum())
            assert folded <= jaccard.bits_apart(whole[i], whole[j]) <= apart == jaccard.shingles_apart(x, y)
