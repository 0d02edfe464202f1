"""The pipeline against a brute-force version of its five stages."""

import hashlib
import random
import re
import string

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def prose(seed: int, n: int) -> list[str]:
    dice = random.Random(seed)
    return ["".join(dice.choices(string.ascii_lowercase, k=dice.randint(3, 8))) for _ in range(n)]


PASSAGE = prose(900, 20)
NEAR = [*prose(1, 80)[:-1], "changed"]
PERSONAL = prose(60, 70) + "ask x.y@mail.example.com or 10.1.2.3 not 10.1.2.999 card 4111 1111 1111 1111 call +1 (626) 555-5759 now".split(" ")
DOCS = [(i, " ".join(prose(i, 80))) for i in range(20)] + [
    (30, " ".join(prose(0, 80)).upper()), (31, " ".join(NEAR)), (32, " ".join([*NEAR, "and", "more"])),
    (40, "only a few words"), (41, "z " * 90), (42, None), (43, ""), (44, " \n\t"), (None, " ".join(prose(44, 60))),
    (50, " ".join([*prose(50, 100), *PASSAGE])), (51, " ".join([*prose(51, 400), *PASSAGE[:13]])), (52, " ".join([*prose(52, 60), *PASSAGE[:12]])),
    (60, " ".join(PERSONAL)), (61, "É▁ \U0001f600\t" + " ".join(prose(61, 60))),
]
USUAL = [(1000 + i, " ".join(prose(1000 + i, 60 + i % 40))) for i in range(100)]
ODD = [(2000 + i, " ".join(f"{w}###$$$%%%" for w in prose(2000 + i, 80))) for i in range(2)]


def passes_base_rules(text: str | None) -> bool:
    words = WORD.findall(text or "")
    places: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + d for at in places.values() if len(at) > 1 for k in at for d in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def without_near_duplicates(rows: list) -> list:
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in text))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [r for r, g in zip(rows, group) if r[0] is None or r[0] == least[g]]


def contaminated(text: str, items: list[str | None]) -> bool:
    words = ALNUM.findall(text.lower())
    hit = set()
    for item in items:
        own = ALNUM.findall((item or "").lower())
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        hit |= {p for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for p in range(k, k + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def masked(text: str) -> str:
    spans = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                spans.append((m.start(), no, m.end(), kind))
    out, at = "", 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        else:
            start = at
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "few") for i, t in DOCS] + [(i, t, "en", "many") for i, t in USUAL + ODD]
    ids, texts, langs, sources = zip(*rows)
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs), "source": pa.array(sources), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(table), path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3], pa.int64()), "text": pa.array([" ".join(PASSAGE).title(), None, "!!"])}), path / "benchmark.parquet")
    return str(path)


def test_whole_pipeline(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [r for r in DOCS + USUAL if passes_base_rules(r[1])]
    rows = without_near_duplicates(rows)
    rows = [r for r in rows if not contaminated(r[1], [" ".join(PASSAGE).title(), None, "!!"])]
    kept = {i for i, _ in rows}
    assert not kept & {30, 31, 32, 40, 41, 42, 43, 44, 50} and kept >= {None, 0, 1, 51, 52, 60, 61}
    want = set()
    for i, text in rows:
        ids = model.encode(masked(text))
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids))]
        want.add((i, len(ids), *digest))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("doc_id < 3 or doc_id is null"), folder).columns == docs.columns


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
