"""Maps over Arrow batches: what a worker holds of a batch's results."""

import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quirepack.llm import pieces  # noqa: E402

MOST = 1 << 20


@pytest.mark.parametrize("operator", [pieces.encoded, pieces.op8, pieces.encode])
def test_results_of_a_large_batch_are_given_back_in_parts(spark, monkeypatch, operator):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    dice = random.Random(7)
    pool = ["".join(dice.choices("abcdefghij é", k=dice.randint(1, 9))) for _ in range(3000)]
    texts = [None, *(" ".join(dice.choices(pool, k=300)) for _ in range(1500)), " ".join(dice.choices(pool, k=250_000)), "", None, "the last one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    seen = []
    df = spark.createDataFrame(rows[:1] + rows[-1:], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: seen.append((run, schema)) or self)
    operator(df, path)
    (run, schema), = seen
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = list(run(iter([batch.slice(0, 0), batch])))
    assert all(o.schema.names == schema.names for o in out)
    # texts come back only from the operator that adds to them
    assert ("text" in schema.names) == (operator is pieces.encode)
    assert [i for o in out for i in o.column("doc_id").to_pylist()] == list(range(len(texts)))
    sizes, first = [len((t or "").encode()) for t in texts], 0
    assert sum(sizes) > 4 * MOST and max(sizes) > MOST
    for o in out:
        own = sizes[first : first + o.num_rows]
        assert sum(own) <= MOST or len(own) == 1
        first += o.num_rows
    want = [model.encode(t or "") for t in texts]
    if "ids" in schema.names:
        assert [i for o in out for i in o.column("ids").to_pylist()] == want
    if "n_tokens" in schema.names:
        assert [n for o in out for n in o.column("n_tokens").to_pylist()] == [len(x) for x in want]
