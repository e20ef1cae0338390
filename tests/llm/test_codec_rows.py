"""Encoding of awkward rows: null and repeated ids, clashing names, a full table, very long texts."""

import random

import sentencepiece
from millrace.llm import sentencepiece_codec as spm


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(spm, "TABLE_CHUNKS", 5)  # in this process only; workers keep theirs
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    rows = [(None, "a b"), (1, "a b"), (1, "c  d"), (2, long), (3, None), (4, ""), (5, "x" * 20_000)]
    df = spark.createDataFrame([(*x, "n", 0) for x in rows], "doc_id long, text string, ids string, id int")
    model = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    got = sorted(((x.doc_id, list(x.ids), x.decoded) for x in spm.encode_documents(df, spm.model_path()).collect()), key=str)
    want = [(i, model.encode(t or "", add_eos=True)) for i, t in rows]
    assert got == sorted([(i, ids, model.decode(ids)) for i, ids in want], key=str)
    table = spm.ChunkTable(spm.model_path())
    for _, t in rows:  # a table that is started anew at each text
        assert table.encode([t or ""], None)[0].tolist() == model.encode(t or "")
