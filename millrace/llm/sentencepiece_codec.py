"""SentencePiece encoding and decoding through a distinct-chunk table.

White space is marked (U+2581), and in the models that this operator accepts no piece has a marker
after another character. So no merge crosses the place where a marker follows a non-marker: a text
splits there into chunks (markers, then non-markers) that can be segmented each on its own. Every
distinct chunk of a block of documents is segmented once; the ids then go back by position as one
numpy gather. The table stays in the task that reads the documents: a table for all documents
would mean a shuffle of each (document, position, chunk), many times the text, while a block
already repeats most of its chunks. Its size is bounded, and a full table is started anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._text import list_array, text_slices

MARK = "▁"
#: Chunks in a table before it is started anew; a memory bound (some 70 MB), without effect on results.
TABLE_CHUNKS = 400_000
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """The ids of distinct chunks, kept flat; grows by whole blocks."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing or self.model.encode("a", out_type=str)[0][:1] != MARK or self.model.encode(" a  b ") != self.model.encode(f"{MARK}a{MARK}{MARK}b{MARK}"):
            raise ValueError("the model's pieces cross white space, or it normalises white space")
        self.single = self.model.piece_to_id(MARK)
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without its first marker."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Positions of the chunks in the table, which first learns the new ones."""
        code = self.code
        new = [c for c in dict.fromkeys(chunks) if c not in code]
        if new:
            ids = self.model.encode(new, num_threads=1)
            for i, c in enumerate(new):
                code[c] = len(self.bounds) - 1 + i
                if not c:
                    ids[i] = [self.single]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            more = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
            self.flat = np.concatenate([self.flat, more])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return np.fromiter(map(code.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, flat, and their offsets; ``end`` closes each text."""
        if len(self.code) > TABLE_CHUNKS:
            self.reset()
        words = [self.chunks(t) for t in texts]
        codes = self.codes([c for w in words for c in w])
        sizes = self.bounds[codes + 1] - self.bounds[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.bounds[codes] - before[:-1], sizes) + np.arange(before[-1])]
        offsets = before[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])]
        if end is not None:
            out = np.insert(out, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        return out, offsets


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_end: bool = True, decode: bool = True) -> DataFrame:
    """id_col, ids (array of int) and, if asked for, decoded: the library's decoding of these ids.

    A row for each input row, in no order; null and empty texts have no ids but the end id. Rows may
    repeat, ids may be null; other columns are not read. Whole texts of any length.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, ids array<int>" + (", decoded string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        end = table.model.eos_id() if with_end else None
        for batch in batches:
            for ids, data, offsets in text_slices(batch.column(0), batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                flat, bounds = table.encode(texts, end)
                columns = [ids, list_array(flat, bounds, pa.int32())]
                if decode:
                    whole, cuts = flat.tolist(), bounds.tolist()
                    columns.append(pa.array([table.model.decode(whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, model_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
