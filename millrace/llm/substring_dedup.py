"""Removal of repeated word windows by relative Lempel-Ziv parsing.

``windows`` routes stretches of documents to the reference blocks that can share a window with them.
In a block the texts are taken by id; each is parsed greedily against an index of all windows of
the smaller ids: a match is extended as far as its reference agrees, word by word, and the factor is kept if
it has 50 words or more. Parsing goes on at the first window that the factor does not contain, so windows
across factor boundaries are looked up, too. A content that has copies in later documents is
parsed once more in their place, with itself among the references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm.windows import Plan, merged, repeated_windows

SIZE = 50
GRAM = 20


def _parse(own: np.ndarray, hashes: list[int], index: dict[int, tuple[int, int]], values: list[np.ndarray], size: int) -> np.ndarray:
    """Offsets of the windows inside factors of ``size`` words or more."""
    found, i = [], 0
    while i < len(hashes):
        hit = index.get(hashes[i])
        if hit is None:
            i += 1
            continue
        ref, place = hit
        n = min(len(own) - i, len(values[ref]) - place)
        differ = np.flatnonzero(own[i : i + n] != values[ref][place : place + n])
        length = int(differ[0]) if len(differ) else n
        if length < size:
            i += 1
            continue
        found.append(np.arange(i, i + length - size + 1))
        i += length - size + 1
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def factors(contents: list[bytes], docs: np.ndarray, cores: np.ndarray, many: np.ndarray, size: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Offsets of windows of each content that also start in a content of smaller id, block by block.

    Contents are words joined by spaces. For those with ``many``, the windows of their copies in later documents, too.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cores)) + 1, [len(cores)]])
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if docs[begin] == docs[end - 1] and not many[begin:end].any():
            continue
        codes: dict[bytes, int] = {}
        values = [np.array([codes.setdefault(w, len(codes)) for w in c.split(b" ")], np.uint64) for c in contents[begin:end]]
        hashes = [_text.Rolling(_text.mix(v + np.uint64(1))).grams(size).tolist() for v in values]
        index: dict[int, tuple[int, int]] = {}
        indexed = 0

        def learn(to: int) -> None:
            nonlocal indexed
            for ref in range(indexed, to):
                for place, h in enumerate(hashes[ref]):
                    index.setdefault(h, (ref, place))
            indexed = to

        first = 0
        for m, own in enumerate(values):
            if docs[begin + m] != docs[begin + first]:
                first = m
                learn(m)
            found = _parse(own, hashes[m], index, values, size)
            if len(found):
                yield begin + m, False, found
        learn(len(values))
        for m in np.flatnonzero(many[begin:end]).tolist():
            found = _parse(values[m], hashes[m], index, values, size)
            if len(found):
                yield begin + m, True, found


def _plan(size: int) -> Plan:
    return Plan(size=size, gram=max(1, size * GRAM // SIZE), words=True, earlier=True, kernel=factors)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id_col, n_words, spans (removed runs of words) and kept (the other words, joined by spaces).

    A row for each input row. A word goes if a window of ``size`` words that covers it also starts in a
    document of smaller id. Null and empty texts have no words; a row without id is compared with
    nothing and stays whole. Rows that repeat an id, with the same text or another, are compared with smaller ids
    only. An empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = repeated_windows(rows, _plan(size)).withColumnsRenamed({"id": "s_id", "mark": "s_mark"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                words = _text.Words(data, offsets)
                held = [merged(x) for x in batch.column(2).slice(at, len(ids)).to_pylist()]
                at += len(ids)
                counts, cuts = np.diff(words.rows), words.rows.tolist()
                pieces = [[*((x, y) for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), n], strict=True) if x < y)] for runs, n in zip(held, counts.tolist(), strict=True)]
                flat = np.array([(a + x, a + y) for a, runs in zip(cuts[:-1], pieces, strict=True) for x, y in runs], np.int64).reshape(-1, 2)
                parts = iter(words.cut(flat[:, 0], flat[:, 1]))
                kept = [b" ".join(next(parts) for _ in runs).decode() for runs in pieces]
                removed = [[{"start": x, "end": y} for x, y in runs] for runs in held]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                    names=["id", "n_words", "spans", "kept"],
                )

    joined = rows.join(spans.hint("merge"), (F.col("id") == F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("id", "text", "spans")
    out = joined.mapInArrow(run, "id long, n_words long, spans array<struct<start long, end long>>, kept string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w),
grams AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS g FROM win),
least AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY g),
dup AS (SELECT doc_id, s FROM grams JOIN least USING (g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM dup, range(50) t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
