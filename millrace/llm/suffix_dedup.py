"""Removal of repeated byte strings with a suffix array built by two-stage sorting.

``windows`` brings together the contents whose 200-byte windows may be equal, in blocks. Within a
block the suffixes that start a window are sorted in two stages: those smaller than their successors
are sorted directly; a scan of the buckets (first bytes) from left to right then puts each of the
rest before its bucket's next free place, right when its successor is met. Adjacent suffixes with
a common prefix of 200 bytes or more start repeated windows, and so does a suffix that stands for
several copies of its content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm.windows import Plan, merged, repeated_windows

SIZE = 200
GRAM = 72
#: Ends a content; no byte of UTF-8 has this value.
_END = 0xFF


def suffix_order(text: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes in order of at least their first ``depth`` bytes.

    Each run of needed places ends at a suffix smaller than its successor; the text goes on for at
    least ``depth`` bytes after the last of them.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    upto = np.searchsorted(change, np.arange(n))
    rising = np.zeros(n, bool)
    inside = upto < len(change)
    turn = change[upto[inside]]
    rising[inside] = text[turn] < text[turn + 1]

    direct = np.flatnonzero(need & rising)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[direct])
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    falling = need & ~rising
    below = np.bincount(text[falling], minlength=256)
    above = np.bincount(text[direct], minlength=256)
    heads = np.concatenate([[0], np.cumsum(below + above)])[:256]
    order = np.empty(int(below.sum() + above.sum()), np.int64)
    byte = text[direct]
    firsts = np.concatenate([[0], np.cumsum(above)])[:256]
    order[(heads + below)[byte] + np.arange(len(direct)) - firsts[byte]] = direct
    if below.any():
        places, head, letters, induced = order.tolist(), heads.tolist(), text.tolist(), falling.tolist()
        for r in range(len(places)):
            i = places[r] - 1
            if i >= 0 and induced[i]:
                c = letters[i]
                places[head[c]] = i
                head[c] += 1
        order = np.array(places, np.int64)
    return order


def repeated_starts(contents: list[bytes], docs: np.ndarray, cores: np.ndarray, many: np.ndarray, size: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Offsets of windows of each content that also start elsewhere in the block, or whose content has further copies."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.frombuffer(bytes([_END]).join(contents) + bytes([_END]) * (size + 2), np.uint8)
    n = len(text)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + sizes - size + 1, -1)
    window = np.cumsum(edges)[:n] > 0
    # Behind a content's last window, take suffixes up to one that is smaller than its successor.
    change = np.flatnonzero(text[1:] != text[:-1])
    turn = change[text[change] < text[change + 1]]
    last = starts + sizes - size
    stop = turn[np.searchsorted(turn, last)]
    np.add.at(edges, starts + sizes - size + 1, 1)
    np.add.at(edges, stop + 1, -1)
    need = np.cumsum(edges)[:n] > 0
    order = suffix_order(text, need, size)
    view = np.lib.stride_tricks.sliding_window_view(text, size)
    both = np.flatnonzero(window[order[:-1]] & window[order[1:]]) if len(order) > 1 else np.zeros(0, np.int64)
    hit = np.zeros(n, bool)
    for at in range(0, len(both), 16384):
        p, q = order[both[at : at + 16384]], order[both[at : at + 16384] + 1]
        close = text[p + size - 1] == text[q + size - 1]
        p, q = p[close], q[close]
        prefix = np.where((same := view[p] == view[q]).all(axis=1), size, same.argmin(axis=1))
        hit[p[prefix >= size]] = True
        hit[q[prefix >= size]] = True
    # A suffix of a content with further copies lies next to theirs in the order of all.
    own = order[window[order]]
    hit[own[many[np.searchsorted(starts, own, "right") - 1]]] = True
    places = np.flatnonzero(hit)
    owner = np.searchsorted(starts, places, "right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for offsets in np.split(places, cuts) if len(places) else []:
        member = int(np.searchsorted(starts, offsets[0], "right")) - 1
        yield member, False, offsets - starts[member]


def _plan(size: int) -> Plan:
    return Plan(size=size, gram=max(1, size * GRAM // SIZE), words=False, earlier=False, kernel=repeated_starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id_col, n_bytes, spans (removed runs of bytes) and kept (the other bytes), a row for each input row.

    Each byte covered by a ``size``-byte string that also starts anywhere else is removed, overlaps
    and further places in the same text included. Null and empty texts have nothing to remove; nor has a
    row without id, which is compared with nothing. Rows that repeat an id, with the same text or another, are
    places like others. An empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = repeated_windows(rows, _plan(size)).withColumnsRenamed({"id": "s_id", "mark": "s_mark"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                held = [merged(x) for x in batch.column(2).slice(at, len(ids)).to_pylist()]
                at += len(ids)
                raw, cuts = data.tobytes(), offsets.tolist()
                removed, kept = [], []
                for a, b, runs in zip(cuts[:-1], cuts[1:], held, strict=True):
                    edge, parts = a, []
                    for x, y in runs:
                        parts.append(raw[edge : a + x])
                        edge = a + y
                    parts.append(raw[edge:b])
                    removed.append([{"start": x, "end": y} for x, y in runs])
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offsets)), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "spans", "kept"],
                )

    joined = rows.join(spans.hint("merge"), (F.col("id") == F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("id", "text", "spans")
    out = joined.mapInArrow(run, "id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT))) AS s FROM b),
grams AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS g FROM win),
often AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
dup AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM grams SEMI JOIN often USING (g)),
runs AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM dup),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS z FROM runs GROUP BY doc_id, run),
held AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
parts AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS front, max(z) AS z, count(*) AS n, sum(z - a) AS removed FROM held JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(z, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN parts ON parts.doc_id = b.doc_id
"""
