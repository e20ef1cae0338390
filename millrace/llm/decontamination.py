"""Benchmark decontamination by spaced-seed hashing.

A fixed mask selects some of at most 13 successive words and ignores the others, so a hash of the
selected words survives substitutions at the ignored places. Every overlap that counts agrees under
one of the masks somewhere, so none is missed for want of a hit. Test items and training documents are hashed
under every mask at every position; equal hashes give hits, and around a hit the two word sequences
are laid side by side to count words that agree.

Documents are scanned once. A bit table of bounded size, made of the items' hashes, drops positions that
cannot have a partner; those that stay are joined exactly. With them goes the neighbourhood of the position
(word hashes, as far as the longest item may reach), so that no text is shuffled and no overlap is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._bits import BitTable
from millrace.llm._scratch import staged, without

#: 1 selects a word, 0 ignores it. A greedy cover of the 931 shortest patterns of agreeing and other words
#: that MIN_WORDS and MIN_SHARE admit (those that hold no shorter one; at most 26 words): each holds a mask.
MASKS = ("1111011", "1110100011", "10010010111", "1110000100011", "1100010001011", "101100010101", "1111101")
#: log2 of the bits of the table of seeds: a document has a position and seven masks for each word, so little may slip through.
SEED_BITS = 26
#: An overlap counts from so many agreeing words, if they are such a share of it.
MIN_WORDS = 10
MIN_SHARE = 0.75
#: Bytes that are no part of a word: ASCII but letters, digits and white space.
_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\v\f\r")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case without ASCII punctuation (a word of nothing else is none), and row splits."""
    raw, cuts = data.tobytes(), offsets.tolist()
    held = [raw[a:b].translate(_text.LOWER, _PUNCTUATION) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    data = np.frombuffer(b"".join(held), np.uint8)
    starts, ends, rows = _text.word_bounds(data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))]))
    return _text.word_hashes(data, starts, ends), rows


def _seeds(words: np.ndarray, rows: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the positions where it lies in one text, and their hashes."""
    row_end = np.repeat(rows[1:], np.diff(rows))
    steps = _text.powers(_text._BASE, max(map(len, masks)))
    terms = [words[i:] * step for i, step in enumerate(steps)]
    for mask in masks:
        n = max(len(words) - len(mask) + 1, 0)
        at = np.flatnonzero(np.arange(n) + len(mask) <= row_end[:n])
        yield at, _text.mix(sum(terms[i][:n] for i, x in enumerate(mask) if x == "1") + np.uint64(int(mask, 2)))[at]


def _masks_of(n_words: int) -> tuple[str, ...]:
    """Of an item: one that is too short for MIN_WORDS agreeing words counts where all of it stands, word for word."""
    return MASKS if n_words >= MIN_WORDS else ("1" * n_words,) if n_words else ()


def benchmark_tables(bench: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(hash, item, item_at) of all seeds, and (item, item_words). Items of equal text go as the smallest id."""
    classes = bench.groupBy(F.col(text_col).cast("string").alias("text")).agg(F.min(id_col).cast("long").alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                words, rows = _words(data, offsets)
                yield pa.RecordBatch.from_arrays([ids, _text.list_array(_text.signed(words), rows, pa.int64())], names=["item", "item_words"])

    items = staged(classes.where("item is not null and text is not null").select("item", "text").mapInArrow(run, "item long, item_words array<long>"), "bench-items")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.asarray(words.values, np.int64).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
                masks = _masks_of(len(words))
                if not masks:
                    continue
                at, found = map(np.concatenate, zip(*_seeds(words, np.array([0, len(words)]), masks), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(found)), pa.array(np.full(len(at), item)), pa.array(at.astype(np.int32))], names=["hash", "item", "item_at"])

    return staged(items.mapInArrow(seeds, "hash long, item long, item_at int"), "bench-seeds"), items


def _longest(same: np.ndarray) -> tuple[int, int, int] | None:
    """Start, end and agreeing words of the stretch with most of them (the longer, then the first on ties) that counts as an overlap."""
    starts = np.flatnonzero(same)
    if len(starts) < MIN_WORDS:
        return None
    # A stretch has the share if its sum is not negative; from each start to the last end that keeps it so.
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - MIN_SHARE, -MIN_SHARE))])
    ahead = np.maximum.accumulate(score[::-1])
    last = len(same) - np.searchsorted(ahead, score[starts])
    count = np.concatenate([[0], np.cumsum(same)])
    matched = count[last] - count[starts]
    ends = starts[count[last] - 1] + 1
    k = np.lexsort((-starts, ends - starts, matched))[-1]
    return (int(starts[k]), int(ends[k]), int(matched[k])) if matched[k] >= MIN_WORDS else None


def find_overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified overlaps, a row for each document and item: id_col, item_id, doc_start, n_words, n_matched.

    doc_start and n_words give the stretch with most agreeing words, counted in words that hold more than ASCII
    punctuation; it begins and ends in agreeing words. Null and empty texts and items without id have no overlaps; an item of fewer than MIN_WORDS words
    overlaps where all its words stand one after the other; a document without id is reported with a null id. Rows that repeat an id count as
    one document. Of items of equal text the smallest id stands for all. Empty tables give no rows.
    """
    spark = docs.sparkSession
    seeds, items = benchmark_tables(bench, item_col, item_text_col)
    table = spark.sparkContext.broadcast(BitTable(seeds.select("hash"), seeds.count(), probes=3, least_bits=SEED_BITS))
    reach = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    short = items.where(F.size("item_words").between(1, MIN_WORDS - 1)).select(F.size("item_words").alias("n")).distinct().orderBy("n")
    masks = MASKS + tuple("1" * x.n for x in short.collect())
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                words, rows = _words(data, offsets)
                at, found, ends = [], [], []
                for mask, (places, hashes) in zip(masks, _seeds(words, rows, masks), strict=True):
                    hit = table.value.may_hold(hashes)
                    at.append(places[hit])
                    found.append(hashes[hit])
                    ends.append(places[hit] + len(mask))
                at, found, ends = np.concatenate(at), np.concatenate(found), np.concatenate(ends)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found, ends = at[order], found[order], ends[order]
                row = np.searchsorted(rows, at, "right") - 1
                new = np.concatenate([[True], (np.diff(at) > reach) | (np.diff(row) > 0)])
                first, last = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [len(at)]]) - 1
                begin = np.maximum(at[first] - reach, rows[row[first]])
                end = np.minimum(np.maximum.reduceat(ends, first) + reach, rows[row[first] + 1])
                size = end - begin
                cuts = np.concatenate([[0], np.cumsum(size)])
                flat = words[np.repeat(begin - cuts[:-1], size) + np.arange(cuts[-1])]
                bounds = np.concatenate([first, [len(at)]])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row[first])),
                        pa.array((begin - rows[row[first]]).astype(np.int32)),
                        _text.list_array(_text.signed(flat), cuts, pa.int64()),
                        _text.list_array(_text.signed(found), bounds, pa.int64()),
                        _text.list_array((at - rows[row]).astype(np.int32), bounds, pa.int32()),
                    ],
                    names=["id", "base", "words", "hashes", "places"],
                )

    near = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind}, base int, words array<long>, hashes array<long>, places array<int>")
    near = staged(near.withColumn("spot", F.monotonically_increasing_id()), "bench-near")
    places = near.select("spot", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("spot", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    # All hits of a diagonal are one row: every stretch of it in the spot is looked at.
    hits = places.join(seeds, "hash").select("spot", "item", (F.col("place") - F.col("item_at")).alias("shift")).distinct()
    pairs = hits.join(near.select("spot", "id", "base", "words"), "spot").join(items, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, item, shift, base, words, item_words in zip(*(batch.column(i) for i in range(6)), strict=True):
                s, b = shift.as_py(), base.as_py()
                x, y = np.asarray(words.values), np.asarray(item_words.values)
                begin, end = max(b, s), min(b + len(x), s + len(y))
                same = x[begin - b : end - b] == y[begin - s : end - s]
                overlap = _longest(same) if len(y) >= MIN_WORDS else (0, len(y), len(y)) if len(same) == len(y) and same.all() else None
                if overlap:
                    left, right, matched = overlap
                    out.append((id_.as_py(), item.as_py(), begin + left, right - left, matched))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "item", "doc_start", "n_words", "n_matched"])

    found = pairs.select("id", "item", "shift", "base", "words", "item_words").mapInArrow(verify, f"id {kind}, item long, doc_start long, n_words long, n_matched long")
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_matched", "n_words", (-F.col("doc_start")).alias("before"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), (-F.col("best.before")).alias("doc_start"), F.col("best.n_words").alias("n_words"), F.col("best.n_matched").alias("n_matched"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a verified overlap, in the columns of docs. Rows without id stay."""
    return without(docs, find_overlaps(docs, bench, id_col, text_col).select(id_col), id_col)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
