"""Near-duplicate detection by min-max hashing.

Each document's set of word shingles is hashed under 39 permutations, and both the smallest and the
largest value are kept: 78 unbiased values for 39 evaluations. They form 26 bands of three; two sets
at the threshold (0.75) share no band with a probability of about 1e-6 (5e-6 for sets of a few shingles, where
minimum and maximum are not independent). Documents of one word sequence (a 128-bit digest of it) are
one class from the start and one row afterwards.

Links are confirmed on whole sets, word by word. Inside a band's bucket pairs are not all confirmed:
 1. each member against the bucket's smallest member; components of these links;
 2. then only members of different components, compared by a 2,048-byte min-max sketch inside the task
    that holds the bucket; pairs that may reach the threshold are confirmed on whole sets like the rest.
The sketch estimate has a standard deviation of 0.0096 at the threshold and the cut lies 0.06 below it, more
than six of them. A pair is handed on in the first bucket that it shares only.

Members of a bucket with more than BLOCK members outside its largest component are dealt anew for the second step, by an
exact prefix filter: two sets at the threshold have one of their rarest quarter of shingles in common, so only
documents that share such a shingle meet. Texts that share a common part but are not similar (templates, licenses)
meet nowhere any more. Of two components the likeliest pair is confirmed first, the others only if it is no link.

Normalised texts leave the scan only for documents that share a bucket (found with a bit table of bounded size).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._bits import BitTable
from millrace.llm._scratch import staged, without
from millrace.llm.components import connected

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 26, 3
SKETCH = 1024
SKETCH_CUT = 0.69
BLOCK = 2048
#: Documents that a bit table tells apart well enough.
MAX_ENTRIES = 1 << 26


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(seed)
    odd = (random.randint(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    return odd, random.randint(0, 1 << 62, n).astype(np.uint64)


def _extremes(values: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Smallest and largest value under n permutations of each run of values: runs by 2n."""
    out = np.empty((len(starts), 2 * n), np.uint64)
    for i, (odd, salt) in enumerate(zip(*_permutations(n, seed), strict=True)):
        h = (values ^ salt) * odd
        h ^= h >> np.uint64(32)
        out[:, 2 * i] = np.minimum.reduceat(h, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, starts)
    return out


def _sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low bytes of the extremes under SKETCH permutations of each run of values, a few hundred runs at a time."""
    ends = np.concatenate([starts[1:], [len(values)]])
    out = np.empty((len(starts), 2 * SKETCH), np.uint8)
    for a in range(0, len(starts), 256):
        b = min(a + 256, len(starts))
        out[a:b] = _extremes(values[starts[a] : ends[b - 1]], starts[a:b] - starts[a], SKETCH, 12) & np.uint64(255)
    return out


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of each text as hashes, ascending, flat with offsets; and the normalised texts."""
    words = _text.Words(_text.lower(data), offsets)
    rows, texts = words.rows, words.texts()
    if not len(words.hashes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), texts
    size = np.diff(rows)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    rolling = _text.Rolling(words.hashes)
    cuts = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), n)
    at = np.arange(cuts[-1]) - cuts[doc] + rows[:-1][doc]
    hashes = rolling(at, np.minimum(at + k, rows[1:][doc]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(size) + 1)), texts


def _common(x: bytes, y: bytes, k: int) -> tuple[int, int]:
    """Shingles that two normalised texts have in common and in all, by their words."""
    a, b = x.split(b" "), y.split(b" ")
    if len(a) < k or len(b) < k:
        sets = [{tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} for w in (a, b)]
        return len(sets[0] & sets[1]), len(sets[0] | sets[1])
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for w in (*a, *b)), np.int64, len(a) + len(b))
    # A shingle's code is that of its first words and its last, numbered anew each time, so it stays small and exact.
    code = flat
    for i in range(1, k):
        code = np.unique(code[:-1] * np.int64(len(codes)) + flat[i:], return_inverse=True)[1]
    left, right = np.unique(code[: len(a) - k + 1]), np.unique(code[len(a) :])
    same = len(np.intersect1d(left, right, assume_unique=True))
    return same, len(left) + len(right) - same


def _bands(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket of each set in each band."""
    got = _extremes(sets, starts, -(-BANDS * ROWS // 2), 11)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), got.shape[:2])
    for r in range(ROWS):
        h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + got[:, :, r])
    return h


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """id, n (set size), same (digest of the word sequence), buckets (one for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                sets, cuts, texts = _shingle_sets(data, offsets, k)
                size = np.diff(cuts)
                full = np.flatnonzero(size)
                buckets = np.zeros((len(size), BANDS), np.uint64)
                if len(full):
                    buckets[full] = _bands(sets, cuts[:-1][full])
                bounds = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                same = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), same, _text.list_array(_text.signed(buckets[full].ravel()), bounds, pa.int64())], names=["id", "n", "same", "buckets"])

    return _inputs(docs, id_col, text_col).mapInArrow(run, "id long, n long, same binary, buckets array<long>")


def _id_hashes(ids: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_text.signed(_hashed(batch.column(0))))], names=["h"])

    return ids.mapInArrow(run, "h long")


def _hashed(ids: pa.Array) -> np.ndarray:
    return _text.mix(np.ascontiguousarray(np.asarray(ids, np.int64)).view(np.uint64))


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, same, n, text, shingles, sketch, bands) of the wanted documents (id, same), and perhaps of some others.

    text is normalised; shingles are hashes, which choose candidates.
    """
    wanted = staged(wanted, "near-wanted")
    count = wanted.count()
    table = docs.sparkSession.sparkContext.broadcast(BitTable(_id_hashes(wanted.select("id")), count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(table.value.may_hold(_hashed(batch.column(0)))))
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                sets, cuts, texts = _shingle_sets(data, offsets, k)
                full = np.flatnonzero(np.diff(cuts))
                if not len(full):
                    continue
                bounds = np.concatenate([cuts[:-1][full], [cuts[-1]]])
                sketch = _sketches(sets, bounds[:-1])
                held = [[r.tobytes() for r in sketch], [r.tobytes() for r in _bands(sets, bounds[:-1])]]
                texts = [texts[i] for i in full.tolist()]
                same = [blake2b(t, digest_size=16).digest() for t in texts]
                n = pa.array(np.diff(bounds))
                columns = [ids.take(pa.array(full)), pa.array(same, pa.binary()), n, pa.array(texts, pa.binary()), _text.list_array(_text.signed(sets), bounds, pa.int64()), *(pa.array(x, pa.binary()) for x in held)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "same", "n", "text", "shingles", "sketch", "bands"])

    rows = _inputs(docs, id_col, text_col)
    if count > MAX_ENTRIES:
        # More than a table tells apart: the texts that are wanted come by a join.
        rows = rows.join(wanted.select(F.col("id").alias("d_id")).distinct().hint("merge"), F.col("id") == F.col("d_id"), "left_semi")
    found = rows.mapInArrow(run, "id long, same binary, n long, text binary, shingles array<long>, sketch binary, bands binary")
    named = wanted.select(F.col("id").alias("w_id"), F.col("same").alias("w_same"))
    found = found.join(named.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("same") == F.col("w_same")), "left_semi")
    # Rows that repeat an id and its text are one document.
    return staged(found.dropDuplicates(["id", "same"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) with percent or more of their union in common, on whole sets of words."""
    left = sets.select(F.col("id").alias("a_id"), F.col("text").alias("x"), F.col("n").alias("x_n"))
    right = sets.select(F.col("id").alias("b_id"), F.col("text").alias("y"), F.col("n").alias("y_n"))
    joined = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    # A smaller set can have no more than itself in common.
    joined = joined.where(F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                same, both = _common(x.as_py(), y.as_py(), k)
                keep.append(same * 100 >= both * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rare_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, component) for documents (id, component): a bucket for each of a set's rarest shingles.

    Of n shingles, ordered by how many of these documents hold them, the first n - ceil(n * percent / 100) + 1 do: two
    sets at the threshold have one of those in common.
    """
    held = rows.join(sets.select(F.col("id").alias("h_id"), "same", "n", "shingles"), F.col("id") == F.col("h_id")).select("id", "same", "component", "n", F.explode("shingles").alias("shingle"))
    held = staged(held, "near-hot")
    often = held.groupBy(F.col("shingle").alias("f_shingle")).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # A shingle of one document leads to no other, but takes a place among the rarest.
    ranked = held.join(often.hint("merge"), F.col("shingle") == F.col("f_shingle"), "left")
    ranked = ranked.groupBy("id", "same", "component", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("order"))
    prefix = F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return ranked.select("id", "component", F.explode(F.filter(prefix, lambda x: x["often"] > 1)["shingle"]).alias("bucket")).select("bucket", "id", "component").distinct()


def _main_components(rows: DataFrame) -> DataFrame:
    """(s_bucket, main, m, others): a bucket's largest component, its members there and the other members, if there are any."""
    counts = rows.groupBy(F.col("bucket").alias("s_bucket"), "component").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("s_bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("all"))
    return stats.select("s_bucket", "main", "m", (F.col("all") - F.col("m")).alias("others")).where("others > 0")


def _likely_pairs(rows: DataFrame, stats: DataFrame, sketches: DataFrame, percent: int, banded: bool) -> DataFrame:
    """(a, b, x, y, est): pairs of different components (x, y) in a bucket whose sketches may reach the threshold.

    rows: bucket, id, component; stats: their _main_components; sketches by k_id. ``banded``: the buckets are bands.
    Members of a bucket's main component are dealt into blocks, and only its other members, dealt into blocks,
    too, are copied to them: group (p, q) holds block p of the main component and block q of the others (all of them if
    they are one block: q = -1, and then p = 0 compares them with each other); groups of negative p hold two blocks of others.
    """
    held = ["id", "component", "n", "sketch", "bands"]
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    dealt = rows.join(stats, F.col("bucket") == F.col("s_bucket")).withColumn("is_main", F.col("component") == F.col("main")).withColumn("mains", blocks("m")).withColumn("rests", blocks("others"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    group = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    one = F.col("rests") == 1
    to_rests = F.when(one, F.array(group(F.col("own"), F.lit(-1)))).otherwise(F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda q: group(F.col("own"), q)))
    to_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda p: group(p, F.when(one, -1).otherwise(F.col("own"))))
    to_others = F.when(one, F.array().cast("array<struct<p:int,q:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda o: group(-1 - F.least(o, F.col("own")), F.greatest(o, F.col("own")))))
    dealt = dealt.withColumn("g", F.explode(F.when(F.col("is_main"), to_rests).otherwise(F.concat(to_mains, to_others))))
    dealt = dealt.select("bucket", F.col("g.p").alias("p"), F.col("g.q").alias("q"), F.when(F.col("is_main"), -1).otherwise(F.col("own")).alias("block"), "id", "component")
    dealt = dealt.join(sketches, F.col("id") == F.col("k_id")).select("bucket", "p", "q", "block", *held)

    def compare(bucket: int, p: int, q: int, block: np.ndarray, ids: np.ndarray, comps: np.ndarray, size: np.ndarray, sketch: np.ndarray, bands: np.ndarray) -> list[np.ndarray]:
        cut = int(np.ceil((SKETCH_CUT + (percent - PERCENT) / 100) * sketch.shape[1]))
        if p < 0:
            here, there = np.flatnonzero(block == -1 - p), np.flatnonzero(block == q)
        else:
            here = np.flatnonzero(block >= 0)
            there = np.arange(len(block)) if q < 0 and p == 0 else np.flatnonzero(block < 0)
        out: list[list[np.ndarray]] = [[], [], []]
        other, n = sketch[there], size[there]
        for i in here.tolist():
            # A smaller set can have no more than itself in common.
            apart = np.flatnonzero((comps[there] != comps[i]) & (np.minimum(n, size[i]) * 100 >= np.maximum(n, size[i]) * percent))
            if not len(apart):
                continue
            same = np.count_nonzero(other[apart] == sketch[i], axis=1)
            good = same >= cut
            hit, same = there[apart[good]], same[good]
            if banded:
                shared = bands[hit] == bands[i]
                own = bands[i][shared.argmax(axis=1)] == bucket
                hit, same = hit[own], same[own]
            for held, found in zip(out, (np.full(len(hit), i), hit, same), strict=True):
                held.append(found)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            key = np.stack([np.asarray(table.column(k), np.int64) for k in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            if not last:
                rest = table.slice(int(cuts[-2]))
                cuts = cuts[:-1]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = table.slice(x, y - x)
                sketch = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint8).reshape(y - x, -1)
                bands = np.frombuffer(b"".join(part.column(8).to_pylist()), np.int64).reshape(y - x, -1)
                block, ids, comps, size = (np.asarray(part.column(c), np.int64) for c in (3, 4, 5, 6))
                i, j, same = compare(*key[:, x].tolist(), block, ids, comps, size, sketch, bands)
                if len(i):
                    i, j = np.where(ids[i] > ids[j], i, j), np.where(ids[i] > ids[j], j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i], ids[j], comps[i], comps[j], same)], names=["a", "b", "x", "y", "est"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from groups(table if rest is None else pa.concat_tables([rest, table]), False)
        if rest is not None:
            yield from groups(rest, True)

    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return dealt.mapInArrow(run, "a long, b long, x long, y long, est long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id, kept: a row for each input row; ids are integers.

    Words are lower-cased (A-Z). Null and empty texts have no shingles and stay alone. Rows of
    equal sets share a component. Rows that repeat an id are one document, which is linked with all that one of its
    texts is linked with; n_shingles is the row's own. A row without id is linked with nothing, has a null component
    and is kept. component_id is the smallest id reachable by links. An empty table gives an empty result; other
    columns are not read.
    """
    sig = staged(signatures(docs, id_col, text_col, shingle), "near-signatures")
    linked = sig.where("id is not null and n > 0")
    classes = staged(linked.groupBy("same").agg(F.min("id").alias("rep"), F.first("buckets").alias("buckets")), "near-classes")
    rows = classes.select("rep", "same", F.explode("buckets").alias("bucket"))
    shared = staged(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("hub")).where("members > 1").withColumnRenamed("bucket", "s_bucket"), "near-buckets")
    members = staged(rows.join(shared, F.col("bucket") == F.col("s_bucket")).select("bucket", "rep", "same", "hub", "members"), "near-members")
    sets = _sets_of(docs, members.select(F.col("rep").alias("id"), "same").distinct(), id_col, text_col, shingle)

    pairs = members.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    # An id with several texts belongs to the class of each.
    several = linked.groupBy(F.col("id").alias("m_id")).agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x != y").select("m_id")
    several = linked.join(several, F.col("id") == F.col("m_id")).select("id", F.col("same").alias("i_same")).join(classes, F.col("same") == F.col("i_same"))
    links = staged(_confirmed(pairs, sets, percent, shingle).unionAll(several.select(F.col("id").alias("a"), F.col("rep").alias("b"))), "near-links")
    found = connected(links)

    placed = members.join(found, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    placed = staged(placed.select("bucket", F.col("rep").alias("id"), "component"), "near-placed")
    stats = staged(_main_components(placed), "near-open")
    sketches = sets.select(F.col("id").alias("k_id"), "n", "sketch", "bands")
    likely = _likely_pairs(placed, stats.where(F.col("others") <= BLOCK), sketches, percent, True)
    wide = stats.where(F.col("others") > BLOCK).select(F.col("s_bucket").alias("w_bucket"))
    wide = staged(placed.join(wide, F.col("bucket") == F.col("w_bucket")).select("id", "component").distinct(), "near-wide")
    if not wide.isEmpty():
        rare = staged(_rare_buckets(wide, sets, percent), "near-rare")
        likely = likely.unionAll(_likely_pairs(rare, _main_components(rare), sketches, percent, False))
    likely = staged(likely.distinct(), "near-likely")
    # Of two components the likeliest pair first: where it is a link, no other pair of the two can add anything.
    pair = F.struct("est", "a", "b")
    first = likely.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.max(pair).alias("p")).select("p.a", "p.b")
    more = staged(_confirmed(first, sets, percent, shingle), "near-links")
    if not more.isEmpty():
        found = connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    at = lambda c: found.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_now"))
    rest = likely.join(first.select(F.col("a").alias("f_a"), F.col("b").alias("f_b")), (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b")), "left_anti")
    rest = rest.join(at("a"), F.col("a") == F.col("a_node"), "left").join(at("b"), F.col("b") == F.col("b_node"), "left")
    rest = rest.where(F.coalesce("a_now", "a") != F.coalesce("b_now", "b")).select("a", "b").distinct()
    more = staged(_confirmed(rest, sets, percent, shingle), "near-links")
    if not more.isEmpty():
        found = connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("same").alias("c_same"), F.coalesce("component", "rep").alias("named"))
    named = staged(named, "near-named")
    out = sig.join(named, (F.col("same") == F.col("c_same")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("named", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, in the columns of docs."""
    return without(docs, near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(id_col), id_col)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g FROM win),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN both_ways ON seen = a)
SELECT r.node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id, r.node = min(seen) AS kept
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.node GROUP BY r.node
"""
