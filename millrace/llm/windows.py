"""Windows of a fixed size that occur more than once, over all documents.

A window (so many bytes or words) is found by its anchor: the run of ``gram`` units with the smallest
hash inside it. Equal windows have equal anchors, so only documents that share an anchor need to
meet. Successive windows with one anchor form a stretch (the windows' union); stretches, not
windows, are what is compared:

 1. scan: hashes of anchors; a partial aggregation finds those that occur more than once;
 2. scan: stretches of repeated anchors as (anchor, digest of the content), aggregated to kinds: how
    often, and the smallest and largest document. A kind is open if it occurs more than once or its anchor has
    several kinds;
 3. scan: one stretch of each open kind, with its count, goes through the kernel, which alone says which windows
    are repeated. Where an anchor has several kinds, contents are shuffled and meet by a core that every
    window of (half of) the stretch contains; a kind that has its anchor to itself can meet nothing but its own
    copies and stays in the task that reads it;
    the same scan gives the stretches that are copies of a representative; they count if the kernel has found its kind
    to be repeated from end to end. A join brings what it has found of the representatives.

Scans read the documents in place; of text, one stretch of each kind whose anchor has several is shuffled. Bit tables
of bounded size tell what cannot be; what they let through is joined exactly, so a full table costs rows
and never results. Of more representatives than a table tells apart, contents are fetched by a join. A core of more than HOT contents is split: its windows
are aggregated, and one representative of each repeated window goes through the kernel with its count. Only contents whose
core may be such a one, by a bit table, are joined to tell; the others are not shuffled for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._bits import BitTable
from millrace.llm._scratch import staged

#: Contents of a core that a task takes together; a core with more is split into its windows.
HOT = 4000
#: Parts of a core that very many kinds have, in the joins that look it up.
SALTS = 16
#: Representatives that a bit table tells apart well enough; of more, contents are fetched by a join.
MAX_ENTRIES = 1 << 26
#: Bytes of contents that a kernel holds at a time; a core's contents are never parted.
BLOCK_BYTES = 1 << 18


class Units:
    """The bytes or words of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: bool):
        if words:
            held = _text.Words(data, offsets)
            self.rows, self.cut, self.rolling = held.rows, held.cut, _text.Rolling(held.hashes)
        else:
            self.raw, self.rows, self.rolling = data.tobytes(), offsets, _text.byte_rolling(data)

    def cut(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The contents of runs of units; words are joined by one space."""
        return [self.raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass(frozen=True)
class Plan:
    """What a window is.

    kernel(contents, docs, groups, many, size) yields (member, later, offsets of its repeated windows);
    many says which contents have further copies. With ``earlier`` a window counts if it also starts in a
    document of smaller id, and later tells the copies in later documents from the one in the
    first; else it counts if it also starts anywhere else, and later is always false.
    """

    size: int
    gram: int
    words: bool
    earlier: bool
    kernel: Callable

    def stretches(self, units: Units) -> tuple[np.ndarray, ...]:
        """Anchor place, first and last window, row and anchor hash of each stretch."""
        rows = units.rows
        grams = units.rolling.grams(self.gram)
        anchor = _text.window_argmin(grams, self.size - self.gram + 1)
        n = len(anchor)
        row_end = np.repeat(rows[1:], np.diff(rows))[:n]
        valid = np.arange(n) + self.size <= row_end
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        return anchor[first], first, last, np.searchsorted(rows, first, "right") - 1, grams[anchor[first]]


def _named(digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of a stretch's digest and its document."""
    return _text.mix(digest + doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _names(kinds: DataFrame) -> DataFrame:
    """The same for rows of (digest, id)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, doc = (np.ascontiguousarray(np.asarray(batch.column(k), np.int64)) for k in (0, 1))
            yield _batch(h=pa.array(_text.signed(_named(digest.view(np.uint64), doc))))

    return kinds.mapInArrow(hashed, "h long")


def _scan(docs: DataFrame, plan: Plan, schema: str, emit: Callable[..., pa.RecordBatch | None]) -> DataFrame:
    """emit for each block: ids, marks (columns of the rows) and units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            at = 0
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                marks = batch.column(2).slice(at, len(ids))
                at += len(ids)
                units = Units(data, offsets, plan.words)
                if units.rows[-1] < plan.size:
                    continue
                out = emit(np.asarray(ids, np.int64), np.asarray(marks, np.int64), units)
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return _batch(**{k: pa.array(_text.signed(v) if v.dtype == np.uint64 else v.astype(np.int64, copy=False)) for k, v in columns.items()})


def repeated_windows(docs: DataFrame, plan: Plan) -> DataFrame:
    """(id, mark, spans) of the documents that have repeated windows, staged.

    spans are runs [a, b) of units covered by repeated windows, in no order. docs has id (long), text and mark (a long
    that depends on the text alone and tells rows of one id apart). Rows without id are left out.
    """
    context, size, gram = docs.sparkSession.sparkContext, plan.size, plan.gram

    def anchors(ids, marks, units):
        return _longs(key=plan.stretches(units)[4])

    keys = _scan(docs, plan, "key long", anchors).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = staged(keys, "window-keys")
    repeated = context.broadcast(BitTable(keys, keys.count()))

    def found(ids, units):
        """Stretches whose anchor may be repeated: anchor, first, last, row, key, digest, name."""
        anchor, first, last, row, key = plan.stretches(units)
        at = np.flatnonzero(repeated.value.may_hold(key))
        anchor, first, last, row, key = anchor[at], first[at], last[at], row[at], key[at]
        digest = _text.digests(units.cut(first, last + size))
        return anchor, first, last, row, key, digest, _named(digest, np.ascontiguousarray(ids[row]))

    def stretches(ids, marks, units):
        _, _, _, row, key, digest, _ = found(ids, units)
        return _longs(key=key, digest=digest, id=ids[row])

    kinds = _scan(docs, plan, "key long, digest long, id long", stretches).groupBy(F.col("key").alias("c_key"), F.col("digest").alias("c_digest"))
    kinds = staged(kinds.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")), "window-kinds")
    several = staged(kinds.groupBy(F.col("c_key").alias("m_key")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("m_key"), "window-anchors")
    marked = kinds.join(several.hint("merge"), F.col("c_key") == F.col("m_key"), "left").where("n > 1 or m_key is not null")
    many = F.col("least") < F.col("most") if plan.earlier else F.col("n") > 1
    opened = staged(marked.select("c_key", "c_digest", "least", many.alias("many"), F.col("m_key").isNotNull().alias("several")), "window-opened")
    met, lone = (staged(opened.where(x), "window-reps") for x in ("several", "not several"))
    n_met = met.count()
    beyond = n_met > MAX_ENTRIES
    wanted, alone = (context.broadcast(BitTable(_names(x.select("c_digest", "least")), n)) for x, n in ((met, n_met), (lone, lone.count())))

    # A stretch may be a copy from end to end unless it stands for its kind.
    first_ones = kinds if plan.earlier else kinds.where("n = 1")
    standing = context.broadcast(BitTable(_names(first_ones.select("c_digest", "least")), first_ones.count()))

    def copy_runs(first, last, row, at):
        """First and last stretch of each run of stretches that overlap or touch."""
        if not len(at):
            return at, at
        cut = np.flatnonzero((first[at[1:]] > last[at[:-1]] + size) | (row[at[1:]] != row[at[:-1]])) + 1
        return at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]

    def open_ones(ids, marks, units):
        """Stretches to be decided by a join (side 0), contents for the kernel (1), what it says of lone kinds (2), runs of copies (3)."""
        anchor, first, last, row, key, digest, name = found(ids, units)
        doc, mark = ids[row], marks[row]
        stands = standing.value.may_hold(name)
        held = np.flatnonzero(stands)
        sent = np.flatnonzero(wanted.value.may_hold(name))
        sent = sent[np.sort(np.unique(name[sent], return_index=True)[1])]  # a document's copies of a stretch are one content
        own, lo, hi = _lone_runs(units, plan, first, last, row, name, np.flatnonzero(alone.value.may_hold(name)))
        heads, tails = copy_runs(first, last, row, np.flatnonzero(~stands))
        at = np.concatenate([held, sent, own, heads])
        side = np.repeat([0, 1, 2, 3], [len(held), len(sent), len(own), len(heads)]).astype(np.int32)
        content = [None] * len(held) + ([None] * len(sent) if beyond else units.cut(first[sent], last[sent] + size)) + [None] * (len(own) + len(heads))
        place, stop = first - units.rows[row], last - units.rows[row]
        begin, end = np.concatenate([place[held], place[sent], lo, place[heads]]), np.concatenate([stop[held], stop[sent], hi, stop[tails] + size])
        third = np.concatenate([(anchor - first)[held], (anchor - first)[sent], (last - first + 1)[own], np.zeros(len(heads), np.int64)])
        return _batch(
            side=pa.array(side), key=pa.array(_text.signed(key[at])), digest=pa.array(_text.signed(digest[at])), id=pa.array(doc[at]), mark=pa.array(mark[at]),
            first=pa.array(begin), last=pa.array(end), anchor=pa.array(third), content=pa.array(content, pa.binary()),
        )

    both = staged(_scan(docs, plan, "side int, key long, digest long, id long, mark long, first long, last long, anchor long, content binary", open_ones), "window-open")
    same = (F.col("key") == F.col("c_key")) & (F.col("digest") == F.col("c_digest"))
    rep = same & (F.col("id") == F.col("least"))
    members = both.where("side = 1").join(met.hint("merge"), rep)
    members = members.select("key", "digest", "id", "mark", "first", "last", "many", "anchor", "content")
    members = (_contents(docs, members, plan) if beyond else members).select("key", "digest", "id", (F.col("last") - F.col("first") + 1).alias("total"), "many", "anchor", "content")
    members = staged(_cores(members, plan), "window-members")
    hot = staged(members.groupBy(F.col("core").alias("h_core")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("h_core"), "window-hot")
    if hot.isEmpty():
        fine = _by_kernel(members, plan)
    else:
        table = context.broadcast(BitTable(hot, hot.count()))
        sure, perhaps = (_sifted(members, table, x) for x in (False, True))
        perhaps = staged(perhaps, "window-perhaps")
        cool, warm = (_salted(perhaps, hot, "core", "h_core", how).select(*_MEMBER) for how in ("left_anti", "left_semi"))
        fine = _by_kernel(sure.unionAll(cool), plan).unionAll(_by_window(warm, plan))
    own = both.where("side = 2").join(lone.hint("merge"), rep).where("many")
    own = own.select("key", "digest", F.col("anchor").alias("total"), F.lit(plan.earlier).alias("later"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    fine = staged(fine.unionAll(own), "window-fine")

    # Kinds that the kernel found repeated from end to end; any other copy is left to the join.
    ends = fine.where("later") if plan.earlier else fine
    ends = ends.groupBy("key", "digest").agg(F.first("total").alias("total"), F.collect_set(F.struct("lo", "hi")).alias("runs"))
    ends = ends.where(F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"] + 1) == F.col("total")).select(F.col("key").alias("e_key"), F.col("digest").alias("e_digest"))
    unproven = staged(opened.where("many").join(ends.hint("merge"), (F.col("c_key") == F.col("e_key")) & (F.col("c_digest") == F.col("e_digest")), "left_anti").select("c_digest"), "window-unproven")
    certain = both.where("side = 3").select("id", "mark", F.col("first").alias("a"), F.col("last").alias("b"))
    if not unproven.isEmpty():
        doubted = context.broadcast(BitTable(unproven, unproven.count()))

        def proven_copies(ids, marks, units):
            _, first, last, row, _, digest, name = found(ids, units)
            at = np.flatnonzero(~standing.value.may_hold(name) & ~doubted.value.may_hold(digest))
            return _longs(id=ids[row[at]], mark=marks[row[at]], a=(first - units.rows[row])[at], b=(last - units.rows[row])[at] + size)

        certain = _scan(docs, plan, "id long, mark long, a long, b long", proven_copies)

    undecided = both.where("side = 0").select("key", "digest", "id", "mark", "first")
    if plan.earlier:
        undecided = undecided.join(kinds.hint("merge"), same).select("key", "digest", "id", "mark", "first", (F.col("least") < F.col("id")).alias("is_later"))
    else:
        undecided = undecided.withColumn("is_later", F.lit(False))
    runs = fine.select(F.col("key").alias("c_key"), F.col("digest").alias("c_digest"), "later", "lo", "hi")
    part = undecided.join(runs.hint("merge"), same & (F.col("is_later") == F.col("later")))
    part = part.select("id", "mark", (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + size).alias("b"))
    # Rows that repeat an id and its text bring the same spans again.
    return staged(part.unionAll(certain).groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "window-spans")


def _runs(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive numbers."""
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return offsets[np.concatenate([[0], cut + 1])], offsets[np.concatenate([cut, [len(offsets) - 1]])]


MEMBER = "core long, key long, digest long, id long, total long, many boolean, skip long, content binary"


_MEMBER = [c.split()[0] for c in MEMBER.split(", ")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, types, strict=True)], names=names)


def _unit_bounds(content: bytes, words: bool) -> tuple[list[int], int]:
    """Starts of a content's units (one more than units), and the bytes between two units."""
    if not words:
        return range(len(content) + 1), 0
    at = [0]
    for w in content.split(b" "):
        at.append(at[-1] + len(w) + 1)
    return at, 1


def _contents(docs: DataFrame, places: DataFrame, plan: Plan) -> DataFrame:
    """places with the contents of their stretches, cut from the documents that a join brings to them."""
    fields = ["key", "digest", "first", "last", "many", "anchor"]
    grouped = places.groupBy(F.col("id").alias("p_id"), F.col("mark").alias("p_mark")).agg(F.collect_list(F.struct(*fields)).alias("places"))
    joined = docs.join(grouped.hint("merge"), (F.col("id") == F.col("p_id")) & (F.col("mark") == F.col("p_mark"))).select("id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                units = Units(data, offsets, plan.words)
                held = batch.column(2).slice(at, len(ids)).to_pylist()
                at += len(ids)
                rows = [(i, p, base) for i, found, base in zip(ids.to_pylist(), held, units.rows[:-1].tolist(), strict=True) for p in found]
                first, last = (np.array([p[k] + base for _, p, base in rows], np.int64) for k in ("first", "last"))
                yield _table([(i, *(p[k] for k in fields), c) for (i, p, _), c in zip(rows, units.cut(first, last + plan.size), strict=True)], f"id long, {_PLACE}, content binary")

    return joined.mapInArrow(run, f"id long, {_PLACE}, content binary")


_PLACE = "key long, digest long, first long, last long, many boolean, anchor long"


def _lone_runs(units: Units, plan: Plan, first: np.ndarray, last: np.ndarray, row: np.ndarray, name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the kernel says of the stretches ``at``, each of which stands for several copies: stretch, first and last window of each run.

    Stretches that follow each other in a text go as one content.
    """
    at = at[np.sort(np.unique(name[at], return_index=True)[1])]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    cut = np.flatnonzero((first[at[1:]] != last[at[:-1]] + 1) | (row[at[1:]] != row[at[:-1]])) + 1
    heads, tails = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
    n = len(heads)
    windows = [first[heads[member]] + offsets for member, later, offsets in plan.kernel(units.cut(first[heads], last[tails] + plan.size), np.arange(n), np.arange(n), np.ones(n, bool), plan.size) if later == plan.earlier]
    if not windows:
        return none, none, none
    place = np.sort(np.concatenate(windows))
    owner = np.searchsorted(first[at], place, "right") - 1
    new = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(owner) > 0)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(place)]]) - 1
    own = at[owner[begin]]
    return own, place[begin] - first[own], place[end] - first[own]


def _cores(members: DataFrame, plan: Plan) -> DataFrame:
    """MEMBER rows: halves of stretches by the digest of a core.

    A window that starts by ``half`` units or more before the anchor contains the units from there to the anchor's end;
    any other contains those from the anchor to the end of the foremost of them.
    """
    size, gram = plan.size, plan.gram
    half = (size - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, digest, id_, total, many, r, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, gap = _unit_bounds(content, plan.words)
                for salt, a, b, lo, hi in ((b"1", 0, min(total - 1, r - half), r - half, r + gram), (b"2", max(0, r - half + 1), total - 1, r, r - half + 1 + size)):
                    if a <= b:
                        core = _text.signed(_text.digests([salt + content[at[lo] : at[hi] - gap]]))[0]
                        out.append((core, key, digest, id_, total, many, a, content[at[a] : at[b + size] - gap]))
            yield _table(out, MEMBER)

    return members.mapInArrow(run, MEMBER)


RUN = "key long, digest long, total long, later boolean, lo long, hi long"


def _sifted(members: DataFrame, table: Broadcast, held: bool) -> DataFrame:
    """MEMBER rows whose core may be in the bit table (held), or certainly is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = np.asarray(batch.column(0), np.int64).view(np.uint64)
            out = batch.filter(pa.array(table.value.may_hold(core) == held))
            if out.num_rows:
                yield out

    return members.select(*_MEMBER).mapInArrow(run, MEMBER)


def _salted(rows: DataFrame, few: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """rows of kinds joined with the ``few`` values that very many of them have, each value in SALTS parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "digest"), F.lit(SALTS)))
    parts = few.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(parts.hint("merge"), (F.col(left) == F.col(right)) & (F.col("salt") == F.col("f_salt")), how)


def _by_kernel(members: DataFrame, plan: Plan) -> DataFrame:
    """RUN rows: runs of repeated windows of each member, as offsets from its stretch."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        core, key, digest, doc, total = (np.asarray(table.column(k), np.int64) for k in range(5))
        many, skip = table.column(5).to_numpy(), np.asarray(table.column(6), np.int64)
        again = np.zeros(len(core), bool)  # rows that repeat an id and its text bring a content twice
        again[1:] = (core[1:] == core[:-1]) & (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & (skip[1:] == skip[:-1])
        own = np.flatnonzero(~again)
        contents = table.column(7).to_pylist()
        out = []
        for member, later, offsets in plan.kernel([contents[i] for i in own], doc[own], core[own], many[own], plan.size):
            member = own[member]
            for lo, hi in zip(*_runs(offsets), strict=True):
                out.append((key[member], digest[member], total[member], later, lo + skip[member], hi + skip[member]))
        return _table(out, RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = pa.Table.from_batches([batch.slice(at, 512)])
                at += 512
                rest = piece if rest is None else pa.concat_tables([rest, piece])
                if rest.nbytes < BLOCK_BYTES:
                    continue
                core = np.asarray(rest.column(0), np.int64)
                cut = int(np.searchsorted(-(core != core[-1]).astype(np.int8), 0, "left"))
                if cut:
                    yield decide(rest.slice(0, cut))
                    rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield decide(rest)

    dealt = members.select(*_MEMBER).repartition("core").sortWithinPartitions("core", "id", "key", "digest", "skip")
    return dealt.mapInArrow(run, RUN)


def _by_window(members: DataFrame, plan: Plan) -> DataFrame:
    """The same for cores with very many members: their windows are aggregated, and one of each goes through the kernel."""
    size = plan.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, id_, total, many, skip, content in zip(*(batch.column(n).to_pylist() for n in _MEMBER[1:]), strict=True):
                at, gap = _unit_bounds(content, plan.words)
                n = len(at) - size
                h = _text.digests([content[at[i] : at[i + size] - gap] for i in range(n)])
                yield _batch(
                    h=pa.array(_text.signed(h)), key=pa.array(np.full(n, key)), digest=pa.array(np.full(n, digest)), id=pa.array(np.full(n, id_)),
                    total=pa.array(np.full(n, total)), many=pa.array(np.full(n, many)), at=pa.array(np.arange(n) + skip), skip=pa.array(np.full(n, skip)),
                )

    rows = staged(members.mapInArrow(run, "h long, key long, digest long, id long, total long, many boolean, at long, skip long"), "window-rows")
    groups = rows.groupBy(F.col("h").alias("g_h")).agg(
        F.count(F.lit(1)).alias("k"), F.max("many").alias("g_many"), F.min("id").alias("g_least"), F.max("id").alias("g_most"), F.min(F.struct("id", "key", "digest", "skip", "at")).alias("one")
    )
    groups = staged(groups.where("k > 1 or g_many"), "window-groups")
    ones = groups.select("g_h", "k", "g_many", "g_least", "g_most", *[F.col(f"one.{c}").alias(f"o_{c}") for c in ("key", "digest", "skip", "at")])
    match = (F.col("key") == F.col("o_key")) & (F.col("digest") == F.col("o_digest")) & (F.col("skip") == F.col("o_skip"))
    held = members.select("key", "digest", "skip", "content").join(ones.hint("merge"), match)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, least, many, place, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, gap = _unit_bounds(content, plan.words)
                out.append((h, h, h, least, 1, many, 0, content[at[place] : at[place + size] - gap]))
            yield _table(out, MEMBER)

    further = (F.col("g_least") < F.col("g_most")) | F.col("g_many") if plan.earlier else F.lit(True)
    proven = _by_kernel(held.select("g_h", "g_least", further.alias("many"), F.col("o_at") - F.col("skip"), "content").mapInArrow(cut, MEMBER), plan)
    proven = staged(proven.select(F.col("key").alias("p_h")).distinct(), "window-proven")
    known = groups.select("g_h", "g_least").join(proven.hint("merge"), F.col("g_h") == F.col("p_h"))
    hit = rows.join(known.hint("merge"), F.col("h") == F.col("g_h"))
    place = [F.col("at").alias("lo"), F.col("at").alias("hi")]
    if not plan.earlier:
        return hit.select("key", "digest", "total", F.lit(False).alias("later"), *place)
    sides = F.array(F.when(F.col("g_least") < F.col("id"), F.lit(False)), F.when(F.col("many"), F.lit(True)))
    return hit.select("key", "digest", "total", F.explode(F.array_compact(sides)).alias("later"), *place)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of spans (a, b), ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
