"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans. The random field reads words as shapes (bucketed
counts of digits, dots, hyphens and so on, and whether a word is a bracketed "at" or "dot"; for a word and its two
neighbours), is trained from a small labelled table by gradient ascent on the likelihood, and is
decoded by Viterbi for all sentences of a block at once in numpy. A run of words with one label is a
span; it is added where the kind's check holds (digits, parts) and no base span overlaps it. It thus finds what the
patterns cannot: national telephone numbers, written-out addresses ("jo (at) host (dot) org"), addresses with
bracketed dots, and card numbers that are separated by other signs or have a wrong check digit.

A word of letters only, four or more words away from any other in its sentence, has no label; the rest of a sentence
is decoded. Everything happens in the task that reads the documents; nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Rows of the labelled table that are read at most; training is a driver's job.
MAX_LABELLED = 5000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards so that the cost is linear."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted groups, leftmost; a match with a part over 255 is consumed and dropped."""
    for region in _DOTTED.finditer(text):
        if region.group().count(".") < 3:
            continue
        for chain in _GROUPS.finditer(region.group()):
            parts, at = chain.group().split("."), region.start() + chain.start()
            ends, total = [], at
            for p in parts:
                total += len(p)
                ends.append(total)
                total += 1
            for i in range(0, len(parts) - 3, 4):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                    yield ends[i] - len(parts[i]), ends[i + 3]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ascending; code points, end exclusive."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --- shapes -------------------------------------------------------------------------------------

#: Features of a word and their numbers of values; a shape is one code of all of them.
SIZES = (10, 2, 2, 4, 4, 2, 3, 3)
SHAPES = int(np.prod(SIZES))
_DIGITS = np.zeros(1 << 10, np.int64)
for _i, _bound in enumerate((1, 4, 5, 9, 12, 15, 17, 20, 40)):
    _DIGITS[_bound:] = _i + 1
#: Words within so many of one that is not plain are decoded.
REACH = 4
_CLASSES = np.zeros((6, 256), np.uint8)  # digit, letter, @, dot, hyphen or bracket, other
_CLASSES[0, 48:58] = 1
_CLASSES[1, 65:91] = _CLASSES[1, 97:123] = 1
_CLASSES[1, 128:] = 1
_CLASSES[2, ord("@")] = 1
_CLASSES[3, ord(".")] = 1
_CLASSES[4, [ord(c) for c in "-()/"]] = 1
_CLASSES[5, [ord(c) for c in "=\"':;_#$%&*<>[]{}|\\~^`+"]] = 1


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape code of each word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    edges = np.stack([starts, ends], 1).ravel()
    counts = []
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(_CLASSES[k][data], dtype=np.int32)])
        counts.append((total[edges[1::2]] - total[edges[::2]]).astype(np.int64))
    plus = data[starts] == ord("+")
    dots = counts[3] - (data[ends - 1] == ord("."))
    # Signs inside a word tell more than those around it.
    other = counts[5] - plus
    inner = (_CLASSES[5][data[starts]] + _CLASSES[5][data[ends - 1]]).astype(np.int64) - plus
    signs = np.where(other <= 0, 0, np.where((counts[0] > 0) & (other > inner) & ~_ends_in_signs(data, starts, ends, other), 2, 1))
    parts = (_DIGITS[np.minimum(counts[0], 1023)], counts[1] > 0, counts[2] > 0, np.clip(dots, 0, 3), np.minimum(counts[4], 3), plus, signs, _connectors(data, starts, ends))
    code = np.zeros(len(starts), np.int64)
    for size, part in zip(SIZES, parts, strict=True):
        code = code * size + part
    return code


def _ends_in_signs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Words whose signs all stand at their end ("5927!!" or "5927$$$"); three at most are looked at."""
    n = np.zeros(len(starts), np.int64)
    run = np.ones(len(starts), bool)
    for k in range(1, 4):
        run &= (ends - k > starts) & (_CLASSES[5][data[np.maximum(ends - k, 0)]] > 0)
        n += run
    return n >= other


def _connectors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for a bracketed "at", 2 for a bracketed "dot", in any case; else 0."""
    out = np.zeros(len(starts), np.int64)
    size = ends - starts
    for code, word in ((1, b"at"), (2, b"dot")):
        here = np.flatnonzero((size == len(word) + 2) & np.isin(data[starts], _OPEN) & np.isin(data[ends - 1], _CLOSE))
        for k, letter in enumerate(word):
            here = here[(data[starts[here] + 1 + k] | 32) == letter]
        out[here] = code
    return out


_OPEN, _CLOSE = (np.frombuffer(x, np.uint8) for x in (b"([{<", b")]}>"))


def _plain_code() -> int:
    return int(shapes(np.frombuffer(b"word", np.uint8), np.array([0]), np.array([4]))[0])


def _feature_matrix() -> np.ndarray:
    """One-hot features of every shape code."""
    codes, columns = np.arange(SHAPES), []
    for size in reversed(SIZES):
        columns.insert(0, np.eye(size)[codes % size])
        codes = codes // size
    return np.concatenate(columns, 1)


# --- the random field ---------------------------------------------------------------------------


class Field:
    """Weights of the field; ``tables`` score (previous, own, next shape) for each label."""

    def __init__(self, tables: np.ndarray, steps: np.ndarray):
        self.tables, self.steps = tables, steps

    def emissions(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = self.tables[1][codes]
        before, after = np.roll(codes, 1), np.roll(codes, -1)
        out = out + np.where(first[:, None], 0, self.tables[0][before]) + np.where(last[:, None], 0, self.tables[2][after])
        return out

    def viterbi(self, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The best labels of many sentences (codes[cuts[i]:cuts[i+1]]), step by step for all at once."""
        size = np.diff(cuts)
        first = np.zeros(len(codes), bool)
        last = np.zeros(len(codes), bool)
        first[cuts[:-1][size > 0]] = True
        last[cuts[1:][size > 0] - 1] = True
        scores = self.emissions(codes, first, last)
        order = np.argsort(-size, kind="stable")
        begin, size = cuts[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        back = np.zeros((len(codes), len(LABELS)), np.int8)
        best = scores[begin[: alive[0]]] if longest else np.zeros((0, len(LABELS)))
        ends = best.copy()
        for t in range(1, longest):
            n = alive[t]
            paths = best[:n, :, None] + self.steps
            back[begin[:n] + t] = paths.argmax(1)
            best = paths.max(1) + scores[begin[:n] + t]
            ends[:n] = best
        out = np.zeros(len(codes), np.int64)
        label = ends.argmax(1) if longest else np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            out[at] = label[:n]
            label[:n] = back[at, label[:n]]
        return out

    def decode(self, codes: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Labels of words in sentences; stop[i] says that a sentence begins at word i (one more than words)."""
        where, bounds = segments(codes != _PLAIN, stop)
        out = np.zeros(len(codes), np.int64)
        out[where] = self.viterbi(codes[where], bounds)
        return out


def segments(odd: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words within REACH of an odd one of their sentence, and the bounds of their runs."""
    n = len(odd)
    at = np.arange(n)
    sentence = np.cumsum(stop[:n])
    before = np.maximum.accumulate(np.where(odd, at, -1))
    after = np.minimum.accumulate(np.where(odd, at, n)[::-1])[::-1]
    near = (before >= 0) & (at - before <= REACH) & (sentence[before] == sentence)
    near |= (after < n) & (after - at <= REACH) & (sentence[np.minimum(after, n - 1)] == sentence)
    where = np.flatnonzero(near)
    if not len(where):
        return where, np.zeros(1, np.int64)
    first = np.concatenate([[True], (np.diff(where) > 1) | stop[where[1:]]])
    return where, np.concatenate([np.flatnonzero(first), [len(where)]])


_PLAIN = _plain_code()


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty; Adam on exact forward-backward gradients."""
    rows = [(w, y) for w, y in rows if w]
    longest, n, k = max(len(w) for w, _ in rows), len(rows), len(LABELS)
    codes, gold = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (words, labels) in enumerate(rows):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        codes[i, : len(raw)] = shapes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        gold[i, : len(raw)] = [LABELS.index(y) for y in labels]
        mask[i, : len(raw)] = True
    features = _feature_matrix()
    f = features.shape[1]
    x = np.zeros((n, longest, 3 * f))
    x[:, 1:, :f] = features[codes[:, :-1]] * mask[:, 1:, None]
    x[:, :, f : 2 * f] = features[codes] * mask[:, :, None]
    x[:, :-1, 2 * f :] = features[codes[:, 1:]] * mask[:, 1:, None]
    w, steps = np.zeros((3 * f, k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    onehot = np.eye(k)[gold] * mask[:, :, None]
    want_steps = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
    log_sum = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for step in range(1, rounds + 1):
        e = x @ w
        alpha, beta = np.zeros((longest, n, k)), np.zeros((longest, n, k))
        alpha[0] = e[:, 0]
        for t in range(1, longest):
            alpha[t] = np.where(mask[:, t, None], log_sum(alpha[t - 1][:, :, None] + steps, 1) + e[:, t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(mask[:, t + 1, None], log_sum(steps + (e[:, t + 1] + beta[t + 1])[:, None, :], 2), 0)
        z = log_sum(alpha[-1], 1)
        prob = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        got_steps = np.zeros((k, k))
        for t in range(1, longest):
            joint = np.exp(alpha[t - 1][:, :, None] + steps + (e[:, t] + beta[t])[:, None, :] - z[:, None, None])
            got_steps += (joint * mask[:, t, None, None]).sum(0)
        grads = (np.einsum("ntf,ntk->fk", x, onehot - prob) / n - penalty * w, (want_steps - got_steps) / n - penalty * steps)
        for i, (target, g) in enumerate(zip((w, steps), grads, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            target += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(np.stack([features @ w[i * f : (i + 1) * f] for i in range(3)]), steps)


def labelled_rows(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by rule: words around items of each kind, and look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 9)))
    part = lambda: str(r.randint(0, 255))

    def item(kind: str) -> list[str]:
        if kind == "email":
            at, dot = r.choice(["(at)", "[at]", "(AT)", "{at}"]), r.choice(["(dot)", "[dot]", "(DOT)", "{dot}"])
            return r.choice([[f"{word()}.{digits(2)}@{word()}.example.com"], [f"{word()}@{word()}.org"], [word(), at, word(), dot, word()], [f"{word()}{digits(2)}", at, word(), dot, word()], [word(), at, word(), dot, word(), dot, word()]])
        if kind == "ip":
            return r.choice([[".".join(part() for _ in range(4))], ["[.]".join(part() for _ in range(4))], [f"{part()}.{part()}.{part()}[.]{part()}"], [f"{part()}[.]{part()}.{part()}.{part()}"]])
        if kind == "card":
            c = digits(16)
            groups = [c[:4], c[4:8], c[8:12], c[12:]]
            return r.choice([[c], [c], [digits(15)], groups, ["-".join(groups)], [".".join(groups)], ["/".join(groups)], ["_".join(groups)]])
        return r.choice([[f"+{digits(2)}", digits(3), digits(7)], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"({digits(5)})", digits(6)], [f"{digits(4)}/{digits(7)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(11)}"]])

    def other() -> list[str]:
        return r.choice(
            [
                [f"password={digits(9)}a{digits(6)}"], [f"v{digits(1)}.{digits(1)}.{digits(2)}"], [f"{digits(1)}.{digits(1)}.{digits(2)}"], [digits(r.randint(1, 8))], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}/{digits(2)}/{digits(4)}"],
                [f"id:{digits(12)}"], [f"id={digits(16)}"], [digits(r.choice([9, 10, 11, 12, 13, 18, 19, 22]))], [f"{digits(2)}.{digits(2)}"], [f"{digits(1)}.{digits(1)}."], [f"{digits(6)}ab{digits(9)}f{digits(5)}"], [f'"{digits(9)}c{digits(9)}e{digits(12)}"'],
                ["-"], ["(" + word() + ")"], ["[" + word() + "]"], [digits(1), digits(2), digits(3)], [f"{digits(4)}-{digits(4)}"], [f"{digits(2)}:{digits(2)}:{digits(2)}"], ["(dot)"], ["(at)"], [f"{digits(1)},{digits(3)},{digits(3)}"], ["|"], [word() + r.choice(["!!", "$$$", "###", "***"])],
            ]
        )

    rows = []
    for i in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            plain = [word() for _ in range(r.randint(1, 4))]
            words += plain
            labels += ["O"] * len(plain)
            kind = r.choice(LABELS) if i % 4 else "O"
            part_ = other() if kind == "O" else item(kind)
            part_[-1] += r.choice(["", "", "", ",", ";", "!!", "$$$"]) if kind == "card" or i % 3 == 0 else ""
            words += part_
            labels += [kind] * len(part_)
        words[-1] += r.choice(["", ".", ","])
        rows.append((words, labels))
    return rows


_WRITTEN_AT = re.compile(r"(?i)[\[({<]at[\])}>]")
_WRITTEN_DOT = re.compile(r"(?i)[\[({<]dot[\])}>]")


def _checked(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "email":
        return ("@" in text or bool(_WRITTEN_AT.search(text))) and ("." in text or bool(_WRITTEN_DOT.search(text)))
    if any(c.isalpha() for c in text):
        return False
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", text) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 15 <= len(d) <= 16
    return 9 <= len(d) <= 15


#: Signs around a span that are no part of it.
_AROUND = ".,;:!?\"'$%&*#|<>`~="
def _span(kind: str, raw: bytes, start: int, end: int) -> tuple[int, int] | None:
    """Offset and length in code points of what is left of a piece without the signs around it, if it holds the kind's check."""
    piece = raw[start:end].decode()
    text = piece.strip(_AROUND)
    return (piece.index(text), len(text)) if text and _checked(kind, text) else None


_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans (array of kind, start, end, base), ascending; a row for each input row.

    start and end count code points. Null and empty texts have no spans; rows may repeat and ids may
    be null; other columns are not read; an empty table gives an empty result. ``labelled`` (words and labels, arrays of strings, at most MAX_LABELLED rows are read;
    rows with a null, unequal lengths or unknown labels are skipped) replaces the built-in table.
    """
    rows = labelled_rows()
    if labelled is not None:
        got = [(r[0], r[1]) for r in labelled.select("words", "labels").limit(MAX_LABELLED).collect()]
        rows = [(w, y) for w, y in got if w and y and len(w) == len(y) and None not in w and set(y) <= set(LABELS)] or rows
    field = train(rows)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                raw = data.tobytes()
                cuts = offsets.tolist()
                texts = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                spans = [[(a, k, b, True) for a, k, b in base_spans(t)] for t in texts]
                starts, ends, rows = _text.word_bounds(data, offsets)
                codes = shapes(data, starts, ends)
                stop = np.zeros(len(starts) + 1, bool)
                stop[1:] = _SENTENCE_END[data[ends - 1]] if len(ends) else False
                stop[rows] = True
                labels = field.decode(codes, stop) if len(starts) else codes
                tagged = np.flatnonzero(labels)
                if len(tagged):
                    new = np.ones(len(tagged), bool)
                    new[1:] = (np.diff(tagged) > 1) | (np.diff(labels[tagged]) != 0) | stop[tagged[1:]]
                    heads = np.flatnonzero(new)
                    tails = np.concatenate([heads[1:], [len(tagged)]]) - 1
                    for x, y in zip(tagged[heads].tolist(), tagged[tails].tolist(), strict=True):
                        row = int(np.searchsorted(rows, x, "right")) - 1
                        name = LABELS[labels[x]]
                        # A run that fails the check may be several spans of a word each.
                        for p, q in [(x, y)] if (whole := _span(name, raw, starts[x], ends[y])) or x == y else [(i, i) for i in range(x, y + 1)]:
                            span = whole or _span(name, raw, starts[p], ends[q])
                            if span is None:
                                continue
                            a = len(raw[cuts[row] : starts[p]].decode()) + span[0]
                            b = a + span[1]
                            if all(b <= s[0] or a >= s[2] for s in spans[row] if s[3]):
                                spans[row].append((a, labels[x] - 1, b, False))
                flat = [s for row in spans for s in sorted(row)]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
                items = pa.StructArray.from_arrays(
                    [pa.array([KINDS[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32()), pa.array([s[3] for s in flat], pa.bool_())],
                    names=["kind", "start", "end", "base"],
                )
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)], names=["id", "spans"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind string, start int, end int, base boolean>>")
    return found.withColumnRenamed("id", id_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
