"""Equality is decided by content: strings that collide under a polynomial hash, hot cores and buckets, repeated ids."""

import collections
import random

import numpy as np
import pytest

from millrace.llm import _text, decontamination, minhash_dedup, substring_dedup, suffix_dedup, windows

R = random.Random(17)


def words(n, r=R, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


TWINS = thue_morse(1024)


def test_the_twins_collide_under_the_routing_hash():
    h = [int(_text.byte_rolling(np.frombuffer(t.encode(), np.uint8)).grams(1024)[0]) for t in TWINS]
    assert TWINS[0] != TWINS[1] and h[0] == h[1]


def brute_words(rows, size):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        grams = [tuple(w[s : s + size]) for s in range(len(w) - size + 1)]
        gone = set()
        for s, g in enumerate(grams):
            if first.setdefault(g, i) < i:
                gone.update(range(s, s + size))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_colliding_words_are_different(spark):
    other = words(60)
    rows = [(i, " ".join([*other[:30], t, *other[30:]])) for i, t in enumerate(TWINS)] + [(2, TWINS[0]), (3, TWINS[1]), (4, f"x {TWINS[0]} y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.kept for x in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_words(rows, 50) and got[1] == rows[1][1]
    near = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(df.where("doc_id > 1")).collect()}
    assert near == {2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(0, TWINS[0]), (1, " ".join([*words(10), TWINS[1]]))], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.find_overlaps(df, bench).collect()} == {(0, 0), (2, 0), (4, 0)}


def passages(n, r):
    """Texts around one common passage, some of them twice, with common words before and behind."""
    passage = words(60, r)
    rows = []
    for i in range(n):
        rows.append((i, " ".join([*words(r.randint(3, 20), r, 4), *passage, *words(r.randint(3, 20), r, 4)])))
    return rows + [(n + i, rows[r.randrange(n)][1]) for i in range(n // 3)]


@pytest.mark.parametrize("hot", [1000, 3])
def test_hot_cores_are_split(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    rows = passages(40, random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.kept for x in substring_dedup.remove_repeats(df, size=12).collect()} == brute_words(rows, 12)
    count = collections.Counter(t.encode()[s : s + 60] for _, t in rows for s in range(len(t.encode()) - 59))
    for x in suffix_dedup.remove_repeats(df, size=60).collect():
        t = rows[x.doc_id][1].encode()
        gone = {k for s in range(len(t) - 59) if count[t[s : s + 60]] > 1 for k in range(s, s + 60)}
        assert bytes(x.kept) == bytes(c for k, c in enumerate(t) if k not in gone)


def test_hot_cores_leave_others_alone(spark, monkeypatch):
    """For the sake of one hot core, contents of other cores are not shuffled again."""
    r = random.Random(11)
    own = [words(60, r, 10**9) for _ in range(300)]
    texts = [" ".join([*words(5, r, 10**9), *p, *words(5, r, 10**9)]) for p in [*own, *own, *[words(60, r, 10**9)] * 8]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    took = []
    for hot in (1000, 5):
        monkeypatch.setattr(windows, "HOT", hot)
        before = shuffled()
        assert {x.doc_id: x.kept for x in substring_dedup.remove_repeats(df).collect()} == brute_words(rows, 50)
        took.append(shuffled() - before)
    assert took[0] > 500_000 and took[1] < 1.3 * took[0], took


def test_full_bit_tables(spark, monkeypatch):
    """More entries than a table tells apart: contents and texts come by joins."""
    monkeypatch.setattr(windows, "MAX_ENTRIES", 0)
    monkeypatch.setattr(minhash_dedup, "MAX_ENTRIES", 0)
    rows = passages(20, random.Random(5))
    df = spark.createDataFrame([(*x, 0) for x in rows] + [(None, rows[0][1], 0)], "doc_id long, text string, mark int")
    assert {x.doc_id: x.kept for x in substring_dedup.remove_repeats(df, size=12).collect() if x.doc_id is not None} == brute_words(rows, 12)
    count = collections.Counter(t.encode()[s : s + 60] for _, t in rows for s in range(len(t.encode()) - 59))
    for x in suffix_dedup.remove_repeats(df.where("doc_id is not null"), size=60).collect():
        t = rows[x.doc_id][1].encode()
        gone = {k for s in range(len(t) - 59) if count[t[s : s + 60]] > 1 for k in range(s, s + 60)}
        assert bytes(x.kept) == bytes(c for k, c in enumerate(t) if k not in gone)
    assert {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(df).collect() if x.doc_id is not None} == components(rows)


def test_nothing_goes_without_the_kernel(spark, monkeypatch):
    """Each removed unit is found by the suffix sorter or the parser."""
    rows = passages(20, random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = lambda *args: iter(())
    plan = substring_dedup._plan(50)
    monkeypatch.setattr(substring_dedup, "_plan", lambda size: windows.Plan(plan.size, plan.gram, plan.words, plan.earlier, none))
    assert all(not x.spans for x in substring_dedup.remove_repeats(df).collect())
    other = suffix_dedup._plan(200)
    monkeypatch.setattr(suffix_dedup, "_plan", lambda size: windows.Plan(other.size, other.gram, other.words, other.earlier, none))
    assert all(not x.spans for x in suffix_dedup.remove_repeats(df).collect())


def test_rows_that_repeat_an_id(spark):
    a, b, c = (" ".join(words(80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, f"{c} x"), (4, "other"), (5, f"{c} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, len(x.kept.split())) for x in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([(1, 80, 80), (2, 80, 0), (2, 80, 80), (2, 80, 80), (3, 80, 0), (4, 81, 81), (4, 1, 1), (5, 81, 1)])
    kept = sorted((x.doc_id, x.n_bytes, len(x.kept)) for x in suffix_dedup.remove_repeats(df).collect())
    n = {t: len(t) for t in (a, b, c)}
    assert kept == sorted([(1, n[a], 0), (2, n[a], 0), (2, n[b], 0), (2, n[b], 0), (3, n[b], 0), (4, n[c] + 2, 1), (4, 5, 5), (5, n[c] + 2, 1)])
    near = sorted((x.doc_id, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(df).collect())
    assert near == sorted([(1, 1, True), *[(2, 1, False)] * 3, (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False)])


def components(rows):
    sets = {i: {tuple(t.split()[s : s + 5]) for s in range(len(t.split()) - 4)} for i, t in rows}
    name = {i: i for i in sets}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                name[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def test_large_buckets_of_templates(spark, monkeypatch):
    """Texts of one template that are not similar, and pairs of them that are, in buckets above BLOCK."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    r = random.Random(6)
    template = words(120, r, 10000)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(template + words(r.randint(60, 90), r, 10000))))
    for i in range(60, 90):
        w = rows[r.randrange(60)][1].split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)
    assert len(set(got.values())) > 20


@pytest.mark.parametrize("n", [4, 8, 40, 400])
def test_recall_at_the_threshold(n):
    """Pairs of sets with exactly three quarters in common: share of those that share a band and pass the sketch."""
    r = np.random.RandomState(n)
    pairs = 4000 if n < 100 else 500
    lost = 0
    for _ in range(pairs // 500):
        flat, starts = [], []
        for _ in range(500):
            common = 3 * n // 4
            x = r.randint(0, 1 << 62, common + n - common).astype(np.uint64)
            for own in (x, x[:common]):  # a set and three quarters of it
                starts.append(sum(map(len, flat[-1:])) + (starts[-1] if starts else 0))
                flat.append(own)
        sets, starts = np.concatenate(flat), np.array(starts)
        bands = minhash_dedup._bands(sets, starts)
        sketch = (minhash_dedup._extremes(sets, starts, minhash_dedup.SKETCH, 12) & np.uint64(255)).astype(np.uint8)
        shared = (bands[::2] == bands[1::2]).any(axis=1)
        passed = (sketch[::2] == sketch[1::2]).sum(axis=1) >= minhash_dedup.SKETCH_CUT * sketch.shape[1]
        lost += int((~(shared & passed)).sum())
    assert lost / pairs <= 0.001


def test_common_shingles_of_words():
    r = random.Random(9)
    for _ in range(300):
        x, y = ([r.choice("abc") for _ in range(r.randint(1, 30))] for _ in range(2))
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in (x, y)]
        got = minhash_dedup._common(" ".join(x).encode(), " ".join(y).encode(), 5)
        assert got == (len(sets[0] & sets[1]), len(sets[0] | sets[1]))
