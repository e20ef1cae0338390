"""Training-data operators against brute force, on small tables with every awkward row."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, decontamination, exact_dedup, language_id, minhash_dedup, pii, secret_scan, substring_dedup, suffix_dedup, warc, windows
from millrace.llm import sentencepiece_codec as spm

SPACE = re.compile(r"[\x20\x09-\x0D]+")
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghijé") for _ in range(R.randint(1, 8))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, one long and one periodic text."""
    base = [prose(R.randint(60, 220)) for _ in range(25)]
    passage = prose(70)
    rows = [(i, t) for i, t in enumerate(base)]
    add = lambda t: rows.append((len(rows), t))
    for t in base[:4]:
        add(t)
        add(t.replace(" ", "\n\t", 3))
        words = t.split(" ")
        for _ in range(6):
            words[R.randrange(len(words))] = R.choice(VOCABULARY)
            add(" ".join(words))
    for t in base[5:10]:
        add(t[:90] + " " + passage + " " + prose(20))
    for _ in range(40):
        add(base[0])
    for t in (None, "", "   ", "\n", "one", "two words", "Ünï ▁ marked  text ", "word " * 400, "x" * 700, prose(6000) + " " + passage, "a b c d", "A B c D"):
        add(t)
    R.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "id": F.lit(1), "n": F.lit(None).cast("string"), "spans": F.lit("x"), "rest": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def rows_by_id(df, key="doc_id"):
    out = {r[key]: r for r in df.collect()}
    assert len(out) == len(ROWS)
    return out


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[SPACE.sub(" ", t or "")].append(i)
    for first in (1, 64):
        got = rows_by_id(exact_dedup.exact_dedup(docs, first_digit=first, growth=4))
        for i, t in ROWS:
            members = groups[SPACE.sub(" ", t or "")]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text) == (min(members), len(members), i == min(members), SPACE.sub(" ", t or ""))
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 2, 4, False), (None, None, 2, True), (None, None, 2, True)], key=str)


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    got = rows_by_id(spm.encode_documents(docs, spm.model_path()))
    for i, t in ROWS:
        ids = model.encode(t or "", add_eos=True)
        assert list(got[i].ids) == ids and got[i].decoded == model.decode(ids)
    assert spm.encode_documents(empty, spm.model_path()).count() == 0
    table = spm.ChunkTable(spm.model_path())
    r = random.Random(1)
    for _ in range(2000):
        t = "".join(r.choice("ab  ▁é\n日\x00.") for _ in range(r.randint(0, 12)))
        assert table.encode([t], None)[0].tolist() == model.encode(t)


def jaccard_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, empty):
    want = jaccard_components(ROWS)
    got = rows_by_id(minhash_dedup.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_near_duplicate_chains_in_one_bucket(spark, monkeypatch):
    """A cluster whose members mostly are just below the threshold, dealt in several blocks."""
    r = random.Random(5)
    base = prose(150, r).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(2, 9)):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(minhash_dedup, "BLOCK", 30)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows)


def test_null_ids_are_linked_with_nothing(spark):
    t = prose(40)
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def covered(n, size, starts):
    out = np.zeros(n + 1, int)
    for s in starts:
        out[s] += 1
        out[s + size] -= 1
    return np.cumsum(out)[:-1] > 0


@pytest.mark.parametrize("size", [200, 40])
def test_suffix_dedup(docs, empty, size):
    count = collections.Counter()
    texts = {i: (t or "").encode() for i, t in ROWS}
    for b in texts.values():
        count.update(b[s : s + size] for s in range(len(b) - size + 1))
    got = rows_by_id(suffix_dedup.remove_repeats(docs, size=size))
    for i, b in texts.items():
        gone = covered(len(b), size, [s for s in range(len(b) - size + 1) if count[b[s : s + size]] > 1])
        r = got[i]
        assert r.n_bytes == len(b) and bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert len(r.spans) == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("size,hot", [(50, 20000), (8, 20000), (8, 2)])
def test_substring_dedup(docs, empty, size, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    first, want = {}, {}
    for i, t in sorted(ROWS):
        w = words_of(t)
        grams = [tuple(w[s : s + size]) for s in range(len(w) - size + 1)]
        gone = covered(len(w), size, [s for s, g in enumerate(grams) if first.get(g, i) < i])
        for g in grams:
            first.setdefault(g, i)
        want[i] = (len(w), " ".join(x for x, y in zip(w, gone) if not y), int(gone.sum()))
    got = rows_by_id(substring_dedup.remove_repeats(docs, size=size))
    assert {i: (r.n_words, r.kept, sum(s.end - s.start for s in r.spans)) for i, r in got.items()} == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_windows_of_rows_without_id(spark):
    t = prose(120)
    df = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")
    got = {r.doc_id: len(words_of(r.kept)) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {None: 120, 1: 120, 2: 0}
    alone = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    assert all(not r.spans for r in suffix_dedup.remove_repeats(alone).collect())


def test_two_stage_order():
    r = random.Random(8)
    for _ in range(200):
        contents = ["".join(r.choice("ab") for _ in range(r.randint(6, 40))).encode() for _ in range(r.randint(1, 6))]
        count = collections.Counter(c[s : s + 6] for c in contents for s in range(len(c) - 5))
        want = {m: [s for s in range(len(c) - 5) if count[c[s : s + 6]] > 1] for m, c in enumerate(contents)}
        got = {m: o.tolist() for m, _, o in suffix_dedup.repeated_starts(contents, None, None, np.zeros(len(contents), bool), 6)}
        assert got == {m: o for m, o in want.items() if o}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def patterns(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("a@.1 2-+9(é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == patterns(t)
    for t in ("1" * 30000, "a" * 30000 + "@", "1." * 20000, "+1" * 10000, "@a.b" * 5000):
        pii.base_spans(t)


def test_field_on_held_out_rows():
    field = pii.train(pii.labelled_rows())
    right = total = 0
    for words, labels in pii.labelled_rows(200, seed=99):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        codes = pii.shapes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        stop = np.zeros(len(codes) + 1, bool)
        stop[[0, -1]] = True
        got = field.decode(codes, stop)
        where, bounds = pii.segments(codes != pii._PLAIN, stop)
        for a, b in itertools.pairwise(bounds.tolist()):
            assert got[where[a:b]].tolist() == field.viterbi(codes[where[a:b]], np.array([0, b - a])).tolist()
        right += sum(pii.LABELS[a] == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_against_all_paths():
    import itertools

    field = pii.train(pii.labelled_rows(60), rounds=20)
    r = np.random.RandomState(0)
    for _ in range(20):
        codes = r.randint(0, pii.SHAPES, 4)
        e = field.emissions(codes, np.array([True, False, False, False]), np.array([False, False, False, True]))
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
        assert abs(score(best) - score(tuple(field.viterbi(codes, np.array([0, 4]))))) < 1e-9


def test_personal_data(spark, docs, empty):
    text = "Write é to jo.e@mail.example.com or +49 151 23456789 now. From 10.0.0.255 with 4539 1488 0343 6467, please. Call (555) 123-4567 today."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[1] if s.base] == patterns(text)
    assert [text[s.start : s.end] for s in got[1] if not s.base] == ["(555) 123-4567"]
    assert got[2] == [] and got[3] == [] and got[None] == got[1]
    found = rows_by_id(pii.find_personal_data(docs))
    for i, t in ROWS:
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in found[i].spans if s.base] == patterns(t or "")
    assert pii.find_personal_data(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(i, prose(30)) for i in range(10)] + [(10, None), (11, "too short"), (None, prose(30)), (12, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = random.Random(2)
    leaked = []
    for i in range(10):
        words = items[i][1].split(" ")
        if i % 2:
            for _ in range(3):
                words[r.randrange(30)] = "SUBSTITUTE"
        leaked.append((1000 + i, prose(50) + " " + " ".join(words).upper().replace("É", "é") + " " + prose(9)))
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([*leaked, (None, items[0][1])], "doc_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in decontamination.find_overlaps(df, bench).collect()}
    assert got == {(1000 + i, i) for i in range(10)} | {(None, 0)}
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.count() == len(ROWS) + 1 and kept.columns == df.columns
    assert decontamination.find_overlaps(empty, bench).count() == 0
    assert decontamination.find_overlaps(df, bench.where("false")).count() == 0


def brute_overlap(words, item):
    """Most agreeing words, their stretch's length and its start, over all stretches of all diagonals."""
    best = (0, 0, 0)
    for s in range(1 - len(item), len(words)):
        lo, hi = max(0, s), min(len(words), s + len(item))
        same = [words[i] == item[i - s] for i in range(lo, hi)]
        for l in (i for i, x in enumerate(same) if x):
            n = 0
            for r in range(l, len(same)):
                n += same[r]
                if same[r] and n >= decontamination.MIN_WORDS and n >= decontamination.MIN_SHARE * (r + 1 - l):
                    best = max(best, (n, r + 1 - l, -(lo + l)))
    return best


def overlap_rows(spark, texts, items):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    return {(x.doc_id, x.item_id): (x.n_matched, x.n_words, -x.doc_start) for x in decontamination.find_overlaps(docs, bench).collect()}


def test_overlaps_behind_a_first_hit(spark):
    """Of one diagonal: 7 agreeing words, a gap of other words, then a longer agreement."""
    item = [f"w{i}" for i in range(110)]
    texts = []
    for gap, n in ((12, 21), (26, 60), (3, 14), (1, 40)):
        texts.append([f"p{i}" for i in range(15)] + item[:7] + ["other"] * gap + item[7 + gap : 7 + gap + n] + [f"q{i}" for i in range(15)])
    got = overlap_rows(spark, texts, [item])
    assert got == {(i, 0): brute_overlap(t, item) for i, t in enumerate(texts)}
    assert [got[i, 0][0] for i in range(4)] == [21, 60, 21, 47]


def test_every_overlap_at_the_threshold_is_found(spark):
    """Every fourth word substituted; 3 of 13 and 4 of 16 words substituted anywhere inside; short items word for word."""
    r = random.Random(8)
    item = [f"w{i}" for i in range(80)]
    gaps = [range(3, 80, 4)]
    gaps += [sorted(r.sample(range(1, 12), 3)) for _ in range(60)] + [sorted(r.sample(range(1, 15), 4)) for _ in range(60)]
    texts, want = [], {}
    for i, gap in enumerate(gaps):
        n = 80 if i == 0 else 13 if i <= 60 else 16
        at = r.choice([0, 80 - n])
        texts.append([f"p{k}" for k in range(i % 3)] + ["other" if k in gap else item[at + k] for k in range(n)] + [f"q{k}" for k in range(i % 2)])
        want[i, 0] = brute_overlap(texts[-1], item)
    texts += [["x", "five", "words", "of", "an", "item", "y"], ["five", "words", "of", "the", "item"], ["alone"]]
    got = overlap_rows(spark, texts, [item, ["five", "words", "of", "an", "item"], ["alone"]])
    assert got == want | {(121, 1): (5, 5, -1), (123, 2): (1, 1, 0)}


def test_masks_cover_the_threshold():
    """Each shortest pattern that MIN_WORDS and MIN_SHARE admit holds a mask."""
    masks = [int(m[::-1], 2) for m in decontamination.MASKS]
    least, share = decontamination.MIN_WORDS, decontamination.MIN_SHARE
    n = 0
    # A pattern of 2 * least agreeing words has a half that is admitted, too.
    for size in range(least, int(2 * least / share) + 1):
        for k in range(int(size * (1 - share)) + 1):
            if least <= size - k < 2 * least and (size - k == least or int((size - 1) * (1 - share)) < k):
                for gap in itertools.combinations(range(1, size - 1), k):
                    bits = (1 << size) - 1 - sum(1 << i for i in gap)
                    assert any(bits >> i & m == m for m in masks for i in range(size))
                    n += 1
    assert n > 0


def test_language(spark, empty):
    r = random.Random(6)
    letters = {"aa": "abcde", "bb": "opqrst", "cc": "éüöklm"}
    text = lambda l, n: " ".join("".join(r.choice(letters[l]) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, text(l, 40), l, f"{l}.host") for i, l in enumerate(["aa"] * 20 + ["bb"] * 20 + ["cc"] * 20)]
    rows += [(100, text("aa", 40), "bb", "aa.host"), (101, None, "aa", None), (102, "", None, "x"), (103, "12 34 %%", "bb", "bb.host"), (104, text("bb", 3000), None, None), (None, text("cc", 5), None, "cc.host")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    assert all(got[i].language == l for i, (_, _, l, _) in enumerate(rows[:60]))
    assert got[100].language == "aa" and got[104].language == "bb" and got[None].language == "cc"
    assert {i for i, x in got.items() if not x.kept} == {101, 102, 103}
    assert {x.doc_id for x in language_id.drop_unknown(df).collect()} == set(got) - {101, 102, 103}
    assert language_id.identify(empty).count() == 0
    assert language_id.identify(df, declared_col=None).where("kept").count() == 0


def test_weak_text_follows_other_evidence(spark):
    rows = [(i, "ab ba", "aa" if i % 2 else "bb", "x" if i % 2 else "y") for i in range(40)] + [(i, "ab ab ba" if i % 2 else "ba ba ab", "aa" if i % 2 else "bb", "x" if i % 2 else "y") for i in range(40, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.language for x in language_id.identify(df, full_weight=1.0).collect()}
    assert all(got[i] == l for i, _, l, _ in rows[40:])


def test_page_evidence(spark):
    rows = [(1, "https://u:p@m.a.example.de:80/x?y", '<HTML lang="DE-at"><style>p{}</style><p>Der Text</p><!-- no --></html>'), (2, None, None)]
    got = {x.page_id: x for x in language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].suffix, got[1].declared, got[1].text.split()) == ("m.a.example.de", "de", "DE", ["Der", "Text"])
    assert (got[2].host, got[2].suffix, got[2].declared, got[2].text) == (None, None, None, "")


def test_secrets(spark, empty):
    r = random.Random(4)
    key = lambda n, a: "".join(r.choice(a) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        secret = [f"password={key(18, '0123456789abcdef')}", f'token = "{key(40, "0123456789abcdef")}"', "AKIA" + key(16, "ABCDEFGHJKLMNPQRSTUVWXYZ234567")][i % 3]
        rows.append((i, f"{prose(30)} {secret} {prose(5)}", "src"))
        want[i] = True
    for i in range(40, 60):
        rows.append((i, f"{prose(30)} card number {key(16, '0123456789')} {prose(5)}", None))
        want[i] = False
    rows += [(60, None, "s"), (61, "", "s"), (62, prose(30), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan.scan(df).collect()
    found = collections.defaultdict(bool)
    for x in got:
        found[x.doc_id] |= x.is_secret
    wrong = [i for i in want if found[i] != want[i]]
    assert len(wrong) <= 4 and set(found) <= set(want)
    assert all(rows[x.doc_id][1].split()[x.place].find(x.candidate) >= 0 for x in got)
    assert secret_scan.scan(empty).count() == 0


def test_forest_on_held_out_findings(spark):
    entries = spark.createDataFrame([(w,) for w in ("page", "harbour", "number", "window", "station", "matter", "garden")], "entry string")
    found = secret_scan.labelled_findings(spark, 60, entries)
    train, held = found.where("pmod(xxhash64(key), 3) > 0"), found.where("pmod(xxhash64(key), 3) = 0")
    model = secret_scan.train(train, entries)
    scored = model.transform(secret_scan._vector(secret_scan.features(held.withColumn("path_rate_in", F.col("path_rate")), entries)))
    right = scored.where("prediction = label").count()
    assert right >= 0.97 * held.count()
    weight = dict(zip(secret_scan.FEATURES, model.featureImportances.toArray()))
    for name in ("length", "changes", "covered", "keyword_near", "innocent_near", "keyword_after", "innocent_after", "test_path", "path_rate"):
        assert weight[name] > (0.01 if name in ("covered", "test_path", "path_rate") else 0), weight


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, tmp_path, least):
    pages = [(1, "http://a/\nb", "<p>é</p>"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://c/", None), (5, "http://d/", ""), (6, "x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "y", "z" * 300000), (0, "q", "same"), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, min_bytes=least)
    rows = warc.captures(spark, path, payload=True).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for r in rows:
        assert r.request.concurrent_to == r.response.record_id == r.metadata.concurrent_to
        i = r.metadata.notes.get("page_id")
        i = None if i is None else int(i)
        body = (next(p[2] for p in pages if p[0] == i) or "").encode()
        response = len(body) < least or first[body.decode()] == i
        assert r.response.type == ("response" if response else "revisit")
        assert r.response.payload_bytes == len(body) and r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (bytes(r.response.payload) == body) if response else r.response.payload is None
        assert r.metadata.notes.get("refers_to") == (None if response else str(first[body.decode()]))
    warc.write_archives(df.where("false"), path + "0")
    assert warc.captures(spark, path + "0").count() == 0


def test_parse_members_and_damage():
    import gzip

    one = warc._record([("WARC-Type", "warcinfo")], b"abc") + b"\r\n\r\n"
    packed = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parse(packed)] == [b"abc", b"abc"] == [b for _, b in warc.parse(one + one)]
    with pytest.raises(ValueError):
        list(warc.parse(b"nothing\r\n\r\n"))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    leak = prose(40, r)
    rows = [(i, prose(80, r), "en", "s", 0) for i in range(30)]
    rows += [(30, rows[0][1].replace(" ", "  "), "en", "s", 0), (31, rows[1][1] + " end", "en", "s", 0), (32, prose(9, r) + " " + leak, "en", "s", 0), (33, "123 456", "en", "s", 0), (34, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x.ids for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(30))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    assert all(list(out[i]) == model.encode(rows[i][1], add_eos=True) for i in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontaminate", "encode"]
