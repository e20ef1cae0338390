"""Posteriors with all four kinds of evidence, against the same sums by hand; documents and pages together."""

import collections
import math
import random

from millrace.llm import language_id
from millrace.llm.language_id import BUCKETS, CELL_ROWS, FULL_WEIGHT, PRIOR_ROWS, UNKNOWN, UNKNOWN_PRIOR

R = random.Random(8)


def buckets(text):
    """Hash buckets of the trigrams of letters (others are blanks), as the operator numbers them."""
    x = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (text or "").encode()]
    out = []
    for a, b, c in zip(x, x[1:], x[2:]):
        if b != 32 or (a != 32 and c != 32):
            code = (a << 16) | (b << 8) | c
            out.append(((code * 2654435761) & 0xFFFFFFFF) >> 18)
    return out


def posteriors(rows):
    """rows: id, text, label, declared, suffix, host."""
    low = lambda x: None if x is None else x.lower()
    counts = collections.defaultdict(collections.Counter)
    for _, t, label, *_ in rows:
        if label and label.lower() != UNKNOWN:
            counts[label.lower()].update(buckets(t))
    names = sorted(l for l, c in counts.items() if c) + [UNKNOWN]
    n = len(names)
    logp = lambda l, b: -math.log(BUCKETS) if l == UNKNOWN else math.log((counts[l][b] + 0.5) / (sum(counts[l].values()) + 0.5 * BUCKETS))
    means, first = [], []
    for _, t, *_ in rows:
        bs = buckets(t)
        means.append([sum(logp(l, b) for b in bs) / len(bs) if bs else 0.0 for l in names])
        first.append(means[-1].index(max(means[-1])) if bs else n - 1)

    def table(key):
        out = collections.defaultdict(lambda: [0.0] * n)
        for r, f in zip(rows, first):
            if key(r) is not None:
                out[key(r)][f] += 1
        return out

    declared, suffix, host = (table(lambda r, k=k: low(r[k])) for k in (3, 4, 5))
    total = [sum(f == i for f in first) for i in range(n)]
    base = [(x + CELL_ROWS) / (sum(total) + n * CELL_ROWS) for x in total]
    base[-1] = UNKNOWN_PRIOR
    prior = lambda own, parent: [(o + PRIOR_ROWS * p) / (sum(own) + PRIOR_ROWS) for o, p in zip(own, parent)]
    suffix_prior = {s: prior(own, base) for s, own in suffix.items()}
    pair = table(lambda r: (low(r[5]), low(r[4])) if r[5] is not None else None)
    host_prior = {}
    for h, own in host.items():
        weights = {s: sum(v) for (g, s), v in pair.items() if g == h}
        parent = [sum(w * suffix_prior.get(s, base)[i] for s, w in weights.items()) / sum(weights.values()) for i in range(n)]
        host_prior[h] = prior(own, parent)

    def given(cells):
        all_rows = [sum(v[i] for v in cells.values()) for i in range(n)]
        return {k: [math.log((v[i] + CELL_ROWS) / (all_rows[i] + CELL_ROWS * (len(cells) + 1))) for i in range(n)] for k, v in cells.items()}

    d_log, a_log = given(declared), given(suffix)
    out = {}
    for (i, t, _, d, a, h), mean, f in zip(rows, means, first):
        size = len(buckets(t))
        if not size:
            out[i] = (UNKNOWN, 1.0, UNKNOWN)
            continue
        weight = size / (1 + size / FULL_WEIGHT)
        p = host_prior.get(low(h)) or suffix_prior.get(low(a)) or base
        zero = [0.0] * n
        logs = [m * weight + math.log(q) + x + y for m, q, x, y in zip(mean, p, d_log.get(low(d), zero), a_log.get(low(a), zero))]
        best = logs.index(max(logs))
        out[i] = (names[best], 1 / sum(math.exp(x - logs[best]) for x in logs), names[f])
    return out


def text(letters, n):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 6))) for _ in range(n))


def sample():
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgéü"}
    rows = []
    for i in range(150):
        l = R.choice(sorted(letters))
        label = R.choice([l, l.upper(), None])
        declared = R.choice([l, "AA", None])
        host = R.choice([f"{l}.host.{l}", "big.com", None])
        suffix = None if host is None or R.random() < 0.2 else host.split(".")[-1]
        rows.append((i, R.choice([text(letters[l], R.randint(1, 30)), text(letters[l], 2), text("xyz", 3)]), label, declared, suffix, host))
    rows += [(150, None, "aa", "aa", "com", "big.com"), (151, "", None, None, None, None), (152, "12 34", "bb", "bb", "bb", "bb.host.bb"), (153, text("abcde", 3000), None, "bb", "bb", "new")]
    return rows


def test_posterior_by_hand(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, label string, declared string, suffix string, host string, first int, mean string")
    got = {x.doc_id: x for x in language_id.identify(df, "doc_id", "text", "declared", "suffix", "host", "label").collect()}
    want = posteriors(rows)
    assert {i: (x.language, x.text_language) for i, x in got.items()} == {i: (w[0], w[2]) for i, w in want.items()}
    assert all(abs(got[i].posterior - w[1]) < 1e-4 for i, w in want.items())
    assert any(w[0] != w[2] for w in want.values())  # other evidence turns some texts


def test_documents_and_pages(spark, tmp_path):
    """Pages bring markup language, suffix and host; weak pages follow them; repeated rows and null ids stay."""
    docs = [(i, text("abcde" if i % 2 else "opqrs", 40), "aa" if i % 2 else "bb", "s", 0) for i in range(40)] + [(None, text("abcde", 9), None, None, 0), (0, "ab", None, "s", 0)]
    page = lambda i, l, host, body: (i, f"https://{host}/x", f'<html lang="{l}"><body><p>{body}</p></body></html>')
    pages = [page(i, "aa" if i % 2 else "bb", f"h{i % 2}.{'xa' if i % 2 else 'xb'}", text("abcde" if i % 2 else "opqrs", 30)) for i in range(40)]
    pages += [page(40, "aa", "h1.xa", "ex"), page(41, "bb", "h0.xb", "ex"), (42, None, None), pages[0], (None, *pages[1][1:])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, page_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = language_id.op8_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(docs) + len(pages) and all(x.doc_id is None or x.page_id is None for x in out)
    by_page = {x.page_id: x.language for x in out if x.page_id is not None}
    assert [by_page[i] for i in (40, 41, 42)] == ["aa", "bb", UNKNOWN]
    assert all(by_page[i] == ("aa" if i % 2 else "bb") for i in range(40))
    assert all(x.language == ("aa" if x.doc_id % 2 else "bb") for x in out if x.doc_id)


def test_a_very_long_text_and_ties(spark):
    rows = [(1, text("abcde", 150_000), "aa", "s"), (2, text("opqrs", 50), "bb", "s"), (3, "xyz", None, "s"), (3, "xyz", None, "s")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {x.doc_id: x.language for x in got if x.doc_id < 3} == {1: "aa", 2: "bb"}
    assert len({(x.language, x.posterior) for x in got if x.doc_id == 3}) == 1 and len(got) == 4
