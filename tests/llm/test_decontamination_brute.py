"""Overlaps of random texts against brute force: document, item, start, length and agreeing words."""

import random

from millrace.llm import decontamination

PUNCTUATION = ".,;:-'\"()!?"


def normal(word):
    return "".join(c for c in word.lower() if c.isalnum())


def brute(words, item):
    """Most agreeing words, their stretch's length and its start, over all stretches of all diagonals."""
    best = (0, 0, 0)
    if len(item) < decontamination.MIN_WORDS:
        at = [s for s in range(len(words) - len(item) + 1) if item and words[s : s + len(item)] == item]
        return (len(item), len(item), -at[0]) if at else best
    for s in range(1 - len(item), len(words)):
        lo, hi = max(0, s), min(len(words), s + len(item))
        same = [words[i] == item[i - s] for i in range(lo, hi)]
        for left in (i for i, x in enumerate(same) if x):
            n = 0
            for right in range(left, len(same)):
                n += same[right]
                if same[right] and n >= decontamination.MIN_WORDS and n >= decontamination.MIN_SHARE * (right + 1 - left):
                    best = max(best, (n, right + 1 - left, -(lo + left)))
    return best


def dressed(r, word):
    """With marks before, inside and behind."""
    word = word.upper() if r.random() < 0.2 else word
    k = r.randint(0, len(word))
    marks = [r.choice(PUNCTUATION) if r.random() < 0.2 else "" for _ in range(3)]
    return marks[0] + word[:k] + marks[1] + word[k:] + marks[2] + (" -" if r.random() < 0.1 else "")


def test_random_texts(spark):
    r = random.Random(12)
    word = lambda n: f"w{r.randrange(n)}"
    items = [[word(3000) for _ in range(r.choice([0, 1, 3, 9, 10, 14, 25, 60, 150]))] for _ in range(30)]
    items += [["a", "b"] * 20, ["a", "b", "c"] * 10]
    texts = []
    for _ in range(150):
        t = [word(3000) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            item = r.choice(items)
            a = r.randint(0, len(item))
            part = list(item[a : a + r.choice([5, 10, 14, 30, 120])])
            rate = r.choice([0, 0, 0.1, 0.25, 0.5])
            t += [word(3000) if r.random() < rate else w for w in part] + [word(3000) for _ in range(r.randint(0, 12))]
        texts.append(t)
    texts += [["a", "b"] * 13 + ["a", "b", "c"] * 5, []]
    rows = [(i, " ".join(dressed(r, w) for w in t)) for i, t in enumerate(texts)]
    bench = [(i, " ".join(dressed(r, w) for w in t)) for i, t in enumerate(items)]
    assert [[normal(w) for w in t.split() if normal(w)] for _, t in rows] == texts
    df, items_df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_matched, x.n_words, -x.doc_start) for x in decontamination.find_overlaps(df, items_df).collect()}
    # Of items of equal text (the empty ones aside) the smallest id stands for all.
    text_of = {}
    for i, t in bench:
        text_of.setdefault(t, i)
    want = {(d, i): b for d, t in enumerate(texts) for i, item in enumerate(items) if text_of[bench[i][1]] == i and (b := brute(t, item))[0]}
    assert got == want and len(want) > 40


def test_an_agreement_behind_a_long_gap_and_marks_before_words(spark):
    item = [f"w{i}" for i in range(49)]
    doc = [*item[:7], *(f"x{i}" for i in range(28)), *item[35:]]
    alone = item[35:]
    quoted = [('"' if i % 3 == 0 else "") + w for i, w in enumerate(item[:12])]
    long = [f"v{i}" for i in range(500)]
    texts = [doc, alone, quoted, ["p", *long]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.doc_start, x.n_words, x.n_matched) for x in decontamination.find_overlaps(df, bench).collect()}
    assert got == {(0, 0): (35, 14, 14), (1, 0): (0, 14, 14), (2, 0): (0, 12, 12), (3, 1): (1, 500, 500)}


def test_a_very_long_text_and_clashing_names(spark):
    r = random.Random(2)
    item = [f"i{k}" for k in range(20)]
    text = [f"w{r.randrange(5000)}" for _ in range(200_000)]
    text[150_000:150_020] = item
    df = spark.createDataFrame([(1, " ".join(text), 1, "x", "y")], "doc_id long, text string, bad_id int, hash string, item_words string")
    bench = spark.createDataFrame([(0, " ".join(item), 5)], "item_id long, text string, item int")
    assert [tuple(x) for x in decontamination.find_overlaps(df, bench).collect()] == [(1, 0, 150_000, 20, 20)]
    assert decontamination.drop_contaminated(df, bench).count() == 0
