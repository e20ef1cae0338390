"""Every declared language has a model, and pages bring all evidence."""

import random

from millrace.llm import language_id

R = random.Random(3)


def text(letters, n):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 7))) for _ in range(n))


def test_rare_and_many_languages(spark, monkeypatch):
    """120 languages, a script each; some with one row; one without text."""
    monkeypatch.setattr(language_id, "HELD_LANGUAGES", 7)
    names = [f"l{i:03}" for i in range(120)]
    script = {l: [chr(0x3400 + 8 * i + k) for k in range(8)] for i, l in enumerate(names)}
    rows = [(100 * i + k, text(script[l], 25), l, "s") for i, l in enumerate(names) for k in range(6 if i % 2 else 1)]
    rows += [(-1, None, "none", "s"), (-2, "12 34", "none", "s"), (-3, text("abcdefghijklmnopqrst", 30), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    assert all(got[i].language == l and got[i].kept for i, _, l, _ in rows[:-3])
    assert {i for i, x in got.items() if not x.kept} == {-1, -2, -3}


def test_few_rows(spark):
    """Under five rows for each language, nothing is lost."""
    rows = [(0, text("abcde", 40), "aa", "s"), (1, text("opqrst", 40), "bb", "s"), (2, text("opqrst", 40), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x.doc_id: x.language for x in language_id.identify(df).collect()} == {0: "aa", 1: "bb", 2: "bb"}
    assert language_id.drop_unknown(df).count() == 3
