"""The forest's use of path, dictionary and neighbours; awkward rows."""

import random

from millrace.llm import secret_scan

R = random.Random(15)
HEX = "0123456789abcdef"
WORDS = ["harbour", "number", "window", "station", "matter", "garden", "village", "morning"]


def key(n, letters=HEX):
    return "".join(R.choice(letters) for _ in range(n - 1)) + "7"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_path_dictionary_and_neighbours_decide(spark):
    rows, want = [], {}
    for i in range(30):
        value = key(40)
        rows += [(4 * i, f'{prose(20)} token = "{value}" {prose(3)}', "src/app.py"), (4 * i + 1, f'{prose(20)} token = "{value}" {prose(3)}', "tests/fixtures/a.json")]
        words = "-".join(R.choice(WORDS) for _ in range(4)) + "-7"
        rows += [(4 * i + 2, f"{prose(20)} token = {words} {prose(3)}", "src/app.py"), (4 * i + 3, f"{prose(20)} the sha256 checksum {key(64)} {prose(3)}", "src/app.py")]
        want |= {4 * i: True, 4 * i + 1: False, 4 * i + 2: False, 4 * i + 3: False}
    got = {x.doc_id: x.is_secret for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want), {i % 4: 0 for i in want if got[i] != want[i]}


def test_awkward_rows(spark):
    """Null ids and paths, repeated rows, clashing names, a very long text, two secrets in one word."""
    first, second = key(18), key(40)
    text = f"{prose(10)} password={first},token={second} and {prose(5)}"
    long = " ".join(WORDS) * 20_000 + f" password={first} {prose(5)}"
    rows = [(None, text, None), (1, text, "s"), (1, text, "s"), (2, long, "s"), (3, None, "s"), (4, "", None)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, source string, key string, value int, path_rate double").withColumnRenamed("value", "entry")
    got = sorted(((x.doc_id, x.candidate, x.is_secret) for x in secret_scan.scan(df).collect()), key=str)
    pair = [first, second]
    assert got == sorted([(i, v, True) for i in (None, 1, 1) for v in pair] + [(2, first, True)], key=str)
