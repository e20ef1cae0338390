"""Several secrets in one word."""

import collections
import random

from millrace.llm import secret_scan

R = random.Random(5)
HEX, CAPITALS = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZ234567"


def key(n, letters):
    return "".join(R.choice(letters) for _ in range(n - 1)) + "7"


def test_every_run_of_a_word_is_scored(spark):
    aws, token, password = "AKIA" + key(16, CAPITALS), key(40, HEX), key(18, HEX)
    many = [key(40, HEX) for _ in range(300)]
    rows = [
        (0, f'{{"aws_key":"{aws}","token":"{token}","p":"/assets/static-files-main/"}}'),
        (1, f"see https://h.example/?password={password}&api_key={token}&page=2 now"),
        (2, "".join(f'"token":"{k}",' for k in many)),
        (3, f"one password={password}, a=b1=c2=d3=e4=f5=g6"),
    ]
    want = {0: [aws, token, "/assets/static-files-main/"], 1: [password, token], 2: many, 3: [password, "a=b1=c2=d3=e4=f5=g6"]}
    found = collections.defaultdict(list)
    secret = set()
    for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), path_col=None).collect():
        found[x.doc_id].append(x.candidate)
        if x.is_secret:
            secret.add((x.doc_id, x.candidate))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert {(0, aws), (0, token), (1, password), (1, token), (3, password)} <= secret
    assert sum((2, k) in secret for k in many) >= 290
