"""What the random field adds to the patterns, on sentences labelled by hand and on the documents."""

import random
import re

import numpy as np

from millrace.llm import pii

#: Spans that the patterns cannot give are in brackets of the form <<kind|text>>.
SENTENCES = [
    "Call our office <<phone|(555) 123-4567>> before noon on weekdays.",
    "Die Nummer ist <<phone|(03471) 882211>> und wir sind bis 18 Uhr da.",
    "You may ring <<phone|212-555-0187>> or come to room 12 of building 4.",
    "Telefon <<phone|0341/9876543>>, Zimmer 3.",
    "Her line, <<phone|415.555.0132>>, was busy all day.",
    "Reach us at +1 (017) 555-7713 or at <<phone|(017) 555-7713>> today.",
    "Write to <<email|jo (at) mail (dot) org>> for a copy.",
    "Escriba a <<email|ana42 [at] correo [dot] es>> antes del lunes.",
    "The list is kept by <<email|sam (at) lists (dot) example (dot) net>> these days.",
    "Mail jo@mail.example.com or <<email|jo {at} host {dot} org>> please.",
    "The server <<ip|10[.]0[.]0[.]5>> did not answer.",
    "Traffic came from <<ip|203[.]0[.]113[.]77>> at night, and from 198.51.100.7 at noon.",
    "Blocked: <<ip|192.168.1[.]20>> for an hour.",
    "She paid with <<card|9807915762804490>> last week.",
    "La tarjeta <<card|4845 1681 1440 7329>> fue rechazada.",
    "Use <<card|4539.1488.0343.6468>> for the test.",
    "Ou bien <<card|5927/2430/7427/3351>>, dit-il.",
    "Billed to <<card|4550997810720808>>, then refunded.",
    "THE CARD <<card|5927243074273351>>!! OF!! THE!! HOUSE!!",
    "Carte <<card|371449635398432>> valable encore.",
    # Nothing to add.
    "The meeting is on 2024-03-11 at 10:30:00 in room 204.",
    "Version 2.0.17 replaced 1.9.3 in May.",
    "Licensed under the Apache License, Version 2.0.",
    "The order 1234567 has 3 parts, 12 screws and 400 nuts.",
    "It cost 1,250,000 in 1998 and 3,400,000 in 2004.",
    'Set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and restart.',
    "Look at password=8812734590a812345 in the file.",
    "Serial 123456789012 is on the back.",
    "There are (at) signs and a lone (dot) here.",
    "We met 12 people, 13 dogs and 14 cats.",
    "The ratio was 3.14 and the sum 2.71 or so.",
    "Pages 120-134 and 2001-2004 are missing.",
    "Paid with 4539 1488 0343 6467 and sent to jo@mail.example.com from 10.0.0.5.",
    "An id of 1234567890123456789012 is too long.",
    "She wrote (once) [twice] and - never - again.",
]
MARK = re.compile(r"<<(\w+)\|(.*?)>>")


def labelled():
    for i, s in enumerate(SENTENCES):
        text, want, at = "", set(), 0
        for m in MARK.finditer(s):
            text += s[at : m.start()]
            want.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        yield i, text + s[at:], want


def test_spans_labelled_by_hand(spark):
    rows = list(labelled())
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if not s.base} for r in pii.find_personal_data(df).collect()}
    right = sum(len(got[i] & want) for i, _, want in rows)
    found, all_of = sum(len(x) for x in got.values()), sum(len(want) for _, _, want in rows)
    print(f"recall {right}/{all_of}, precision {right}/{found}", [(i, got[i], want) for i, _, want in rows if got[i] != want])
    assert right >= 0.9 * all_of and right >= 0.9 * found


def test_numbers_of_the_documents(spark):
    """Against the documents themselves: runs of 15 or 16 digits that stand alone and fail the check digit."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    want, found = set(), set()
    for r in df.collect():
        base = pii.base_spans(r.text or "")
        for m in re.finditer(r"(?<!\S)[|]?([0-9]{15,16})(?=[.,;!$%&*#|]*(\s|$))", r.text or ""):
            if all(m.end(1) <= a or m.start(1) >= b for a, _, b in base):
                want.add((r.doc_id, m.start(1), m.end(1)))
        found |= {(r.doc_id, s.start, s.end) for s in got[r.doc_id] if not s.base}
    print(f"recall {len(want & found)}/{len(want)}, precision {len(want & found)}/{len(found)}")
    assert len(want) >= 10 and len(want & found) >= 0.9 * len(want) and len(want & found) >= 0.8 * len(found)


def test_segments():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 40)
        odd = np.array([r.random() < 0.1 for _ in range(n)])
        stop = np.array([r.random() < 0.1 for _ in range(n + 1)])
        stop[[0, n]] = True
        sentence = np.cumsum(stop[:n])
        want = [i for i in range(n) if any(odd[j] and sentence[j] == sentence[i] and abs(i - j) <= pii.REACH for j in range(n))]
        where, bounds = pii.segments(odd, stop)
        assert where.tolist() == want
        runs = [where[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert all(x == list(range(x[0], x[-1] + 1)) and len({sentence[i] for i in x}) == 1 for x in runs)
        assert all(b[0] > a[-1] + 1 or stop[b[0]] for a, b in zip(runs, runs[1:]))


def test_very_long_texts(spark):
    """Of plain words, and of numbers without a stop."""
    rows = [(0, "word " * 400_000 + "call (555) 123-4567 now"), (1, "12 " * 100_000)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == [("phone", 2_000_005, 2_000_019)]
