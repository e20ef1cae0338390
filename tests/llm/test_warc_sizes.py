"""Archives bounded in bytes, large payloads, repeated rows, clashing names."""

import base64
import hashlib

from pyspark.sql import functions as F

from millrace.llm import warc


def test_large_payloads_get_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_FILE", ((0, 10), (1000, 2), (5000, 1)))
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(40)] + [(100 + i, None, "y" * (1000 + i)) for i in range(5)] + [(200 + i, "", "z" * (6000 + i)) for i in range(3)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, digest string, least int").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    sizes = {}
    for f in (tmp_path / "w").rglob("*.gz"):
        sizes.setdefault(f.parent.name, []).append(len(list(warc.parse(f.read_bytes()))) // 3)
    assert sorted(sizes["from-0"]) == [10] * 4 and sorted(sizes["from-1000"]) == [1, 2, 2] and sizes["from-5000"] == [1] * 3
    got = {int(r.metadata.notes["page_id"]): (r.response.payload_bytes, r.response.payload_digest) for r in warc.captures(spark, path).collect()}
    assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}


def test_one_very_large_payload_and_repeated_rows(spark, tmp_path):
    big = "<p>" + "w" * (17 << 20)
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "v", "a"), (2, "v", "a"), (None, None, None)], "page_id long, url string, html string")
    df = df.unionAll(spark.range(1).select((F.col("id") + 9).alias("page_id"), F.lit("big").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("w"), 17 << 20)).alias("html")))
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    rows = warc.captures(spark, path).collect()
    got = sorted((r.metadata.notes["page_id"], r.response.type, r.metadata.notes.get("refers_to"), r.response.payload_bytes) for r in rows if "page_id" in r.metadata.notes)
    assert got == [("1", "response", None, 1)] * 2 + [("2", "revisit", "1", 1)] * 2 + [("9", "response", None, len(big))]
    assert len(rows) == 6
