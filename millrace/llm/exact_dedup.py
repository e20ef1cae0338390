"""Exact dedup by distributed MSD radix partitioning.

Rows start in one group. Each round splits every group by the next bytes of its texts; a group with
one row leaves as a singleton, a group whose texts have ended is a class of equal texts, and only
the rest goes to the next round, with a digit sixteen times as wide. Texts are compared by their
own bytes in every round; no digest takes part in the decision. The first digit also holds the
length in bytes, so the texts of a group end in the same round.

A round is one partial aggregation (a row for each distinct digit and map task, so that a class
with a third of all rows costs no more than any other) and one sort-merge join of the rows with the
repeated digits, whose large partitions adaptive execution may split. Rounds are written to the
shared folder; the number of rounds grows with the logarithm of the longest repeated text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._scratch import staged, without

FIRST_DIGIT = 64
GROWTH = 16


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """Classes of equal texts, a row for each input row.

    Returns id_col, keep_id (smallest id of the class), group_size, kept and text (normalised).
    Null and empty texts are equal. Rows that repeat an id are rows like others: all rows with the
    smallest id of a class are kept. A row without id is counted, and kept only when no row of
    its class has an id. An empty table gives an empty result. Other columns are not read.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("rest"))
    rows = rows.select("id", "rest", F.octet_length("rest").cast("long").alias("size"), F.lit(0).cast("long").alias("grp"))
    done: list[DataFrame] = []
    start, width = 0, first_digit
    while True:
        digit = F.substring(F.col("rest").cast("binary"), start + 1, width)
        keyed = rows.select("id", "rest", F.col("size"), F.col("grp"), digit.alias("digit"))
        groups = (
            keyed.groupBy("grp", "size", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
            .where("n > 1")
            .select(F.col("grp").alias("g_grp"), F.col("size").alias("g_size"), F.col("digit").alias("g_digit"), "n", "least", F.monotonically_increasing_id().alias("next"))
        )
        groups = staged(groups, "radix-groups")
        end = start + width
        # Sort-merge at every size: the repeated digits grow with the input.
        joined = keyed.join(groups.hint("merge"), (F.col("grp") == F.col("g_grp")) & (F.col("size") == F.col("g_size")) & (F.col("digit") == F.col("g_digit")), "left")
        more = F.col("next").isNotNull() & (F.col("size") > end)
        joined = staged(
            joined.select(
                "id", "rest", "size",
                more.alias("more"),
                F.when(more, F.col("next")).otherwise(F.lit(0)).cast("long").alias("grp"),
                F.when(F.col("next").isNotNull(), F.col("n")).otherwise(F.lit(1)).cast("long").alias("n"),
                F.when(F.col("next").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("least"),
            ),
            "radix-rows",
        )
        done.append(joined.where(~F.col("more")))
        rows = joined.where("more").select("id", "rest", "size", "grp")
        if rows.isEmpty():
            break
        start, width = end, width * growth
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select(
        F.col("id").alias(id_col),
        F.col("least").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"),
        F.col("rest").alias("text"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of equal texts, in the columns of docs. Rows without id stay."""
    return without(docs, exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(id_col), id_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
