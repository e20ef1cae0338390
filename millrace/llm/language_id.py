"""Language identification by Bayesian evidence fusion.

For each language l the log posterior of a document adds
  the text's log likelihood under byte-trigram models (one for each labelled language, counted over
  all labelled rows, and a flat one, ``und``, for text in none of them),
  log P(declared markup language | l) and log P(address suffix | l), and
  a host prior, smoothed hierarchically: host towards suffix, suffix towards the whole corpus.
The query takes documents (labels train the models; the source is the host) and pages (markup language, suffix and
host come from html and url; they have no labels) as one table.
The tables behind the last three are grouped aggregations of the text-only decisions over all rows.
The likelihood of a long text is tempered (its weight levels off at ``full_weight`` trigrams), so
that text cannot drown all other evidence and neighbouring trigrams do not count as independent.

A host with a third of all rows costs a partial aggregation and one row of a small table; the join
that brings priors back carries no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._scratch import staged, without

UNKNOWN = "und"
BUCKETS = 1 << 14
#: Languages whose counts a task holds at a time (128 KB each); beyond, it hands them on.
HELD_LANGUAGES = 256
FULL_WEIGHT = 200.0
#: Pseudo-rows that a parent lends to its child in the hierarchy of priors, and to each table cell.
PRIOR_ROWS = 20.0
CELL_ROWS = 1.0
UNKNOWN_PRIOR = 0.01

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that holds a letter and lies in one text, and row splits."""
    x = _LETTER[data].astype(np.uint32)
    n = len(x) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (x[:n] << 16) | (x[1:-1] << 8) | x[2:]
    good = (x[1:-1] != 32) | ((x[:n] != 32) & (x[2:] != 32))
    for shift in (1, 2):
        cut = offsets[1:-1] - shift
        good[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(good)
    bucket = ((code[at] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    return bucket, np.searchsorted(at, offsets)


def _labelled(docs: DataFrame, text: str, declared: str | None) -> DataFrame:
    return docs.select(F.lower(F.col(declared).cast("string")).alias("declared") if declared else F.lit(None).cast("string").alias("declared"), F.col(text).cast("string").alias("text"))


def train(docs: DataFrame, text_col: str, declared_col: str | None) -> tuple[list[str], np.ndarray]:
    """Languages (``und`` last) and log probabilities (language by bucket), counted over all rows.

    Every declared language with a trigram of text has a model.
    """
    rows = _labelled(docs, text_col, declared_col)
    langs = sorted(r[0] for r in rows.where("declared is not null").select("declared").distinct().collect() if r[0] != UNKNOWN)
    index = {l: i for i, l in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def held() -> pa.RecordBatch:
            at = np.array(sorted(sums), np.int64)
            all_of = np.stack([sums[i] for i in at]) if sums else np.zeros((0, BUCKETS), np.int64)
            sums.clear()
            i, b = np.nonzero(all_of)
            return pa.RecordBatch.from_arrays([pa.array(at[i], pa.int32()), pa.array(b, pa.int32()), pa.array(all_of[i, b], pa.int64())], names=["i", "b", "n"])

        for batch in batches:
            for declared, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                bucket, rows = _trigrams(data, offsets)
                lang = np.array([index.get(d, -1) for d in declared.to_pylist()])
                of = np.repeat(lang, np.diff(rows))
                order = np.argsort(of, kind="stable")
                of, bucket = of[order], bucket[order]
                for i in np.unique(lang[lang >= 0]):
                    here = bucket[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]
                    if len(here):
                        if len(sums) == HELD_LANGUAGES and i not in sums:
                            yield held()
                        sums[i] = sums.get(i, 0) + np.bincount(here, minlength=BUCKETS)
        yield held()

    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        got = rows.mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
        counts[got["i"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
        # Without a trigram a model would be as flat as und.
        full = counts.any(axis=1)
        langs, counts = [l for l, x in zip(langs, full, strict=True) if x], counts[full]
    smooth = counts + 0.5
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return [*langs, UNKNOWN], np.concatenate([logs, np.full((1, BUCKETS), -np.log(BUCKETS))])


def _table(scores: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of each key by text-only language, as an array."""
    sums = [F.sum(F.when(F.col("first") == i, 1.0).otherwise(0.0)) for i in range(n)]
    return scores.groupBy(*keys).agg(F.array(*sums).alias("rows"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", suffix_col: str | None = None, host_col: str | None = "source", label_col: str | None = None, full_weight: float = FULL_WEIGHT) -> DataFrame:
    """id_col, language, posterior, text_language, n_trigrams and kept, a row for each input row.

    Columns that are None or hold null give no evidence. label_col names the language that a row's text trains
    (declared_col, if it is not given) and is no evidence itself. id_col may be of any type. Every labelled language has a model; other
    columns are not read. ``kept`` is false where ``und`` is the
    likeliest: texts without letters (null and empty ones, too) and texts in none of the declared
    languages. Ties go to the alphabetically first language. An empty table gives an empty result;
    if no row declares a language, all are ``und``. Rows may repeat; ids may be null.
    """
    names, logs = train(docs, text_col, label_col or declared_col)
    weights = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    n = len(names)
    kind = docs.schema[id_col].dataType.simpleString()
    part = lambda c: F.lower(F.col(c).cast("string")) if c else F.lit(None).cast("string")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            at = 0
            for ids, data, offsets in _text.text_slices(batch.column(0), batch.column(1)):
                bucket, rows = _trigrams(data, offsets)
                size = np.diff(rows)
                full = np.flatnonzero(size)
                mean = np.zeros((len(size), n))
                if len(full):
                    for i in range(n):
                        mean[full, i] = np.add.reduceat(w[i][bucket], rows[full], dtype=np.float64) / size[full]
                rest = [batch.column(k).slice(at, len(ids)) for k in (2, 3, 4)]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), _text.list_array(mean.ravel(), np.arange(len(size) + 1) * n, pa.float64()), *rest], names=["id", "n_trigrams", "mean", "declared", "suffix", "host"])

    scores = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), part(declared_col).alias("declared"), part(suffix_col).alias("suffix"), part(host_col).alias("host")).mapInArrow(
        score, f"id {kind}, n_trigrams long, mean array<double>, declared string, suffix string, host string"
    )
    best = F.when(F.col("n_trigrams") == 0, n - 1).otherwise(F.array_position("mean", F.array_max("mean")).cast("int") - 1)
    scores = staged(scores.withColumn("first", best), "language-scores")

    whole = _table(scores, [], n).first()
    total = np.array(whole["rows"] if whole and whole["rows"][0] is not None else [0.0] * n)
    base = (total + CELL_ROWS) / (total + CELL_ROWS).sum()
    base[-1] = UNKNOWN_PRIOR
    lit = lambda values: F.array(*[F.lit(float(v)) for v in values])

    def prior(rows: Column, parent: Column) -> Column:
        """(rows + lent * parent) / (all rows + lent), for each language."""
        size = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x) + PRIOR_ROWS
        return F.zip_with(rows, parent, lambda r, p: (r + p * PRIOR_ROWS) / size)

    suffixes = _table(scores.where("suffix is not null"), ["suffix"], n).select(F.col("suffix").alias("s_suffix"), prior(F.col("rows"), lit(base)).alias("s_prior"))
    suffixes = staged(suffixes, "language-suffixes")
    # A host may have addresses of several suffixes; its parent is their mixture.
    hosts = _table(scores.where("host is not null"), ["host", "suffix"], n).join(suffixes, F.col("suffix") == F.col("s_suffix"), "left")
    sizes = F.aggregate(F.col("rows"), F.lit(0.0), lambda a, x: a + x)
    hosts = hosts.withColumn("parent", F.coalesce("s_prior", lit(base))).withColumn("size", sizes)
    hosts = hosts.groupBy("host").agg(
        F.array(*[F.sum(F.col("rows")[i]) for i in range(n)]).alias("rows"),
        F.array(*[F.sum(F.col("parent")[i] * F.col("size")) / F.sum("size") for i in range(n)]).alias("parent"),
    )
    hosts = staged(hosts.select(F.col("host").alias("h_host"), prior(F.col("rows"), F.col("parent")).alias("h_prior")), "language-hosts")

    def given(column: str, name: str) -> DataFrame:
        """log P(value | language) for each value of an evidence column."""
        cells = _table(scores.where(f"{column} is not null"), [column], n)
        sums = cells.agg(F.array(*[F.sum(F.col("rows")[i]) for i in range(n)]).alias("r"), F.count(F.lit(1)).alias("k")).first()
        all_rows = np.array(sums["r"] if sums["k"] else [0.0] * n)
        den = lit(all_rows + CELL_ROWS * (sums["k"] + 1))
        return staged(cells.select(F.col(column).alias(f"{name}_key"), F.zip_with("rows", den, lambda r, d: F.log((r + CELL_ROWS) / d)).alias(f"{name}_log")), f"language-{name}")

    declared, addressed = given("declared", "d"), given("suffix", "a")
    zero = lit(np.zeros(n))
    joined = (
        scores.join(hosts, F.col("host") == F.col("h_host"), "left")
        .join(declared, F.col("declared") == F.col("d_key"), "left")
        .join(addressed, F.col("suffix") == F.col("a_key"), "left")
        .join(suffixes, F.col("suffix") == F.col("s_suffix"), "left")
    )
    weight = F.col("n_trigrams") / (1.0 + F.col("n_trigrams") / F.lit(full_weight))
    joined = joined.select(
        "id", "n_trigrams", "first",
        F.zip_with(
            F.zip_with(F.transform("mean", lambda m: m * weight), F.coalesce("h_prior", "s_prior", lit(base)), lambda a, p: a + F.log(p)),
            F.zip_with(F.coalesce("d_log", zero), F.coalesce("a_log", zero), lambda a, b: a + b),
            lambda a, b: a + b,
        ).alias("logs"),
    )
    top = F.array_max("logs")
    named = F.array(*[F.lit(x) for x in names])
    joined = joined.select(
        "id", "n_trigrams", "first",
        F.when(F.col("n_trigrams") == 0, n - 1).otherwise(F.array_position("logs", top).cast("int") - 1).alias("best"),
        F.when(F.col("n_trigrams") == 0, 1.0).otherwise(1.0 / F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)).alias("posterior"),
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.element_at(named, F.col("best") + 1).alias("language"),
        "posterior",
        F.element_at(named, F.col("first") + 1).alias("text_language"),
        "n_trigrams",
        (F.col("best") != n - 1).alias("kept"),
    )


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", **columns: str | None) -> DataFrame:
    """The documents in a known language, in the columns of docs. Rows without id stay."""
    return without(docs, identify(docs, id_col, **columns).where(~F.col("kept")).select(id_col), id_col)


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The evidence columns of web pages: id, text (markup removed), declared, suffix and host."""
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    declared = F.regexp_extract(F.col(html_col), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    void = lambda c: F.when(c != "", c)
    return pages.select(F.col(id_col), text.alias("text"), void(declared).alias("declared"), void(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"), void(host).alias("host"))


def evidence(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Both tables as rows of id (doc_id or page_id), text, label, declared, suffix and host."""
    ident = lambda doc, page: F.struct(doc.cast("long").alias("doc_id"), page.cast("long").alias("page_id")).alias("id")
    none = F.lit(None).cast("string")
    found = page_evidence(pages)
    return documents.select(ident(F.col("doc_id"), F.lit(None)), F.col("text").cast("string"), F.col("lang").cast("string").alias("label"), none.alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host")).unionAll(
        found.select(ident(F.lit(None), F.col("page_id")), "text", none.alias("label"), "declared", "suffix", "host")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document and each page: doc_id or page_id (the other is null) and identify's columns."""
    rows = evidence(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = identify(rows, "id", "text", "declared", "suffix", "host", "label")
    return out.select("id.doc_id", "id.page_id", *out.columns[1:])
