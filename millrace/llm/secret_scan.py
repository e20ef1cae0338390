"""Secret scan with a random forest that removes false positives.

Candidates are the runs of key-like characters in long words with a digit, all of them. Each gets features:
length, changes of character class, shares of digits and capitals, distinct characters, how much of
it is covered by dictionary words (words of this corpus), its path and how many candidates that has for each text, and the
words (or the text in its own word) before and behind it. A random
forest trained from labelled findings gives the probability that a candidate is a secret. The built-in findings are made by
rule: secrets of several forms, and look-alikes that differ from them by their form, by their neighbours, by being made
of dictionary words, by lying in test data or by lying in a dump full of such strings.

Everything on this path is DataFrame, SQL or ML-pipeline code on the JVM. The dictionary is a partial
aggregation over all words of all documents (a row for each distinct word and map task is shuffled)
and is joined with the candidates' pieces only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._scratch import staged

MIN_LENGTH = 16
#: A word is in the dictionary from so many occurrences in the corpus.
DICTIONARY_COUNT = 5
#: Labelled findings that are read at most.
MAX_LABELLED = 10000
TREES, DEPTH, SEED = 30, 6, 7
_KEYWORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|credential|bearer)"
#: A run of key-like characters, with padding; where none is long enough, "=" joins them.
_RUN = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}=*|(?<![A-Za-z0-9+/_=-])(?![A-Za-z0-9+/_=-]*[A-Za-z0-9+/_-]{{{MIN_LENGTH}}})[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
_INNOCENT = r"(?i)(sha\d*|md5|checksum|digest|commit|uuid|guid|hash|etag|rev|build|version|order|invoice|card|id)\b"
FEATURES = ["length", "changes", "digits", "capitals", "hex", "distinct", "covered", "keyword_inside", "keyword_near", "innocent_near", "keyword_after", "innocent_after", "test_path", "path_rate"]
#: Dictionary words that the built-in findings use at most.
FINDING_WORDS = 500


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """id, path, place (index of the word), value, lead, before2, before, after: a row for each run of each word.

    lead is the word's text from the run before; the words before go to a word's first run only and the word behind
    to its last, so that the rows of a long word hold its text once.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    # Few texts hold a candidate; the cheap test comes before any array is built.
    rows = rows.where(F.col("text").rlike(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"))
    rows = rows.select("id", "path", _words(F.col("text")).alias("words"))
    rows = rows.select("id", "path", "words", F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))).alias("placed"))
    like = lambda w: (F.length(w) >= MIN_LENGTH) & w.rlike(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}") & w.rlike("[0-9]")
    rows = rows.select("id", "path", "words", F.explode(F.filter("placed", lambda x: like(x["word"]))).alias("x"))
    near = lambda k: F.coalesce(F.get("words", F.col("x.place") + k), F.lit(""))
    word = F.col("x.word")
    runs = F.transform(F.regexp_extract_all(word, F.lit(_RUN), F.lit(0)), lambda v, i: F.struct(i.alias("run"), v.alias("value")))
    rows = rows.select("id", "path", F.col("x.place").alias("place"), F.split(word, _RUN).alias("leads"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"), F.explode(runs).alias("r"))
    first = F.col("r.run") == 0
    lead = F.get("leads", F.col("r.run"))
    last = F.col("r.run") == F.size("leads") - 2
    return rows.select(
        "id", "path", "place", F.col("r.value").alias("value"), lead.alias("lead"),
        F.when(first, F.col("before2")).otherwise("").alias("before2"), F.when(first, F.col("before")).otherwise(lead).alias("before"),
        F.when(last, F.col("after")).otherwise(F.get("leads", F.col("r.run") + 1)).alias("after"),
    )


def dictionary(docs: DataFrame, text_col: str, least: int = DICTIONARY_COUNT) -> DataFrame:
    """Words of 3 to 20 letters a-z that occur ``least`` times or more in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("entry"))
    counts = words.where(F.length("entry").between(3, 20)).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select("entry")


def features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """found with FEATURES; needs key (unique), value and lead, before2, before, after, path, path_rate_in.

    A labelled finding has a word in place of value and lead: the run at its end, or else the first.
    """
    rows = found
    if "value" not in found.columns:
        value = F.regexp_extract("word", rf"([A-Za-z0-9+/_-]{{{MIN_LENGTH},}}=*)[^A-Za-z0-9]*$", 1)
        value = F.when(value != "", value).otherwise(F.regexp_extract("word", rf"([A-Za-z0-9+/_=-]{{{MIN_LENGTH},}})", 1))
        rows = found.withColumn("value", value).withColumn("lead", F.expr("substring(word, 1, greatest(length(word) - length(value), 0))"))
    pieces = rows.select("key", F.explode(F.array_distinct(F.split(F.lower("value"), "[^a-z]+"))).alias("piece")).where(F.length("piece") >= 3)
    known = pieces.join(entries.hint("merge"), F.col("piece") == F.col("entry"), "left_semi").groupBy(F.col("key").alias("k_key")).agg(F.sum(F.length("piece")).alias("letters"))
    rows = rows.join(known.hint("merge"), F.col("key") == F.col("k_key"), "left")
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    near = F.concat_ws(" ", "before2", "before")
    as_number = lambda c: c.cast("double")
    return rows.select(
        *[c for c in found.columns if c not in ("path_rate_in", "path_rate", "value")],
        "value",
        F.length("value").cast("double").alias("length"),
        count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])|[^A-Za-z0-9](?=[A-Za-z0-9])").alias("changes"),
        count("[0-9]").alias("digits"),
        count("[A-Z]").alias("capitals"),
        as_number(F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        (F.coalesce("letters", F.lit(0)) / n).alias("covered"),
        as_number(F.coalesce(F.col("lead").rlike(_KEYWORD), F.lit(False))).alias("keyword_inside"),
        as_number(near.rlike(_KEYWORD)).alias("keyword_near"),
        as_number(near.rlike(_INNOCENT)).alias("innocent_near"),
        as_number(F.coalesce(F.col("after").rlike(_KEYWORD), F.lit(False))).alias("keyword_after"),
        as_number(F.coalesce(F.col("after").rlike(_INNOCENT), F.lit(False))).alias("innocent_after"),
        as_number(F.coalesce(F.col("path").rlike(r"(?i)(test|example|sample|fixture|mock|docs?/)"), F.lit(False))).alias("test_path"),
        F.col("path_rate_in").alias("path_rate"),
    )


def labelled_findings(spark: SparkSession, n: int = 200, entries: DataFrame | None = None) -> DataFrame:
    """word, before2, before, after, path, path_rate and label, made by rule: n rows of each kind.

    entries: the corpus's dictionary, of which at most FINDING_WORDS words are used.
    """
    words = [] if entries is None else [r[0] for r in entries.where(F.length("entry") >= 5).orderBy(F.xxhash64("entry"), "entry").limit(FINDING_WORDS).collect()]
    base = spark.range(n).select(F.col("id").cast("string").alias("i"))
    hexed = lambda salt: F.sha2(F.concat(F.col("i"), F.lit(salt)).cast("binary"), 256)
    capital = lambda salt, k: F.substring(F.translate(F.upper(F.regexp_replace(F.base64(F.unhex(hexed(salt))), "[+/=]", "")), "0189", "WXYZ"), 1, k)
    mixed = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(hexed(salt))), "[+/=]", ""), 1, k)
    letters = lambda salt, k: F.translate(F.substring(hexed(salt), 1, k), "0123456789", "ghijklmnop")
    digits = lambda salt, k: F.translate(F.substring(hexed(salt), 1, k), "abcdef", "013579")
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(len(options))).cast("int") + 1)
    known = lambda salt: pick(words, salt) if words else letters(salt, 7)
    joined = lambda salt: F.concat(known(f"{salt}1"), pick("-_/", f"{salt}s"), known(f"{salt}2"), pick("-_/", f"{salt}t"), known(f"{salt}3"), pick("-_/", f"{salt}u"), known(f"{salt}4"), F.lit("-"), digits(f"{salt}5", 1))
    aws, password, token = F.concat(F.lit("AKIA"), capital("a", 14), digits("a", 2)), F.concat(F.lit("password="), F.substring(hexed("b"), 1, 18)), F.concat(F.lit('"'), F.substring(hexed("c"), 1, 40), F.lit('"'))
    secret, api = F.concat(mixed("d", 31), F.lit("7")), F.concat(F.lit("sk_"), mixed("e", 23), F.lit("4"))
    guessed = F.concat(letters("q", 6), F.lit("-"), letters("r", 7), F.lit("-"), letters("s", 6), F.lit("-"), digits("t", 1))
    say = F.lit
    home = ["", "src/app.py", "config/prod.env", "notes.txt", "src3"]
    tests = ["tests/test_auth.py", "spec/fixtures/keys.json", "examples/demo.env", "docs/guide.md", "test/sample.yml"]
    # word, before2, before, after, paths, candidates for each text of the path, label
    kinds = [
        (aws, say("of"), say("and"), say("in"), home, 0.05, 1.0),
        (password, say("the"), say("in"), say("of"), home, 0.05, 1.0),
        (token, say("token"), say("="), say("the"), home, 0.05, 1.0),
        (secret, say("secret"), say("key:"), say(""), home, 0.05, 1.0),
        (api, say("api"), say("is"), say("for"), home, 0.05, 1.0),
        (secret, say("a"), say("of"), say("secret"), home, 0.05, 1.0),
        (guessed, say("token"), say("="), say("the"), home, 0.05, 1.0),
        (guessed, say("password"), say("is"), say("now"), home, 0.05, 1.0),
        # Look-alikes by form or neighbours.
        (F.concat(letters("f", 5), say("-"), letters("g", 6), say("-"), letters("h", 5), say("-20240311")), say("see"), say("page"), say("in"), home, 0.05, 0.0),
        (hexed("i"), say("sha256"), say("checksum"), say("of"), home, 0.05, 0.0),
        (F.substring(hexed("v"), 1, 40), say("in"), say("the"), say("commit"), home, 0.05, 0.0),
        (F.concat(F.substring(hexed("j"), 1, 8), say("-"), F.substring(hexed("k"), 1, 4), say("-"), F.substring(hexed("l"), 1, 4), say("-"), F.substring(hexed("m"), 1, 12)), say("uuid"), say("is"), say("of"), home, 0.05, 0.0),
        (digits("n", 16), say("card"), say("number"), say("and"), home, 0.05, 0.0),
        (digits("w", 16), say("the"), say("of"), say("and"), home, 0.05, 0.0),
        (F.concat(letters("o", 4), say("1111111111111111")), say("a"), say("row"), say("of"), home, 0.05, 0.0),
        # By dictionary words.
        (joined("x"), say("token"), say("="), say("the"), home, 0.05, 0.0),
        (joined("y"), say("password"), say("is"), say("now"), home, 0.05, 0.0),
        (joined("z"), say("see"), say("the"), say("and"), home, 0.05, 0.0),
        # By place.
        (aws, say("of"), say("and"), say("in"), tests, 0.05, 0.0),
        (password, say("the"), say("in"), say("of"), tests, 0.05, 0.0),
        (token, say("token"), say("="), say("the"), tests, 0.05, 0.0),
        (secret, say("a"), say("of"), say("and"), home, 20.0, 0.0),
        (F.substring(hexed("p"), 1, 40), say("a"), say("of"), say("and"), home, 20.0, 0.0),
    ]
    out = None
    for k, (word, before2, before, after, paths, rate, label) in enumerate(kinds):
        place = [pick(paths, f"path{k}").alias("path"), F.lit(rate).alias("path_rate"), F.lit(label).alias("label")]
        part = base.select(F.concat(F.lit(f"{k}-"), "i").alias("key"), word.alias("word"), before2.alias("before2"), before.alias("before"), after.alias("after"), *place)
        out = part if out is None else out.unionAll(part)
    return out.coalesce(2)


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(labelled: DataFrame, entries: DataFrame) -> RandomForestClassificationModel:
    """The forest from labelled findings: key, word, before2, before, after, path, path_rate, label; at most MAX_LABELLED rows.

    A null word or label takes a row out; other nulls count as empty or 0.
    """
    rows = labelled.limit(MAX_LABELLED).where("label is not null and word is not null").withColumn("path_rate_in", F.coalesce(F.col("path_rate"), F.lit(0.0)))
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(_vector(features(rows, entries)).select("features", "label"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = 0.5) -> DataFrame:
    """id_col, place, candidate, path, probability, is_secret: a row for each candidate of each text.

    place is the index of the word in its text; a word has a row for each of its runs of MIN_LENGTH key-like characters or
    more (letters, digits and + / _ - =); words without a digit have none. Null and empty texts, and texts without a candidate,
    give no rows; null paths count as empty, null ids stay null, repeated rows are scanned each.
    Empty tables give an empty result; other columns are not read. ``labelled`` replaces the built-in findings (see train).
    """
    spark = docs.sparkSession
    entries = staged(dictionary(docs, text_col), "secret-dictionary")
    found = staged(candidates(docs, id_col, text_col, path_col).withColumn("key", F.monotonically_increasing_id().cast("string")), "secret-candidates")
    model = train(labelled_findings(spark, entries=entries) if labelled is None else labelled, entries)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rates = docs.groupBy(path.alias("r_path")).agg(F.count(F.lit(1)).alias("rows"))
    hits = found.groupBy(F.col("path").alias("h_path")).agg(F.count(F.lit(1)).alias("hits"))
    rates = staged(rates.join(hits, F.col("r_path") == F.col("h_path")).select("r_path", (F.col("hits") / F.col("rows")).alias("path_rate_in")), "secret-paths")
    rows = found.join(rates, F.col("path") == F.col("r_path"), "left").drop("r_path")
    scored = model.transform(_vector(features(rows.withColumn("path_rate_in", F.coalesce("path_rate_in", F.lit(0.0))), entries)))
    chance = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), F.col("place").cast("long").alias("place"), F.col("value").alias("candidate"), "path", chance.alias("probability"), (chance >= cut).alias("is_secret"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in all documents with the forest's verdict."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
