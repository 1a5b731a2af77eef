"""Quality rules with a hashed n-gram log-likelihood ratio (operator 3), in native columns.

Words and word pairs are hashed into fixed numbers of buckets.  Two multinomials over the
buckets are counted: of the documents that the labels call good (the trusted target) and of
all documents (the raw corpus).  A document's score is the mean over its n-grams of
``ln(p_target / p_raw)``; it is kept at ``threshold`` or above.

The weights of the buckets are whole numbers of millionths, and a score is compared by
multiplication, so verdicts do not depend on the order of any sum.  The number of buckets
is a parameter and bounds what the driver sees; the counts cover every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import beside, original, pick, words

BUCKETS = 1 << 15  # of words, and as many of pairs
PAIR_FACTOR = 40_503
THRESHOLD_MICRO = -200_000
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOL = r"[#*$%&|<>]"
MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_grams", "score_micro"]
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "score_micro", "base_failed", "kept"]
BLANKS = "\t\n\x0b\x0c\r "


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours, from the words' hashes."""
    pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: buckets + (a * PAIR_FACTOR + b) % buckets)
    return F.concat(F.transform(h, lambda x: x % buckets), pairs)


def _scores(h: Column, table: Column, buckets: int) -> Column:
    """Per word, its weight and that of the pair it ends."""

    def score(x: Column, i: Column) -> Column:
        pair = buckets + (F.get(h, i - 1) * PAIR_FACTOR + x) % buckets
        return F.get(table, (x % buckets).cast("int")) + F.when(i > 0, F.get(table, pair.cast("int"))).otherwise(F.lit(0).cast("long"))

    return F.transform(h, score)


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """``ln(p_target / p_raw)`` in millionths for every bucket, counts raised by one.

    Each task sums its documents per bucket before anything is shuffled.  Without any
    trusted document all weights are 0.
    """
    trusted = pick(labels, doc_id="long", quality="int").where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    rows = pick(docs, doc_id="long", text="string")
    # both sizes of input get the same plan: labels grow with the documents
    flagged = rows.hint("merge").join(trusted.hint("merge"), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words(F.col("text")).alias("w"))
    grams = flagged.select("trusted", _hashes(F.col("w")).alias("h")).select("trusted", F.explode_outer(_grams(F.col("h"), buckets)).alias("bucket"))
    counted = grams.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    found = {r["bucket"]: (r["target"], r["raw"]) for r in counted.collect()}
    return weights_of(found, 2 * buckets)


def weights_of(found: dict[int, tuple[int, int]], n: int) -> list[int]:
    """At most ``n`` counts to ``n`` weights."""
    import math

    target, raw = sum(t for t, _ in found.values()), sum(r for _, r in found.values())
    if not target:
        return [0] * n
    shift = math.log((raw + n) / (target + n))
    none = (0, 0)
    return [round(1e6 * (math.log(found.get(b, none)[0] + 1) - math.log(found.get(b, none)[1] + 1) + shift)) for b in range(n)]


def with_quality(df: DataFrame, weights: list[int], text: str = "text", threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """The frame and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams,
    score_micro, base_failed, kept``; works row by row, without a shuffle.

    Null and empty texts have no words and fail; a text without n-grams scores 0.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    # an array of weights as one constant: read as text, cast once while the query is planned
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    buckets = len(weights) // 2
    had = df.columns
    lines = F.filter(F.split(plain, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = df.select(
        *had,
        words(F.col(text)).alias("__w"),
        F.regexp_count(plain, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    had = [*had, "n_symbols"]
    df = df.select(
        *had,
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _hashes(F.col("__w")).alias("__h"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__x"),
    )
    had = [*had, "word_chars", "n_words", "n_dup_lines"]
    x = F.col("__x")
    starts = F.when(F.size(x) >= WINDOW, F.sequence(F.lit(0), F.size(x) - WINDOW)).otherwise(F.array().cast("array<int>"))
    h = F.col("__h")
    df = df.select(
        *had,
        _scores(h, table, buckets).alias("__g"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW)])).alias("__win"),
    )
    df = df.select(*had, "__g", "__win", (F.size(F.array_distinct("__win")) < F.size("__win")).alias("__again"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.select(
        *had,
        F.greatest(2 * F.size("__g") - 1, F.lit(0)).cast("long").alias("n_grams"),
        F.aggregate("__g", F.lit(0).cast("long"), lambda acc, g: acc + g).alias("score_micro"),
        F.when(F.col("__again"), F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("__sorted"),
    )
    had = [*had, "n_grams", "score_micro"]
    s = F.col("__sorted")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
    df = df.select(*had, F.array_sort(F.transform(again, lambda x: x["i"])).alias("__p"))
    p = F.col("__p")
    df = df.select(*had, F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")).alias("__c"))
    repeats = F.aggregate("__c", F.lit(0).cast("long"), lambda acc, c: acc + c)
    # the results leave a generator: no filter on them can go below it, where Spark would put
    # the nested expressions into one another and compute them anew for every word
    had = [c for c in had if c not in RESULT]
    df = df.select(*had, F.inline_outer(F.array(F.struct(*MEASURED, repeats.alias("n_repeat_words")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score_micro") >= threshold_micro * F.col("n_grams")))




def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """One row per document.

    Repeated rows are each judged, and counted each in the raw corpus; repeated labels count
    once, one good label is enough; null labels and null ids of labels are no labels; a null
    doc_id stays null and is not trusted; an empty table gives no rows; other columns are
    ignored.
    """
    weights = bucket_weights(docs, labels, buckets)
    return with_quality(pick(docs, doc_id="long", text="string"), weights, threshold_micro=threshold_micro).select("doc_id", *RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    Nulls, empty texts, ties, repeated rows and empty tables as in ``quality_rules``: each row
    is judged alone, so of repeated rows all stay or none.
    """
    weights = bucket_weights(docs, labels, buckets)
    rows, names = beside(docs, text="string")
    return original(with_quality(rows, weights, threshold_micro=threshold_micro).where("kept"), names)
