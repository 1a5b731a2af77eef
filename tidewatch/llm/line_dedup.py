"""Line dedup by winnowing (operator 5), in native columns.

Lines without a word take no part.  A *window* begins at every line and is the shortest run
of lines from there with at least ``min_words`` words; a line of that length is a window by
itself.  From each window its smallest line hash is selected, the leftmost of equal ones:
the fingerprints of the document.  A run of lines that occurs twice with ``min_words`` words
or more holds the same window in both places, hence the same fingerprint: none is missed.

Fingerprints (line hash, document, place) are joined by their line hash: one that is at a
single place of the corpus is dropped with the windows it was selected from, which is what
becomes of most of a large corpus.  What two places share is decided on the windows of the
fingerprints left: a window is compared with the earliest occurrence of the same window in
(doc_id, text hash, line) order, never with the earliest place of its fingerprint alone, since
that line may stand there among others and the match with a third place would be lost.  A
line that is everywhere makes no pairs either way.

Windows of one document with the same distance to the same earlier document are one
match; it is extended both ways over all lines that are equal at that distance, and every
unbroken run of equal lines that holds a window is deleted from the later place.  The
earliest occurrence always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, pick, written

MIN_WORDS = 50
SALTS = 16
BLANKS = "\t\n\x0b\x0c\r "


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, h, x, n``: hash and number of words of every line that has a word.

    Written once; all that follows reads this narrow table, not the texts.
    """
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), F.split(F.coalesce("text", F.lit("")), "\n").alias("all"))
    counted = rows.select("doc_id", "h", F.transform("all", lambda x: F.struct(F.xxhash64(x).alias("x"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("all"))
    worded = counted.select("doc_id", "h", F.filter("all", lambda x: x["n"] > 0).alias("lines"))
    return written(worded.select("doc_id", "h", F.col("lines.x").alias("x"), F.col("lines.n").alias("n")), "line-hashes")


def _windows(hashed: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, h, first, len, pick, print, window``: all windows, the place and hash of their
    minimum and a hash of their content."""
    n = F.col("n")
    # a window has no more than min_words lines, so looking that far is enough at any length
    def at(i):
        reach = F.slice(n, i + 1, min_words)
        sums = F.aggregate(
            reach, F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
            lambda acc, k: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["words"] + k).alias("words"), (acc["lines"] + 1).alias("lines"))),
        )
        return F.struct(i.alias("first"), sums["lines"].alias("len"), sums["words"].alias("words"))

    # explode_outer: a plain explode adds a filter on the size of its array, which is then
    # pushed below and computed a second time, inside out
    found = hashed.select("doc_id", "h", "x", F.filter(F.transform(n, lambda _, i: at(i)), lambda w: w["words"] >= min_words).alias("w"))
    each = found.select("doc_id", "h", "x", F.explode_outer("w").alias("w")).where("w IS NOT NULL").select("doc_id", "h", F.col("w.first").alias("first"), F.col("w.len").alias("len"), F.slice("x", F.col("w.first") + 1, F.col("w.len")).alias("x"))
    return each.select(
        "doc_id", "h", "first", "len", F.array_min("x").alias("print"),
        (F.col("first") + F.array_position("x", F.array_min("x")).cast("int") - 1).alias("pick"),
        F.concat(F.xxhash64("x"), F.lit(" "), F.md5(F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).cast("binary"))).alias("window"),
    )


def _with_shared_print(windows: DataFrame) -> DataFrame:
    """The windows whose fingerprint is selected at two places or more.

    The fingerprints are repeated ``SALTS`` times and a window goes to one of them by its own
    place, so that those of a very common line don't meet in one task.
    """
    place = F.struct("doc_id", "h", "pick")
    prints = windows.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("NOT (low <=> high)")
    prints = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    return windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", "first"), F.lit(SALTS))).join(prints, ["print", "salt"], "left_semi").drop("salt")


def matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, at``: the places to delete, counted over lines with words from 0."""
    keyed = _lines(docs)
    windows = written(_with_shared_print(written(_windows(keyed, min_words), "line-windows")), "line-fingerprints")
    here = F.struct("doc_id", "h", "first")
    first_seen = windows.groupBy("window").agg(F.min(here).alias("origin"), F.count(F.lit(1)).alias("times")).where("times > 1")
    paired = windows.join(first_seen.select("window", "origin"), "window").select(
        "doc_id", "h", "first", "len", "pick", F.col("origin.doc_id").alias("o_doc"), F.col("origin.h").alias("o_h"), (F.col("first") - F.col("origin.first")).alias("shift"),
    )
    itself = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("h") == F.col("o_h")) & (F.col("shift") == 0)
    # repeated rows have equal keys, and give equal matches
    fingerprints = written(paired.where(~itself).groupBy("doc_id", "h", "o_doc", "o_h", "shift", "pick").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("len")).alias("end")), "line-matches")
    match = fingerprints.groupBy("doc_id", "h", "o_doc", "o_h", "shift").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("seeds"))

    places = keyed.select("doc_id", "h", F.posexplode("x").alias("at", "x")).distinct()
    involved = fingerprints.select("doc_id", "h").union(fingerprints.select("o_doc", "o_h")).distinct()
    places = written(places.join(involved, [places["doc_id"].eqNullSafe(involved["doc_id"]), places["h"] == involved["h"]], "left_semi"), "line-places")
    mine = places.toDF("p_doc", "p_h", "at", "x")
    theirs = places.toDF("q_doc", "q_h", "q_at", "q_x")
    shifted = match.join(mine, [F.col("doc_id").eqNullSafe(F.col("p_doc")), F.col("h") == F.col("p_h")]).select(
        "doc_id", "h", "o_doc", "o_h", "shift", "at", "x", (F.col("at") - F.col("shift")).alias("o_at")
    )
    equal = shifted.join(theirs, [F.col("o_doc").eqNullSafe(F.col("q_doc")), F.col("o_h") == F.col("q_h"), F.col("o_at") == F.col("q_at"), F.col("x") == F.col("q_x")])
    one = ["doc_id", "h", "o_doc", "o_h", "shift"]
    runs = equal.select(*one, "at", (F.col("at") - F.row_number().over(W.partitionBy(*one).orderBy("at"))).alias("island")).groupBy(*one, "island").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    seeds = match.select(*[F.col(c).alias(f"m_{c}") for c in one], F.explode("seeds").alias("seed"))
    held = runs.join(seeds, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in one] + [F.col("seed.first").between(F.col("low"), F.col("high"))], "left_semi")
    return held.select("doc_id", "h", F.explode(F.sequence("low", "high")).alias("at")).distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_deleted, deleted_lines, kept_md5`` per row of documents.

    ``deleted_lines`` are line numbers from 0; the kept lines joined by line ends are the
    new text (``clean_text`` if asked for), of which ``kept_md5`` is the digest.  Null and
    empty texts have one line without a word and lose nothing; a null doc_id sorts before
    all others; rows that repeat id and text are one document here, so neither is deleted
    for the other, and each gets a result; rows that share an id but not the text are
    ordered by a hash of the text; an empty table gives no rows; other columns are ignored.
    """
    gone = matches(docs, min_words)
    by_doc = gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("at")).alias("gone")).toDF("g_doc", "g_h", "gone")
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    # a merge join at every size: the list of documents with deletions grows with the input
    joined = rows.hint("merge").join(by_doc.hint("merge"), [F.col("doc_id").eqNullSafe(F.col("g_doc")), F.col("h") == F.col("g_h")], "left")
    # most rows lose nothing: their text is neither split nor joined again
    none = F.array().cast("array<int>")
    cut = F.size("gone") > 0
    joined = joined.select("doc_id", "text", F.coalesce("gone", none).alias("gone"))
    joined = joined.select("doc_id", "text", "gone", F.when(cut, F.split("text", "\n")).alias("all"))
    worded = F.filter(F.transform("all", lambda x, i: F.when(F.translate(x, BLANKS, "") != "", i)), lambda i: i.isNotNull())
    joined = joined.select("doc_id", "text", "all", "gone", F.when(cut, worded).alias("worded"))
    lost = joined.select("doc_id", "text", "all", F.when(F.size("worded") > 0, F.transform("gone", lambda at: F.get(F.col("worded"), at))).otherwise(none).alias("lost"))
    # (asking for the size of ``worded`` too keeps it a column: used once only, it would be
    # put into the lambda and computed again for every deleted line)
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("lost"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("all"), i)), "\n")
    text = F.when(F.size("lost") > 0, kept).otherwise(F.col("text"))
    n_breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return lost.select(
        "doc_id",
        (n_breaks + 1).cast("long").alias("n_lines"),
        F.size("lost").cast("long").alias("n_deleted"),
        F.array_join(F.transform("lost", lambda v: v.cast("string")), ",").alias("deleted_lines"),
        F.md5(text.cast("binary")).alias("kept_md5"),
        *([text.alias("clean_text")] if with_text else []),
    )
