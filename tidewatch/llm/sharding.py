"""Proportional stratified interleaving of sources over shards (operator 11), in native columns.

Within its source every row gets a rank by a seeded shuffle, and from it a fractional rank
``(rank + phase) / rows of the source``, with a seeded phase in [0, 1) per source.  Sorted by
fractional rank all sources advance at the same pace, so any cut of that order holds each
source in its share of the whole, give or take two rows.  The order is cut into shards whose
row counts differ by one at most.

Neither rank is numbered in one task per source or in one task at all: rows are dealt into
cells of about ``cell_rows`` rows (by their shuffle key within the source, then by their
fractional rank), cells are counted with partial sums, and a row's place is the number of
rows in earlier cells plus its place in its own.  Both keys are spread evenly by
construction, so no cell is large, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import as_uri, pick, written

SHARDS = 24
SEED = 11
CELL_ROWS = 10_000
FILE_ROWS = 100_000
KEY_BITS = 60
EXTRA_BYTES = 8


def _drawn(*parts: Column) -> Column:
    """A number of ``KEY_BITS`` bits from the md5 of the parts; null counts as absent, unlike ''."""
    named = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *named).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _before(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Rows in all earlier cells; one narrow row per cell goes through the window."""
    earlier = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, source, text_hash, size, text_crc32, rank, fraction, place, shard, slot`` per row.

    ``size`` is the text's UTF-8 bytes and 8 more, ``slot`` the place in the shard from 0.
    Null texts have no bytes and the check sum of nothing; rows of a null source are a stratum
    of their own; null ids and equal texts are spread like others, since the shuffle goes by
    id, source and text together.  Rows that repeat all three can't be told apart: they are
    folded before the shuffle, take consecutive ranks and each gets its own place.  Equal
    fractional ranks follow the seeded number of the source, then the shuffle.  An empty table
    gives no rows; other columns are ignored.  More shards than rows leave the last ones empty.
    """
    rows = pick(docs, doc_id="long", text="string", source="string")
    plain = F.coalesce("text", F.lit("")).cast("binary")
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), (F.octet_length(plain) + EXTRA_BYTES).cast("long").alias("size"), F.crc32(plain).alias("text_crc32"))
    identity = ["doc_id", "source", "text_hash", "size", "text_crc32"]
    folded = rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies"))
    folded = written(folded.withColumn("key", _drawn(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"), F.col("text_crc32"))), "shard-rows")
    total = folded.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    n_cells = max(1, -(-total // cell_rows))
    width = -(-(1 << KEY_BITS) // n_cells)

    # rank within the source: cells of the shuffle key
    celled = folded.withColumn("cell", F.floor(F.col("key") / F.lit(width)) if n_cells > 1 else F.lit(0).cast("long"))
    counts = _before(celled.groupBy("source", "cell").agg(F.sum("copies").alias("n")), ["source"], "cell")
    sizes = W.partitionBy("source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = counts.withColumn("source_rows", F.sum("n").over(sizes)).withColumn("phase", _drawn(F.lit(seed), F.col("source")))
    counts = counts.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "before", "source_rows", "phase")
    met = celled.join(counts, [celled["source"].eqNullSafe(counts["c_source"]), celled["cell"] == counts["c_cell"]]).drop("c_source", "c_cell")
    within = W.partitionBy("source", "cell").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    each = met.withColumn("first", first).withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    fraction = (F.col("rank") + F.col("phase") / F.lit(float(1 << KEY_BITS))) / F.col("source_rows")
    placed = written(each.select(*identity, "key", "rank", "phase", fraction.alias("fraction")), "shard-ranks")

    # place in the order of fractional ranks: cells of the fraction
    celled = placed.withColumn("cell", F.least(F.floor(F.col("fraction") * n_cells), F.lit(n_cells - 1)))
    counts = _before(celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell").select("cell", "before")
    within = W.partitionBy("cell").orderBy("fraction", "phase", F.col("source").asc_nulls_first(), "rank")
    place = F.col("before") + F.row_number().over(within) - 1
    ordered = celled.join(counts, "cell").withColumn("place", place.cast("long"))
    # whole-number division: the last place of a shard is never rounded into the next
    ordered = ordered.withColumn("shard", F.expr(f"place * {n_shards} div {max(total, 1)}").cast("int"))
    start = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ordered.select("doc_id", "source", "text_hash", "size", "text_crc32", "rank", "fraction", "place", "shard", (F.col("place") - start).alias("slot"))


def row_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The digest of ``assign_shards`` with the law it keeps: shards of equal row counts."""
    placed = assign_shards(docs, n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = SHARDS, seed: int = SEED, rows_per_file: int = FILE_ROWS) -> DataFrame:
    """Write ``doc_id, text, source`` as Parquet folders ``shard=<n>`` and return the table read back.

    Files hold consecutive slots and are sorted by them.  A text moves once to meet its place
    and once to its file; rows that repeat id, source and text meet as one and leave as many.
    """
    placed = assign_shards(docs, n_shards, seed).select(F.col("doc_id").alias("a_doc"), F.col("source").alias("a_source"), "text_hash", "size", "shard", "slot")
    rows = pick(docs, doc_id="long", text="string", source="string")
    once = rows.withColumn("hash", F.xxhash64("text")).groupBy("doc_id", "source", "hash").agg(F.first("text").alias("text"))
    same = [once["doc_id"].eqNullSafe(placed["a_doc"]), once["source"].eqNullSafe(placed["a_source"]), once["hash"] == placed["text_hash"]]
    full = once.join(placed, same).select("doc_id", "text", "source", "shard", "slot", F.floor(F.col("slot") / rows_per_file).alias("part"))
    full = full.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part")
    full.write.partitionBy("shard").parquet(as_uri(folder))
    return docs.sparkSession.read.schema(full.schema).parquet(as_uri(folder))
