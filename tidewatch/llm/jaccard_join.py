"""N-gram Jaccard join with Bayesian pruning (operator 7).

Texts are sets of word n-grams (five words; shorter texts are one n-gram).  Equal sets are
folded to one representative.  Representatives that share a band of MinHash values meet in a
bucket; a bucket of many members is cut into blocks, and every pair of blocks is a *tile*
of bounded size with a task's memory in mind.  Inside a tile, pairs are vectors:

1. In a first pass over sketches alone, MinHash values are compared a few at a time.  After ``k`` values with ``m`` matches the
   posterior of the similarity is Beta(m + 1, k - m + 1); a pair whose probability of
   reaching the threshold is below ``TOLERANCE`` is dropped.  The least ``m`` for each ``k``
   is a table made once.
2. Members that still have a pair come back with their n-gram sets, and what is left is
   verified exactly.

A pair is only taken up in the first band it shares, so it is counted once.  A tile returns
links per member and a star per connected set, never its pairs; the stars of all tiles are
joined to classes by label propagation over tables.

A pair of similarity exactly 0.8 shares none of the 16 bands of 4 values with probability
2e-4 and is lost to pruning with about 1e-5; both fall fast above the threshold, and a class
survives as long as its links still connect it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import beside, original, pick, text_slices, written
from tidewatch.llm.fm_index import hash_words
from tidewatch.session import broadcast_if_small, cut_lineage

NGRAM = 5
THRESHOLD = 0.8
BANDS = 16
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK_MEMBERS = 256
BLOCK_GRAMS = 400_000
SALTS = 16

SLICE_BYTES = 4 << 20
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_rng = np.random.default_rng(20240207)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def gram_sets(column: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    for _, _, data, ends in text_slices(column, SLICE_BYTES):
        words, starts, _ = hash_words(data, ends, _IS_WORD, _BYTE_VALUE)
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        for low, high in zip(bounds[:-1], bounds[1:]):
            size = min(n, high - low)
            if not size:
                yield np.zeros(0, np.uint64)
                continue
            h = np.full(high - low - size + 1, size, np.uint64)
            for k in range(size):
                h = _mixed(h * _MIX[0] + words[low + k : high - size + 1 + k])
            yield np.unique(h)


def digest(g: np.ndarray) -> bytes | None:
    """128 bits of a set: two sums over its elements."""
    if not len(g):
        return None
    return int(g.sum(dtype=np.uint64)).to_bytes(8, "big") + int(_mixed(g ^ _MIX[0]).sum(dtype=np.uint64)).to_bytes(8, "big")


def signature(g: np.ndarray) -> np.ndarray:
    """MinHash values, the upper 32 bits of each minimum."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 8192):
        part = g[at : at + 8192]
        for k, m in enumerate(_MULTIPLY):
            low[k] = min(low[k], (part * m).min())
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float, step: int = STEP, n: int = BANDS * ROWS) -> dict[int, int]:
    """k -> least matches m of k with P(similarity >= threshold | m of k) >= tolerance.

    With a flat prior the posterior tail is a binomial sum: P(Bin(k + 1, t) <= m).
    """
    table = {}
    for k in range(step, n + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        table[k] = m
    return table


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """Per row (``doc_id, text, text_hash``): its set's digest and size and the MinHash values;
    texts and sets themselves stay behind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, values = [], [], []
            for g in gram_sets(batch.column(1), n):
                sizes.append(len(g))
                digests.append(digest(g))
                values.append(signature(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "text_hash", "n_grams", "digest", "sketch"])

    return docs.mapInArrow(scan, "doc_id long, text_hash long, n_grams long, digest binary, sketch binary")


def _candidate_tiles(reps: DataFrame) -> DataFrame:
    """``bucket, band, ti, tj, rep``: which representatives meet in which tile."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sketch", 4 * ROWS * b + 1, 4 * ROWS)).alias("bucket")) for b in range(BANDS)])
    keys = reps.select("rep", "n_grams", F.explode(bands).alias("k")).select("rep", "n_grams", "k.band", "k.bucket")
    # a bucket's members are counted before they are moved; only shared ones go on
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("grams")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    met = keys.join(shared.select("bucket", F.least(blocks, F.col("members")).cast("int").alias("blocks")), "bucket")
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    met = met.select("bucket", "band", "rep", "blocks", own.alias("block"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("ti"), F.greatest(j, F.col("block")).alias("tj")))
    return met.select("bucket", "band", "rep", "block", F.explode(tiles).alias("t")).select("bucket", "band", "t.ti", "t.tj", "block", "rep")


def _pairs_of_tile(values: np.ndarray, rows: np.ndarray, cols: np.ndarray, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile that outlive the comparison of MinHash values."""
    if rows is cols:
        a, b = np.triu_indices(len(rows), 1)
    else:
        a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(rows)), np.arange(len(cols)), indexing="ij"))
    a, b = rows[a], cols[b]
    for earlier in range(band):  # taken up there
        part = slice(earlier * ROWS, (earlier + 1) * ROWS)
        new = (values[a, part] != values[b, part]).any(axis=1)
        a, b = a[new], b[new]
    matches = np.zeros(len(a), np.int64)
    for k in sorted(least):
        part = slice(k - STEP, k)
        matches = matches + (values[a, part] == values[b, part]).sum(axis=1)
        alive = matches >= least[k]
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def _verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that reach the threshold on their sets."""
    if not len(a):
        return a, b
    used, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    a2, b2 = numbers[: len(a)], numbers[len(a) :]
    lengths = np.array([len(sets[i]) for i in used])
    _, flat = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    mark = np.zeros(flat.max() + 1, bool)
    by = np.argsort(a2, kind="stable")
    keep = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.diff(a2[by], prepend=-1, append=-1))
    for low, high in zip(cuts[:-1], cuts[1:]):
        i, others = a2[by[low]], b2[by[low:high]]
        own = flat[starts[i] : ends[i]]
        mark[own] = True
        sizes = lengths[others]
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(starts[others] - firsts, sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(mark[flat[at]].astype(np.int64), firsts)
        mark[own] = False
        keep[by[low:high]] = common >= threshold * (lengths[i] + sizes - common) - 1e-9
    return a[keep], b[keep]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each connected set of a tile, per member."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _records(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*rows)], names=names)


def _by_tile(rows: DataFrame, columns: list[str], solve, schema: str) -> DataFrame:
    """``solve(members, band, ti, tj)`` for every tile; a task goes through its tiles one by one.

    Members are tuples of ``columns``, in the order of the first, which is the representative.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    key = ["bucket", "ti", "tj"]
    dealt = rows.select(*key, "band", *columns).repartition(*key).sortWithinPartitions(*key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members, out = None, [], []
        for batch in batches:
            for bucket, ti, tj, band, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != (bucket, ti, tj, band):
                    if members:
                        out += solve(sorted(members, key=lambda m: m[0]), *tile)
                    tile, members = (bucket, ti, tj, band), []
                members.append(member)
            if len(out) > 8192:
                yield _records(out, names, pa.int64())
                out = []
        if members:
            out += solve(sorted(members, key=lambda m: m[0]), *tile)
        if out:
            yield _records(out, names, pa.int64())

    return dealt.mapInArrow(work, schema)


def _pruned(members: list[list], band: int, ti: int, tj: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's members (rep, block, sketch, ...) that outlive the pruning."""
    values = np.stack([np.frombuffer(m[2], np.uint32) for m in members])
    block = np.array([m[1] for m in members])
    first = np.flatnonzero(block == ti)
    return _pairs_of_tile(values, first, first if ti == tj else np.flatnonzero(block == tj), band, least)


def _surviving(tiles: DataFrame, reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The tiles again, with only those members that still have a pair."""
    least = least_matches(threshold, tolerance)

    def solve(members: list[list], bucket: int, ti: int, tj: int, band: int) -> list[tuple]:
        a, b = _pruned(members, band, ti, tj, least)
        return [(bucket, band, ti, tj, members[i][1], members[i][0]) for i in np.union1d(a, b)]

    rows = tiles.join(reps.select("rep", "sketch"), "rep")
    return _by_tile(rows, ["rep", "block", "sketch"], solve, "bucket long, band long, ti long, tj long, block long, rep long")


def _linked(tiles: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``rep, star, links, other``: per tile and member, the documents of its links and its star.

    ``links`` counts documents of one set only; a link from or to a set that shares an id with
    another set is named as well, in a row of its own with ``other``.
    """
    least = least_matches(threshold, tolerance)

    def solve(members: list[list], bucket: int, ti: int, tj: int, band: int) -> list[tuple]:
        a, b = _pruned(members, band, ti, tj, least)
        a, b = _verified([np.frombuffer(m[5], np.uint64) for m in members], a, b, threshold)
        singles, shared = np.array([m[3] for m in members]), np.array([m[4] for m in members], bool)
        links = np.bincount(a, singles[b], len(members)) + np.bincount(b, singles[a], len(members))
        star = _stars(len(members), a, b)
        out = [(members[i][0], members[star[i]][0], int(links[i]), None) for i in np.union1d(a, b)]
        named = shared[a] | shared[b]
        for i, j in zip(a[named], b[named]):
            out += [(members[x][0], members[x][0], 0, members[y][0]) for x, y in ((i, j), (j, i))]
        return out

    return _by_tile(tiles.join(sets, "rep"), ["rep", "block", "sketch", "singles", "shared", "grams"], solve, "rep long, star long, links long, other long")


def _with_head(rows: DataFrame, heads: DataFrame, spread: str) -> DataFrame:
    """``rows`` joined by ``class`` with ``heads``, one row per class.

    A class may hold most rows: its head is repeated ``SALTS`` times, and its rows are dealt
    among them by ``spread``.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    repeated = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return dealt.join(repeated, ["class", "salt"]).drop("salt")


def classes(edges: DataFrame) -> DataFrame:
    """``rep, class``: the least id of each connected set of ``rep, star`` edges.

    Labels go to neighbours and then to the label's own label; every round is a checkpoint
    and halves what is left of long chains.  It ends when no label changes, however long
    that takes.
    """
    both = written(edges.select("rep", "star").where("rep <> star").union(edges.select(F.col("star").alias("rep"), F.col("rep").alias("star")).where("rep <> star")).distinct(), "near-edges")
    labels = cut_lineage(both.groupBy("rep").agg(F.min("star").alias("low")).select("rep", F.least("rep", "low").alias("class")))
    while True:
        near = both.join(labels.select(F.col("rep").alias("star"), F.col("class").alias("theirs")), "star").groupBy("rep").agg(F.min("theirs").alias("theirs"))
        next_labels = labels.join(near, "rep").select("rep", F.col("class").alias("before"), F.least("class", "theirs").alias("class"))
        used = next_labels.select("class").distinct()
        jump = labels.select(F.col("rep").alias("class"), F.col("class").alias("further")).join(used, "class", "left_semi")
        next_labels = cut_lineage(_with_head(next_labels, jump, "rep").select("rep", "before", F.least("class", "further").alias("class")))
        if next_labels.where("before <> class").limit(1).count() == 0:
            return next_labels.select("rep", "class")
        labels = next_labels.select("rep", "class")


def _linked_sets(docs: DataFrame, n: int, threshold: float, tolerance: float, by_document: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows, one row per different set, the links between the sets, and
    the sets of ids that have several (only ``by_document``; else none are looked for).

    ``rep`` numbers a set; ids play no part in it.
    """
    rows = pick(docs, doc_id="long", text="string")
    sketches = written(_sketches(rows.withColumn("text_hash", F.xxhash64("text")), n), "sketches")
    named = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one row per different set: the least id, and of that id one text, stands for it
    reps = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count_distinct("doc_id").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("sketch").alias("sketch"))
    members = named.select("doc_id", "digest").distinct()
    if not by_document:
        members = members.limit(0)
    several = broadcast_if_small(written(members.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids"))
    members = written(members.join(several, "doc_id"), "shared-members")
    per_set = members.groupBy("digest").agg(F.count(F.lit(1)).alias("n_shared"))
    reps = reps.join(per_set, "digest", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    reps = reps.select("digest", "first.doc_id", "first.text_hash", "copies", (F.col("copies") - F.col("n_shared")).alias("singles"), (F.col("n_shared") > 0).cast("int").alias("shared"), "n_grams", "sketch")
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "near-sets")
    tiles = written(_surviving(_candidate_tiles(reps), reps, threshold, tolerance), "near-tiles")
    taking_part = tiles.select("rep").distinct()
    sets = _sets(rows, reps.join(taking_part, "rep"), n)
    links = written(_linked(tiles, sets, threshold, tolerance), "near-links")
    return sketches, reps, links, written(members.join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "shared-sets")


def _shared_counts(reps: DataFrame, links: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links where an id has several sets: ``rep, n_shared``, the ids with several sets among
    a set and its neighbours, and ``doc_id, n_links`` of those ids themselves."""
    own = reps.where("shared = 1").select("rep", F.col("rep").alias("other"))
    near = written(links.where("other IS NOT NULL").select("rep", "other").distinct().union(own), "shared-links")
    ids = shared.select(F.col("doc_id").alias("near_doc"), F.col("rep").alias("other"))
    per_set = near.join(ids, "other").select("rep", "near_doc").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("n_shared"))
    reached = written(shared.join(near, "rep").select("doc_id", "other").distinct(), "shared-reach")
    singles = reached.join(reps.select(F.col("rep").alias("other"), "singles"), "other").groupBy("doc_id").agg(F.sum("singles").alias("n"))
    others = reached.join(ids, "other").select("doc_id", "near_doc").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    return per_set, singles.join(others, "doc_id").select("doc_id", (F.col("n") + F.col("m") - 1).alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, n_grams, class_id, n_links`` for every row.

    ``class_id`` is the least doc_id of all documents connected by links; ``n_links`` counts
    the other documents of similarity ``threshold`` or more, copies included.  Null and
    empty texts have no n-grams, are linked to nothing and keep their own id as class; so do
    rows with a null doc_id, whose class is null.  Rows that repeat an id and a text count
    as one document; so do rows that share an id but not the text: that document is linked
    to each other document once, however many of its texts are near, never to itself, and
    connects the classes of its texts.  An empty table gives no rows; other columns are ignored.
    """
    sketches, reps, links, shared = _linked_sets(docs, n, threshold, tolerance, by_document=True)
    firsts = shared.groupBy("doc_id").agg(F.min("rep").alias("star"))  # one row per id with several sets
    joined = shared.join(broadcast_if_small(firsts), "doc_id").select("rep", "star")
    found = classes(links.select("rep", "star").union(joined))
    by_set = reps.join(found, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    heads = by_set.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_set, per_id = _shared_counts(reps, links, shared)
    by_set = _with_head(by_set.select("digest", "rep", "singles", "class"), heads, "rep").join(totals, "rep", "left").join(per_set, "rep", "left")
    count = F.coalesce("links", F.lit(0)) + F.col("singles") + F.coalesce("n_shared", F.lit(0)) - 1
    placed = sketches.join(by_set.select("digest", "class_id", count.alias("n_links")), "digest", "left")
    placed = placed.join(broadcast_if_small(written(per_id.select(F.col("doc_id").alias("shared_id"), F.col("n_links").alias("own_links")), "shared-counts")), F.col("doc_id") == F.col("shared_id"), "left")
    in_class = F.col("doc_id").isNotNull()
    n_links = F.when(in_class & F.col("digest").isNotNull(), F.coalesce("own_links", "n_links")).otherwise(F.lit(0))
    return placed.select("doc_id", "n_grams", F.when(in_class, F.coalesce("class_id", "doc_id")).alias("class_id"), n_links.cast("long").alias("n_links"))


def _sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``rep, singles, shared, sketch, grams`` of the representatives that meet others: their texts are
    read again, which moves a tenth of what keeping all sets would."""
    # a merge join at every size: what takes part grows with the input
    texts = rows.hint("merge").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for g in gram_sets(batch.column(0), n):
                out.append((digest(g), g.tobytes()))
                size += len(g)
                if size > BLOCK_GRAMS:
                    yield _records(out, ["digest", "grams"], pa.binary())
                    out, size = [], 0
            if out:
                yield _records(out, ["digest", "grams"], pa.binary())

    made = texts.mapInArrow(scan, "digest binary, grams binary").dropDuplicates(["digest"])
    return wanted.select("digest", "rep", "singles", "shared", "sketch").join(made, "digest").drop("digest")


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of the documents that stand for their class.

    Classes are of sets here, whatever ids their rows have: of a class the row of the least
    doc_id stays, of equal rows one, and of several texts of that id the one of the least
    hash.  Rows that share an id but are not linked stay beside each other.  Rows without an
    id or without words are nobody's copy and stay.  An empty table gives no rows; other
    columns, whatever their names, come along.
    """
    sketches, reps, links, _ = _linked_sets(docs, n, threshold, tolerance, by_document=False)
    by_set = reps.join(classes(links), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    stays = by_set.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"))
    by_set = _with_head(by_set.select("digest", "rep", "class"), stays, "rep").select("digest", "stays")
    placed = sketches.where("doc_id IS NOT NULL").join(by_set, "digest").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.first("stays").alias("stays"))
    placed = written(placed.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "rows", F.struct("doc_id", "text_hash").eqNullSafe(F.col("stays")).alias("kept")).where("NOT kept OR rows > 1"), "near-copies")
    rows, names = beside(docs, doc_id="long", text="string")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    kept = rows.join(placed.where("NOT kept").select("__doc", "__hash"), same, "left_anti")
    repeats = placed.where("kept").select("__doc", "__hash")
    if repeats.limit(1).count():
        again = kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(repeats, same, "left_anti").union(again)
    return original(kept, names)
