"""Incidents: exact density clustering (DBSCAN, cosine) of anomalies without pairing rows.

Rows are unit vectors, so cosine distance <= eps means Euclidean distance <= R with
R = sqrt(2 eps).  They are put into grid cells no wider than R, and from then on
cells take the place of rows:

* all rows of a cell are neighbours, so a cell with ``min_samples`` rows is one
  dense unit, whatever its size: a campaign of any volume is a few units;
* rows of thin cells are units of their own, at most ``min_samples - 1`` per cell;
* units meet by an equi-join of coarse cells, a few R wide, over the few dimensions
  that spread the data most; a coarse cell of many units is cut into tiles of bounded size;
* two units that meet are compared by their bounding boxes.  Nearly always the boxes alone
  decide; a box pair that straddles R is settled by scanning the rows of one side
  against ever smaller boxes of the other.

No step emits row pairs, no step gathers a cell in one task, nothing is approximated.  With
an R that spans the data (eps 0.5 and more) no dimension tells units apart and all tiles of
units are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import let
from tidewatch.operators import flows as fl
from tidewatch.session import broadcast_if_small, compiled_methods, cut_lineage

DIMS = len(fl.FEATURES) + 1
MEETING_DIMS = 3  # dimensions of the coarse cells, at most: every one more repeats boxes
MEETING_WIDTH = 4  # of a coarse cell, in reaches and widest boxes
CHUNK = 10_000  # rows of a tile, on each side: 10,000 boxes of 62 doubles are 5 MB
BUCKETS = 256  # of small units, compared bucket by bucket
TASKS_PER_CORE = 3  # tiles differ in work
FINER = 4.0  # boxes of a unit get so much smaller at a time
_SLACK = 1e-12


def behaviour_vector(score: Column, attribution: Column) -> Column:
    """Unit vector of the score and the attributed z-scores; NULL for a zero vector."""
    z = F.map_from_entries(F.transform(attribution, lambda a: F.struct(a["feature"], a["z_score"])))
    raw = F.array(score, *[F.coalesce(F.element_at(z, f), F.lit(0.0)) for f in fl.FEATURES])
    return raw


def _unit(raw: Column) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n >= 1e-9, F.transform(v, lambda x: x / n)))

    return let(raw, scaled)  # the vector and its norm are made once per row, not once per number


# --- connected components --------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Alternating large-star and small-star steps; group minima are joined back, so a
    node of any degree is handled by partial aggregation.  Rounds go on until no pair
    changes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = cut_lineage(pairs)
    before = None
    while True:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = pairs.select(F.explode(ways).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        pairs = cut_lineage(small.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


# --- boxes ------------------------------------------------------------------------------


def _boxes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, label, lo, hi): bounding box and least id of every group of rows."""
    v = F.col("v")
    return (
        rows.groupBy(*by)
        .agg(F.count("*").alias("n"), F.min("id").alias("label"), *[f(v[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)])
        .select(*by, "n", "label", *[F.array(*[f"{name}{i}" for i in range(DIMS)]).alias(name) for name in ("lo", "hi")])
    )


def _pair_range(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between boxes a (rows) and boxes b (columns)."""
    near = np.zeros((len(lo_a), len(lo_b)))
    far = np.zeros_like(near)
    # dimensions in which neither side has a value add nothing
    for d in np.flatnonzero(np.any([np.any(x != 0, axis=0) for x in (lo_a, hi_a, lo_b, hi_b)], axis=0)):
        up = lo_b[None, :, d] - hi_a[:, None, d]
        down = lo_a[:, None, d] - hi_b[None, :, d]
        near += np.maximum(np.maximum(up, down), 0.0) ** 2
        far += np.maximum(hi_b[None, :, d] - lo_a[:, None, d], hi_a[:, None, d] - lo_b[None, :, d]) ** 2
    return near, far


def _stack(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in values]) if len(values) else np.zeros((0, DIMS))


def _blocks(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, 2_000_000 // max(width, 1))
    for start in range(0, len(batch), step):
        yield batch.iloc[start : start + step]


def _in_tiles(left: DataFrame, right: DataFrame, tile: list[str], work, schema: str) -> DataFrame:
    """``work(left rows, right rows)`` of every tile that both sides have rows in.

    The tiles are dealt to a set number of tasks: they are little to read and much to compare,
    and partitions put together by their bytes would leave most of the cluster idle.
    """
    tasks = TASKS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism
    names = [x.split()[0] for x in schema.split(", ")]
    theirs = [f"r_{c}" for c in tile]
    right = right.toDF(*[f"r_{c}" for c in right.columns])  # a table may meet itself

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            b = b.drop(columns=theirs).rename(columns=lambda c: c.removeprefix("r_"))
            for block in _blocks(a.drop(columns=tile), len(b)):
                out = work(block, b)
                if out is not None and len(out):
                    found.append(out)
        return pd.concat(found) if found else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    lefts, rights = left.repartition(tasks, *tile).groupBy(*tile), right.repartition(tasks, *theirs).groupBy(*theirs)
    return lefts.cogroup(rights).applyInPandas(solve, schema)


def _tiled(left: DataFrame, right: DataFrame, i: Column, j: Column) -> tuple[DataFrame, DataFrame]:
    """Left rows at home in tile row ``i`` and in all ``j_tiles`` of it, right rows the other way."""

    def every(tiles: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1).cast("array<bigint>"))

    left = left.withColumn("i", F.pmod(i, F.col("i_tiles"))).withColumn("j", every("j_tiles"))
    right = right.withColumn("j", F.pmod(j, F.col("j_tiles"))).withColumn("i", every("i_tiles"))
    return left.drop("i_tiles", "j_tiles"), right.drop("i_tiles", "j_tiles")


def _tile_counts(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``by, i_tiles, j_tiles``: tiles of at most about ``CHUNK`` rows a side, where both sides have rows."""
    rows = left.groupBy(*by).agg(F.count("*").alias("left_rows")).join(right.groupBy(*by).agg(F.count("*").alias("right_rows")), by)
    tiles = [F.ceil(F.col(f"{side}_rows") / CHUNK).cast("long").alias(name) for side, name in (("left", "i_tiles"), ("right", "j_tiles"))]
    return broadcast_if_small(cut_lineage(rows.select(*by, *tiles)))


def _of_units(points: DataFrame, asked: DataFrame, work, schema: str) -> DataFrame:
    """``work(points, asked)`` by their ``unit``; a unit of many rows is cut into tiles.

    Small units share a bucket, so that there are no more groups than the rows are worth.
    """
    tiles = _tile_counts(points, asked, ["unit"])
    buckets = F.pmod(F.xxhash64("unit"), F.lit(BUCKETS))
    left, right = _tiled(points.join(tiles, "unit"), asked.join(tiles, "unit"), F.xxhash64("id"), F.xxhash64("lo"))
    return _in_tiles(left.withColumn("bucket", buckets), right.withColumn("bucket", buckets), ["bucket", "i", "j"], work, schema)


def _meeting(left: DataFrame, right: DataFrame, reach: float, work, schema: str) -> DataFrame:
    """``work(left rows, right rows)`` for all boxes that may lie within ``reach`` of each other.

    A right box is at home in the coarse cell of its lower corner; a left box visits every
    cell in which the corner of a box within reach can lie.  So a pair meets in one cell.
    """
    ends = right.agg(*[f(F.col(c)[d]).alias(f"{n}{d}") for n, f, c in (("lo", F.min, "lo"), ("hi", F.max, "hi")) for d in range(DIMS)],
                     *[F.max(F.col("hi")[d] - F.col("lo")[d]).alias(f"w{d}") for d in range(DIMS)]).first()
    if ends["lo0"] is None:
        return left.sparkSession.createDataFrame([], schema)
    widths = {d: MEETING_WIDTH * (reach + ends[f"w{d}"]) for d in range(DIMS)}
    cells = {d: (ends[f"hi{d}"] - ends[f"lo{d}"]) / widths[d] for d in range(DIMS)}
    dims = [d for d in sorted(cells, key=lambda d: (-cells[d], d))[:MEETING_DIMS] if cells[d] > 2]

    def at(x: Column, d: int) -> Column:
        return F.floor(x / widths[d]).cast("long")

    home, visited = right, left
    for k, d in enumerate(dims):
        home = home.withColumn(f"c{k}", at(F.col("lo")[d], d))
        low, high = at(F.col("lo")[d] - reach - ends[f"w{d}"] - _SLACK, d), at(F.col("hi")[d] + reach + _SLACK, d)
        visited = visited.withColumn(f"c{k}", F.explode(F.sequence(low, high)))
    cell = [f"c{k}" for k in range(len(dims))]
    if not cell:
        cell, home, visited = ["c0"], home.withColumn("c0", F.lit(0).cast("long")), visited.withColumn("c0", F.lit(0).cast("long"))
    met = _tile_counts(visited, home, cell)
    own = F.pmod(F.xxhash64("label"), F.lit(1 << 30))
    lefts, rights = _tiled(visited.join(met, cell), home.join(met, cell), own, own)
    return _in_tiles(lefts, rights, [*cell, "i", "j"], work, schema)


def _neighbourhood(r2: float):
    """Per single unit: rows surely in reach; pairs of units the boxes cannot settle."""

    def work(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        near, far = _pair_range(_stack(block["lo"]), _stack(block["hi"]), _stack(table["lo"]), _stack(table["hi"]))
        a, b = block["label"].to_numpy(), table["label"].to_numpy()
        single = block["n"].to_numpy() == 1
        sure = far <= r2
        counts = pd.DataFrame({"a": a[single], "b": -1, "n": (sure[single] @ table["n"].to_numpy()).astype(np.int64)})
        i, j = np.nonzero((near <= r2) & ~sure & (b[None, :] != a[:, None]))
        # Two dense units are listed once; a single unit lists every dense one.
        keep = single[i] | ((table["n"].to_numpy()[j] > 1) & (a[i] < b[j]))
        open_pairs = pd.DataFrame({"a": a[i][keep], "b": b[j][keep], "n": np.int64(-1)})
        return pd.concat([counts, open_pairs])

    return work


def _sure_links(r2: float):
    """Links between core units whose boxes lie within reach, folded to a forest per block."""

    def work(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        _, far = _pair_range(_stack(block["lo"]), _stack(block["hi"]), _stack(table["lo"]), _stack(table["hi"]))
        linked = far <= r2
        a, b = block["label"].to_numpy(), table["label"].to_numpy()
        big = np.iinfo(np.int64).max
        mine, theirs = a.copy(), b.copy()
        while True:
            new_mine = np.minimum(mine, np.where(linked, theirs[None, :], big).min(axis=1))
            new_theirs = np.minimum(theirs, np.where(linked, new_mine[:, None], big).min(axis=0))
            if (new_mine == mine).all() and (new_theirs == theirs).all():
                break
            mine, theirs = new_mine, new_theirs
        out = pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([mine, theirs])})
        return out[out["a"] != out["b"]].drop_duplicates()

    return work


def _each_unit(block: pd.DataFrame, table: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame]]:
    """(unit, its points, what is asked of it) of the units that both have."""
    asked = table.groupby("unit").indices
    for unit, at in block.groupby("unit").indices.items():
        if unit in asked:
            yield unit, block.iloc[at], table.iloc[asked[unit]]


def _count_in_reach(r2: float):
    """Rows of a dense unit within reach of the single units asking for it."""

    def work(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for unit, rows, who in _each_unit(block, table):
            v, p = _stack(rows["v"]), _stack(who["lo"])
            near, _ = _pair_range(v, v, p, p)
            out.append(pd.DataFrame({"a": who["label"].to_numpy(), "b": unit, "n": (near <= r2).sum(axis=0).astype(np.int64)}))
        return pd.concat(out) if out else None

    return work


def _probe(r2: float):
    """Rows of a unit against small boxes of unit b: 1 when surely linked, 0 when still open."""

    def work(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for unit, rows, boxes in _each_unit(block, table):
            v = _stack(rows["v"])
            near, far = _pair_range(v, v, _stack(boxes["lo"]), _stack(boxes["hi"]))
            sure, maybe = (far <= r2).any(axis=0), (near <= r2).any(axis=0)
            out.append(pd.DataFrame({"a": unit, "b": boxes["b"].to_numpy(), "n": sure.astype(np.int64)})[sure | maybe])
        return pd.concat(out).groupby(["a", "b"], as_index=False)["n"].max() if out else None

    return work


_TRIPLE = "a long, b long, n long"


def dbscan(rows: DataFrame, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """(id, cluster_id) of every clustered row; ``rows`` is (id long, raw array<double>).

    The cluster id is the least unit label in the cluster, hence stable across runs.
    """
    reach2 = 2.0 * eps + _SLACK
    reach = math.sqrt(reach2)

    def cell(width: float) -> Column:
        return F.transform("v", lambda x: F.floor(x / width))

    points = cut_lineage(rows.select("id", _unit(F.col("raw")).alias("v")).filter("v IS NOT NULL"))
    # two rows differ in as many dimensions as they have values in, together; so wide is a cell
    most = points.agg(F.max(F.size(F.filter("v", lambda x: x != 0)))).first()[0] or 1
    side = math.sqrt(2.0 * eps / min(DIMS, 2 * most))
    points = points.withColumn("cell", cell(side))
    cells = cut_lineage(_boxes(points, ["cell"]))
    dense = cells.filter(F.col("n") >= min_samples)
    thin = points.join(cells.filter(F.col("n") < min_samples).select("cell"), "cell", "left_semi")
    singles = thin.select(F.lit(1).cast("long").alias("n"), F.col("id").alias("label"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    units = cut_lineage(dense.select("n", "label", "lo", "hi").unionByName(singles))
    if units.limit(1).count() == 0:
        return rows.select("id", F.col("id").alias("cluster_id")).filter(F.lit(False))

    # Neighbour counts of single units, and the pairs their boxes leave open.
    seen = cut_lineage(_meeting(units, units, reach, _neighbourhood(reach2), _TRIPLE))
    sure_counts = seen.filter("b = -1").groupBy("a").agg(F.sum("n").alias("n"))
    open_pairs = seen.filter("b <> -1").select("a", "b")
    single_labels = units.filter("n = 1").select("label", "lo")
    asking = open_pairs.join(single_labels.withColumnRenamed("label", "a"), "a").select(F.col("b").alias("unit"), F.col("a").alias("label"), "lo")
    asking = cut_lineage(asking)
    dense_points = points.join(broadcast_if_small(dense.select("cell", F.col("label").alias("unit"))), "cell").select("unit", "id", "v")
    if asking.limit(1).count():
        found = cut_lineage(
            _of_units(dense_points, asking, _count_in_reach(reach2), _TRIPLE)
            .groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
        )
        sure_counts = sure_counts.unionByName(found.select("a", "n")).groupBy("a").agg(F.sum("n").alias("n"))
    else:
        found = seen.filter(F.lit(False))
    core_singles = sure_counts.filter(F.col("n") >= min_samples).select(F.col("a").alias("label"))
    core_labels = cut_lineage(core_singles.unionByName(units.filter(F.col("n") >= min_samples).select("label")))
    cores = units.join(core_labels, "label", "left_semi")
    if core_labels.limit(1).count() == 0:
        return rows.select("id", F.col("id").alias("cluster_id")).filter(F.lit(False))

    # Links between core units, then components.
    links = _meeting(cores, cores, reach, _sure_links(reach2), "a long, b long")
    links = links.unionByName(found.select("a", "b").join(core_labels.withColumnRenamed("label", "a"), "a", "left_semi"))
    own = core_labels.select(F.col("label").alias("node"), F.col("label").alias("component"))

    def labelled(edges: DataFrame) -> DataFrame:
        linked = connected_components(edges)
        return cut_lineage(linked.unionByName(own.join(linked, "node", "left_anti")))

    component = labelled(links.distinct())

    # Dense pairs still open matter only across components; settle them with smaller boxes.
    undecided = open_pairs.join(dense.select(F.col("label").alias("a")), "a", "left_semi")
    width = side
    while True:
        comp = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        across = undecided.join(component.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(comp, "b").filter("ca <> cb").select("a", "b")
        undecided = cut_lineage(across)
        if undecided.limit(1).count() == 0:
            break
        width /= FINER
        targets = dense_points.join(undecided.select(F.col("b").alias("unit")).distinct(), "unit", "left_semi")
        if width > 1e-9:
            small = _boxes(targets.withColumn("cell", cell(width)), ["unit", "cell"]).select("unit", "lo", "hi")
        else:
            small = targets.select("unit", F.col("v").alias("lo"), F.col("v").alias("hi")).distinct()
        boxes = cut_lineage(undecided.join(small.withColumnRenamed("unit", "b"), "b").select(F.col("a").alias("unit"), "b", "lo", "hi"))
        answers = cut_lineage(_of_units(dense_points, boxes, _probe(reach2), _TRIPLE).groupBy("a", "b").agg(F.max("n").alias("n")))
        # what has newly met are components: those alone are folded again
        named = component.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        others = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        met = cut_lineage(answers.filter("n = 1").join(named, "a").join(others, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct())
        if met.limit(1).count():
            merged = connected_components(met).select(F.col("node").alias("component"), F.col("component").alias("into"))
            component = cut_lineage(component.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
        undecided = answers.filter("n = 0").select("a", "b")
        if width <= 1e-9:
            break

    # Border rows: single units that are not core but have a core unit in reach.
    border = units.filter("n = 1").join(core_labels, "label", "left_anti")
    core_component = cores.join(component, cores["label"] == component["node"]).select("label", "component", "lo", "hi")

    def reached(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        _, far = _pair_range(_stack(block["lo"]), _stack(block["hi"]), _stack(table["lo"]), _stack(table["hi"]))
        best = np.where(far <= reach2, table["component"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        out = pd.DataFrame({"node": block["label"].to_numpy(), "component": best})
        return out[out["component"] < np.iinfo(np.int64).max]

    by_box = _meeting(border, core_component, reach, reached, "node long, component long")
    by_row = found.join(border.select(F.col("label").alias("a")), "a", "left_semi").join(
        component.select(F.col("node").alias("b"), "component"), "b"
    ).select(F.col("a").alias("node"), "component")
    joined = by_box.unionByName(by_row).groupBy("node").agg(F.min("component").alias("component"))

    unit_component = component.unionByName(joined)
    unit_of = dense_points.select("id", "unit").unionByName(thin.select("id", F.col("id").alias("unit")))
    return unit_of.join(unit_component, unit_of["unit"] == unit_component["node"]).select("id", F.col("component").alias("cluster_id"))


def cluster_incidents(scored: DataFrame, eps: float = 0.5, min_samples: int = 3, id_col: str = "flow_id") -> DataFrame:
    """Scored flows to incidents, each named by the least id of its flows (``cluster_id``).

    Noise and sets smaller than ``min_samples`` give none.
    """
    # numbered in the order of their ids, so that labels and ties don't depend on partitions
    ordered = scored.filter("is_anomaly").repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    # written once: clustering reads it several times
    with compiled_methods(scored.sparkSession):  # the features and scores are made in here
        anomalies = cut_lineage(ordered.withColumn("id", F.monotonically_increasing_id()))
    members = dbscan(anomalies.select("id", behaviour_vector(F.col("score"), F.col("attribution")).alias("raw")), eps, min_samples)
    members = cut_lineage(anomalies.join(members, "id"))
    named = members.groupBy("cluster_id").agg(F.min(id_col).alias("incident"))
    rolled = fl.incident_rollup(members)
    return rolled.join(named, "cluster_id").withColumn("cluster_id", F.col("incident")).drop("incident")
