"""Mixing sources to target weights by min-cost flow (operator 9).

Documents are summed by *membership pattern*, the set of sources that hold them.  A network
routes each pattern's words to the quotas of its sources: every further reading of a pattern
has the pattern's words as capacity and a higher cost (convex, so first readings are used up
before anything is repeated).  The flow says how many words of each pattern the mix takes:
so many whole readings of all its documents, and for the rest a seeded choice, the documents
whose hash lies below a cut found by histograms.

The driver sees one row per pattern and per source, that is the catalogue of sources, never
documents.  Documents are never moved: with the cuts known, each row decides for itself.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, beside, pick, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
REPEAT_COSTS = (0, 1)
SEED = 17
BUCKET_BITS = 12
BROADCAST_PATTERNS = 10_000


def source_targets(sizes: dict[str | None, int], total: float, weights: tuple[int, ...] = WEIGHTS, most: int = len(REPEAT_COSTS)) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size.

    Weights repeat over the sources in code point order, null last.
    """
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    targets: dict[str | None, float] = {}
    left, open_sources = float(total), list(ordered)
    while open_sources:
        by_weight = left / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if by_weight * weight[s] > most * sizes[s]]
        if not full:
            targets |= {s: by_weight * weight[s] for s in open_sources}
            break
        targets |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_sources = [s for s in open_sources if s not in full]
    return targets


def route(patterns: dict[str, tuple[tuple, int]], quotas: dict[str | None, int], costs: tuple[int, ...] = REPEAT_COSTS) -> dict[str, dict[str | None, int]]:
    """Min-cost flow from patterns to quotas: words per pattern and source.

    ``patterns``: name -> (sources, words).  Successive cheapest paths; each fills a reading,
    a quota or a rerouted edge, so their number follows the network, not the words.
    """
    start, goal = ("start",), ("goal",)
    graph: dict[tuple, list[list]] = {start: [], goal: []}

    def edge(a: tuple, b: tuple, capacity: int, cost: int) -> list:
        forth = [b, capacity, cost, None]
        back = [a, 0, -cost, forth]
        forth[3] = back
        graph.setdefault(a, []).append(forth)
        graph.setdefault(b, []).append(back)
        return forth

    used: dict[str, dict[str | None, list]] = {}
    for name in sorted(patterns):
        sources, words = patterns[name]
        for cost in costs:
            edge(start, ("pattern", name), words, cost)
        used[name] = {s: edge(("pattern", name), ("source", s), words * len(costs), 0) for s in sources if s in quotas}
    for s in sorted(quotas, key=lambda s: (s is None, s or "")):
        edge(("source", s), goal, quotas[s], 0)

    while True:
        price, came, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            node = queue.popleft()
            waiting.discard(node)
            for e in graph[node]:
                if e[1] > 0 and price[node] + e[2] < price.get(e[0], float("inf")):
                    price[e[0]], came[e[0]] = price[node] + e[2], (node, e)
                    if e[0] not in waiting:
                        queue.append(e[0])
                        waiting.add(e[0])
        if goal not in price:
            break
        path, node = [], goal
        while node != start:
            node, e = came[node]
            path.append(e)
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            e[3][1] += amount
    return {name: {s: e[3][1] for s, e in edges.items()} for name, edges in used.items()}


def _draw(seed: int, *key: str) -> Column:
    """A document's place in the seeded order, 0 to 2**63 - 1."""
    return F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << 63) - 1))


def _pattern(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))), {"ignoreNullFields": "false"})


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table from the driver if its counted rows are few; else Spark decides."""
    return F.broadcast(table) if rows <= BROADCAST_PATTERNS else table


class Mix:
    """The decisions of a mix: targets of sources, and readings and cut of patterns."""

    def __init__(self, measured: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, costs=REPEAT_COSTS):
        """``measured``: a written table of ``pattern, size, draw``, a row per document."""
        self.costs = costs
        summed = {r["pattern"]: int(r["size"]) for r in measured.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
        self.patterns = {p: (tuple(json.loads(p)), n) for p, n in summed.items()}
        self.sizes: dict[str | None, int] = {}
        for sources, n in self.patterns.values():
            for s in sources:
                self.sizes[s] = self.sizes.get(s, 0) + n
        self.targets = source_targets(self.sizes, sum(summed.values()) * share_percent / 100, weights, len(costs))
        self.flows = route(self.patterns, {s: round(t) for s, t in self.targets.items()}, costs)
        self.readings: dict[str, int] = {}
        rest: dict[str, int] = {}
        for p, (_, n) in self.patterns.items():
            self.readings[p], rest[p] = divmod(sum(self.flows[p].values()), n) if n else (0, 0)
        self.cuts = self._cuts(measured, {p: r for p, r in rest.items() if r})

    def _cuts(self, measured: DataFrame, rest: dict[str, int]) -> dict[str, int]:
        """Per pattern the last draw that is read once more.

        A histogram over the draws finds the bucket in which the rest runs out; only that
        bucket's documents, one in 4,096 of the pattern, are then put in order.
        """
        if not rest:
            return {}
        spark = measured.sparkSession
        wanted = spark.createDataFrame([(p, r) for p, r in rest.items()], "pattern string, rest long")
        bucketed = measured.select("pattern", "size", "draw", F.shiftright("draw", 63 - BUCKET_BITS).alias("bucket"))
        upto = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = bucketed.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(wanted, "pattern")
        last = sums.where("before < rest AND before + words >= rest").select("pattern", "bucket", (F.col("rest") - F.col("before")).alias("rest"))
        inside = bucketed.join(last, ["pattern", "bucket"])
        tied = inside.groupBy("pattern", "rest", "draw").agg(F.sum("size").alias("size"))
        running = W.partitionBy("pattern").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
        near = tied.withColumn("upto", F.sum("size").over(running)).where("upto - size / 2 <= rest")
        # nothing of the bucket fits: everything below it does
        floor = last.select("pattern", (F.shiftleft("bucket", 63 - BUCKET_BITS) - 1).alias("draw"))
        cut = near.select("pattern", "draw").union(floor).groupBy("pattern").agg(F.max("draw").alias("draw"))
        return {r["pattern"]: r["draw"] for r in cut.collect()}

    def decide(self, rows: DataFrame) -> DataFrame:
        """Adds ``copies`` to rows that have ``pattern`` and ``draw``; a small table is joined."""
        plan = [(p, self.readings[p], self.cuts.get(p, -1)) for p in sorted(self.patterns)]
        table = rows.sparkSession.createDataFrame(plan, "__pattern string, __readings long, __cut long")
        joined = rows.join(_small(table, len(plan)), F.col("pattern") == F.col("__pattern"))
        return joined.withColumn("copies", F.col("__readings") + (F.col("draw") <= F.col("__cut")).cast("long")).drop("__pattern", "__readings", "__cut")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, pattern, size, draw`` of documents that each have one ``source``, null or not."""
    rows = pick(docs, doc_id="long", text="string", source="string")
    return rows.select("doc_id", "source", _pattern(F.array("source")).alias("pattern"), word_count(F.col("text")).alias("size"), _draw(seed, "doc_id", "text").alias("draw"))


def mix_overlapping(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, costs=REPEAT_COSTS) -> tuple[DataFrame, Mix]:
    """The mix of ``doc_id, text, members``, where ``members`` lists all sources of a document.

    Returns ``doc_id, size, copies, taken`` and the decisions.  A document of no source is
    never taken; repeated names in a list count once.
    """
    rows = pick(docs, doc_id="long", text="string", members="array<string>")
    measured = written(rows.select("doc_id", _pattern(F.col("members")).alias("pattern"), word_count(F.col("text")).alias("size"), _draw(seed, "doc_id", "text").alias("draw")), "mix")
    mix = Mix(measured, weights, share_percent, costs)
    return mix.decide(measured).select("doc_id", "size", "copies", (F.col("size") * F.col("copies")).alias("taken")), mix


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` per row, by the given weights.

    A null source is a source, the last one; a null or empty text has size 0 and takes
    nothing; rows that repeat id and text have the same draw and are taken alike; a null
    doc_id is drawn as null; an empty table gives no rows; other columns are ignored.
    """
    measured = written(measure(docs, seed), "mix")
    mix = Mix(measured)
    spark = docs.sparkSession
    keyed = {p: (n, mix.targets[sources[0]]) for p, (sources, n) in mix.patterns.items()}
    by_source = spark.createDataFrame([(p, n, t) for p, (n, t) in keyed.items()], "__p string, source_size long, target double")
    decided = mix.decide(measured)
    return decided.join(_small(by_source, len(keyed)), F.col("pattern") == F.col("__p")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is read."""
    mix = Mix(written(measure(docs, seed).select("pattern", "size", "draw"), "mix"))
    rows, names = beside(docs, doc_id="long", text="string", source="string")
    rows = rows.withColumn("pattern", _pattern(F.array("source"))).withColumn("draw", _draw(seed, "doc_id", "text"))
    decided = mix.decide(rows).withColumn("__copy", F.explode_outer(F.expr("CASE WHEN copies > 0 THEN sequence(1, CAST(copies AS INT)) END")))
    return decided.where("__copy IS NOT NULL").select([f"_{i}" for i in range(len(names))]).toDF(*names)
