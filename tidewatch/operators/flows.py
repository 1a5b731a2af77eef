"""Flow features, rule triage, scaling, attribution and evaluation (native columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.scoring import explode_rows, let, stable_round
from tidewatch.session import broadcast_if_small, cut_lineage

FEATURES = fv.FLOW_FEATURES
CLIP = 10.0
BENIGN_LABELS = ("BENIGN", "NORMAL")


# --- features -------------------------------------------------------------------


def list_stats(values: Column) -> Column:
    """``struct(mean, std, max)`` of an array, population deviation; zeros when it is empty."""
    numbers = F.transform(values, lambda v: v.cast("double"))

    def summed(v: Column, of) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + of(x))

    def stats(v: Column) -> Column:
        return let(
            summed(v, lambda x: x) / F.size(v),
            lambda m: F.struct(
                m.alias("mean"), F.sqrt(summed(v, lambda x: (x - m) * (x - m)) / F.size(v)).alias("std"), F.array_max(v).alias("max")
            ),
        )

    zeros = F.struct(*[F.lit(0.0).alias(n) for n in ("mean", "std", "max")])
    return F.when(F.size(values) > 0, let(numbers, stats)).otherwise(zeros)


def flow_features(flows: DataFrame, keep: tuple[str, ...] = ("flow_id", "ts", "src_ip", "dst_ip", "label")) -> DataFrame:
    """The 30 features of every flow, in their fixed order, next to the kept columns."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fwd_p, bwd_p, fwd_b, bwd_b, port = (num(c) for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "dst_port"))
    seconds = F.greatest(num("duration_ms") / 1000.0, F.lit(1e-6))
    flags = F.transform_keys(F.coalesce("tcp_flags", F.create_map().cast("map<string,int>")), lambda k, _: F.lower(k))
    lists = {"fwd_pkt_len": "fwd_pkt_lengths", "bwd_pkt_len": "bwd_pkt_lengths", "iat": "inter_arrival_times"}
    protocol = F.lower(F.coalesce("protocol", F.lit("")))
    values = {
        "duration_ms": num("duration_ms"),
        "fwd_packets": fwd_p, "bwd_packets": bwd_p, "fwd_bytes": fwd_b, "bwd_bytes": bwd_b,
        "total_packets": fwd_p + bwd_p,
        "total_bytes": fwd_b + bwd_b,
        "bytes_per_second": (fwd_b + bwd_b) / seconds,
        "packets_per_second": (fwd_p + bwd_p) / seconds,
        "down_up_ratio": F.coalesce(bwd_b / F.nullif(fwd_b, F.lit(0.0)), F.lit(0.0)),
        "dst_port": port,
        "is_wellknown_port": ((port > 0) & (port < 1024)).cast("double"),
    }
    for prefix in lists:
        values |= {f"{prefix}_{name}": F.col(f"_{prefix}")[name] for name in ("mean", "std", "max")}
    for name in ("syn", "fin", "rst", "psh", "ack", "urg"):
        values[f"{name}_count"] = F.coalesce(F.col("_flags")[name].cast("double"), F.lit(0.0))
    for name in ("tcp", "udp", "icmp"):
        values[f"protocol_{name}"] = (protocol == name).cast("double")
    kept = [c for c in keep if c in flows.columns]

    def finite(c: str) -> Column:
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)

    # Three steps, so that list statistics are worked out once and not once per use.
    prepared = flows.withColumns({"_flags": flags} | {f"_{prefix}": list_stats(F.col(column)) for prefix, column in lists.items()})
    return prepared.select(*kept, *[values[f].alias(f) for f in FEATURES]).select(*kept, *[finite(f) for f in FEATURES])


# --- rule triage ----------------------------------------------------------------


# Reason codes of the rules, and what each level asks for.
SYN_FLOOD, OVERSIZED, ICMP_FLOOD, BUSY_SOURCE = "syn_flood", "oversized_packet", "icmp_flood", "busy_source"
ACTIONS = {"Critical": "isolate_sources", "High": "inspect_now", "Medium": "review", "Safe": "none"}


def flow_rules(log: DataFrame, batch_key: str) -> DataFrame:
    """Every log row with the rule that flags it (``reason``, a code), NULL when none does.

    The counts per source come from an aggregate joined back, not from a window: a
    source that holds most of a batch is counted by partial sums and never gathers
    in one task.
    """
    per_source = log.filter("source_ip IS NOT NULL").groupBy(batch_key, "source_ip").agg(F.count("*").alias("from_source"))
    # Written once: its real size decides on the broadcast without counting the log twice.
    sources = cut_lineage(per_source)
    counted = log.join(broadcast_if_small(sources), [batch_key, "source_ip"], "left").withColumn("from_source", F.coalesce("from_source", F.lit(0)))
    flags = F.upper(F.coalesce("flags", F.lit("")))
    size = F.coalesce("packet_size", F.lit(0))
    protocol = F.upper(F.coalesce("protocol", F.lit("")))
    reason = (
        F.when(flags.contains("SYN_FLOOD") | (F.regexp_count(flags, F.lit("SYN")) >= 3), SYN_FLOOD)
        .when(size > 8000, OVERSIZED)
        .when((protocol == "ICMP") & (F.col("from_source") >= 4), ICMP_FLOOD)
        .when((F.coalesce("source_ip", F.lit("")) != "") & (F.col("from_source") >= 6), BUSY_SOURCE)
    )
    return counted.withColumn("reason", reason)


def triage_level(flagged: Column, floods: Column) -> Column:
    return (
        F.when((floods > 0) & (flagged >= 3), "Critical")
        .when((floods > 0) | (flagged >= 4), "High")
        .when(flagged >= 1, "Medium")
        .otherwise("Safe")
    )


def flagged_flows(log: DataFrame, batch_key: str) -> DataFrame:
    """Every flagged row: (batch_key, ts, id, reason, source_ip, packet_size)."""
    return flow_rules(log, batch_key).filter("reason IS NOT NULL").select(batch_key, "ts", "id", "reason", "source_ip", "packet_size")


def flow_triage(log: DataFrame, batch_key: str, shown: int | None = 6) -> DataFrame:
    """One row per batch: level, action, counts per reason and a report.

    The report is a line for people and names the ``shown`` first flagged rows, picked by a
    bounded top-k (None: all of them); :func:`flagged_flows` has every flagged row as a table.
    """
    ruled = flow_rules(log, batch_key)
    counts = ruled.groupBy(batch_key).agg(
        F.count("*").alias("flows"),
        F.count("reason").alias("flagged"),
        *[F.count_if(F.col("reason") == code).alias(code) for code in (SYN_FLOOD, OVERSIZED, ICMP_FLOOD, BUSY_SOURCE)],
        F.max("ts").alias("ts"),
    )
    first = Window.partitionBy(batch_key).orderBy("ts", "id")
    top = ruled.filter("reason IS NOT NULL").select(batch_key, "ts", "id", "reason").withColumn("n", F.row_number().over(first))
    if shown is not None:
        top = top.filter(F.col("n") <= shown)
    detail = top.groupBy(batch_key).agg(F.array_sort(F.collect_list(F.struct("n", "id", "reason"))).alias("first_flagged"))
    listed = F.concat_ws(", ", F.transform("first_flagged", lambda e: F.concat(e["id"].cast("string"), F.lit("="), e["reason"])))
    level = triage_level(F.col("flagged"), F.col(SYN_FLOOD) + F.col(ICMP_FLOOD))
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    leveled = counts.join(detail, batch_key, "left").withColumn("level", level)
    return leveled.select(
        batch_key, "ts", "flows", "flagged", SYN_FLOOD, OVERSIZED, ICMP_FLOOD, BUSY_SOURCE, "level",
        action[F.col("level")].alias("action"),
        F.concat_ws(": ", F.format_string("%d of %d flows broke a rule", F.col("flagged"), F.col("flows")), F.nullif(listed, F.lit(""))).alias("report"),
        F.lit("heuristic").alias("score_source"),
    )


# --- scaling, scores, attribution -------------------------------------------------


def scaler(features: DataFrame, counted: bool = False) -> DataFrame:
    """One row: mean and deviation per feature, with a floor for constant columns, and ``n`` if asked."""
    stats = features.agg(F.count("*").alias("n"), *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in FEATURES])
    return stats.select(
        *(["n"] if counted else []),
        *[F.struct(F.col(f"{f}.mean").alias("mean"), F.when(F.col(f"{f}.std") < 1e-9, 1.0).otherwise(F.col(f"{f}.std")).alias("std")).alias(f) for f in FEATURES]
    )


def scale(features: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    """z-scores clipped to ±10, in place of the features."""
    z = lambda f: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(f) - means[f]) / stds[f]))
    return features.withColumns({f: z(f) for f in FEATURES})


def min_max(value: Column, low: float, high: float) -> Column:
    """Position in the training range; may exceed 1, and is 0 for a degenerate range."""
    return F.lit(0.0) if high - low < 1e-12 else (value - low) / (high - low)


def ensemble(*scores: Column) -> Column:
    """Mean of the normalised scores, clipped to 0..1."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def attribution(top: int = 5) -> Column:
    """``array<struct<feature, z_score, direction>>`` of the largest |z| that reach one sigma."""
    entries = F.array(*[F.struct((-F.abs(F.col(f))).alias("size"), F.lit(i).alias("n"), F.lit(f).alias("feature"), F.col(f).alias("z")) for i, f in enumerate(FEATURES)])
    # few reach one sigma: only those are sorted
    best = F.slice(F.array_sort(F.filter(entries, lambda e: e["size"] <= -1.0)), 1, top)
    return F.transform(
        best,
        lambda e: F.struct(
            e["feature"].alias("feature"), F.round(e["z"], 3).alias("z_score"), F.when(e["z"] > 0, "high").otherwise("low").alias("direction")
        ),
    )


# --- labels: split and evaluation -------------------------------------------------


def is_attack(label: Column) -> Column:
    return (~F.upper(label).isin(*BENIGN_LABELS)).cast("int")


def benign_split(df: DataFrame, id_col: str, share: float = 0.7, seed: int = 42, minimum: int = 100) -> tuple[DataFrame, DataFrame]:
    """(train, test): a stable share of the benign rows, and everything else that is labelled.

    The side is a hash of the id: no shuffle, and a re-run gives the same sides.
    """
    labelled = df.filter("label IS NOT NULL")
    benign = is_attack(F.col("label")) == 0
    if labelled.filter(benign).limit(minimum).count() < minimum:
        raise ValueError(f"need at least {minimum} benign rows to fit a baseline")
    chosen = benign & (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10000)) < int(share * 10000))
    return labelled.filter(chosen), labelled.filter(~chosen)


def confusion_metrics(scored: DataFrame, truth: str = "y", predicted: str = "predicted") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = scored.agg(
        F.count("*").alias("n"),
        F.count_if(t & p).alias("true_positives"),
        F.count_if(~t & p).alias("false_positives"),
        F.count_if(t & ~p).alias("false_negatives"),
        F.count_if(~t & ~p).alias("true_negatives"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return counts.select(
        "*",
        stable_round(precision, 4).alias("precision"),
        stable_round(recall, 4).alias("recall"),
        stable_round(f1, 4).alias("f1"),
        stable_round(ratio(fp, fp + tn), 4).alias("false_positive_rate"),
    )


def _score_steps(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """Per distinct score: positives, negatives, and both counted over all higher scores.

    The rows are first folded to distinct scores.  The running sums over those are
    taken in two levels, slice sums and then sums inside a slice, so no single task
    sees the whole list.
    """
    steps = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(truth).cast("double").alias("pos"), F.sum(1 - F.col(truth)).cast("double").alias("neg")
    )
    # Slices of the score range, by its bounds: order between slices is order of scores.
    span = steps.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    n_slices = 256
    cut = F.floor((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * n_slices)
    sliced = (
        steps.withColumn("_one", F.lit(1))
        .join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one")
        .withColumn("slice", F.coalesce(cut, F.lit(0)))
        .drop("_one", "lo", "hi")
    )
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    # At most 257 rows: one per slice.
    offsets = sliced.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "slice", F.coalesce(F.sum("p").over(above), F.lit(0.0)).alias("pos_off"), F.coalesce(F.sum("n").over(above), F.lit(0.0)).alias("neg_off")
    )
    inside = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.withColumns({"p_in": F.sum("pos").over(inside), "n_in": F.sum("neg").over(inside)})
        .join(F.broadcast(offsets), "slice")
        .select("score", "pos", "neg", (F.col("pos_off") + F.col("p_in")).alias("tp"), (F.col("neg_off") + F.col("n_in")).alias("fp"))
    )


def ranking_metrics(scored: DataFrame, truth: str = "y", score: str = "score") -> DataFrame:
    """One row: AUC-ROC (ties count half) and average precision, NULL without both classes."""
    steps = _score_steps(scored, truth, score)
    # A positive beats the negatives below it and ties with those at its own score.
    folded = steps.agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("lost"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("gain"),
    )
    pairs = F.nullif(F.col("P") * F.col("N"), F.lit(0.0))
    return folded.select(
        stable_round(1 - F.col("lost") / pairs, 4).alias("auc_roc"),
        F.when(pairs.isNotNull(), stable_round(F.col("gain") / F.nullif(F.col("P"), F.lit(0.0)), 4)).alias("avg_precision"),
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Metrics over the labelled rows; an ``error`` row when there is none."""
    labelled = scored.filter("label IS NOT NULL").select(
        is_attack(F.col("label")).alias("y"), F.col("is_anomaly").cast("int").alias("predicted"), "score"
    )
    both = confusion_metrics(labelled).withColumn("_one", F.lit(1)).join(
        F.broadcast(ranking_metrics(labelled).withColumn("_one", F.lit(1))), "_one"
    )
    return both.drop("_one").withColumn("error", F.when(F.col("n") == 0, "no labelled flows; cannot evaluate"))


# --- incidents --------------------------------------------------------------------


def incident_rollup(members: DataFrame, cluster: str = "cluster_id", shown: int = 20, top: int = 5) -> DataFrame:
    """One row per cluster out of (cluster, score, ts, src_ip, dst_ip, attribution) rows.

    Entity lists are built from distinct pairs cut to the ``shown`` first, so a
    campaign with millions of sources never becomes one array.
    """

    def entities(column: str, prefix: str) -> DataFrame:
        distinct = members.select(cluster, column).distinct()
        counted = distinct.groupBy(cluster).agg(F.count(column).alias(f"{prefix}_count"))
        first = distinct.withColumn("n", F.row_number().over(Window.partitionBy(cluster).orderBy(column))).filter(F.col("n") <= shown)
        listed = first.groupBy(cluster).agg(F.array_sort(F.collect_list(column)).alias(f"{prefix}_ips"))
        return counted.join(listed, cluster)

    features = (
        explode_rows(members, [cluster], F.transform("attribution", lambda a: a["feature"]))
        .groupBy(cluster, F.col("item").alias("feature"))
        .agg(F.count("*").alias("n"))
        .withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "feature")))
        .filter(F.col("r") <= top)
        .groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct("r", "feature", "n"))).alias("f"))
        .select(cluster, F.transform("f", lambda e: F.struct(e["feature"].alias("feature"), e["n"].alias("n"))).alias("shared_features"))
    )
    base = members.groupBy(cluster).agg(
        F.count("*").alias("member_count"),
        F.max("score").alias("top_score"),
        stable_round(F.avg("score"), 4).alias("mean_score"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    peak = F.col("top_score")
    severity = F.when(peak > 0.9, "critical").when(peak > 0.75, "high").when(peak > 0.5, "medium").otherwise("low")
    return (
        base.withColumns({"severity": severity, "max_score": stable_round(peak, 4)})
        .drop("top_score")
        .join(entities("src_ip", "source"), cluster, "left")
        .join(entities("dst_ip", "dest"), cluster, "left")
        .join(features, cluster, "left")
    )
