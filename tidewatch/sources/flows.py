"""Flow readers: Zeek connection logs and CIC flow-feature CSVs."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.session import broadcast_if_small, cut_lineage
from tidewatch.sources.ranges import RANGE_BYTES, read_lines

FLOW_SCHEMA = (
    "flow_id string, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "duration_ms double, fwd_packets bigint, bwd_packets bigint, fwd_bytes bigint, bwd_bytes bigint, "
    "fwd_pkt_lengths array<int>, bwd_pkt_lengths array<int>, inter_arrival_times array<double>, "
    "tcp_flags map<string,int>, label string"
)
_HISTORY_LETTERS = {"syn": "s", "fin": "f", "rst": "r", "ack": "a", "psh": "p"}


def _first_number(record: Column, *names: str) -> Column:
    """First of the fields that holds a number other than zero, else 0."""
    numbers = [F.nullif(record[n].try_cast("double"), F.lit(0.0)) for n in names]
    return F.coalesce(*numbers, F.lit(0.0))


def _first_text(record: Column, names: tuple[str, ...], default: str) -> Column:
    return F.coalesce(*[record[n] for n in names], F.lit(default))


def conn_flows(records: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Records (a ``rec`` map of text fields) to flows."""
    rec = F.col("rec")
    history = F.lower(F.coalesce(rec["history"], F.lit("")))
    flags = [x for name, letter in _HISTORY_LETTERS.items() for x in (F.lit(name), F.regexp_count(history, F.lit(letter)))]
    seconds = F.coalesce(rec["ts"].try_cast("double"), F.lit(0.0))
    sane = F.when(seconds.between(-62135596800, 253402300799), F.timestamp_micros(F.rint(seconds * 1000000).cast("long")))
    uid = F.nullif(rec["uid"], F.lit(""))
    whole = lambda *names: F.floor(_first_number(rec, *names)).cast("long")
    empty_ints, empty_doubles = F.array().cast("array<int>"), F.array().cast("array<double>")
    return records.select(
        uid.alias("flow_id"),
        F.coalesce(sane, received_at if received_at is not None else F.current_timestamp()).alias("ts"),
        _first_text(rec, ("id.orig_h", "id_orig_h"), "0.0.0.0").alias("src_ip"),
        _first_text(rec, ("id.resp_h", "id_resp_h"), "0.0.0.0").alias("dst_ip"),
        whole("id.orig_p", "id_orig_p").cast("int").alias("src_port"),
        whole("id.resp_p", "id_resp_p").cast("int").alias("dst_port"),
        F.coalesce(rec["proto"], F.lit("tcp")).alias("protocol"),
        (_first_number(rec, "duration") * 1000.0).alias("duration_ms"),
        whole("orig_pkts").alias("fwd_packets"),
        whole("resp_pkts").alias("bwd_packets"),
        whole("orig_ip_bytes", "orig_bytes").alias("fwd_bytes"),
        whole("resp_ip_bytes", "resp_bytes").alias("bwd_bytes"),
        empty_ints.alias("fwd_pkt_lengths"),
        empty_ints.alias("bwd_pkt_lengths"),
        empty_doubles.alias("inter_arrival_times"),
        F.create_map(*flags).alias("tcp_flags"),
        F.lit(None).cast("string").alias("label"),
    )


def _unrepeated(names: Column) -> Column:
    """Names of which only the last of equal ones keeps its name; a tab can't be in another."""
    later = lambda i: F.slice(names, i + 2, F.size(names))
    return F.transform(names, lambda n, i: F.when(F.array_contains(later(i), n), F.concat(n, F.lit("\t"), i)).otherwise(n))


def conn_records(lines: DataFrame, block_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, value) lines to one map of text fields per record.

    Tab-separated lines take their names from the last ``#fields`` line before them in
    their file, JSON lines bring their own; of equal names in a header the last counts.
    Lines that fit neither are dropped.  Headers are gathered by block of the file, one narrow
    row per block; each line meets the row of its block.
    """
    trimmed = lines.select("path", "offset", F.floor(F.col("offset") / block_bytes).alias("block"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    names = _unrepeated(F.slice(F.split("line", "\t"), F.lit(2), F.size(F.split("line", "\t"))))
    header = F.when(F.col("line").startswith("#fields"), F.struct("offset", names.alias("names")))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One short row per block, written once so that its size is known before the join.
    blocks = cut_lineage(
        trimmed.groupBy("path", "block")
        .agg(F.sort_array(F.collect_list(header)).alias("headers"))
        .withColumn("before", F.last(F.try_element_at("headers", F.lit(-1))["names"], ignorenulls=True).over(order))
        .filter(F.col("before").isNotNull() | (F.size("headers") > 0))
    )
    rows = trimmed.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    is_json = F.col("line").startswith("{")
    from_json = rows.filter(is_json).select(F.from_json("line", "map<string,string>").alias("rec"))
    own = F.try_element_at(F.filter("headers", lambda h: h["offset"] < F.col("offset")), F.lit(-1))["names"]
    cut = (
        rows.filter(~is_json)
        .join(broadcast_if_small(blocks), ["path", "block"])
        .select(F.coalesce(own, F.col("before")).alias("names"), F.split("line", "\t").alias("parts"))
    )
    from_tsv = cut.filter(F.size("names") == F.size("parts")).select(F.map_from_arrays("names", "parts").alias("rec"))
    return from_json.unionByName(from_tsv).filter(F.col("rec").isNotNull())


def read_conn_log(spark: SparkSession, path: str, received_at: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every connection log below the folder, read in byte ranges."""
    return conn_flows(conn_records(read_lines(spark, path, range_bytes), range_bytes), received_at)


def _number(column: Column) -> Column:
    """A finite number or 0."""
    value = F.trim(column).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def cic_features(rows: DataFrame) -> DataFrame:
    """CIC rows with normalised column names to the flow features plus label."""
    have = set(rows.columns)

    def number(name: str) -> Column:
        return _number(F.col(f"`{name}`")) if name in have else F.lit(0.0)

    read = {feature: number(column) for feature, column in fv.CIC_COLUMNS.items()}
    protocol, port = number("protocol"), read["dst_port"]
    flag = lambda cond: cond.cast("double")
    values = read | {
        "duration_ms": read["duration_ms"] / 1000.0,
        "total_packets": read["fwd_packets"] + read["bwd_packets"],
        "total_bytes": read["fwd_bytes"] + read["bwd_bytes"],
        "is_wellknown_port": flag((port > 0) & (port < 1024)),
        "protocol_tcp": flag(protocol == 6),
        "protocol_udp": flag(protocol == 17),
        "protocol_icmp": flag(protocol == 1),
    }
    label = F.upper(F.trim(F.coalesce(F.col("label"), F.lit("")))) if "label" in have else F.lit("")
    return rows.select(*[values[f].alias(f) for f in fv.FLOW_FEATURES], label.alias("label"))


def _normal_name(name: str) -> str:
    return " ".join(name.strip().lower().split())


def _first_lines(paths):
    """(path, first line) of each file; reads no further than that line."""
    import gzip

    import pandas as pd
    from pyarrow import fs

    for frame in paths:
        lines = []
        for uri in frame["path"]:
            store, base = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
            with store.open_input_file(base) as raw:
                stream = gzip.GzipFile(fileobj=raw) if uri.endswith(".gz") else raw
                head = b""
                while b"\n" not in head and (piece := stream.read(65536)):
                    head += piece
            lines.append(head.split(b"\n")[0].decode("utf-8-sig", "replace").strip("\r"))
        yield pd.DataFrame({"path": frame["path"], "header": lines})


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, paths): the files below the folder grouped by their first line."""
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv").load(path).filter("length > 0")
    uris = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return uris.mapInPandas(_first_lines, "path string, header string").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_cic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV below the folder, each by its own header.

    Header names are lower-cased and single-spaced; of equal ones the last counts.  Files of
    one header are read by one plan; files without a byte bring no rows.
    """
    groups = []
    for row in csv_headers(spark, path).sort("header").toLocalIterator():
        names = [_normal_name(n) for n in next(csv.reader([row["header"]]), [])]
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        last = {name: f"c{i}" for i, name in enumerate(names)}
        raw = spark.read.csv(row["paths"], header=True, schema=schema or "c0 string")
        groups.append(cic_features(raw.select(*[F.col(column).alias(name) for name, column in last.items()])))
    if not groups:
        return cic_features(spark.createDataFrame([], "label string"))
    return reduce(DataFrame.unionByName, groups)
