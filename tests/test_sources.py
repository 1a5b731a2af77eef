"""Readers of lines in ranges, of logs with several headers and of CSVs with headers of their own."""

import gzip
import io
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.sources import flows as fs
from tidewatch.sources import ranges


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"\n", b"\r\n", b"bc\n", b"\xff\n", b"0123456789"]), max_size=30), st.integers(1, 9), st.integers(1, 7))
def test_ranges_cover_every_line_once(parts, step, chunk):
    data = b"".join(parts)
    before, ranges._CHUNK = ranges._CHUNK, chunk
    try:
        found = [piece for at in range(0, len(data), step) for piece in ranges.whole_lines(io.BytesIO(data), at, at + step)]
    finally:
        ranges._CHUNK = before
    assert b"".join(block for _, block in found) == data
    position = 0
    for offset, block in found:
        assert offset == position and (position == 0 or data[position - 1 : position] == b"\n")
        position += len(block)


def plain_records(text):
    """One pass over the lines, the last header in hand."""
    names, records = None, []
    for line in (raw.strip() for raw in text.split("\n")):
        if line.startswith("#fields"):
            names = line.split("\t")[1:]
        elif line and not line.startswith("#") and names and len(line.split("\t")) == len(names):
            records.append(dict(zip(names, line.split("\t"))))
    return records


def test_records_follow_the_last_header_seen(spark, tmp_path):
    r = random.Random(3)
    wanted = []
    for number in range(4):
        lines = ["early\tline\twithout a header"] if number % 2 else []
        for _ in range(6):
            names = r.sample(["ts", "uid", "proto", "duration", "history"], r.randint(2, 5))
            names += r.sample(names, r.randint(0, 1))  # a name twice: the last counts
            lines.append("#fields\t" + "\t".join(names))
            lines += ["\t".join(str(r.randint(0, 10**6)) for _ in range(len(names) - r.randint(0, 5) // 5)) for _ in range(r.randint(0, 30))]
            lines += ["", "#close 2024"]
        text = "\n".join(lines) + ("\n" if number < 2 else "")
        wanted += plain_records(text)
        if number == 3:
            (tmp_path / "c.log.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / f"{number}.log").write_text(text)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.log").write_text("")
    for size in (97, 1000, ranges.RANGE_BYTES):
        got = [
            {k: v for k, v in row["rec"].items() if "\t" not in k}
            for row in fs.conn_records(ranges.read_lines(spark, str(tmp_path), size), size).collect()
        ]
        assert sorted(map(sorted, (g.items() for g in got))) == sorted(map(sorted, (w.items() for w in wanted)))


def test_no_logs_at_all(spark, tmp_path):
    assert fs.read_conn_log(spark, str(tmp_path)).count() == 0
    assert fs.read_cic_csv(spark, str(tmp_path)).count() == 0


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("Flow Duration,Total Fwd Packets,Label,Protocol\n5000,7,benign,6\n\n1000,8,ddos,17\n")
    (tmp_path / "2.csv").write_text("﻿Label , Protocol,Total  Fwd Packets,total fwd packets,Flow Duration\r\nBENIGN,1,3,9,2000\r\n", newline="")
    (tmp_path / "3.csv").write_text("Label,Protocol\nshort\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "header only.csv").write_text("Protocol,Label\n")
    rows = fs.read_cic_csv(spark, str(tmp_path)).select("duration_ms", "fwd_packets", "label", "protocol_tcp", "protocol_udp", "protocol_icmp").collect()
    assert sorted(map(tuple, rows)) == [
        (0.0, 0.0, "SHORT", 0.0, 0.0, 0.0), (1.0, 8.0, "DDOS", 0.0, 1.0, 0.0), (2.0, 9.0, "BENIGN", 0.0, 0.0, 1.0), (5.0, 7.0, "BENIGN", 1.0, 0.0, 0.0)]
    assert fs.csv_headers(spark, str(tmp_path)).count() == 4
