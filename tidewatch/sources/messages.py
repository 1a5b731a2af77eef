"""Raw RFC 5322 messages: folder reader, base64url decoding, and the MIME parser.

The parser is the one place of the e-mail job that needs Python.  It only takes
the message apart; every judgement on the parts is a native column elsewhere.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator
from datetime import timezone
from email.utils import getaddresses, parseaddr, parsedate_to_datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_HEADER = 4096  # characters; a longer one is not remembered
PARSED_SCHEMA = (
    "from_display string, from_addr string, reply_to_addr string, return_path string, subject string, "
    "message_id string, auth_results array<string>, received_spf array<string>, received array<string>, "
    "hop_times array<double>, hop_time_failures int, dkim_signature string, plain string, html string, "
    "attachments array<struct<filename:string,content_type:string,size:bigint,sha256:string,extension:string>>, "
    "error string"
)
_FIELDS = [part.strip().split(" ")[0] for part in PARSED_SCHEMA.split(", ")]


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Every file below the folder as one message, recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("msg_id"), F.col("content").alias("raw"))


def decode_base64url(text: Column) -> Column:
    """Message bytes out of base64url without padding; NULL when it is not valid."""
    standard = F.regexp_replace(F.translate(text, "-_", "+/"), "=+$", "")
    width = F.ceil(F.length(standard) / 4) * 4
    return F.try_to_binary(F.rpad(standard, width.cast("int"), F.lit("=")), F.lit("base64"))


def _text_of(part) -> str:
    """Body text: the declared charset first, then the usual suspects."""
    blob = part.get_payload(decode=True)
    if blob is None:
        payload = part.get_payload()
        return payload if isinstance(payload, str) else ""
    for charset in (part.get_content_charset(), "utf-8", "cp1252", "latin-1"):
        try:
            return blob.decode(charset) if charset else blob.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            pass
    return blob.decode("utf-8", "replace")


def _hop_times(hops: list[str]) -> tuple[list[float], int]:
    times, failures = [], 0
    for hop in hops:
        if ";" in hop:
            try:
                when = parsedate_to_datetime(hop.rpartition(";")[2].strip())
                times.append((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())
            except (TypeError, ValueError, IndexError, OverflowError):
                failures += 1
    return times, failures


def _attachment(part, name: str) -> dict:
    data = part.get_payload(decode=True) or b""
    return {
        "filename": name,
        "content_type": part.get_content_type(),
        "size": len(data),
        "sha256": hashlib.sha256(data).hexdigest() if data else None,
        "extension": name.rpartition(".")[2].lower() if "." in name else "",
    }


class _ParsedOnce(email.policy.EmailPolicy):
    """The default policy parses a header anew whenever it is read; this one remembers the last ones."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        return _header(name, value) if len(value) <= LONG_HEADER else _DEFAULT.header_fetch_parse(name, value)


_DEFAULT = email.policy.default
_POLICY = _ParsedOnce()


@lru_cache(maxsize=512)
def _header(name: str, value: str) -> str:
    return _DEFAULT.header_fetch_parse(name, value)


def _take_apart(raw: bytes) -> dict:
    msg = email.message_from_bytes(raw, policy=_POLICY)

    def all_of(header: str) -> list[str]:
        return [str(v) for v in msg.get_all(header) or []]

    bodies: dict[str, list[str]] = {"plain": [], "html": []}
    attachments = []
    for part in msg.walk():
        name = part.get_filename() if msg.is_multipart() else None
        if name:
            attachments.append(_attachment(part, name))
        elif part.is_multipart():
            continue
        elif part.get_content_type() == "text/html":
            bodies["html"].append(_text_of(part))
        elif part.get_content_type() == "text/plain" or part is msg:
            bodies["plain"].append(_text_of(part))

    display, address = parseaddr(str(msg.get("From", "")))
    reply_to = getaddresses(all_of("Reply-To"))
    hops = all_of("Received")
    times, failures = _hop_times(hops)
    return {
        "from_display": display or None,
        "from_addr": address or None,
        "reply_to_addr": reply_to[0][1] if reply_to else None,
        "return_path": parseaddr(str(msg.get("Return-Path", "")))[1] or None,
        "subject": str(msg.get("Subject", "")) or None,
        "message_id": str(msg.get("Message-ID", "")) or None,
        "auth_results": all_of("Authentication-Results"),
        "received_spf": all_of("Received-SPF"),
        "received": hops,
        "hop_times": times,
        "hop_time_failures": failures,
        "dkim_signature": str(msg.get("DKIM-Signature")) if msg.get("DKIM-Signature") else None,
        "plain": "\n".join(bodies["plain"]),
        "html": "\n".join(bodies["html"]),
        "attachments": attachments,
        "error": None,
    }


def parse_messages(messages: DataFrame, id_col: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """One parsed row per message; a message that cannot be read keeps its reason in ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch[raw_col]:
                try:
                    rows.append(_take_apart(bytes(raw) if raw is not None else b""))
                except Exception as exc:  # noqa: BLE001 - one bad message must not fail the job
                    rows.append({f: None for f in _FIELDS} | {"error": f"{type(exc).__name__}: {exc}"})
            out = pd.DataFrame(rows, columns=_FIELDS)
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    id_type = messages.schema[id_col].dataType.simpleString()
    return messages.select(id_col, raw_col).mapInPandas(parse, f"{id_col} {id_type}, {PARSED_SCHEMA}")


def parse_report(parsed: DataFrame) -> DataFrame:
    """How many messages were read and how many skipped."""
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
