"""Live event payloads: build, parse, and the changes worth announcing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTION_SCHEMA = (
    "event string, id bigint, tenant_id bigint, module string, threat_type string, risk_score double, "
    "ref_id bigint, summary string, ts timestamp"
)
INCIDENT_SCHEMA = "event string, id bigint, tenant_id bigint, kind string, severity string, entity_count bigint, status string"


def detection_struct() -> Column:
    return F.struct(
        F.lit("detection").alias("event"), "id", "tenant_id", "module", "threat_type", "risk_score", "ref_id",
        F.left(F.coalesce("summary", F.lit("")), F.lit(200)).alias("summary"), "ts",
    )


def incident_struct() -> Column:
    return F.struct(F.lit("incident").alias("event"), "id", "tenant_id", "kind", "severity", "entity_count", "status")


_JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def detection_payload(detections: DataFrame) -> DataFrame:
    """One JSON payload per detection."""
    return detections.select(F.to_json(detection_struct(), _JSON_OPTIONS).alias("value"))


def incident_json() -> Column:
    return F.to_json(incident_struct(), _JSON_OPTIONS)


def incident_payload(incidents: DataFrame) -> DataFrame:
    return incidents.select(incident_json().alias("value"))


def parse_payload(payloads: DataFrame, schema: str = DETECTION_SCHEMA) -> DataFrame:
    """Payloads back to columns; malformed ones are dropped."""
    parsed = F.from_json("value", schema, {**_JSON_OPTIONS, "mode": "PERMISSIVE"})
    return payloads.select(parsed.alias("e")).filter("e.event IS NOT NULL").select("e.*")
