"""Flow tables: Parquet by hour, and a view of flows over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.planner import Layout

#: Same SQL for Spark and DuckDB but for the time and the hexadecimal digits.
_FLOWS = """
SELECT {ms} AS sysExportTime, 167772160 + (user_id * 7919) % 65536 AS sourceIPv4Address, 3232235520 + event_id % 1024 AS destinationIPv4Address,
       1024 + event_id % 50000 AS sourceTransportPort,
       CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'error' THEN 53 WHEN 'signup' THEN 22 ELSE 3306 END AS destinationTransportPort,
       CASE event_type WHEN 'error' THEN 17 ELSE 6 END AS protocolIdentifier, CAST(round(value * 100) AS BIGINT) AS octetDeltaCount, 1 + event_id % 64 AS packetDeltaCount,
       event_id % 256 AS tcpControlBits, event_type AS applicationName, {mac} AS sourceMacAddress, event_id % 5000 AS flowDurationMilliseconds, event_id AS sysRowId
FROM events"""
FLOWS_DUCKDB = _FLOWS.format(ms="epoch_us(ts) // 1000", mac="lpad(printf('%x', event_id * 65537), 12, '0')")
EVENT_LAYOUT = Layout()


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*")
    sql = _FLOWS.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", mac="lower(lpad(hex(event_id * 65537), 12, '0'))")
    head, _, _ = sql.strip().removeprefix("SELECT").rpartition("FROM")
    return events.selectExpr(*_columns(head))


def _columns(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Hour-partitioned flows; columns of all files, null where a file lacks them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


STORED_LAYOUT = Layout(partitions=("year", "month", "day", "hour"))
