"""Flows into hour-partitioned Parquet; compaction and retention of what is stored.

A streaming sink keeps a log of its own files, so compaction writes to a table beside it, and retention works on that table.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import row_id

PARTITIONS = ("year", "month", "day", "hour")


def with_hours(flows: DataFrame, time: str = "sysExportTime") -> DataFrame:
    """The partition columns, UTC, from event time; late rows go to their own hour."""
    t = F.timestamp_millis(F.col(time))
    return flows.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})


def with_row_ids(flows: DataFrame, time: str = "sysExportTime") -> DataFrame:
    """A time-ordered id of each row's own (version 7 layout), unless there is one. Its random part is drawn when rows are written, so equal rows differ."""
    return flows if "sysRowId" in flows.columns else flows.withColumn("sysRowId", row_id(F.col(time), F.uuid()))


def store(flows: DataFrame, path: str) -> None:
    with_hours(with_row_ids(flows)).write.mode("append").partitionBy(*PARTITIONS).option("compression", "zstd").parquet(path)


def store_stream(flows: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """The running query. once: what is there now, then it ends."""
    writer = with_hours(with_row_ids(flows)).writeStream.format("parquet").outputMode("append").partitionBy(*PARTITIONS).option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd")
    if not once:
        return writer.trigger(processingTime=every).start()
    # State that times out asks for empty batches without end; the query takes a copy of the settings as it starts.
    conf, key = flows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def compact(spark: SparkSession, path: str, hour: datetime, target: str, rows_per_file: int = 5_000_000) -> None:
    """One hour, all its files' columns, rewritten under target in order of time and id with bloom filters on addresses. The hour is replaced there, so a second run changes nothing; target must not be path."""
    if target.rstrip("/") == path.rstrip("/"):
        raise ValueError("an hour can't be read and replaced in one table")
    part = {"year": hour.year, "month": hour.month, "day": hour.day, "hour": hour.hour}
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    for k, v in part.items():
        rows = rows.where(F.col(k) == v)
    order = [c for c in ("sysExportTime", "sysRowId") if c in rows.columns]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    for c in ("sourceIPv4Address", "destinationIPv4Address"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(target)


def expired_hours(spark: SparkSession, path: str, now: datetime, keep_hours: int = 744) -> list[datetime]:
    """Hours wholly before now - keep_hours; 0 keeps all. Read from the folders' names alone."""
    if not keep_hours:
        return []
    cut = now.astimezone(timezone.utc) - timedelta(hours=keep_hours)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{p}=*" for p in PARTITIONS))
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    found = [datetime(*(int(x.partition("=")[2]) for x in s.getPath().toString().rsplit("/", 4)[1:]), tzinfo=timezone.utc) for s in listed or ()]
    return sorted(h for h in found if h + timedelta(hours=1) <= cut)


def drop_hours(spark: SparkSession, path: str, hours: list[datetime]) -> None:
    """Deletes those hours' folders through the table's own file system."""
    jvm = spark.sparkContext._jvm
    for h in hours:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/year={h.year}/month={h.month}/day={h.day}/hour={h.hour}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
