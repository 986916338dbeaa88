"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a demand that changes linearly over training time 0..1. Its integral is the source's target; inverting
the integral at a document's place in its source's cumulative tokens gives its training position; a later copy's place is a
whole source further on. Rows are range-sorted by position, by that of the first copy or one row a copy. Targets share the
total size by weight and stop at max_repeat times the source's size; the excess goes to the others by weight.

Cumulative sizes are taken within hash buckets of a source and then over the bucket totals, so a hot source, or a hot or null
doc_id, is dealt over many tasks. The order within a source is by a hash of doc_id and text, so reruns agree; rows that tie are
alike in both and interchangeable, and share a bucket. Null and blank texts have size 0 and are never taken; null sources form
one source, ranked last. Texts of any length count whole. An empty table gives an empty result. Columns to keep that are named
as results are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, words

#: Demand at the start and end of training, by a source's rank; each pair averages 1.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WEIGHTS = (5.0, 2.0, 1.0)


def _by_rank(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, max_repeat: float = 3.0) -> DataFrame:
    """sizes (source, source_size): with target and the ramp's start and end. One row a source; windows run over sources only."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.select("*", _by_rank(F.col("rank"), weights).alias("weight"), _by_rank(F.col("rank"), tuple(r[0] for r in ramps)).alias("ramp0"), _by_rank(F.col("rank"), tuple(r[1] for r in ramps)).alias("ramp1"))
    cap = max_repeat * F.col("source_size")
    order = W.orderBy("ratio", "rank")
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    # By rising cap / weight: the first source below its cap has the right level; treating it or later ones as capped lowers the level.
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    ranked = ranked.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(all_rows))
    return ranked.select("source", "source_size", "ramp0", "ramp1", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


_RESULTS = ("doc_id", "source", "size", "source_size", "target", "copies", "taken", "positions", "position", "copy")


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple = WEIGHTS, ramps: tuple = RAMPS, max_repeat: float = 3.0, bucket_digits: int = 3, keep: tuple = ()) -> DataFrame:
    """doc_id, source, keep's columns, size, source_size, target, copies, taken, positions (of all copies, 0..1; empty if not taken), position (of the first; null if not taken)."""
    out = _placed(docs, text, weights, ramps, max_repeat, bucket_digits, keep).withColumn("position", F.get("positions", F.lit(0)))
    # Rows without a position are spread by id over the range of positions, so that no task gets them all.
    at = F.coalesce(F.col("position"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 20)) / float(1 << 20))
    out = out.withColumn("__at", at)
    return out.repartitionByRange(F.col("__at")).sortWithinPartitions("__at").drop("__at")


def training_order(docs: DataFrame, text: str = "text", weights: tuple = WEIGHTS, ramps: tuple = RAMPS, max_repeat: float = 3.0, bucket_digits: int = 3, keep: tuple = ()) -> DataFrame:
    """One row for each copy taken, range-sorted by its position: the columns of mix_sources without positions, and copy (from 0)."""
    out = _placed(docs, text, weights, ramps, max_repeat, bucket_digits, keep)
    out = out.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return out.repartitionByRange(F.col("position")).sortWithinPartitions("position")


def _placed(docs: DataFrame, text: str, weights: tuple, ramps: tuple, max_repeat: float, bucket_digits: int, keep: tuple) -> DataFrame:
    keep = tuple(c for c in keep if c not in _RESULTS)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    sized = docs.select("doc_id", "source", carried.alias("carried"), F.size(words(F.col(text))).cast("long").alias("size"), key.alias("key"))
    sized = sized.withColumn("bucket", F.substring("key", 1, bucket_digits))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    aims = targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, max_repeat)
    totals = totals.withColumn("bucket_from", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    per_bucket = totals.alias("t").join(aims.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source"))).select("t.source", "bucket", "bucket_from", "source_size", "target", "ramp0", "ramp1")
    row = W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(row)).alias("d").join(per_bucket.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    start = F.col("bucket_from") + F.col("upto") - F.col("size")
    placed = placed.select("d.doc_id", "d.source", "carried", "size", "source_size", "target", "ramp0", "ramp1", start.alias("start"))
    # Whole passes over the source, and one more for documents whose middle comes before the rest of the target.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(passes + (F.col("start") + F.col("size") / 2.0 < rest).cast("long")).cast("long")
    placed = placed.withColumns({"copies": copies, "taken": copies * F.col("size")})
    # Demand ramp0 + (ramp1 - ramp0) t integrates to ramp0 t + (ramp1 - ramp0) t^2 / 2; the rationalised root also holds for flat ramps.
    scale = (F.col("ramp0") + F.col("ramp1")) / 2

    def position(k: Column) -> Column:
        u = F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size") + F.col("size") / 2.0) / F.when(F.col("target") > 0, F.col("target")))
        return 2 * u * scale / (F.col("ramp0") + F.sqrt(F.greatest(F.lit(0.0), F.col("ramp0") * F.col("ramp0") + 2 * (F.col("ramp1") - F.col("ramp0")) * u * scale)))

    every = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "source", *[F.col(f"carried.`{c}`").alias(c) for c in keep], "size", "source_size", "target", "copies", "taken", every.alias("positions"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", F.try_element_at("positions", F.lit(-1)).alias("last_position"))


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
SQL = {
    "op5_curriculum_mix": f"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap,
      CASE (rk - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS r0, CASE (rk - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS r1 FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv
      FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN cap / weight > lv THEN lv END) OVER () AS final FROM l),
t AS (SELECT source, source_size, r0, r1, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
p AS (SELECT doc_id, size, source_size, target, r0, r1, start,
      CASE WHEN size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) + CASE WHEN start + size / 2.0::DOUBLE < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END AS copies
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
-- Places of the first and the last copy in the source's demand; t solves r0 t + (r1 - r0) t^2 / 2 = place, (r0 + r1) / 2 being the whole demand.
u AS (SELECT *, least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / target) * (r0 + r1) / 2 AS u0, least(1.0::DOUBLE, (start + (copies - 1) * source_size + size / 2.0::DOUBLE) / target) * (r0 + r1) / 2 AS u1 FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
       CASE WHEN copies > 0 THEN 2 * u0 / (r0 + sqrt(greatest(0, r0 * r0 + 2 * (r1 - r0) * u0))) END AS position,
       CASE WHEN copies > 0 THEN 2 * u1 / (r0 + sqrt(greatest(0, r0 * r0 + 2 * (r1 - r0) * u1))) END AS last_position FROM u"""
}
QUERIES = {"op5_curriculum_mix": op5_curriculum_mix}
