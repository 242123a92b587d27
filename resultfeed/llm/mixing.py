"""Mixing sources to target weights (operator 2), DataFrame functions only.

1. Words are counted per source (map-side partial sums, so a hot source is no problem).
2. Sources are ranked by code point, null last, and get the weights in turn.  Targets share the
   total by weight; a target stops at ``cap`` times its source's size and what it leaves is
   shared again.  That is a water level ``lam``: target = min(cap * size, lam * weight).  The level
   is found by the sharing rounds themselves; a round is one aggregate over the table of sources
   and returns three numbers to the driver.
3. rate = target / size.  A document is emitted floor(rate) times, plus once more if a number in
   [0, 1) drawn from the MD5 of seed and doc_id is below the fraction of its rate.

Defined cases: null and blank texts have size 0 and rate 0 in a source without words; a null
source is a source of its own, last in the order; rows with one doc_id share their draw; a null
doc_id draws as the text ``null``; an empty table gives an empty table.  Other columns pass
through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: The table of sources is broadcast up to this many rows and name bytes, joined with salt beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4_000_000
SALTS = 32
#: Sources in one range when they are ranked.
RANK_ROWS = 50_000


@dataclass
class Rates:
    """One row per source: source, source_size, weight, target, rate; ``small``: safe to broadcast."""

    table: DataFrame
    small: bool


def _ranked(sizes: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``rank`` from 0 by (null last, code point) without sorting everything in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(1, -(-n_sources // RANK_ROWS))
    ranged = cut(sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = (
        ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def source_rates(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> Rates:
    """Targets and repetition rates from a table with ``source`` and ``size`` (one row per document)."""
    sizes = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n, name_bytes = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and name_bytes <= BROADCAST_BYTES
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(_ranked(sizes, n).withColumn("weight", turn).drop("rank"))

    most = F.col("source_size") * cap
    total, weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, stopped = (total / weight if weight else 0.0), 0
    while True:
        above = most < F.lit(level) * F.col("weight")
        now, held, open_weight = table.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if now == stopped or not open_weight:
            break
        level, stopped = (total - held) / open_weight, now
    share = F.lit(level) * F.col("weight")
    target = F.when(most < share, most.cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return Rates(table.withColumn("target", target).withColumn("rate", rate), small)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 52 bits of MD5(seed:doc_id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)


def _with_rates(docs: DataFrame, rates: Rates, columns: dict[str, str]) -> DataFrame:
    """``docs`` with the columns of its source's row under the new names of ``columns``."""
    key, salt = free_name([*docs.columns, *columns.values()], "rates_source"), free_name([*docs.columns, *columns.values()], "rates_salt")
    right = rates.table.select(F.col("source").alias(key), *[F.col(k).alias(v) for k, v in columns.items()])
    if rates.small:
        right = F.broadcast(right)
        return docs.join(right, docs["source"].eqNullSafe(right[key]), "left").drop(key)
    left = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    right = right.withColumn(salt + "_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, left["source"].eqNullSafe(right[key]) & (left[salt] == right[salt + "_r"]), "left").drop(key, salt, salt + "_r")


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    Texts are read once; what is kept of them (an id, a source, a number) is checkpointed.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = source_rates(sized, weights, cap)
    out = _with_rates(sized, rates, {"source_size": "source_size", "target": "target", "rate": "rate"})
    return out.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed)).drop("rate")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, same columns."""
    columns = docs.columns
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    rate = free_name(columns, "mix_rate")
    times, one = free_name(columns, "mix_copies"), free_name(columns, "mix_copy")
    out = _with_rates(docs, rates, {"rate": rate}).withColumn(times, copies(F.col("doc_id"), F.col(rate), seed))
    return out.where(F.col(times) > 0).withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(rate, times, one)


def op2(spark, sf_dir: str) -> DataFrame:
    """Digest of the mix for every document: size, its source's size and target, words taken."""
    from .common import read_table

    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, row_number() OVER r AS k, sum(3 * source_size) OVER r - 3 * source_size AS held, sum(weight) OVER r - weight AS gone
  FROM w WINDOW r AS (ORDER BY 3.0 * source_size / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - held AS DOUBLE) / CAST((SELECT sum(weight) FROM w) - gone AS DOUBLE) AS lev FROM o
), level AS (
  SELECT arg_min(lev, k) AS lam FROM l WHERE NOT (3 * source_size < lev * weight)
), t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size < lam * weight THEN CAST(3 * source_size AS DOUBLE) ELSE lam * weight END AS target FROM w, level
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken
FROM r
"""
