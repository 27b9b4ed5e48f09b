"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Within a source the documents stand in the order of their keys: the leading hex
digits of a key are its range, each range is summed, the ranges' sums are added up along a source, and a window within a
range finishes the prefix sums. So no task holds more than one range of one source, however large a source is. A source's
budget is cut exactly where the prefix sum reaches it: whole epochs first, then the documents in order, the last in part.

Nulls: a null text has size 0; a null source is a source, the last one; a null doc_id has a key of its own. Rows that
agree in id, source and size tie, and any order of them gives the same rows. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, saved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size), a row per source.

    The targets share the total by weight; none exceeds `most` times its source's size, and the excess is shared by weight
    among the others until none is above. That ends at min(most*size, level*weight), the level found by one sweep over the
    sources in the order of most*size/weight. The windows see a row per source, not per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("w", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, all_rows = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.when(F.col("cap") * F.col("w_left") > F.col("left") * F.col("w"), F.col("left") / F.col("w_left")))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix", range_digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row per document; taken counts words with repeats.

    range_digits: hex digits of a key that name its range; 3 gives each source 4096 ranges, a digit more 16 times as many."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes").withColumn("key", key).withColumn("range", F.substring("key", 1, range_digits))
    targets = source_targets(sizes, weights, most)
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("before"))
    t = targets.select(F.col("source").alias("t"), "source_size", "target")
    offsets = ranges.join(t, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("before") - F.col("at")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {documents}),
k AS (SELECT *, md5(concat_ws(':', 'mix', COALESCE(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM s),
p AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, source_size * CAST(3.0 AS DOUBLE) AS cap FROM p),
l AS (SELECT *, CAST(SUM(source_size) OVER () AS DOUBLE) - COALESCE(SUM(cap) OVER b, 0.0) AS rest, SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0.0) AS w_left
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (SELECT first(x.rest / x.w_left ORDER BY x.cap / x.w, x.source NULLS LAST) FROM l x WHERE x.cap * x.w_left > x.rest * x.w) AS level FROM l),
t AS (SELECT source, source_size, COALESCE(LEAST(cap, level * w), cap) AS target FROM v),
o AS (SELECT k.*, t.source_size, t.target, COALESCE(SUM(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target, CAST(epochs * size + GREATEST(0, LEAST(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
