"""Joins on intervals, positions and points in space, without pairing all rows.

Intervals are half-open [start, end). Each side is exploded to genome bins and joined on (chrom, bin); of the bins that two
overlapping intervals share, only the first one keeps the pair, so no deduplication is needed after. Equi joins on bins can
be split by adaptive execution where a bin is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.scratch import saved

#: Into which rows that are about to be paired are dealt at least.
PAIR_PARTITIONS = 64


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in a fixed number of partitions: by their own bytes they would be joined to few, which have all pairs to make."""
    return rows.repartition(max(PAIR_PARTITIONS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches; an empty interval touches the bin of its start."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def range_join(left: DataFrame, right: DataFrame, l: tuple[str, str, str], r: tuple[str, str, str], how: str = "overlap", width: int = 1024, keep: Column | None = None) -> DataFrame:  # noqa: E741
    """Pairs whose (chrom, start, end) overlap; how="within": left lies inside right.

    Column names of both sides must differ. width: about the median length of an interval."""
    lc, ls, le = l
    rc, rs, re_ = r
    a = left.withColumn("__bin", F.explode(bins(F.col(ls), F.col(le), width)))
    b = right.withColumn("__bin2", F.explode(bins(F.col(rs), F.col(re_), width)))
    on = (F.col(lc) == F.col(rc)) & (F.col("__bin") == F.col("__bin2")) & (F.col("__bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    on &= (F.col(ls) >= F.col(rs)) & (F.col(le) <= F.col(re_)) if how == "within" else (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    if keep is not None:
        on &= keep
    return a.join(b, on).drop("__bin", "__bin2")


def merged(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): of each group of intervals those that overlap as one, so that a base of a group lies in one only."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    own = ranges.select(*keys, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("__new", (reach.isNull() | (F.col(start) >= reach)).cast("long")).withColumn("__chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "__chain").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__chain")


def in_ranges(left: DataFrame, ranges: DataFrame, l: tuple[str, str, str], r: tuple[str, str, str], key: str, invert: bool = False, width: int = 1024) -> DataFrame:  # noqa: E741
    """Left rows, by a unique key, that overlap any range; or none."""
    hit = range_join(left.select(key, *dict.fromkeys(l)), ranges.select(*[F.col(c).alias(f"__r_{c}") for c in dict.fromkeys(r)]), l, tuple(f"__r_{c}" for c in r), width=width).select(F.col(key).alias("__key")).distinct()
    return left.join(hit, F.col(key) == F.col("__key"), "left_anti" if invert else "left_semi")


def grid_join(left: DataFrame, right: DataFrame, l: tuple[str, str, str], r: tuple[str, str, str], radius: float, same: tuple[str, str] | None = None) -> DataFrame:  # noqa: E741
    """Pairs of points within a radius, with their distance: equal cells of a 3-D grid, the left side in its 27 neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.expr("transform(sequence(0, 26), i -> named_struct('i', i % 3 - 1, 'j', i div 3 % 3 - 1, 'k', i div 9 - 1))"))
    a = left.withColumn("__n", near)
    a = a.select(*left.columns, *[(cell(c) + F.col(f"__n.{d}")).alias(f"__g{d}") for c, d in zip(l, "ijk", strict=True)])
    b = right.select(*right.columns, *[cell(c).alias(f"__h{d}") for c, d in zip(r, "ijk", strict=True)])
    on = F.lit(True)
    for d in "ijk":
        on &= F.col(f"__g{d}") == F.col(f"__h{d}")
    if same:
        on &= F.col(same[0]) == F.col(same[1])
    square = sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(l, r, strict=True)), F.lit(0.0))
    return a.join(b, on & (square <= radius * radius)).withColumn("distance", F.sqrt(square)).drop(*[f"__g{d}" for d in "ijk"], *[f"__h{d}" for d in "ijk"])


def pairs_within(sites: DataFrame, window: int, key: str = "vid", most_rank: int | None = None) -> DataFrame:
    """Site pairs on one chromosome, first before second, at most `window` bases (and most_rank sites) apart."""
    a = sites.withColumn("__bin", F.floor(F.col("pos") / window))
    if most_rank:
        a = ranked(sites, key).withColumn("__bin", F.floor(F.col("pos") / window))
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns if c != "__bin"], F.explode(F.array(F.col("__bin"), F.col("__bin") - 1)).alias("__bin2"))
    near = (F.col("chrom") == F.col("chrom2")) & (F.col("__bin") == F.col("__bin2")) & ((F.col("pos2") > F.col("pos")) | ((F.col("pos2") == F.col("pos")) & (F.col(f"{key}2") > F.col(key)))) & (F.col("pos2") - F.col("pos") <= window)
    if most_rank:
        near &= F.col("rank2") - F.col("rank") <= most_rank
    return dealt(a, "chrom", "__bin").join(dealt(b, "chrom2", "__bin2"), near).drop("__bin", "__bin2", "rank", "rank2")


def ranked(sites: DataFrame, key: str = "vid", bin_width: int = 100_000) -> DataFrame:
    """sites with `rank`, their number along the chromosome by pos and key: a number in a bin, and the bins' sizes before it."""
    own = saved(sites.withColumn("__bin", F.floor(F.col("pos") / bin_width)), "ranked")
    along = Window.partitionBy("chrom").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("chrom", "__bin").agg(F.count("*").alias("__n")).select("chrom", "__bin", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("chrom", "__bin").orderBy("pos", key))
    return own.withColumn("rank", inside).join(base, ["chrom", "__bin"]).withColumn("rank", F.col("rank") + F.col("__base")).drop("__bin", "__base")


def chains(rows: DataFrame, start: str, end: str, within: int, order: tuple[str, ...], bin_width: int = 100_000) -> DataFrame:
    """rows (chrom, ...) with `chain`, which numbers a chromosome's groups of intervals: a row goes on with the group if its
    start is at most `within` after the greatest end of all rows before it, in the order of start and `order`.

    A bin knows its greatest end and how many groups begin in it; those are added up along a chromosome, a row per bin, so
    that no task sorts a chromosome."""
    own = saved(rows.withColumn("__bin", F.floor(F.col(start) / bin_width)), "chains")
    w = Window.partitionBy("chrom", "__bin").orderBy(start, *order)
    along = Window.partitionBy("chrom").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("chrom", "__bin").agg(F.max(end).alias("__end")).select("chrom", "__bin", F.max("__end").over(along).alias("__before"))
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    own = own.join(ends, ["chrom", "__bin"]).withColumn("__reach", reach).withColumn("__new", (F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + within)).cast("long"))
    own = own.withColumn("__inside", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__before", "__reach")
    counts = own.groupBy("chrom", "__bin").agg(F.sum("__new").alias("__n")).select("chrom", "__bin", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__base"))
    return own.join(counts, ["chrom", "__bin"]).withColumn("chain", F.col("__base") + F.col("__inside")).drop("__bin", "__new", "__inside", "__base")


def running_sums(rows: DataFrame, order: str, columns: list[str], range_rows: int = 200_000) -> DataFrame:
    """rows with <column>_below and <column>_above: the sums over all rows that come before and after by `order`, whose values are
    distinct. Rows are dealt to ranges; a range adds what the ranges before it sum up to."""
    n = rows.count()
    own = saved(rows.repartitionByRange(max(1, -(-n // range_rows)), order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = own.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])  # a row per range
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in columns], *[F.sum(f"__{c}").over(every).alias(f"__{c}_all") for c in columns])
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(sums, "__part")
    for c in columns:
        out = out.withColumn(f"{c}_below", (F.col(f"__{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long")).withColumn(f"{c}_above", (F.col(f"__{c}_all") - F.col(f"{c}_below") - F.col(c)).cast("long"))
    return out.drop("__part", *[f"__{c}_{x}" for c in columns for x in ("before", "all")])


def numbered(rows: DataFrame, *order: Column, range_rows: int = 200_000) -> DataFrame:
    """rows with `number`, their place from 1 on by `order`: dealt to ranges, a place in a range, and the sizes of those before."""
    own = saved(rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return own.withColumn("number", inside).join(before, "__part").withColumn("number", F.col("number") + F.col("__before")).drop("__part", "__before")
