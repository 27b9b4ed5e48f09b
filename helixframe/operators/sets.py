"""Several variant sets: comparing, intersecting, merging, subsetting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.variants import bound, fill_type, normalised
from helixframe.operators.ranges import chains


def diff_samples(left: DataFrame, right: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(sample, kind): in B, 1 or 2; names (sample, other) renames the left side."""
    a = left.select("sample").distinct()
    if names is not None:
        a = a.join(names, "sample", "left").select(F.coalesce("other", "sample").alias("sample"))
    return a.withColumn("x", F.lit(1)).join(right.select("sample").distinct().withColumn("y", F.lit(1)), "sample", "full").select("sample", F.when(F.col("x").isNull(), "2").when(F.col("y").isNull(), "1").otherwise("B").alias("kind"))


def tagged(sets: dict[str, DataFrame]) -> DataFrame:
    """One frame of several, with their names in src; columns that a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("src", F.lit(name)) for name, df in sets.items()))


def walk_together(sets: dict[str, DataFrame]) -> DataFrame:
    """(chrom, pos, one id per set): a row per position of any set."""
    return tagged(sets).groupBy("chrom", "pos").agg(*[F.min(F.when(F.col("src") == n, F.col("vid"))).alias(n) for n in sets])


def intersect_sites(sets: dict[str, DataFrame], at_least: int = 1, at_most: int | None = None, window: int = 0) -> DataFrame:
    """(chrom, pos, sources): sites in so many sets. window > 0 chains positions at most that far apart to one group, named by
    its first position."""
    all_ = tagged(sets).select("chrom", "pos", "src").distinct()
    if window:
        all_ = chains(all_.withColumn("end", F.col("pos")), "pos", "end", window, ("src",))
        by = all_.groupBy("chrom", "chain").agg(F.min("pos").alias("pos"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"), F.count_distinct("src").alias("n")).drop("chain")
    else:
        by = all_.groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"), F.count("*").alias("n"))
    out = by.where(F.col("n") >= at_least)
    return (out.where(F.col("n") <= at_most) if at_most else out).select("chrom", "pos", "sources")


def complement(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Sites of the first set whose position no other has."""
    return reduce(lambda a, b: a.join(b.select("chrom", "pos"), ["chrom", "pos"], "left_anti"), others, first)


def _total(df: DataFrame, c: str) -> Column:
    """The sum of a column, item by item if it holds arrays of one length."""
    if df.schema[c].dataType.typeName() != "array":
        return F.sum(c).alias(c)
    every = F.collect_list(c)  # as many as sets have rows at a position
    return F.when(F.size(every) > 0, F.aggregate(F.slice(every, 2, F.greatest(F.size(every), F.lit(1))), every[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q))).alias(c)


def merge_sites(
    sets: dict[str, DataFrame], calls: dict[str, DataFrame], weights: dict[str, int] | None = None, summed: tuple[str, ...] = (), first: tuple[str, ...] = (), samples: dict[str, DataFrame] | None = None, missing: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Merges sets by position. Sites: chrom, pos, the longest reference, the union of alternatives on it (each stretched by
    the rest of the reference), the mean quality weighted by `weights` (numbers of samples; 1 without), the sum of the
    `summed` columns (of arrays item by item), the first set's value of the `first` columns, the union of filters but PASS,
    `sf` with the numbers of the sets, an f behind those that were filtered, AN and AC recounted.
    Calls: src, sample and allele numbers in the merged list. With `samples`, a frame per set, samples whose set has no row
    at a position are there too, with `missing` (0: the reference) for both alleles."""
    all_ = tagged(sets)
    number = F.lit(None).cast("int")
    for k, name in enumerate(sets):
        number = F.when(F.col("src") == name, k).otherwise(number)
    flagged = F.concat(number.cast("string"), F.when(F.coalesce(F.size("filters") > 0, F.lit(False)), "f").otherwise(""))
    order = F.struct(number.alias("k"), "vid")
    weight = F.lit(1)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("src") == name, w).otherwise(weight)
    ref = all_.groupBy("chrom", "pos").agg(F.max_by("ref", F.struct(F.length("ref"), "ref")).alias("long_ref"))
    own = all_.join(ref, ["chrom", "pos"])
    stretched = own.select("chrom", "pos", "src", "vid", "long_ref", "ref", F.posexplode("alts").alias("k", "a")).withColumn("alt", F.concat("a", F.expr("substring(long_ref, length(ref) + 1)")))
    alts = stretched.groupBy("chrom", "pos").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    flags = own.select("chrom", "pos", F.explode_outer("filters").alias("f")).groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.collect_set("f")), ";").alias("filters"))
    qual = own.groupBy("chrom", "pos").agg(F.round(F.sum(F.col("qual") * weight) / F.sum(F.when(F.col("qual").isNotNull(), weight)), 2).alias("qual"), *[_total(own, c) for c in summed], *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in first],
        F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(number.alias("k"), flagged.alias("t")))), lambda x: x["t"]), ",").alias("sf"))
    # A site's new allele numbers are one array, so that its calls are put in order for one join.
    longer = F.transform("alts", lambda x: F.concat(x, F.expr("substring(long_ref, length(ref) + 1)")))
    place = own.withColumn("__own", longer).drop("alts").join(alts, ["chrom", "pos"], "left").select("src", "vid", "chrom", "pos", F.transform("__own", lambda x: F.array_position("alts", x).cast("int")).alias("__new")).distinct()
    number_of = lambda c: F.when(F.col(c) == 0, 0).otherwise(F.get("__new", F.col(c) - 1)).alias(c)
    moved = tagged({name: df.select("vid", "sample", "a1", "a2") for name, df in calls.items()}).join(place, ["src", "vid"]).select("chrom", "pos", "src", "sample", number_of("a1"), number_of("a2"))
    if samples is not None:
        who = tagged({name: df.select("sample") for name, df in samples.items()})
        lacking = ref.select("chrom", "pos", F.explode(F.array(*map(F.lit, samples))).alias("src")).join(all_.select("chrom", "pos", "src"), ["chrom", "pos", "src"], "left_anti")
        blank = F.lit(missing).cast("int")
        moved = moved.unionByName(lacking.join(F.broadcast(who), "src").select("chrom", "pos", "src", "sample", blank.alias("a1"), blank.alias("a2")))
    an = moved.select("chrom", "pos", F.explode(F.array("a1", "a2")).alias("a")).where("a is not null").groupBy("chrom", "pos").agg(F.count("*").alias("an"), F.count_if(F.col("a") > 0).alias("ac"))
    sites = ref.join(alts, ["chrom", "pos"]).join(flags, ["chrom", "pos"]).join(qual, ["chrom", "pos"]).join(an, ["chrom", "pos"], "left").na.fill(0, ["an", "ac"])
    return sites.select("chrom", "pos", F.col("long_ref").alias("ref"), F.array_join("alts", ",").alias("alts"), "qual", "filters", "sources", "sf", "an", "ac", *summed, *first), moved


def annotate_from_table(variants: DataFrame, table: DataFrame, info: dict[str, bool] | None = None, match_alleles: bool = False) -> DataFrame:
    """variants (vid, chrom, pos, id, ref, alts, qual, filters, info: a map) filled from a table of inclusive intervals:
    chrom, start, end, rank and any of id, qual, filters, ref, alts and the columns named in `info` (True: a flag).

    A site's rows count in the order of rank. id becomes the rows' ids, each once, ';' between; qual and filters those of the
    last row that has any; an INFO value the rows' values, ',' between, and where none has one ('', '.' or null) the key is
    removed; a flag is set where a row's value is neither of these nor '0', else removed. With match_alleles an alternative
    of the row must be one of the site, each with its reference and without shared ends; a row with reference '.' fits all.
    Sites without a row stay as they are."""
    from helixframe.operators.ranges import range_join

    own = table.select(*[F.col(c).alias(f"__t_{c}") for c in table.columns], (F.col("end") + 1).alias("__t_stop"))
    sites, l, r = variants.select("vid", "chrom", "pos", (F.col("pos") + 1).alias("__end")), ("chrom", "pos", "__end"), ("__t_chrom", "__t_start", "__t_stop")  # noqa: E741
    if match_alleles:
        # Alleles are cut before the join, once a row, and are a key of it; of several that a site and a row share the first counts.
        short = lambda ref, alt: bound(normalised(ref, alt, F.lit(0)), lambda n: F.concat_ws("-", n["ref"], n["alt"]))
        pairs = lambda ref, alts: F.array_distinct(F.transform(alts, lambda a: short(F.col(ref), a)))
        of_sites = variants.select("vid", "chrom", "pos", (F.col("pos") + 1).alias("__end"), pairs("ref", "alts").alias("__pairs")).withColumn("__pair", F.explode("__pairs"))
        of_rows = own.where(~F.coalesce(F.col("__t_ref") == ".", F.lit(False))).withColumn("__t_pairs", pairs("__t_ref", "__t_alts")).withColumn("__t_pair", F.explode("__t_pairs"))
        same = range_join(of_sites, of_rows, l, r, width=256, keep=F.col("__pair") == F.col("__t_pair")).where(F.get(F.array_intersect("__pairs", "__t_pairs"), F.lit(0)) == F.col("__pair"))
        of_all = range_join(sites, own.where(F.col("__t_ref") == "."), l, r, width=256)
        hits = of_all.unionByName(same.drop("__pairs", "__pair", "__t_pairs", "__t_pair"))
    else:
        hits = range_join(sites, own, l, r, width=256)
    rank = F.col("__t_rank")

    def last(c: str) -> Column:
        return F.max_by(f"__t_{c}", F.when(F.col(f"__t_{c}").isNotNull(), rank)) if c in table.columns else F.lit(None).cast(variants.schema[c].dataType)

    def value(c: str, flag: bool) -> Column:
        raw = F.col(f"__t_{c}").cast("string")
        some = raw.isNotNull() & ~raw.isin("", ".")
        if flag:
            return F.when(F.bool_or(some & (raw != "0")), "")
        every = F.array_sort(F.collect_list(F.when(some, F.struct(rank.alias("r"), raw.alias("v")))))
        return F.when(F.size(every) > 0, F.array_join(F.transform(every, lambda x: x["v"]), ","))

    ids = F.array_sort(F.collect_set("__t_id")) if "id" in table.columns else F.array().cast("array<string>")
    info = info or {}
    by = hits.groupBy("vid").agg(ids.alias("__ids"), last("qual").alias("__qual"), last("filters").alias("__filters"), *[value(c, flag).alias(f"__i_{c}") for c, flag in info.items()])
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"__i_{c}").alias("v")) for c in info])
    filled = F.col("info") if not info else F.map_concat(F.map_filter("info", lambda k, _: ~k.isin(*info)), F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))
    new = {"id": F.when(F.size("__ids") > 0, F.array_join("__ids", ";")).otherwise(F.col("id")), "qual": F.coalesce("__qual", "qual"), "filters": F.coalesce("__filters", "filters"), "info": F.when(F.col("__ids").isNotNull(), filled).otherwise(F.col("info"))}
    return variants.join(by, "vid", "left").select(*[new[c].alias(c) if c in new else c for c in variants.columns])


_SITE = ["chrom", "pos", "nth"]


def allele_bases(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(chrom, pos, nth, vid, sample, dose, bases): the sorted bases of a complete call, null if incomplete, and its dosage. nth
    numbers the sites of one position by vid, so that two sets' sites there meet one by one."""
    nth = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("vid"))
    b = calls.join(variants.select("vid", "chrom", "pos", nth.alias("nth"), F.concat(F.array("ref"), "alts").alias("alleles")), "vid")
    pair = F.array_join(F.array_sort(F.array(F.get("alleles", F.col("a1")), F.get("alleles", F.col("a2")))), "/")
    return b.select(*_SITE, "vid", "sample", (F.col("a1") + F.col("a2")).alias("dose"), F.when(F.col("a1").isNotNull() & F.col("a2").isNotNull(), pair).alias("bases"))


def discordance(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], by: list[str]) -> DataFrame:
    """(by, n_common, n_discordant, rate): complete calls of common sites and samples whose bases differ, order-free."""
    a = allele_bases(*left).where("bases is not null")
    b = allele_bases(*right).where("bases is not null").select(*_SITE, "sample", F.col("bases").alias("bases2"))
    got = a.join(b, [*_SITE, "sample"]).groupBy(*by).agg(F.count("*").alias("n_common"), F.count_if(F.col("bases") != F.col("bases2")).alias("n_discordant"))
    return got.withColumn("rate", F.round(F.col("n_discordant") / F.col("n_common"), 6))


def discordance_matrix(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(dose1, dose2, n): the 4 x 4 table of dosages, 3 for missing, at common biallelic sites."""
    code = lambda c: F.coalesce(F.col(c), F.lit(3))
    two = lambda s: (s[0].where(F.size("alts") == 1), s[1])
    a = allele_bases(*two(left)).select(*_SITE, "sample", code("dose").alias("dose1"))
    b = allele_bases(*two(right)).select(*_SITE, "sample", code("dose").alias("dose2"))
    return a.join(b, [*_SITE, "sample"]).groupBy("dose1", "dose2").agg(F.count("*").alias("n"))


def genotype_comparison(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], strata: DataFrame | None = None) -> DataFrame:
    """(class, n_match, n_mismatch, n_lost, n_gained): by the left side's genotype class; lost: right is missing. With strata
    (vid, stratum, or vid, sample, stratum, of the left side) by these too."""
    a = allele_bases(*left)
    by = ["class"]
    if strata is not None:
        a, by = a.join(strata, [c for c in ("vid", "sample") if c in strata.columns]), ["stratum", "class"]
    a = a.select(*_SITE, "sample", "dose", "bases", *by[:-1])
    b = allele_bases(*right).select(*_SITE, "sample", F.col("dose").alias("dose2"), F.col("bases").alias("bases2"))
    j = a.join(b, [*_SITE, "sample"])
    kind = lambda d, s: F.when(F.split(s, "/")[0] != F.split(s, "/")[1], F.when(F.col(d) <= 2, "het_RA").otherwise("het_AA")).when(F.col(d) == 0, "hom_RR").otherwise("hom_AA")
    j = j.withColumn("class", F.coalesce(kind("dose", F.col("bases")), kind("dose2", F.col("bases2"))))
    return j.where("class is not null").groupBy(*by).agg(F.count_if(F.col("bases") == F.col("bases2")).alias("n_match"), F.count_if(F.col("bases") != F.col("bases2")).alias("n_mismatch"), F.count_if(F.col("bases").isNotNull() & F.col("bases2").isNull()).alias("n_lost"), F.count_if(F.col("bases").isNull() & F.col("bases2").isNotNull()).alias("n_gained"))


def non_reference_discordance(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(rate): mismatches over mismatches and matches of calls with an alternative allele."""
    g = genotype_comparison(left, right)
    bad = F.sum("n_mismatch")
    return g.agg(F.round(bad / (bad + F.sum(F.when(F.col("class") != "hom_RR", F.col("n_match")).otherwise(0))), 6).alias("rate"))


def subset(variants: DataFrame, calls: DataFrame, samples: DataFrame, exclude_ref: bool = False, private: bool = False, trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sites and calls of some samples; exclude_ref drops sites where all are reference, private keeps sites whose
    alternative alleles no other sample has, trim drops alternatives that none of them carries and renumbers calls."""
    own = calls.join(F.broadcast(samples.select("sample")), "sample", "left_semi")
    carried = lambda c: c.select("vid", F.explode(F.array("a1", "a2")).alias("a")).where("a > 0").distinct()
    mine = carried(own)
    v = variants
    if exclude_ref or private:
        v = v.join(mine.select("vid").distinct(), "vid", "left_semi")
    if private:
        others = carried(calls.join(F.broadcast(samples.select("sample")), "sample", "left_anti"))
        v = v.join(mine.join(others, ["vid", "a"], "left_semi").select("vid").distinct(), "vid", "left_anti")
    own = own.join(v.select("vid"), "vid", "left_semi")
    if trim:
        kept = mine.groupBy("vid").agg(F.array_sort(F.collect_set("a")).alias("kept"))
        v = v.join(kept, "vid", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
        numbered = own.join(v.select("vid", "kept"), "vid")
        for side in ("a1", "a2"):
            numbered = numbered.withColumn(side, F.when(F.col(side) > 0, F.array_position("kept", F.col(side)).cast("int")).otherwise(F.col(side)))
        own = numbered.drop("kept")
        v = v.withColumn("alts", F.transform("kept", lambda k: F.get("alts", k - 1))).drop("kept")
    return v, own


def natural_chrom() -> list[Column]:
    """Sort keys: the number in a chromosome's name, then the rest."""
    bare = F.regexp_replace("chrom", "^chr", "")
    return [F.coalesce(F.regexp_extract(bare, r"^(\d+)", 1).try_cast("int"), F.lit(1_000_000)), bare]


def sort_sites(variants: DataFrame, natural: bool = True) -> DataFrame:
    return variants.orderBy(*(natural_chrom() if natural else [F.col("chrom")]), "pos")


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """target and those of the rows whose key it lacks; of rows with one key the first by `order`."""
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")
    return target.unionByName(first.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace_partition(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with all rows of the keys that `rows` has replaced by them."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_by_label(tables: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    return {name: df.where(F.col("label") != label) for name, df in tables.items()}


def frequency_strata(variants: DataFrame, calls: DataFrame, width: float = 0.1) -> DataFrame:
    """(vid, stratum): the lower end of the bin of a site's share of alternative alleles; 1 belongs to the last bin."""
    alleles = calls.select("vid", F.explode(F.array("a1", "a2")).alias("a")).where("a is not null")
    share = alleles.groupBy("vid").agg((F.count_if(F.col("a") > 0) / F.count("*")).alias("af"))
    last = F.lit(round(1 / width) - 1)
    return share.join(variants.select("vid"), "vid").select("vid", F.round(F.least(F.floor(F.round(F.col("af") / width, 9)), last) * width, 6).alias("stratum"))


def allele_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n_sites, n_ref, n_alt): positions of both sets, those with another reference, and of the others those with other
    alternatives. Of a set's sites at one position the one with the first reference and alternatives counts."""
    first = lambda df, r, a: df.groupBy("chrom", "pos").agg(F.min(F.struct("ref", F.array_sort("alts").alias("alts"))).alias("x")).select("chrom", "pos", F.col("x.ref").alias(r), F.col("x.alts").alias(a))
    j = first(left, "r1", "a1").join(first(right, "r2", "a2"), ["chrom", "pos"])
    other = F.col("r1") != F.col("r2")
    return j.agg(F.count("*").alias("n_sites"), F.count_if(other).alias("n_ref"), F.count_if(~other & (F.col("a1") != F.col("a2"))).alias("n_alt"))


def phase_comparison(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(sample, n_both, n_same): heterozygous calls of the same bases that both sides phased, and those in the same order.
    Calls: phased."""

    def ordered(variants: DataFrame, calls: DataFrame, a: str, b: str) -> DataFrame:
        j = calls.where("phased and a1 <> a2").join(variants.select("vid", "chrom", "pos", F.concat(F.array("ref"), "alts").alias("__l")), "vid")
        return j.select("chrom", "pos", "sample", F.get("__l", F.col("a1")).alias(a), F.get("__l", F.col("a2")).alias(b))

    j = ordered(*left, "x1", "x2").join(ordered(*right, "y1", "y2"), ["chrom", "pos", "sample"])
    same = (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))
    return j.where(same | ((F.col("x1") == F.col("y2")) & (F.col("x2") == F.col("y1")))).groupBy("sample").agg(F.count("*").alias("n_both"), F.count_if(same).alias("n_same"))


def only_types(variants: DataFrame, calls: DataFrame, types: list[str], replace_with_ref: bool = False, keep_uncalled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sites and calls whose alternatives of other types (those of fill_type) are missing, or the reference. Sites where no
    call has an allele left go, unless they are kept."""
    ok = variants.select("vid", F.transform("alts", lambda a: fill_type(F.col("ref"), a).isin(*types)).alias("__ok"))
    j = calls.join(ok, "vid")
    other = F.lit(0 if replace_with_ref else None).cast("int")
    for side in ("a1", "a2"):
        j = j.withColumn(side, F.when((F.col(side) > 0) & ~F.get("__ok", F.col(side) - 1), other).otherwise(F.col(side)))
    own = j.drop("__ok")
    if keep_uncalled:
        return variants, own
    called = own.where("a1 is not null or a2 is not null").select("vid").distinct()
    return variants.join(called, "vid", "left_semi"), own.join(called, "vid", "left_semi")


def first_unsorted(sites: DataFrame) -> tuple | None:
    """The first place (chrom, pos), in the order of the rows, that is less than one before it; null if there is none. Tasks look
    through their rows; the driver compares where they begin and end, a row each."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = bad = None
        for batch in batches:
            for at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = first or at
                if bad is None and last is not None and at < last:
                    bad = at
                last = max(last or at, at)
        rows = [] if first is None else [(TaskContext.get().partitionId(), *first, *last, *(bad or (None, None)))]
        kinds = (pa.int32(), *(pa.string(), pa.int64()) * 3)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "c1", "p1", "c2", "p2", "c3", "p3"])

    greatest = None
    for r in sites.select("chrom", F.col("pos").cast("long")).mapInArrow(look, "part int, c1 string, p1 long, c2 string, p2 long, c3 string, p3 long").orderBy("part").collect():
        if greatest is not None and (r.c1, r.p1) < greatest:
            return r.c1, r.p1
        if r.c3 is not None:
            return r.c3, r.p3
        greatest = (r.c2, r.p2)
    return None


def concat(sets: list[DataFrame], pad: bool = False, are_sorted: bool = False) -> DataFrame:
    """Sets below one another, by place. Sets must have the same columns; with pad, those that one lacks are null.

    With are_sorted each set has to be in the order of chrom and pos, which is checked. Then only the sets' ends are compared:
    sets that lie apart follow one another as they are, without a shuffle, and only those whose ranges overlap are merged."""
    unlike = [df.columns for df in sets if set(df.columns) != set(sets[0].columns)]
    if unlike and not pad:
        raise ValueError(f"sets have different columns: {sets[0].columns} and {unlike[0]}")
    below = lambda own: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=pad), own)
    if not are_sorted:
        return sort_sites(below(sets), natural=False)
    place = F.struct("chrom", F.col("pos").cast("long").alias("pos"))
    spans = []
    for k, df in enumerate(sets):
        if (bad := first_unsorted(df)) is not None:
            raise ValueError(f"set {k} is not sorted at {bad[0]}:{bad[1]}")
        a, b = df.agg(F.min(place), F.max(place)).first()
        if a is not None:
            spans.append((tuple(a), tuple(b), k))
    groups: list[list[int]] = []
    end = None
    for a, b, k in sorted(spans):
        if end is None or a > end:
            groups.append([])
        groups[-1].append(k)
        end = b if end is None else max(end, b)
    whole = below([df.limit(0) for df in sets]).columns
    parts = [sets[own[0]] if len(own) == 1 else sort_sites(below([sets[k] for k in own]), natural=False) for own in groups]
    return below([below([sets[0].limit(0), *[df.limit(0) for df in sets[1:]]]), *parts]).select(*whole) if parts else below(sets)


def in_order(calls: DataFrame, template: DataFrame) -> DataFrame:
    """(vid, line): a site's calls in the order of a template (sample, place), which may leave samples out."""
    text = F.concat(F.coalesce(F.col("a1").cast("string"), F.lit(".")), F.lit("/"), F.coalesce(F.col("a2").cast("string"), F.lit(".")))
    cells = F.array_sort(F.collect_list(F.struct("place", text.alias("g"))))  # a site's samples
    return calls.join(template, "sample").groupBy("vid").agg(F.array_join(F.transform(cells, lambda x: x["g"]), " ").alias("line"))
