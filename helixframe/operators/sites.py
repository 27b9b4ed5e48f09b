"""Site and sample statistics of variants and calls.

variants: vid, chrom, pos, ref, alts (array), qual, filters. calls: vid, sample, a1, a2 (null: missing; allele numbers),
phased, dp, gq. A pair of site and sample without a row is uncalled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ROUND = 6


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), ROUND)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return a / F.when(b != 0, b)


#: Rational approximations of the error function by stretches of x (W. J. Cody's method, as in the C libraries): coefficients
#: above and below the line, from the constant on. Fixed values.
_ERF = {
    "small": ([1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05], [1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06]),
    "one": ([-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03], [1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02]),
    "middle": ([-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00], [1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02]),
    "large": ([-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02], [1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01]),
}


def erfc(x: Column) -> Column:
    """1 less the error function of x >= 0."""
    sum_of = lambda z, c: reduce(lambda acc, k: acc * z + k, reversed(c[:-1]), F.lit(c[-1]))
    share = lambda z, name: sum_of(z, _ERF[name][0]) / sum_of(z, _ERF[name][1])
    tail = lambda name: F.exp(-x * x - 0.5625 + share(1 / (x * x), name)) / x
    return F.when(x < 0.84375, 1 - (x + x * share(x * x, "small"))).when(x < 1.25, 1 - 8.45062911510467529297e-01 - share(x - 1, "one")).when(x < 1 / 0.35, tail("middle")).when(x < 28, tail("large")).when(x.isNotNull(), 0.0)


def chi_square_p(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution with 1, 2 or 4 degrees of freedom; null for others."""
    half = F.greatest(x, F.lit(0.0)) / 2
    return F.when(dof == 1, erfc(F.sqrt(half))).when(dof == 2, F.exp(-half)).when(dof == 4, F.exp(-half) * (1 + half))


def with_chi_square_p(rows: DataFrame, x: str, dof: str, name: str) -> DataFrame:
    """rows with `name`, chi_square_p() of two columns, step by step: each step is worked out once a row, by generated code
    that is short enough to be compiled. For rows by the billion."""
    # coalesce() says that a value is never null, which saves code; nothing is divided by 0.
    sum_of = lambda c: reduce(lambda acc, k: f"({acc} * __z + {k!r}D)", reversed(c[:-1]), f"{c[-1]!r}D")
    by = lambda small, one, middle, large: f"if(__root < 0.84375D, {small}, if(__root < 1.25D, {one}, if(__root < {1 / 0.35!r}D, {middle}, {large})))"
    above, below = (by(*[sum_of(_ERF[part][k]) for part in ("small", "one", "middle", "large")]) for k in (0, 1))
    tail = "if(__root < 28.0D, exp(-__root * __root - 0.5625D + __share) / __root, 0.0D)"
    steps = {
        "__half": f"if({x} <= 0, 0.0D, {x} * 0.5D)", "__root": "sqrt(__half)", "__z": "coalesce(if(__root < 0.84375D, __root * __root, if(__root < 1.25D, __root - 1.0D, 1.0D / (__root * __root))), 0.0D)", "__share": f"coalesce({above} / {below}, 0.0D)",
        name: f"case when {x} is null then null when {dof} = 1 then if(__root < 0.84375D, 1.0D - (__root + __root * __share), if(__root < 1.25D, {1 - 8.45062911510467529297e-01!r}D - __share, {tail})) when {dof} = 2 then exp(-__half) when {dof} = 4 then exp(-__half) * (1.0D + __half) end",
    }
    return reduce(lambda own, step: own.withColumn(step[0], F.expr(step[1])), steps.items(), rows).drop(*[c for c in steps if c != name])


def chromosomes(calls: DataFrame) -> DataFrame:
    """A row per called chromosome: vid, sample, allele."""
    return calls.select("vid", "sample", F.explode(F.array("a1", "a2")).alias("allele")).where("allele is not null")


def allele_counts(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(vid, allele, base, n, total), a row per allele of each site, carried or not."""
    counts = chromosomes(calls).groupBy("vid", "allele").agg(F.count("*").alias("n"))
    alleles = variants.select("vid", F.posexplode(F.concat(F.array("ref"), "alts")).alias("allele", "base"))
    out = alleles.join(counts, ["vid", "allele"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy("vid")))


def allele_freq(variants: DataFrame, calls: DataFrame) -> DataFrame:
    return allele_counts(variants, calls).withColumn("freq", rounded(ratio(F.col("n"), F.col("total"))))


def derived_counts(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Allele counts with the ancestral allele (column aa) first; sites whose aa is no allele are dropped."""
    known = variants.where(F.array_contains(F.concat(F.array("ref"), "alts"), F.upper("aa")))
    got = allele_counts(known, calls).join(known.select("vid", F.upper("aa").alias("aa")), "vid")
    return got.select("vid", "base", "n", "total", (F.col("base") == F.col("aa")).alias("ancestral"))


def full(calls: DataFrame) -> DataFrame:
    """Calls with both alleles, diploid."""
    return calls.where("a1 is not null and a2 is not null")


def genotype_counts(calls: DataFrame) -> DataFrame:
    """(vid, hom_ref, het, hom_alt, n) of complete calls; het: two different alleles."""
    return full(calls).groupBy("vid").agg(
        F.count_if((F.col("a1") == 0) & (F.col("a2") == 0)).alias("hom_ref"),
        F.count_if(F.col("a1") != F.col("a2")).alias("het"),
        F.count_if((F.col("a1") == F.col("a2")) & (F.col("a1") > 0)).alias("hom_alt"),
        F.count("*").alias("n"),
    )


def biallelic(variants: DataFrame) -> DataFrame:
    return variants.where(F.size("alts") == 1)


def heterozygosity(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, observed_hom, expected_hom, n, f) over biallelic, fully diploid, polymorphic sites."""
    own = calls.join(biallelic(variants).select("vid"), "vid")
    site = own.groupBy("vid").agg((F.sum(F.coalesce("a1", F.lit(0))) + F.sum(F.coalesce("a2", F.lit(0)))).alias("alt"), (2 * F.count("*")).alias("n_chr"), F.count_if(F.col("a1").isNull() | F.col("a2").isNull()).alias("gaps"))
    site = site.where((F.col("gaps") == 0) & (F.col("alt") > 0) & (F.col("alt") < F.col("n_chr")))
    f = F.col("alt") / F.col("n_chr")
    expected = 1 - 2 * f * (1 - f) * F.col("n_chr") / (F.col("n_chr") - 1)
    by = own.join(site, "vid").groupBy("sample").agg(F.count_if(F.col("a1") == F.col("a2")).alias("observed_hom"), F.sum(expected).alias("e"), F.count("*").alias("n"))
    return by.select("sample", "observed_hom", rounded(F.col("e")).alias("expected_hom"), "n", F.round(ratio(F.col("observed_hom") - F.col("e"), F.col("n") - F.col("e")), 4).alias("f"))


def exact_hwe(het: np.ndarray, hom1: np.ndarray, hom2: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """Exact Hardy-Weinberg p values of triples, a row each: two-sided, at most so many heterozygotes, at least so many.

    Given the allele counts, h heterozygotes beside a and b homozygotes have a probability in proportion to
    2^h / (h! a! b!). The terms of all triples lie one after the other, in blocks of about `most`."""
    het, hom1, hom2 = (np.asarray(x, np.int64) for x in (het, hom1, hom2))
    rare, total = 2 * np.minimum(hom1, hom2) + het, het + hom1 + hom2
    log_factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, total.max(initial=0) + 1)))]
    sizes = rare // 2 + 1
    out = np.empty((len(het), 3))
    for block in np.split(np.arange(len(het)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1):
        n = sizes[block]
        first = np.cumsum(n) - n
        own = np.repeat(np.arange(len(block)), n)
        a = np.arange(n.sum()) - first[own]
        h = rare[block][own] - 2 * a
        log = h * np.log(2) - log_factorial[h] - log_factorial[a] - log_factorial[total[block][own] - h - a]
        p = np.exp(log - np.maximum.reduceat(log, first)[own])
        p /= np.add.reduceat(p, first)[own]
        seen = het[block][own]
        mine = p[first + (rare - het)[block] // 2][own]
        for k, part in enumerate((p <= mine * (1 + 1e-9), h <= seen, h >= seen)):
            out[block, k] = np.minimum(1.0, np.add.reduceat(np.where(part, p, 0.0), first))
    return out


def hwe(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Per biallelic site genotype counts, expectations, chi square and exact p. Python sees distinct count triples only."""
    c = genotype_counts(calls.join(biallelic(variants).select("vid"), "vid"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            x[["p", "p_lo", "p_hi"]] = exact_hwe(x["het"], x["hom_ref"], x["hom_alt"])
            yield x

    p = c.select("het", "hom_ref", "hom_alt").distinct().mapInPandas(solve, "het long, hom_ref long, hom_alt long, p double, p_lo double, p_hi double")
    q = (2 * F.col("hom_ref") + F.col("het")) / (2 * F.col("n"))
    e = [q * q * F.col("n"), 2 * q * (1 - q) * F.col("n"), (1 - q) * (1 - q) * F.col("n")]
    chi = sum((F.when(x > 0, (F.col(o) - x) * (F.col(o) - x) / x).otherwise(0.0) for o, x in zip(("hom_ref", "het", "hom_alt"), e, strict=True)), F.lit(0.0))
    return c.join(p, ["het", "hom_ref", "hom_alt"]).select("vid", "hom_ref", "het", "hom_alt", *[rounded(x).alias(n) for x, n in zip(e, ("e_hom_ref", "e_het", "e_hom_alt"), strict=True)], rounded(chi).alias("chisq"), "p", "p_lo", "p_hi")


def sample_burden(variants: DataFrame, calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, hom_ref, het, hom_alt, missing) over all sites, uncalled ones missing."""
    got = calls.groupBy("sample").agg(
        F.count_if((F.col("a1") == 0) & (F.col("a2") == 0)).alias("hom_ref"), F.count_if(F.col("a1") != F.col("a2")).alias("het"),
        F.count_if((F.col("a1") == F.col("a2")) & (F.col("a1") > 0)).alias("hom_alt"),
    )
    n = variants.agg(F.count("*").alias("sites"))
    out = samples.select("sample").join(got, "sample", "left").na.fill(0)
    return out.join(F.broadcast(n)).select("sample", "hom_ref", "het", "hom_alt", (F.col("sites") - F.col("hom_ref") - F.col("het") - F.col("hom_alt")).alias("missing"))


def frequency_burden(calls: DataFrame, once: bool = False) -> DataFrame:
    """(sample, allele_count, n): how many non-reference alleles of each count a sample carries; once: a pair counts once."""
    counts = chromosomes(calls).where("allele > 0").groupBy("vid", "allele").agg(F.count("*").alias("allele_count"))
    own = chromosomes(calls).where("allele > 0")
    own = own.distinct() if once else own
    return own.join(counts, ["vid", "allele"]).groupBy("sample", "allele_count").agg(F.count("*").alias("n"))


def sample_depth(calls: DataFrame) -> DataFrame:
    return calls.where("dp is not null").groupBy("sample").agg(F.count("*").alias("n_sites"), rounded(F.avg("dp")).alias("mean_depth"))


def _filtered(calls: DataFrame, filtered: DataFrame | None, by: str) -> tuple[DataFrame, DataFrame]:
    """The calls that are left, and (by, n_filtered) of those (vid, sample) that genotype filters took out."""
    out = (calls.select("vid", "sample").limit(0) if filtered is None else filtered.select("vid", "sample")).distinct()
    return calls.join(out, ["vid", "sample"], "left_anti"), out.groupBy(by).agg(F.count("*").alias("n_filtered"))


def sample_missing(variants: DataFrame, calls: DataFrame, samples: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """(sample, n_data, n_filtered, n_miss, f_miss): a call misses if its first allele does. Filtered calls are no data."""
    left, gone = _filtered(calls, filtered, "sample")
    got = left.where("a1 is not null").groupBy("sample").agg(F.count("*").alias("have"))
    n = variants.agg(F.count("*").alias("sites"))
    out = samples.select("sample").join(got, "sample", "left").join(gone, "sample", "left").na.fill(0).join(F.broadcast(n))
    total = F.col("sites") - F.col("n_filtered")
    miss = total - F.col("have")
    return out.select("sample", total.alias("n_data"), "n_filtered", miss.alias("n_miss"), rounded(ratio(miss, total)).alias("f_miss"))


def site_missing(variants: DataFrame, calls: DataFrame, n_samples: int, filtered: DataFrame | None = None) -> DataFrame:
    """(vid, n_data, n_filtered, n_miss, f_miss) by chromosomes: two a sample, one where a call is haploid, which is a phased
    one without a second allele, or one of ploidy 1 if calls have it. Filtered calls are no data."""
    left, gone = _filtered(calls, filtered, "vid")
    one = F.col("a2").isNull() & F.coalesce("phased", F.lit(False))
    if "ploidy" in calls.columns:
        one |= F.coalesce(F.col("ploidy") == 1, F.lit(False))
    got = left.groupBy("vid").agg((F.count("a1") + F.count("a2")).alias("have"), F.count_if(one).alias("haploid"))
    out = variants.select("vid").join(got, "vid", "left").join(gone, "vid", "left").na.fill(0)
    total = 2 * (n_samples - F.col("n_filtered")) - F.col("haploid")
    miss = total - F.col("have")
    return out.select("vid", total.cast("long").alias("n_data"), "n_filtered", miss.cast("long").alias("n_miss"), rounded(ratio(miss, total)).alias("f_miss"))


def site_depth(calls: DataFrame) -> DataFrame:
    """(vid, sum_depth, sumsq_depth, mean_depth, var_depth) of known depths."""
    d = F.col("dp").cast("long")
    return calls.where("dp is not null").groupBy("vid").agg(F.sum(d).alias("sum_depth"), F.sum(d * d).alias("sumsq_depth"), rounded(F.avg("dp")).alias("mean_depth"), rounded(F.var_samp("dp")).alias("var_depth"))


def genotype_depth(variants: DataFrame, calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(vid, sample, depth): a row per site and sample, -1 where unknown. The matrix in long form: samples are few."""
    grid = variants.select("vid").join(F.broadcast(samples.select("sample")))
    return grid.join(calls.select("vid", "sample", "dp"), ["vid", "sample"], "left").select("vid", "sample", F.coalesce("dp", F.lit(-1)).alias("depth"))


def singletons(calls: DataFrame) -> DataFrame:
    """(vid, allele, kind, sample): S, carried once; D, carried twice by one sample."""
    by = chromosomes(calls).groupBy("vid", "allele").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("k"), F.min("sample").alias("sample"))
    return by.where("n = 1 or (n = 2 and k = 1)").select("vid", "allele", F.when(F.col("n") == 1, "S").otherwise("D").alias("kind"), "sample")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def is_single(ref: Column, alt: Column) -> Column:
    return ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)


def filter_summary(variants: DataFrame) -> DataFrame:
    """(filter, n_variants, n_ts, n_tv, ratio) of biallelic sites by their FILTER text."""
    alt = F.col("alts")[0]
    ts, one = is_transition(F.col("ref"), alt), is_single(F.col("ref"), alt)
    by = biallelic(variants).groupBy(F.coalesce(F.array_join("filters", ";"), F.lit(".")).alias("filter")).agg(F.count("*").alias("n_variants"), F.count_if(one & ts).alias("n_ts"), F.count_if(one & ~ts).alias("n_tv"))
    return by.withColumn("ratio", rounded(ratio(F.col("n_ts"), F.col("n_tv")))).orderBy(F.desc("n_variants"), "filter")


def tstv_summary(variants: DataFrame) -> DataFrame:
    """(model, n): the six unordered pairs of bases, Ts and Tv; biallelic single bases."""
    alt = F.col("alts")[0]
    own = biallelic(variants).where(is_single(F.col("ref"), alt)).select(F.array_join(F.array_sort(F.array("ref", alt)), "").alias("pair"))
    model = F.explode(F.array("pair", F.when(F.col("pair").isin("AG", "CT"), "Ts").otherwise("Tv"))).alias("model")
    return own.select(model).groupBy("model").agg(F.count("*").alias("n"))


def tstv_by_count(variants: DataFrame, calls: DataFrame, n_samples: int) -> DataFrame:
    """(alt_count, n_ts, n_tv) for every count of the alternative allele from 0 to 2N-1."""
    alt = F.col("alts")[0]
    count = chromosomes(calls).where("allele = 1").groupBy("vid").agg(F.count("*").alias("c"))
    own = biallelic(variants).where(is_single(F.col("ref"), alt)).join(count, "vid", "left").select(F.coalesce("c", F.lit(0)).alias("alt_count"), is_transition(F.col("ref"), alt).alias("ts"))
    by = own.groupBy("alt_count").agg(F.count_if("ts").alias("n_ts"), F.count_if(~F.col("ts")).alias("n_tv"))
    every = variants.sparkSession.range(2 * n_samples).select(F.col("id").alias("alt_count"))
    return every.join(F.broadcast(by), "alt_count", "left").na.fill(0)


def indel_histogram(variants: DataFrame) -> DataFrame:
    """(length, n, percent): alternative minus reference length, 0 for single bases; ACGT alleles."""
    own = variants.select("ref", F.explode("alts").alias("alt")).where(F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT]+$") & ((F.length("ref") != F.length("alt")) | (F.length("ref") == 1)))
    by = own.groupBy((F.length("alt") - F.length("ref")).alias("length")).agg(F.count("*").alias("n"))
    return by.withColumn("percent", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))


def record_stats(variants: DataFrame, calls: DataFrame, n_samples: int) -> DataFrame:
    """(vid, num_called, call_rate, num_hom_ref, num_het, num_hom_alt, num_unknown, aaf, nucl_diversity, heterozygosity)"""
    g = genotype_counts(calls)
    per = chromosomes(calls).groupBy("vid", "allele").agg(F.count("*").alias("c")).groupBy("vid").agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("chr"), F.sum(F.when(F.col("allele") > 0, F.col("c")).otherwise(0)).alias("alt"))
    out = variants.select("vid").join(g, "vid", "left").join(per, "vid", "left").na.fill(0)
    p = ratio(F.col("alt"), F.col("chr"))
    return out.select(
        "vid", F.col("n").alias("num_called"), rounded(F.col("n") / n_samples).alias("call_rate"), F.col("hom_ref").alias("num_hom_ref"), F.col("het").alias("num_het"), F.col("hom_alt").alias("num_hom_alt"),
        (F.lit(n_samples) - F.col("n")).alias("num_unknown"), rounded(p).alias("aaf"), rounded(ratio(F.col("chr"), F.col("chr") - 1) * 2 * p * (1 - p)).alias("nucl_diversity"),
        rounded(1 - F.col("sq") / F.when(F.col("chr") > 0, F.col("chr") * F.col("chr"))).alias("heterozygosity"),
    )


def site_pi(calls: DataFrame) -> DataFrame:
    """(vid, pi): probability that two chromosomes of a site differ; complete diploid calls."""
    per = chromosomes(full(calls)).groupBy("vid", "allele").agg(F.count("*").alias("c")).groupBy("vid").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    return per.select("vid", rounded(ratio(F.col("n") * F.col("n") - F.col("sq"), F.col("n") * (F.col("n") - 1))).alias("pi"))


def fst_terms(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(vid, num, den) of the Weir-Cockerham estimator, alleles summed; complete diploid calls."""
    own = full(calls).join(samples, "sample")
    size = own.groupBy("vid", "pop").agg(F.count("*").alias("n"))
    alleles = own.select("vid", F.explode(F.array("a1", "a2")).alias("allele")).distinct()
    grid = size.join(alleles, "vid")
    got = own.select("vid", "pop", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("allele"), "a1", "a2").groupBy("vid", "pop", "allele").agg(
        F.sum((F.col("a1") == F.col("allele")).cast("int") + (F.col("a2") == F.col("allele")).cast("int")).alias("c"), F.count_if(F.col("a1") != F.col("a2")).alias("h"))
    cell = grid.join(got, ["vid", "pop", "allele"], "left").na.fill(0).select("vid", "allele", "n", (F.col("c") / (2 * F.col("n"))).alias("p"), (F.col("h") / F.col("n")).alias("h"))
    by = cell.groupBy("vid", "allele").agg(F.count("*").alias("r"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("p")).alias("np"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("npp"), F.sum(F.col("n") * F.col("h")).alias("nh"))
    r, s = F.col("r"), F.col("s")
    by = by.where("r > 1").withColumn("nbar", s / r).withColumn("pbar", F.col("np") / s).withColumn("hbar", F.col("nh") / s).withColumn("nc", (s - F.col("ss") / s) / (r - 1))
    nbar, pbar, hbar, nc = (F.col(c) for c in ("nbar", "pbar", "hbar", "nc"))
    var = (F.col("npp") - s * pbar * pbar) / ((r - 1) * nbar)
    w = pbar * (1 - pbar) - var * (r - 1) / r
    a = nbar / nc * (var - (w - hbar / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (w - hbar * (2 * nbar - 1) / (4 * nbar))
    c = hbar / 2
    return by.where("nbar > 1").select("vid", a.alias("a"), (a + b + c).alias("d")).groupBy("vid").agg(F.sum("a").alias("num"), F.sum("d").alias("den"))


def weir_fst(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(vid, fst), to ten digits, without negative zeros; null where the denominator is 0."""
    return fst_terms(calls, samples).select("vid", (F.round(F.when(F.abs("den") > 1e-12, F.col("num") / F.col("den")), 10) + 0.0).alias("fst"))
