"""Statistics along the genome: bins, sliding windows, runs and phase."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import sites as S
from helixframe.operators.ranges import bins, dealt, running_sums
from helixframe.operators.sites import ratio, rounded
from helixframe.sources.scratch import saved


def dense_bins(by_bin: DataFrame, counts: list[str], from_first: bool = True) -> DataFrame:
    """(chrom, bin, ...) with the empty bins between a chromosome's first (or 0) and last bin."""
    ends = by_bin.groupBy("chrom").agg((F.min("bin") if from_first else F.lit(0)).alias("a"), F.max("bin").alias("b"))
    every = ends.select("chrom", F.explode(F.sequence("a", F.col("b").cast(by_bin.schema["bin"].dataType) if from_first else F.col("b").cast("int"))).alias("bin"))
    return every.join(by_bin, ["chrom", "bin"], "left").na.fill(0, counts)


def snp_density(variants: DataFrame, width: int) -> DataFrame:
    """(chrom, start, n, per_kb) of distinct positions; leading empty bins are left out, inner ones kept."""
    by = variants.select("chrom", "pos").distinct().groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n"))
    return dense_bins(by, ["n"]).select("chrom", (F.col("bin") * width).alias("start"), "n", rounded(F.col("n") * 1000 / width).alias("per_kb"))


def tstv_bins(variants: DataFrame, width: int) -> DataFrame:
    """(chrom, start, n_snps, ratio): biallelic single bases; 0 without transversions; empty bins up to the last are kept."""
    alt = F.col("alts")[0]
    own = S.biallelic(variants).where(S.is_single(F.col("ref"), alt)).withColumn("ts", S.is_transition(F.col("ref"), alt))
    by = own.groupBy("chrom", F.floor(F.col("pos") / width).cast("int").alias("bin")).agg(F.count("*").alias("n_snps"), F.count_if("ts").alias("ts"), F.count_if(~F.col("ts")).alias("tv"))
    return dense_bins(by, ["n_snps", "ts", "tv"], False).select("chrom", (F.col("bin") * width).cast("long").alias("start"), "n_snps", rounded(F.coalesce(ratio(F.col("ts"), F.col("tv")), F.lit(0.0))).alias("ratio"))


def tstv_by_quality(variants: DataFrame) -> DataFrame:
    """(qual, ts_below, tv_below, ts_above, tv_above): strictly below and above each quality. Counts are summed per quality
    first, and then along ranges of qualities."""
    alt = F.col("alts")[0]
    own = S.biallelic(variants).where(S.is_single(F.col("ref"), alt) & F.col("qual").isNotNull()).withColumn("t", S.is_transition(F.col("ref"), alt))
    by = own.groupBy("qual").agg(F.count_if("t").alias("ts"), F.count_if(~F.col("t")).alias("tv"))
    return running_sums(by, "qual", ["ts", "tv"]).select("qual", "ts_below", "tv_below", "ts_above", "tv_above")


def tajima_d(variants: DataFrame, calls: DataFrame, width: int, n_samples: int) -> DataFrame:
    """(chrom, start, n_snps, d) of biallelic polymorphic sites; null for empty inner bins."""
    n = 2 * n_samples
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    f = S.chromosomes(calls.join(S.biallelic(variants).select("vid"), "vid")).groupBy("vid").agg(F.avg("allele").alias("p")).where("p > 0 and p < 1")
    by = f.join(variants.select("vid", "chrom", "pos"), "vid").groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n_snps"), F.sum(2 * F.col("p") * (1 - F.col("p")) * n / (n - 1)).alias("pi"))
    s = F.col("n_snps")
    d = ratio(F.col("pi") - s / a1, F.sqrt(e1 * s + e2 * s * (s - 1)))
    return dense_bins(by, ["n_snps"]).select("chrom", (F.col("bin") * width).alias("start"), "n_snps", F.round(F.when(s > 0, d), 5).alias("d"))


def window_numbers(pos: Column, size: int, step: int) -> Column:
    """The sliding windows [step*k + 1, step*k + size] that hold a position."""
    first = F.greatest(F.ceil((pos - size) / step), F.lit(0))
    return F.explode(F.sequence(first, F.ceil(pos / step) - 1))


def window_pi(variants: DataFrame, calls: DataFrame, size: int, step: int, n_samples: int) -> DataFrame:
    """(chrom, start, end, n_sites, pi): differing pairs over all pairs; bases without a site count as alike."""
    per = S.chromosomes(S.full(calls)).groupBy("vid", "allele").agg(F.count("*").alias("c")).groupBy("vid").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    own = per.join(variants.select("vid", "chrom", "pos"), "vid").select("chrom", window_numbers(F.col("pos"), size, step).alias("k"), (F.col("n") * F.col("n") - F.col("sq")).alias("differ"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))
    by = own.groupBy("chrom", "k").agg(F.count_if(F.col("differ") > 0).alias("n_sites"), F.sum("differ").alias("differ"), F.sum("pairs").alias("pairs"), F.count("*").alias("m"))
    whole = F.col("pairs") + (F.lit(size) - F.col("m")) * (2 * n_samples) * (2 * n_samples - 1)
    return by.where("n_sites > 0").select("chrom", (F.col("k") * step + 1).alias("start"), (F.col("k") * step + size).alias("end"), "n_sites", F.round(F.col("differ") / whole, 8).alias("pi"))


def window_fst(variants: DataFrame, calls: DataFrame, samples: DataFrame, size: int, step: int) -> DataFrame:
    """(chrom, start, n_sites, weighted, mean)"""
    t = S.fst_terms(calls, samples).where(F.abs("den") > 1e-12).join(variants.select("vid", "chrom", "pos"), "vid")
    by = t.select("chrom", window_numbers(F.col("pos"), size, step).alias("k"), "num", "den").groupBy("chrom", "k").agg(F.count("*").alias("n_sites"), rounded(ratio(F.sum("num"), F.sum("den"))).alias("weighted"), rounded(F.avg(F.col("num") / F.col("den"))).alias("mean"))
    return by.select("chrom", (F.col("k") * step + 1).alias("start"), "n_sites", "weighted", "mean")


def switch_errors(left: DataFrame, right: DataFrame, variants: DataFrame) -> DataFrame:
    """(sample, n_het, n_switch): consecutive common phased heterozygous sites where the pairing of haplotypes flips."""
    het = lambda c: c.where("phased and a1 <> a2")
    own = het(left).join(het(right).select("vid", "sample", F.col("a1").alias("b1"), F.col("a2").alias("b2")), ["vid", "sample"]).where("(a1 = b1 and a2 = b2) or (a1 = b2 and a2 = b1)")
    own = own.join(variants.select("vid", "chrom", "pos"), "vid").withColumn("same", F.col("a1") == F.col("b1"))
    flip = F.col("same") != F.lag("same").over(Window.partitionBy("sample", "chrom").orderBy("pos", "vid"))
    return own.withColumn("flip", flip).groupBy("sample").agg(F.count("*").alias("n_het"), F.count_if("flip").alias("n_switch"))


def phase_join(calls: DataFrame, chunks: DataFrame, least_quality: float = 10.0, least_pq: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Joins phased chunks that overlap. calls: sample, chunk, chrom, pos, a1, a2, phased (pq with least_pq); chunks: chunk,
    chrom, rank. Positions are once in a chunk, and at most two chunks share one.

    At a position that two chunks share, p is the share of samples whose genotypes differ, at least 1/n and at most 1 - 1/n (1/4
    for one sample). A sample that is phased and heterozygous in both, with the same alleles, matches with likelihood
    p^2 + (1 - p)^2 and is crossed with 2 p (1 - p), or the other way round. The later chunk is turned over if crossing is
    likelier; turns add up along a chromosome. Without such a position both likelihoods are 1/2, and nothing is turned. A new
    phase set begins where quality, the difference of their log10, is below least_quality; and, with least_pq, at a call
    outside overlaps whose pq is below that.

    Returns (sample, chrom, rank, n_sites, lk_match, lk_mismatch, quality, swapped), a row per sample and chunk but a
    chromosome's first; and the joined calls (sample, chrom, pos, a1, a2, phased, ps): where chunks overlap, the call of the
    chunk whose end is farther off; ps is the first position of the phase set."""
    pq = F.col("pq").cast("double") if "pq" in calls.columns else F.lit(None).cast("double")
    own = calls.select("sample", "chunk", "pos", "a1", "a2", F.coalesce("phased", F.lit(False)).alias("phased"), pq.alias("pq")).join(chunks.select("chunk", "chrom", "rank"), "chunk").drop("chunk")
    w = Window.partitionBy("chrom").orderBy("rank")
    follows = chunks.select("chrom", "rank").distinct().withColumn("before", F.lag("rank").over(w)).where("before is not null")
    # Calls at positions of two chunks; equal ones of a sample there are one row with their number, so that no row is made for each
    # two of them where sites share a position.
    spots = own.groupBy("chrom", "pos").agg(F.min("rank").alias("before"), F.max("rank").alias("next")).where("before < next").join(follows.withColumnRenamed("rank", "next"), ["chrom", "next", "before"])
    at = ["sample", "chrom", "pos", "next"]
    near = own.join(spots, ["chrom", "pos"]).where("rank = before or rank = next").repartition(*at)
    kinds = lambda of, a, b: near.where(F.col("rank") == F.col(of)).groupBy(*at, F.col("a1").alias(f"{a}1"), F.col("a2").alias(f"{a}2"), F.col("phased").alias(b)).agg(F.count("*").alias(f"{a}_n"))
    a1, a2, b1, b2 = F.col("a1"), F.coalesce("a2", "a1"), F.col("b1"), F.coalesce("b2", "b1")
    same, cross = a1.eqNullSafe(b1) & a2.eqNullSafe(b2), a1.eqNullSafe(b2) & a2.eqNullSafe(b1)
    times = F.col("a_n") * F.col("b_n")
    tells = F.col("phased") & F.col("b_phased") & (a1 != a2) & (b1 != b2)
    total = lambda which, name: F.coalesce(F.sum(F.when(which, times)), F.lit(0)).alias(name)
    shared = kinds("next", "a", "phased").join(kinds("before", "b", "b_phased"), at).groupBy(*at).agg(F.sum(times).alias("n"), total(~(same | cross), "wrong"), total(tells & same, "n_same"), total(tells & cross & ~same, "n_cross"))
    shared = saved(shared.withColumnRenamed("next", "rank"), "shared")
    n, wrong = F.sum("n"), F.sum("wrong")
    places = shared.groupBy("chrom", "rank", "pos").agg(F.when(n == 1, F.lit(0.25)).otherwise(F.least(F.greatest(wrong / n, 1 / n), 1 - 1 / n)).alias("p"))
    ends = places.groupBy("chrom", "rank").agg(F.min("pos").alias("from"), F.max("pos").alias("to"))
    told = shared.where("n_same + n_cross > 0").join(places, ["chrom", "rank", "pos"])
    p, n_same, n_cross = F.col("p"), F.col("n_same"), F.col("n_cross")
    alike, unlike = F.log10(p * p + (1 - p) * (1 - p)), F.log10(2 * p * (1 - p))
    sums = told.groupBy("sample", "chrom", "rank").agg(F.sum(n_same + n_cross).alias("n_sites"), F.sum(n_same * alike + n_cross * unlike).alias("m"), F.sum(n_same * unlike + n_cross * alike).alias("x"))
    half = F.lit(math.log10(0.5))
    every = own.select("sample", "chrom", "rank").distinct().join(follows.select("chrom", "rank"), ["chrom", "rank"]).join(sums, ["sample", "chrom", "rank"], "left")
    every = every.select("sample", "chrom", "rank", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("m", half).alias("m"), F.coalesce("x", half).alias("x"))
    along = Window.partitionBy("sample", "chrom").orderBy("rank")
    turned = F.sum((F.col("x") - F.col("m") > 1e-9).cast("int")).over(along) % 2 == 1
    told_of = every.select("sample", "chrom", "rank", "n_sites", F.col("m").alias("lk_match"), F.col("x").alias("lk_mismatch"), F.abs(F.col("m") - F.col("x")).alias("quality"), turned.alias("swapped"))

    # Of two calls at a shared position the one whose chunk's overlap ends, or began, farther off.
    earlier = F.col("to") - F.col("pos") > F.col("pos") - F.col("from")
    lost = places.join(ends, ["chrom", "rank"]).join(follows, ["chrom", "rank"]).select("chrom", "pos", F.when(earlier, F.col("rank")).otherwise(F.col("before")).alias("rank"))
    kept = own.join(lost, ["chrom", "pos", "rank"], "left_anti")
    # Breaks inside a chunk are numbered there; the numbers of the chunks before are added.
    if least_pq is None:
        kept = kept.withColumn("breaks", F.lit(0).cast("long"))
    else:
        inside = places.select("chrom", "pos").distinct().withColumn("shared", F.lit(True))
        weak = F.col("shared").isNull() & F.coalesce(F.col("pq") < least_pq, F.lit(False))
        kept = kept.join(inside, ["chrom", "pos"], "left").withColumn("breaks", F.sum(weak.cast("int")).over(Window.partitionBy("sample", "chrom", "rank").orderBy("pos")))
    # What lies between two breaks is a row until its phase set is known.
    cells = kept.groupBy("sample", "chrom", "rank", "breaks").agg(F.min("pos").alias("first"))
    per = cells.groupBy("sample", "chrom", "rank").agg(F.max("breaks").alias("inner")).join(told_of.select("sample", "chrom", "rank", "swapped", "quality"), ["sample", "chrom", "rank"], "left")
    new = F.coalesce(F.col("quality") < least_quality, F.lit(False)).cast("int")
    start = per.select("sample", "chrom", "rank", "swapped", (F.sum(F.col("inner") + new).over(along) - F.col("inner")).alias("base"))
    ps = F.min("first").over(Window.partitionBy("sample", "chrom", F.col("base") + F.col("breaks")))
    sets = cells.join(start, ["sample", "chrom", "rank"]).select("sample", "chrom", "rank", "breaks", "swapped", ps.alias("ps"))
    turn = F.coalesce("swapped", F.lit(False)) & F.col("a2").isNotNull()
    joined = kept.join(sets, ["sample", "chrom", "rank", "breaks"]).select("sample", "chrom", "pos", F.when(turn, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(turn, F.col("a1")).otherwise(F.col("a2")).alias("a2"), "phased", "ps")
    return told_of, joined


def _haplotypes(pos: np.ndarray, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of sites in the order of their places: a row per chromosome with its allele at each site, in the order of alleles where
    sites share a place, and how many sites before each, and before the end, lack the chromosome's."""
    a = np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32).reshape(len(pos), -1)
    rank = np.unique(pos, return_inverse=True)[1]
    codes = np.sort((rank[:, None].astype(np.int64) << 32) + a, axis=0).astype(np.uint32).T
    return np.ascontiguousarray(codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes), np.vstack([np.zeros((1, a.shape[1]), np.int64), np.cumsum(a == ord("."), axis=0)])


def _spectrum(codes: np.ndarray, missing: np.ndarray, i: int, j: int) -> tuple[int, int, str] | None:
    """(n_snp, n_unique, spectrum) of the sites from i to j, none if every chromosome lacks one."""
    times = Counter(codes[k, i:j].tobytes() for k in np.flatnonzero(missing[i] == missing[j]).tolist())
    of = Counter(times.values())
    return (j - i, len(times), ",".join(f"{m}:{of[m]}" for m in sorted(of))) if times else None


def haplotype_counts(variants: DataFrame, calls: DataFrame, bed: DataFrame, width: int = 8192) -> DataFrame:
    """(iid, n_snp, n_unique, spectrum): haplotypes of phased samples over the sites in a bin; spectrum: multiplicity:number.

    A site's calls are one text, a letter per chromosome. Sites and places, one for all bins that are equal, meet by stretches of
    `width` bases, so that no row exists for a place and a site; only a place that goes beyond a stretch takes its sites' texts
    along, a piece per stretch."""
    # Calls are made once, for the samples' numbers and for their letters.
    whole = saved(calls.where("phased and a1 is not null and a2 is not null").select("vid", "sample", "a1", "a2"), "calls")
    number = whole.select("sample").distinct().select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("k"))  # of a study's people
    n = number.count()
    letter = lambda c: F.call_function("char", 48 + F.col(c))
    texts = whole.join(number, "sample").groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("k", F.concat(letter("a1"), letter("a2"))))).alias("m"))
    texts = texts.select("vid", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: F.coalesce(F.try_element_at("m", i - 1), F.lit(".."))), "").alias("letters"))
    points = S.biallelic(variants).select("vid", "chrom", "pos").join(texts, "vid", "left").fillna(".." * max(n, 1), ["letters"])
    points = points.where("chrom is not null").select("chrom", F.col("pos").cast("long").alias("pos"), "letters", F.explode(bins(F.col("pos"), F.col("pos") + 1, width)).alias("stretch"))
    places = bed.select(F.col("chrom").alias("b_chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("b_end")).where("b_chrom is not null").distinct()
    places = places.withColumn("stretch", F.explode(bins(F.col("start"), F.col("b_end"), width)))
    columns = ["b_chrom", "start", "b_end", "n_snp", "n_unique", "spectrum", "pos", "letters"]

    def meet(key: tuple, sites: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sites) and len(asked):
            sites = sites.sort_values("pos", kind="stable")
            pos, letters = sites["pos"].to_numpy(), sites["letters"].tolist()
            codes, missing = _haplotypes(pos, letters)
            begins, ends = np.searchsorted(pos, asked["start"].to_numpy()).tolist(), np.searchsorted(pos, asked["b_end"].to_numpy()).tolist()
            low, high = key[1] * width, (key[1] + 1) * width
            for chrom, start, end, i, j in zip(asked["b_chrom"], asked["start"].tolist(), asked["b_end"].tolist(), begins, ends, strict=True):
                if i >= j:
                    continue
                if start < low or end > high:
                    out.append((chrom, start, end, None, None, None, pos[i:j], "".join(letters[i:j])))
                elif got := _spectrum(codes, missing, i, j):
                    out.append((chrom, start, end, *got, None, None))
        return pd.DataFrame(out, columns=columns).astype({"n_snp": "Int64", "n_unique": "Int64"})

    schema = "b_chrom string, start long, b_end long, n_snp long, n_unique long, spectrum string, pos array<long>, letters string"
    met = dealt(points, "chrom", "stretch").groupBy("chrom", "stretch").cogroup(dealt(places, "b_chrom", "stretch").groupBy("b_chrom", "stretch")).applyInPandas(meet, schema)
    piece = F.when(F.col("letters").isNotNull(), F.struct("pos", "letters"))
    by = met.groupBy("b_chrom", "start", "b_end").agg(*[F.max(c).alias(c) for c in ("n_snp", "n_unique", "spectrum")], F.array_sort(F.collect_list(piece)).alias("s"))
    rows = by.select("b_chrom", "start", "b_end", "n_snp", "n_unique", "spectrum", F.flatten("s.pos").alias("pos"), F.array_join("s.letters", "").alias("letters"))

    def spectra(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for *place, n_snp, n_unique, spectrum, pos, letters in part.itertuples(index=False):
                if spectrum is not None:
                    out.append((*place, int(n_snp), int(n_unique), spectrum))
                    continue
                each = len(letters) // len(pos)
                codes, missing = _haplotypes(np.asarray(pos), [letters[k : k + each] for k in range(0, len(letters), each)])
                if got := _spectrum(codes, missing, 0, len(pos)):
                    out.append((*place, *got))
            yield pd.DataFrame(out, columns=columns[:6])

    found = rows.mapInPandas(spectra, "b_chrom string, start long, b_end long, n_snp long, n_unique long, spectrum string")
    return bed.join(found, (F.col("chrom") == F.col("b_chrom")) & (bed["start"] == found["start"]) & (F.col("end") == F.col("b_end"))).select("iid", "n_snp", "n_unique", "spectrum")
