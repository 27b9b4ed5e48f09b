"""Autozygous runs: a two-state hidden Markov chain along each chromosome, as an associative scan over bins.

The forward-backward sums of a stretch of sites are a product of 2 x 2 matrices, so:

1. each bin of a chromosome makes one matrix per sample, the product of its sites' steps and emissions from the bin's left
   edge to its right one, for a block of samples at once;
2. the bins' products are combined along the chromosome, forwards and backwards: a row per bin and block, of which a genome
   has some thousands;
3. each bin, entered from both sides, has its sites' posteriors;
4. runs that reach a bin's last site are joined to those that begin at the next bin's first.

A step over a distance is semigroup: two steps are one over both distances, and a site where a sample has no call is a
factor of one. So edges of bins and absent calls change nothing, and results do not depend on bins or blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import sites as S
from helixframe.operators.gram import numbered_samples
from helixframe.sources.scratch import saved


class Chain:
    """State 1 is autozygous. Chains start in the states' lasting shares, and go back to them at `rate` per base."""

    def __init__(self, prior: float, rate: float, error: float):
        self.share, self.rate, self.error = np.array([1 - prior, prior]), rate, error

    def step(self, distance: float) -> np.ndarray:
        stay = np.exp(-self.rate * distance)
        return stay * np.eye(2) + (1 - stay) * self.share[None, :]

    def emission(self, het: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(sites, samples, 2); het: 1, 0, or -1 without a call."""
        h = (2 * p * (1 - p))[:, None]
        out = np.ones((*het.shape, 2))
        for state, x in ((0, np.broadcast_to(h, het.shape)), (1, np.full(het.shape, self.error))):
            out[..., state] = np.where(het == 1, x, np.where(het == 0, 1 - x, 1.0))
        return out


def _bin_sites(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples, positions, p, het as a matrix of sites by samples) of a bin and a block of samples."""
    samples, column = np.unique(part["sample"].to_numpy(), return_inverse=True)
    places, row = np.unique(np.stack([part["pos"].to_numpy(), part["vid"].to_numpy()]), axis=1, return_inverse=True)
    row = row.ravel()
    p = np.empty(places.shape[1])
    p[row] = part["p"].to_numpy()
    het = np.full((places.shape[1], len(samples)), -1, np.int8)
    het[row, column] = part["het"].to_numpy()
    return samples, places[0], p, het


def narrowed(sites: DataFrame, width: int, most: int) -> int:
    """width, or as much less that no bin of a chromosome's positions has more than `most` sites; 1 at least."""
    while True:
        n = sites.groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if n <= most or width == 1:
            return width
        width = max(1, width // -(-n // most))


def autozygous_runs(
    variants: DataFrame, calls: DataFrame, error: float = 0.01, prior: float = 0.05, threshold: float = 0.99, generations: int = 4, per_base: float = 1e-8, bin_width: int = 1_000_000, block: int = 64, bin_sites: int = 10_000,
) -> DataFrame:
    """(sample, chrom, start, end, n_sites): stretches of a sample's sites whose posterior of being autozygous exceeds the
    threshold. Sites of one position are in the order of their vid. Bins are narrower than bin_width where sites are dense, so
    that none has more than bin_sites, but of one position."""
    bin_width = narrowed(S.biallelic(variants), bin_width, bin_sites)
    chain = Chain(prior, 2 * generations * per_base, error)
    f = S.chromosomes(calls).groupBy("vid").agg(F.avg((F.col("allele") > 0).cast("int")).alias("p")).where("p > 0 and p < 1")
    number = saved(numbered_samples(calls), "samples")
    own = S.full(calls).join(number, "sample").join(S.biallelic(variants).select("vid", "chrom", "pos"), "vid").join(f, "vid")
    own = own.select("vid", F.col("k").cast("long").alias("sample"), "chrom", F.col("pos").cast("long").alias("pos"), "p", (F.col("a1") != F.col("a2")).cast("int").alias("het"))
    own = saved(own.withColumn("bin", F.floor(F.col("pos") / bin_width)).withColumn("block", F.floor(F.col("sample") / block)), "sites")
    keys = ["chrom", "bin", "block"]

    def product(part: pd.DataFrame) -> pd.DataFrame:
        samples, pos, p, het = _bin_sites(part)
        emit = chain.emission(het, p)
        at = float(part["bin"].iloc[0]) * bin_width
        m = np.broadcast_to(np.eye(2), (len(samples), 2, 2))
        for i in range(len(pos)):
            m = (m @ chain.step(pos[i] - at)) * emit[i][:, None, :]
            m = m / m.max((1, 2), keepdims=True)
            at = pos[i]
        m = m @ chain.step((float(part["bin"].iloc[0]) + 1) * bin_width - at)
        return pd.DataFrame({**{k: part[k].iloc[:1] for k in keys}, "samples": [samples.tobytes()], "m": [np.ascontiguousarray(m).tobytes()]})

    products = own.groupBy(*keys).applyInPandas(product, "chrom string, bin long, block long, samples binary, m binary")

    def along(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        every = [np.frombuffer(x, np.int64) for x in part["samples"]]
        m = [np.frombuffer(x, np.float64).reshape(-1, 2, 2) for x in part["m"]]
        bins = part["bin"].tolist()
        names = np.unique(np.concatenate(every))
        where = [np.searchsorted(names, x) for x in every]
        left, right = [], [np.empty(0)] * len(bins)
        v, at = np.tile(chain.share, (len(names), 1)), bins[0]
        for b, x, k in zip(bins, m, where, strict=True):
            v = v @ chain.step(float(b - at) * bin_width)
            left.append(v[k].tobytes())
            v, at = v @ chain.step(bin_width), b + 1
            v[k] = np.einsum("si,sij->sj", np.frombuffer(left[-1], np.float64).reshape(-1, 2), x)
            v /= v.sum(1, keepdims=True)
        v, at = np.ones((len(names), 2)), bins[-1] + 1
        for i in range(len(bins) - 1, -1, -1):
            v = v @ chain.step(float(at - bins[i] - 1) * bin_width).T
            right[i] = v[where[i]]
            v, at = v @ chain.step(bin_width).T, bins[i]
            v[where[i]] = np.einsum("sij,sj->si", m[i], right[i])
            v /= v.sum(1, keepdims=True)
        return pd.DataFrame({"chrom": part["chrom"], "bin": bins, "block": part["block"], "samples": part["samples"], "before": left, "after": [x.tobytes() for x in right]})

    entered = products.groupBy("chrom", "block").applyInPandas(along, "chrom string, bin long, block long, samples binary, before binary, after binary")

    def posteriors(part: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        samples, pos, p, het = _bin_sites(part)
        emit, n = chain.emission(het, p), len(pos)
        edge = float(part["bin"].iloc[0]) * bin_width
        v = np.frombuffer(ends["before"].iloc[0], np.float64).reshape(-1, 2)
        forward, at = np.empty((n, len(samples), 2)), edge
        for i in range(n):
            v = v @ chain.step(pos[i] - at) * emit[i]
            v = forward[i] = v / v.sum(1, keepdims=True)
            at = pos[i]
        v, at = np.frombuffer(ends["after"].iloc[0], np.float64).reshape(-1, 2), edge + bin_width
        inside = np.empty((n, len(samples)), bool)
        for i in range(n - 1, -1, -1):
            v = v @ chain.step(at - pos[i]).T
            both = forward[i] * v
            inside[i] = both[:, 1] / both.sum(1) > threshold
            v = emit[i] * v
            v, at = v / v.sum(1, keepdims=True), pos[i]
        rows = []
        for k, sample in enumerate(samples.tolist()):
            own_sites = np.flatnonzero(het[:, k] >= 0)
            flags = inside[own_sites, k]
            turn = np.diff(np.r_[0, flags.astype(int), 0])
            a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
            rows += [(sample, pos[own_sites[i]], pos[own_sites[j]], j - i + 1, i == 0, j == len(flags) - 1) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            if not (flags[0] or flags[-1]):  # what ends before this bin can't go on after it
                rows.append((sample, pos[own_sites[0]], None, 0, False, False))
        out = pd.DataFrame(rows, columns=["sample", "start", "end", "n_sites", "goes_on", "reaches"])
        out.insert(0, "bin", part["bin"].iloc[0])
        out.insert(0, "chrom", part["chrom"].iloc[0])
        return out

    pieces = own.groupBy(*keys).cogroup(entered.groupBy(*keys)).applyInPandas(posteriors, "chrom string, bin long, sample long, start long, end long, n_sites long, goes_on boolean, reaches boolean")
    pieces = saved(pieces, "runs")
    border = "goes_on or reaches or end is null"
    w = Window.partitionBy("sample", "chrom").orderBy("bin", "start", F.col("end").asc_nulls_first())
    joined = F.col("goes_on") & F.coalesce(F.lag("reaches").over(w), F.lit(False))
    runs = pieces.where(border).withColumn("new", (~joined).cast("int")).withColumn("run", F.sum("new").over(w)).where("end is not null")
    runs = runs.groupBy("sample", "chrom", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_sites").alias("n_sites")).drop("run")
    whole = pieces.where(f"not ({border})").select("sample", "chrom", "start", "end", "n_sites").union(runs.select("sample", "chrom", "start", "end", "n_sites"))
    return whole.withColumnRenamed("sample", "k").join(number, "k").select("sample", "chrom", "start", "end", "n_sites")
