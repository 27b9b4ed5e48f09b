"""Sums over sites of products between samples, as blocked matrix products.

A site is one row with the samples that have a call and their dosages. A task packs its sites, some hundred at a time, into
matrices of sites by samples and multiplies them once, block of samples by block of samples: X' Y for each sum that is
asked for, missing calls as zeros of masks. So there is no row for a site and a pair of samples; a task sends each block
once, and blocks are added up in rounds of `fan_in`, so that no group holds more than so many. Pairs of blocks are taken
`pairs_at_once` in a pass, which bounds what a task holds, however many samples there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.scratch import saved

#: From dosages, a row per site, -1 where missing, to the matrices whose products are summed, by the sum's name.
Factors = Callable[[np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]


def numbered_samples(calls: DataFrame) -> DataFrame:
    """(sample, k): the samples, which are the people of a study, numbered from 0 in their order."""
    return calls.select("sample").distinct().select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("k"))


def dosage_rows(variants: DataFrame, calls: DataFrame, number: DataFrame) -> DataFrame:
    """(vid, ks, xs): the samples with a complete call of a biallelic site, and how many alternative alleles they have."""
    own = calls.where("a1 <= 1 and a2 <= 1").join(variants.where(F.size("alts") == 1).select("vid"), "vid").join(number, "sample")
    pair = F.collect_list(F.struct("k", (F.col("a1") + F.col("a2")).cast("int").alias("x")))
    return own.groupBy("vid").agg(pair.alias("c")).select("vid", F.col("c.k").alias("ks"), F.col("c.x").alias("xs"))


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    ks, xs = batch.column(0), batch.column(1)
    counts = np.diff(ks.offsets.to_numpy())
    out = np.full((batch.num_rows, n), -1, np.int8)
    out[np.repeat(np.arange(batch.num_rows), counts), ks.flatten().to_numpy()] = xs.flatten().to_numpy()
    return out


def block_sums(rows: DataFrame, n: int, names: list[str], factors: Factors, block: int = 512, pairs_at_once: int = 64, sites_at_once: int = 1024, fan_in: int = 32) -> DataFrame:
    """(bi, bj, data), bi <= bj: the sums of all sites for each pair of blocks of samples; data: one matrix of doubles for each
    name, one after the other, row by row."""
    blocks = max(1, -(-n // block))
    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    passes = None
    for at in range(0, len(pairs), pairs_at_once):
        own = pairs[at : at + pairs_at_once]

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k in range(0, batch.num_rows, sites_at_once):
                    made = factors(_matrix(batch.slice(k, sites_at_once), n))
                    for i, j in own:
                        got = np.array([made[x][0][:, i * block : (i + 1) * block].T @ made[x][1][:, j * block : (j + 1) * block] for x in names], np.float64)
                        total[i, j] = total[i, j] + got if (i, j) in total else got
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in total], pa.int32()), pa.array([j for _, j in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["bi", "bj", "data"])

        one = rows.select("ks", "xs").mapInArrow(run, "bi int, bj int, data binary")
        passes = one if passes is None else passes.union(one)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["data"].iloc[0]) // 8)
        for data in group["data"]:
            total += np.frombuffer(data, np.float64)
        return pd.DataFrame({"bi": group["bi"].iloc[:1], "bj": group["bj"].iloc[:1], "part": group["part"].iloc[:1], "data": [total.tobytes()]})

    out = saved(passes.withColumn("part", F.spark_partition_id()), "blocks")
    most = out.agg(F.max("part")).first()[0] or 0
    while most > 0:
        most //= fan_in
        out = out.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).groupBy("bi", "bj", "part").applyInPandas(add, "bi int, bj int, part int, data binary")
    return out.groupBy("bi", "bj", "part").applyInPandas(add, "bi int, bj int, part int, data binary").select("bi", "bj", "data")


def pair_rows(sums: DataFrame, n: int, names: list[str], some: str, block: int = 512) -> DataFrame:
    """(i, j, ...), i <= j: the sums of each pair of samples for which the sum named `some` is over 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(data, np.float64).reshape(len(names), min(block, n - bi * block), -1)
                a, b = np.nonzero(x[names.index(some)] > 0)
                keep = a + bi * block <= b + bj * block
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a + bi * block), pa.array(b + bj * block), *(pa.array(x[k][a, b]) for k in range(len(names)))], ["i", "j", *names])

    return sums.mapInArrow(run, "i long, j long, " + ", ".join(f"{x} double" for x in names))


def sample_sums(variants: DataFrame, calls: DataFrame, names: list[str], factors: Factors, some: str, **how) -> DataFrame:
    """(sample, sample2, ...), sample <= sample2: sums over sites of products of the pair's factors."""
    number = saved(numbered_samples(calls), "samples")
    n = number.count()
    sums = block_sums(dosage_rows(variants, calls, number), n, names, factors, **how)
    pairs = pair_rows(sums, n, names, some, **{k: v for k, v in how.items() if k == "block"})
    first, second = number.select("sample", F.col("k").alias("i")), number.select(F.col("sample").alias("sample2"), F.col("k").alias("j"))
    return pairs.join(first, "i").join(second, "j").select("sample", "sample2", *names)


# The factors.


def king_factors(x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    ref, het, alt, called = ((x == 0).astype(np.float32), (x == 1).astype(np.float32), (x == 2).astype(np.float32), (x >= 0).astype(np.float32))
    return {"het_het": (het, het), "ref_alt": (ref, alt), "alt_ref": (alt, ref), "hets": (het, called), "hets2": (called, het), "both": (called, called)}


def yang_factors(x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of polymorphic sites. own and one: (own, one) is what the diagonal sums up, for each sample with itself."""
    called = x >= 0
    dosage = np.where(called, x, 0).astype(np.float64)
    f = dosage.sum(1) / np.maximum(2 * called.sum(1), 1)
    good = (f > 0) & (f < 1)
    called, dosage, f = called[good], dosage[good], f[good][:, None]
    v = 2 * f * (1 - f)
    z = np.where(called, (dosage - 2 * f) / np.sqrt(v), 0)
    own = np.where(called, (dosage * dosage - (1 + 2 * f) * dosage + 2 * f * f) / v, 0)
    mask = called.astype(np.float64)
    return {"product": (z, z), "own": (own, mask), "both": (mask, mask)}


def centred_factors(normalise: bool) -> Factors:
    """Of polymorphic sites: dosages less their mean, missing ones at the mean; sites counts the sites, in each entry."""

    def make(x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        called = x >= 0
        dosage = np.where(called, x, 0).astype(np.float64)
        m = dosage.sum(1) / np.maximum(called.sum(1), 1)
        good = (m > 0) & (m < 2)
        called, dosage, m = called[good], dosage[good], m[good][:, None]
        scale = np.sqrt(m / 2 * (1 - m / 2)) if normalise else 1.0
        z = np.where(called, (dosage - m) / scale, 0)
        mask, ones = called.astype(np.float64), np.ones(called.shape)
        return {"product": (z, z), "both": (mask, mask), "sites": (ones, ones)}

    return make
