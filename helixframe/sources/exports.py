"""Calls as text for other programs, a line per row. Rows are calls joined with their sites (with_alleles): vid, chrom, pos,
id, alleles, sample, a1, a2, phased. A call is haploid if it is phased and lacks its second allele. Sites of one position follow
one another by vid, in all samples alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.variants import iupac
from helixframe.sources.vcf import base_of, ordered_join


def with_alleles(variants: DataFrame, calls: DataFrame) -> DataFrame:
    return calls.join(variants.select("vid", "chrom", "pos", "id", F.concat(F.array("ref"), "alts").alias("alleles")), "vid")


def _letters() -> Column:
    """Both bases, '0' if missing; a haploid call has its base twice."""
    second = F.when(F.col("a2").isNull() & F.coalesce("phased", F.lit(False)), base_of("a1")).otherwise(base_of("a2"))
    return F.concat_ws(" ", base_of("a1"), second)


def _place() -> tuple[Column, Column]:
    """The chromosome by PLINK's numbers and letters, else 0, and the id, else chrom:pos."""
    number = F.regexp_replace("chrom", "^chr", "")
    known = number.rlike(r"^\d+$") | number.isin("X", "Y", "XY", "MT", "M")
    return F.when(known, number).otherwise("0"), F.coalesce("id", F.concat("chrom", F.lit(":"), F.col("pos").cast("string")))


def plink_family(samples: DataFrame) -> DataFrame:
    """(sample, line) of a TFAM file; a PED line begins so."""
    name = F.col("sample").cast("string")
    return samples.select("sample", F.concat_ws("\t", name, name, *[F.lit("0")] * 4).alias("line"))


def plink_ped(rows: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(sample, chrom, bin, line): a sample's PED line in pieces, one for `width` bases of a chromosome, so that no row or group
    holds a whole line, which is as long as there are sites. Joined by tabs in the order of chrom and bin, behind the line of
    plink_family(), they are the line; whole_lines() joins those that are short enough. plink_tped() has a line per site."""
    return rows.groupBy("sample", "chrom", F.floor(F.col("pos") / width).alias("bin")).agg(ordered_join(_letters(), ["pos", "vid"], "\t").alias("line"))


def whole_lines(pieces: DataFrame, columns: dict[str, str], begin: DataFrame | None = None) -> DataFrame:
    """A row per sample of pieces (sample, chrom, bin, ...): each column joined by what `columns` says, behind the line of `begin`
    (sample, line). For lines that fit into a row."""
    out = pieces.groupBy("sample").agg(*[ordered_join(F.col(c), ["chrom", "bin"], sep).alias(c) for c, sep in columns.items()])
    return out if begin is None else begin.withColumnRenamed("line", "__begin").join(out, "sample").select("sample", F.concat_ws("\t", "__begin", "line").alias("line"))


def plink_map(variants: DataFrame) -> DataFrame:
    """(vid, line): chromosome, id, no distance, position."""
    return variants.select("vid", F.concat_ws("\t", *_place(), F.lit("0"), F.col("pos").cast("string")).alias("line"))


def plink_tped(rows: DataFrame) -> DataFrame:
    """(vid, line): the columns of a MAP line and the calls of all samples."""
    got = rows.groupBy("vid", "chrom", "pos", "id").agg(ordered_join(_letters(), ["sample"], " ").alias("cells"))
    return got.select("vid", F.concat_ws(" ", *_place(), F.lit("0"), F.col("pos").cast("string"), "cells").alias("line"))


def impute(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(vid, hap, legend) of biallelic sites whose calls are all complete and phased."""
    own = calls.join(variants.where(F.size("alts") == 1).select("vid"), "vid")
    ok = F.bool_and(F.col("phased") & F.col("a1").isNotNull() & F.col("a2").isNotNull())
    hap = own.groupBy("vid").agg(ordered_join(F.concat_ws(" ", F.col("a1").cast("string"), F.col("a2").cast("string")), ["sample"], " ").alias("hap"), ok.alias("ok")).where("ok")
    pos = F.col("pos").cast("string")
    return hap.join(variants, "vid").select("vid", "hap", F.concat_ws(" ", F.coalesce("id", F.concat("chrom", F.lit("-"), pos)), pos, "ref", F.col("alts")[0]).alias("legend"))


def vcf_tab(rows: DataFrame, ambiguity: bool = False) -> DataFrame:
    """(vid, line): a call per sample as a/b, '.' if missing; with ambiguity two single bases as their IUPAC letter."""
    a, b = base_of("a1", "."), base_of("a2", ".")
    cell = F.concat_ws("/", a, b)
    return rows.groupBy("vid").agg(ordered_join(F.coalesce(iupac(a, b), cell) if ambiguity else cell, ["sample"], "\t").alias("line"))


RESIDUE = ["structid", "chain", "seqid"]


def residue_attribute(rows: DataFrame, value: Column, fold: bool = False) -> DataFrame:
    """(structid, chain, seqid, value): the greatest value of each residue; with fold a frequency above 0.5 is that of the
    other allele."""
    folded = F.when(value > 0.5, F.round(1 - value, 6)).otherwise(value) if fold else value
    return rows.withColumn("value", folded).groupBy(*RESIDUE).agg(F.max("value").alias("value"))


def attribute_range(attribute: DataFrame) -> DataFrame:
    """(structid, least, greatest) of a residue attribute, values of -1 and less left out of the least."""
    return attribute.groupBy("structid").agg(F.min(F.when(F.col("value") > -1, F.col("value"))).alias("least"), F.max("value").alias("greatest"))


def scores_json(scores: DataFrame) -> DataFrame:
    """(structid, chain, json) of (structid, chain, seqid, score): an object of residues, in their order, with their score."""
    every = F.array_sort(F.collect_list(F.struct("seqid", "score")))  # a chain's residues
    entries = F.transform(every, lambda x: F.struct(x["seqid"].cast("string").alias("key"), F.struct(x["score"].alias("score")).alias("value")))
    return scores.groupBy("structid", "chain").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def ldhat(variants: DataFrame, calls: DataFrame, phased: bool, width: int = 1_000_000) -> DataFrame:
    """(sample, chrom, bin, sites, locs) over the biallelic sites of `width` bases: the first allele of each call, or, unphased,
    2 for unlike alleles; ? if missing; places in kilobases. whole_lines() joins short ones: sites without, locs with commas."""
    own = calls.join(variants.where(F.size("alts") == 1).select("vid", "chrom", "pos"), "vid")
    code = F.col("a1").cast("string") if phased else F.when(F.col("a1") != F.col("a2"), "2").when(F.col("a1") == F.col("a2"), F.col("a1").cast("string"))
    return own.groupBy("sample", "chrom", F.floor(F.col("pos") / width).alias("bin")).agg(ordered_join(F.coalesce(code, F.lit("?")), ["pos", "vid"], "").alias("sites"), ordered_join(F.round(F.col("pos") / 1000, 3).cast("string"), ["pos", "vid"], ",").alias("locs"))


def beagle_likelihoods(calls: DataFrame, values: str, phred: bool = True, filtered: Column | None = None) -> DataFrame:
    """(vid, sample, likelihoods) of a column of PL (phred) or GL arrays; 1 for every genotype of a filtered call."""
    one = lambda x: F.round(F.pow(F.lit(10.0), -x / 10.0 if phred else x), 6)
    like = F.transform(values, (lambda x: F.when(filtered, F.lit(1.0)).otherwise(one(x))) if filtered is not None else one)
    return calls.select("vid", "sample", like.alias("likelihoods"))


def tab_to_sites(tab: DataFrame) -> DataFrame:
    """(vid, alts) of genotypes in letters (vid, ref, g as a/b): the letters other than the reference, in order."""
    letters = tab.select("vid", "ref", F.explode(F.split("g", r"[/|]")).alias("b")).where((F.col("b") != F.col("ref")) & ~F.col("b").isin("0", ".", ""))
    return letters.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("alts"))


def template_text(template: str, values: dict[str, Column]) -> Column:
    """A template as text: %NAME stands for a value, null is '.'."""
    parts = re.split(r"%([A-Z]+)", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit(".")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def formatted(rows: DataFrame, template: str, site: dict[str, Column], call: dict[str, Column]) -> DataFrame:
    """(vid, line) of calls joined with their sites: a template of site values, in which a part in [ ] is repeated for each
    sample, in their order."""
    before, bracket, after = re.fullmatch(r"([^\[]*)(\[[^\]]*\])?(.*)", template, re.S).groups()
    each = ordered_join(template_text((bracket or "")[1:-1], {**site, **call}), ["sample"], "")
    fixed = {name: F.first(c) for name, c in site.items()}  # alike in all rows of a site
    return rows.groupBy("vid").agg(F.concat(template_text(before, fixed), each, template_text(after, fixed)).alias("line"))
