"""Statistics of a variant file by user filters: over the columns FILTER, QUAL and INFO for sites, over FORMAT and single
samples for calls.

A filter names a field and how its values make scopes: any value, one value, or bins up to a greatest one. A row falls into
the scope `all` and one scope per filter that its fields allow (FILTER: one per value). Rows are exploded to their scopes and
to what is counted in them, and counted once, with map-side sums; no task sees more than its share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.variants import event_type


@dataclass(frozen=True)
class Rule:
    """field: FILTER, QUAL, INFO/x, FORMAT/x or SAMPLE/name/x. width and most: bins of so much, all over `most` in one; value: the
    one value that counts; flag: whether an INFO flag has to be there."""

    field: str
    width: float | None = None
    most: float | None = None
    value: str | None = None
    flag: bool | None = None

    @staticmethod
    def of(text: str) -> Rule:
        """field, field=width:most or field=value; INFO/x=flag and INFO/x=noflag ask for a flag."""
        field, _, how = text.partition("=")
        width, colon, most = how.partition(":")
        if colon:
            return Rule(field, float(width), float(most))
        if how in ("flag", "noflag"):
            return Rule(field, flag=how == "flag")
        return Rule(field, value=how or None)

    def key(self, value: Column) -> Column:
        """The scope's name of a value as text, null for none."""
        name = lambda x: F.concat(F.lit(f"{self.field}/"), x)
        if self.value is not None:
            return F.when(value == self.value, name(value))
        if self.width is None:
            return F.when(value.isNotNull(), name(value))
        at = F.floor(value.try_cast("double") / self.width) * F.lit(self.width)
        shown = F.when(at > self.most, F.lit(f">{self.most:g}")).otherwise(F.regexp_replace(at.cast("double").cast("string"), r"\.0$", ""))
        return F.when(value == ".", name(value)).when(at.isNotNull(), name(shown))

    def site_scopes(self) -> Column:
        if self.field == "FILTER":
            values = F.when(F.col("filters").isNull(), F.array(F.lit("."))).when(F.size("filters") == 0, F.array(F.lit("PASS"))).otherwise(F.col("filters"))
            return F.array_compact(F.transform(values, self.key))
        if self.field == "QUAL":
            return F.array_compact(F.array(self.key(F.coalesce(F.col("qual").cast("string"), F.lit(".")))))
        tag = F.lit(self.field.removeprefix("INFO/"))
        if self.flag is not None:
            return F.when(F.coalesce(F.map_contains_key("info_map", tag), F.lit(False)) == self.flag, F.array(F.lit(self.field))).otherwise(F.array().cast("array<string>"))
        return F.array_compact(F.array(self.key(F.try_element_at("info_map", tag))))

    def call_scopes(self, columns: list[str]) -> Column:
        kind, *rest = self.field.split("/")
        column = rest[-1].lower()
        if column not in columns:
            raise ValueError(f"calls have no column {column}")
        own = self.key(F.coalesce(F.col(column).cast("string"), F.lit(".")))
        return F.array_compact(F.array(own if kind == "FORMAT" else F.when(F.col("sample").cast("string") == rest[0], own)))


def _entry(stat: str, key: Column | None = None) -> Column:
    return F.struct(F.lit(stat).alias("stat"), (F.lit("") if key is None else key.cast("string")).alias("key"))


def _kind(type_: Column) -> Column:
    return F.when(type_.startswith("r"), "ref").when(type_.startswith("s"), "snp").when(type_.startswith("i"), "indel").otherwise("other")


def _of_allele(ref: Column, alt: Column, type_: Column) -> Column:
    """Entries of one allele: its change of a base, whether that is a transition, the signed length of an indel."""
    change = F.concat(ref, F.lit(">"), alt)
    ts = change.isin("A>G", "G>A", "C>T", "T>C")
    return F.when(type_ == "s1", F.array(_entry("change", change), F.when(ts, _entry("ts")).otherwise(_entry("tv")))).when(type_.startswith("i"), F.array(_entry("indel", F.substring(type_, 2, 20)))).otherwise(F.array().cast("array<struct<stat:string,key:string>>"))


def user_stats(variants: DataFrame, calls: DataFrame, rules: list[str] = ()) -> DataFrame:
    """(scope, sample, stat, key, n). variants: vid, ref, alts, filters, qual, info_map; calls: vid, sample, a1, a2, phased and the
    FORMAT fields in lower case.

    Of sites (sample null): count; n_alt, by how many alternatives have a call; snp, indel, other: sites with such an
    alternative; change, ts, tv, indel of alternatives; and in scope all shared, by how many samples have an alternative.
    Of complete calls: count; ref, snp, indel, other: calls with such an allele; hom_RR, het_RA, hom_AA, het_AA; phased, unphased;
    change, ts, tv and indel of distinct alleles; private: no other sample has an alternative there."""
    parsed = [Rule.of(x) for x in rules]
    at_sites = [r for r in parsed if not r.field.startswith(("FORMAT/", "SAMPLE/"))]
    at_calls = [r for r in parsed if r.field.startswith(("FORMAT/", "SAMPLE/"))]
    own = calls.where("a1 is not null and a2 is not null")
    per = own.groupBy("vid").agg(F.count_if((F.col("a1") > 0) | (F.col("a2") > 0)).alias("carriers"), F.array_distinct(F.flatten(F.collect_set(F.array("a1", "a2")))).alias("called"))
    typed = F.transform("alts", lambda a: F.struct(a.alias("alt"), event_type(F.col("ref"), a).alias("type")))
    sites = variants.join(per, "vid", "left").withColumn("typed", typed)
    n_alt = F.size(F.filter(F.coalesce("called", F.array().cast("array<int>")), lambda a: a > 0))
    kinds = F.array_distinct(F.transform("typed", lambda x: F.struct(_kind(x["type"]).alias("stat"), F.lit("").alias("key"))))
    alleles = F.flatten(F.transform("typed", lambda x: _of_allele(F.col("ref"), x["alt"], x["type"])))
    entries = F.concat(F.array(_entry("count"), _entry("n_alt", n_alt)), kinds, alleles)
    scopes = F.concat(F.array(F.lit("all")), *[r.site_scopes() for r in at_sites])
    shared = sites.select(F.lit("all").alias("scope"), F.lit("shared").alias("stat"), F.coalesce("carriers", F.lit(0)).cast("string").alias("key"))
    of_sites = sites.select(F.explode(scopes).alias("scope"), entries.alias("e")).select("scope", F.inline("e")).union(shared)
    of_sites = of_sites.groupBy("scope", "stat", "key").agg(F.count("*").alias("n")).select("scope", F.lit(None).cast(calls.schema["sample"].dataType).alias("sample"), "stat", "key", "n")

    c = own.join(sites.select("vid", "ref", "typed", "carriers"), "vid")
    one = lambda a: F.when(F.col(a) == 0, F.struct(F.col("ref").alias("alt"), F.lit("r0").alias("type"))).otherwise(F.get("typed", F.col(a) - 1))
    pair = F.array_distinct(F.array_compact(F.array(one("a1"), one("a2"))))
    same, with_ref = F.col("a1") == F.col("a2"), (F.col("a1") == 0) | (F.col("a2") == 0)
    genotype = F.when(same & with_ref, "hom_RR").when(with_ref, "het_RA").when(same, "hom_AA").otherwise("het_AA")
    entries = F.concat(
        F.array(_entry("count"), F.struct(genotype.alias("stat"), F.lit("").alias("key")), F.struct(F.when(F.coalesce("phased", F.lit(False)), "phased").otherwise("unphased").alias("stat"), F.lit("").alias("key"))),
        F.array_distinct(F.transform(pair, lambda x: F.struct(_kind(x["type"]).alias("stat"), F.lit("").alias("key")))), F.flatten(F.transform(pair, lambda x: _of_allele(F.col("ref"), x["alt"], x["type"]))),
        F.when((F.col("carriers") == 1) & ((F.col("a1") > 0) | (F.col("a2") > 0)), F.array(_entry("private"))).otherwise(F.array().cast("array<struct<stat:string,key:string>>")),
    )
    scopes = F.concat(F.array(F.lit("all")), *[r.call_scopes(calls.columns) for r in at_calls])
    of_calls = c.select("sample", F.explode(scopes).alias("scope"), entries.alias("e")).select("sample", "scope", F.inline("e")).groupBy("scope", "sample", "stat", "key").agg(F.count("*").alias("n"))
    return of_sites.union(of_calls)
