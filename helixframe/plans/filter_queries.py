"""Queries of the filters, one each, and of the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import filters as P
from helixframe.plans.registry import query
from helixframe.plans.site_queries import ALLELES, CHR, COUNTS, sites_of

INDEL = "(length(ref) <> 1 OR length(alt1) <> length(ref) OR (alt2 IS NOT NULL AND length(alt2) <> length(ref)))"
V = "SELECT vid FROM variants WHERE"


def info_map(v):
    pairs = F.filter(F.split("info", ";"), lambda x: x != "")
    return v.withColumn("info_map", F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.element_at(F.split(x, "="), 1), F.coalesce(F.try_element_at(F.split(x, "="), F.lit(2)), F.lit(""))))))


def q(name, sql):
    def keep(f):
        return query(name, sql)(lambda t: f(t, sites_of(t)).select("vid"))

    return keep


@q("f1_indels", f"{V} {INDEL}")
def _(t, v):
    return v.where(P.is_indel())


@q("f1_no_indels", f"{V} NOT {INDEL}")
def _(t, v):
    return v.where(~P.is_indel())


@q("f2_ids", "WITH l AS (SELECT concat('rs', CAST(l_partkey AS VARCHAR)) AS id FROM lineitem WHERE l_quantity > 45) SELECT vid FROM variants WHERE id IN (SELECT id FROM l)")
def _(t, v):
    return P.SiteFilter(ids=t.lineitem.where("l_quantity > 45").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("id"))).apply(v, t.calls)[0]


@q("f2_without_ids", "WITH l AS (SELECT concat('rs', CAST(l_partkey AS VARCHAR)) AS id FROM lineitem WHERE l_quantity > 49) SELECT vid FROM variants WHERE id IS NULL OR id NOT IN (SELECT id FROM l)")
def _(t, v):
    return P.SiteFilter(without_ids=t.lineitem.where("l_quantity > 49").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("id"))).apply(v, t.calls)[0]


@q("f3_pass", f"{V} filter = 'PASS'")
def _(t, v):
    return P.by_filter(v, only_pass=True)


@q("f3_keep_flag", f"{V} filter IN ('q10', 'q10;s50')")
def _(t, v):
    return P.by_filter(v, keep=["q10"])


@q("f3_remove_flag", f"{V} filter IS NULL OR filter <> 'q10;s50'")
def _(t, v):
    return P.by_filter(v, remove=["s50"])


@q("f4_range", f"{V} chrom = 'chr2' AND pos BETWEEN 20000 AND 120000")
def _(t, v):
    return P.SiteFilter(chrom="chr2", from_pos=20000, to_pos=120000).apply(v, t.calls)[0]


@q("f5_positions", "WITH l AS (SELECT DISTINCT chrom, start_pos AS pos FROM intervals) SELECT vid FROM variants v WHERE EXISTS (SELECT 1 FROM l WHERE l.chrom = v.chrom AND l.pos = v.pos)")
def _(t, v):
    return P.SiteFilter(positions=t.intervals.select("chrom", F.col("start_pos").alias("pos"))).apply(v, t.calls)[0]


@q("f5_without_positions", "WITH l AS (SELECT DISTINCT chrom, start_pos AS pos FROM intervals) SELECT vid FROM variants v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.chrom = v.chrom AND l.pos = v.pos)")
def _(t, v):
    return P.SiteFilter(without_positions=t.intervals.select("chrom", F.col("start_pos").alias("pos"))).apply(v, t.calls)[0]


@q("f6_overlap", "WITH l AS (SELECT DISTINCT chrom, start_pos AS pos FROM intervals) SELECT DISTINCT vid FROM variants v JOIN l ON l.chrom = v.chrom AND l.pos >= v.pos AND l.pos < v.pos + length(ref)")
def _(t, v):
    return P.overlapping_positions(v, t.intervals.select("chrom", F.col("start_pos").alias("pos")))


@q("f7_chroms", f"{V} chrom IN ('chr1', 'chr4')")
def _(t, v):
    return P.SiteFilter(chroms=["chr1", "chr4"]).apply(v, t.calls)[0]


_BED = "WITH l AS (SELECT chrom, start_pos AS s, end_pos AS e FROM intervals WHERE seqid < 40) SELECT {} FROM variants v {} JOIN l ON l.chrom = v.chrom AND ((v.pos > s AND v.pos <= e) OR (v.pos + length(ref) - 1 > s AND v.pos + length(ref) - 1 <= e) OR (v.pos <= s AND v.pos + length(ref) - 1 > e))"


@q("f8_bed", _BED.format("DISTINCT vid", ""))
def _(t, v):
    return P.in_intervals(v, t.intervals.where("seqid < 40").select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")))


@q("f8_without_bed", _BED.format("vid", "ANTI"))
def _(t, v):
    return P.in_intervals(v, t.intervals.where("seqid < 40").select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")), True)


@q("f9_alleles", f"{V} alt2 IS NOT NULL")
def _(t, v):
    return P.SiteFilter(min_alleles=3).apply(v, t.calls)[0]


@q("f10_info_flag", f"{V} vid % 4 = 0")
def _(t, v):
    return P.SiteFilter(info_flag="DB").apply(info_map(v), t.calls)[0]


@q("f11_qual", f"{V} qual >= 40.5")
def _(t, v):
    return P.SiteFilter(min_qual=40.5).apply(v, t.calls)[0]


@q("f12_mean_depth", "SELECT vid FROM calls JOIN variants USING (vid) GROUP BY vid HAVING SUM(COALESCE(dp, 0)) / count(*) BETWEEN 25 AND 45")
def _(t, v):
    return P.mean_depth(v, t.calls, 25, 45)


@q("f13_mask", "SELECT DISTINCT v.vid FROM variants v JOIN intervals i ON i.chrom = v.chrom AND v.pos >= start_pos AND v.pos < end_pos AND seqid % 10 <= 2")
def _(t, v):
    return P.by_mask(v, t.intervals.select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), (F.col("seqid") % 10).alias("digit")), 2)


@q("f14_phased", "SELECT vid FROM variants WHERE vid NOT IN (SELECT vid FROM calls WHERE NOT phased)")
def _(t, v):
    return P.phased_only(v, t.calls)


_MASKED = "SELECT vid, sample, CASE WHEN {0} THEN a1 END AS a1, CASE WHEN {0} THEN a2 END AS a2 FROM calls"


@query("f15_f16_mask_calls", _MASKED.format("gq >= 20 AND dp BETWEEN 10 AND 90"))
def _(t):
    return P.mask_calls(t.calls, 20, 10, 90).select("vid", "sample", "a1", "a2")


@query("f17_mask_flagged_calls", _MASKED.format("gq % 5 <> 0"))
def _(t):
    flagged = t.calls.withColumn("ft", F.when(F.col("gq") % 5 == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")))
    return flagged.select("vid", "sample", *[F.when(~F.array_contains("ft", "low"), F.col(c)).alias(c) for c in ("a1", "a2")])


_FREQ = f"WITH {COUNTS}, f AS (SELECT vid, min(LEAST(n / total, 1 - n / total)) AS maf, min(n / total) FILTER (allele > 0) AS lo, max(n / total) FILTER (allele > 0) AS hi, min(n) AS mac, min(n) FILTER (allele > 0) AS lac, max(n) FILTER (allele > 0) AS hac, any_value(total) AS t FROM cnt WHERE total > 0 GROUP BY vid) SELECT vid FROM f WHERE "


@q("f18_maf", _FREQ + "maf >= 0.3 AND maf <= 0.45")
def _(t, v):
    return P.by_frequency(v, t.calls, min_maf=0.3, max_maf=0.45)


@q("f18_non_ref_af", _FREQ + "lo >= 0.4 AND hi <= 0.7")
def _(t, v):
    return P.by_frequency(v, t.calls, min_af=0.4, max_af=0.7)


@q("f18_non_ref_af_any", _FREQ + "hi >= 0.5 AND lo <= 0.6")
def _(t, v):
    return P.by_frequency(v, t.calls, min_af_any=0.5, max_af_any=0.6)


@q("f18_call_rate", _FREQ + "t >= 30")
def _(t, v):
    return P.by_frequency(v, t.calls, min_chromosomes=30)


@q("f19_mac", _FREQ + "mac >= 9 AND mac <= 15")
def _(t, v):
    return P.by_frequency(v, t.calls, min_mac=9, max_mac=15)


@q("f19_non_ref_ac", _FREQ + "lac >= 12 AND hac <= 20")
def _(t, v):
    return P.by_frequency(v, t.calls, min_ac=12, max_ac=20)


@query("f20_hwe")
def _(t):
    return P.by_hwe(sites_of(t), t.calls, 0.05).select("vid")


@query("f21_thin", """WITH RECURSIVE o AS (SELECT vid, chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, vid) AS k FROM variants),
 k AS (SELECT vid, chrom, pos, k, pos AS last, true AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.vid, o.chrom, o.pos, o.k, CASE WHEN o.pos - k.last >= 700 THEN o.pos ELSE k.last END, o.pos - k.last >= 700 FROM k JOIN o ON o.chrom = k.chrom AND o.k = k.k + 1)
 SELECT vid FROM k WHERE kept""")
def _(t):
    return P.thin(sites_of(t), 700).select("vid")


@query("f22_keep_samples", "SELECT vid, sample, a1, a2 FROM calls WHERE sample IN (SELECT sample FROM samples WHERE pop = 1)")
def _(t):
    return t.calls.join(t.samples.where("pop = 1"), "sample", "left_semi").select("vid", "sample", "a1", "a2")


@query("f22_remove_samples", "SELECT vid, sample, a1, a2 FROM calls WHERE sample NOT IN (SELECT sample FROM samples WHERE pop = 1)")
def _(t):
    return t.calls.join(t.samples.where("pop = 1"), "sample", "left_anti").select("vid", "sample", "a1", "a2")


@query("f23_max_samples", "SELECT sample FROM samples ORDER BY md5(concat('7:', CAST(sample AS VARCHAR))), sample LIMIT 7")
def _(t):
    return P.pick_samples(t.samples, 7).select("sample")


@query("f24_site_quality", "SELECT vid, qual FROM variants WHERE qual < 30")
def _(t):
    return P.low_quality(t.variants)


@query("f25_genotype_quality", "SELECT vid, max(gq) AS gq FROM calls WHERE COALESCE(a1, 0) > 0 OR COALESCE(a2, 0) > 0 GROUP BY vid HAVING max(gq) < 50")
def _(t):
    return P.low_genotype_quality(t.calls)


@query("f26_depth_per_sample", f"SELECT vid, min(dp) AS dp FROM calls JOIN variants USING (vid) WHERE NOT {INDEL} GROUP BY vid HAVING min(dp) < 5")
def _(t):
    return P.low_sample_depth(sites_of(t), t.calls)


@query("f27_avg_depth", "SELECT vid, round(3 * size / 20, 6) AS depth FROM variants WHERE 3 * size / 20 < 3")
def _(t):
    return P.low_average_depth(info_map(t.variants), 20)


@q("f28_snp_only", f"{V} NOT {INDEL}")
def _(t, v):
    return v.where(F.size(F.filter("alts", lambda a: F.length(a) != 1)) == 0).where(F.length("ref") == 1)


@query("f29_error_bias", """WITH d AS (SELECT vid, a1 + a2 AS gt, gq % 20 AS r, dp % 15 AS a FROM calls WHERE a1 <= 1 AND a2 <= 1 AND dp IS NOT NULL), s AS (SELECT vid, SUM(a) / SUM(r + a) AS ab FROM d GROUP BY vid)
 SELECT vid, round(SUM(a * ln(GREATEST(ab, 1e-9)) + r * ln(GREATEST(1 - ab, 1e-9)) - a * ln(GREATEST(0.5 + 0.48 * (gt - 1), 1e-9)) - r * ln(GREATEST(1 - (0.5 + 0.48 * (gt - 1)), 1e-9))), 4) AS bias FROM d JOIN s USING (vid) GROUP BY vid""")
def _(t):
    d = t.calls.where("a1 <= 1 and a2 <= 1 and dp is not null").select("vid", (F.col("a1") + F.col("a2")).alias("gt"), (F.col("gq") % 20).alias("ref_depth"), (F.col("dp") % 15).alias("alt_depth"))
    return P.binomial_bias(t.variants, d).select("vid", "bias")


@query("f30_annotate", """SELECT vid, concat_ws(';', CASE WHEN qual < 10 THEN 'qual' END, CASE WHEN 3 * size < 20 OR 3 * size > 140 THEN 'DP' END, CASE WHEN vid % 19 <> 0 AND vid % 60 < 10 THEN 'MQ' END) AS failed FROM variants""")
def _(t):
    return P.info_bounds(info_map(t.variants), {"qual": (10, None), "DP": (20, 140), "MQ": (10, None)})


_N = "WITH v AS (SELECT vid, ref, qual, 3 * size AS dp, vid % 4 + vid % 3 AS alt_bases, (vid % 200) / 1000000.0 AS pv, CASE WHEN vid % 19 <> 0 THEN vid % 60 END AS mq FROM variants)"


@query("f30_named_filters", f"{_N} SELECT vid, concat_ws(';', CASE WHEN pv < 1e-4 THEN 'EndDistBias' END, CASE WHEN dp > 140 THEN 'MaxDP' END, CASE WHEN alt_bases < 2 THEN 'MinAB' END, CASE WHEN mq < 10 THEN 'MinMQ' END, CASE WHEN qual < 10 THEN 'Qual' END, CASE WHEN pv < 1e-4 THEN 'StrandBias' END) AS failed FROM v")
def _(t):
    more = F.concat(F.col("info"), F.lit(";DP4=9,9,"), (F.col("vid") % 4).cast("string"), F.lit(","), (F.col("vid") % 3).cast("string"), F.lit(";PV4="), *[x for i in range(4) for x in (((F.col("vid") % 200) / 1000000.0).cast("string"), F.lit("," if i < 3 else ""))])
    return P.named_filters(info_map(t.variants.withColumn("info", more)), MaxDP=140)


@query("f30_equilibrium_filters", """WITH g AS (SELECT vid, (vid % 10) / 20 AS rr, (vid % 7) / 14 AS ra, (vid % 100) / 1000.0 AS p, (vid % 50) / 100.0 AS h, (vid % 3 - 1) / 2.0 AS f FROM variants)
 SELECT vid, concat_ws(';', CASE WHEN h < 0.2 AND f < 0 THEN 'HWE2' END, CASE WHEN vid % 4 > 0 AND p < 0.05 AND rr + ra / 2 > 0 AND rr + ra / 2 < 1 AND ra > 2 * (rr + ra / 2) * (1 - rr - ra / 2) THEN 'HWE_G3' END) AS failed FROM g""")
def _(t):
    text = lambda c: c.cast("double").cast("string")
    g3 = F.concat(F.lit(";G3="), text(F.col("vid") % 10 / 20), F.lit(","), text(F.col("vid") % 7 / 14), F.lit(",0;HWE_G3="), text(F.col("vid") % 100 / 1000.0))
    v = t.variants.withColumn("info", F.concat("info", F.when(F.col("vid") % 4 > 0, g3).otherwise(""))).withColumns({"hwe": F.col("vid") % 50 / 100.0, "icf": (F.col("vid") % 3 - 1) / 2.0})
    return P.named_filters(info_map(v), **{n: None for n in P.NAMED} | {"HWE_G3": 0.05, "HWE2": 0.2})


@query("f31_snp_gap", f"WITH g AS (SELECT chrom, pos - 600 AS s, pos + length(ref) + 600 AS e FROM variants WHERE {INDEL}) SELECT DISTINCT v.vid FROM (SELECT * FROM variants WHERE NOT {INDEL}) v JOIN g ON g.chrom = v.chrom AND v.pos >= s AND v.pos < e")
def _(t):
    return P.snp_gap(sites_of(t), 600)


@query("f32_gap_win", """WITH o AS (SELECT vid, chrom, pos + 1 AS f, pos + CASE WHEN length(alt1) <> length(ref) THEN abs(length(alt1) - length(ref)) ELSE abs(length(alt2) - length(ref)) END AS e,
  CASE vid % 4 WHEN 0 THEN (vid % 5) / 10 WHEN 1 THEN (vid % 7) / 10 WHEN 2 THEN vid % 3 ELSE 0 END AS af FROM variants WHERE length(alt1) <> length(ref) OR length(alt2) <> length(ref)),
 r AS (SELECT *, max(e + 700) OVER (PARTITION BY chrom ORDER BY f, vid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o), c AS (SELECT *, CAST(SUM(CASE WHEN reach IS NULL OR f > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY f, vid) AS BIGINT) AS cluster FROM r)
 SELECT vid, chrom, cluster, row_number() OVER (PARTITION BY chrom, cluster ORDER BY af DESC, f, vid) = 1 AS passes FROM c""")
def _(t):
    f = F.when(F.col("vid") % 4 == 0, F.concat(F.lit(";AF="), (F.col("vid") % 5 / 10).cast("string"), F.lit(",9;AC=8"))).when(F.col("vid") % 4 == 1, F.concat(F.lit(";AF1="), (F.col("vid") % 7 / 10).cast("string"))).when(F.col("vid") % 4 == 2, F.concat(F.lit(";AC="), (F.col("vid") % 3).cast("string"))).otherwise("")
    return P.gap_window(info_map(sites_of(t).withColumn("info", F.concat("info", f))), 700)


@query("f33_snp_cluster", """WITH a AS (SELECT vid, chrom, pos, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 1499 FOLLOWING) AS n FROM variants), b AS (SELECT vid, max(n) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1499 PRECEDING AND CURRENT ROW) AS m FROM a) SELECT vid FROM b WHERE m >= 5""")
def _(t):
    return P.snp_cluster(t.variants, 5, 1500)


@query("f34_user_filter", "SELECT vid, CASE WHEN 3 * size > 60 AND qual > 20 THEN 'PASS' ELSE 'mine' END AS verdict FROM variants")
def _(t):
    mine = (F.try_element_at("info_map", F.lit("DP")).cast("int") > 60) & (F.col("qual") > 20)
    return info_map(t.variants).select("vid", F.when(mine, "PASS").otherwise("mine").alias("verdict"))


@q("f35_hard_filter", f"{V} filter IS NULL OR filter = 'PASS'")
def _(t, v):
    return v.where(F.coalesce(F.size("filters") == 0, F.lit(True)) | F.col("filters").isNull())


@query("filter_chain", f"""WITH m AS (SELECT vid, sample, CASE WHEN gq >= 10 THEN a1 END AS a1, CASE WHEN gq >= 10 THEN a2 END AS a2 FROM calls), s AS (SELECT v.* FROM variants v JOIN (SELECT vid FROM calls GROUP BY vid HAVING SUM(COALESCE(dp, 0)) / count(*) >= 20) d USING (vid) WHERE NOT {INDEL} AND filter = 'PASS' AND alt2 IS NULL AND qual >= 20),
 c AS (SELECT vid, a1 AS a FROM m WHERE a1 IS NOT NULL UNION ALL SELECT vid, a2 FROM m WHERE a2 IS NOT NULL), f AS (SELECT vid, avg(a) AS p FROM c JOIN s USING (vid) GROUP BY vid) SELECT vid, round(p, 6) AS p FROM f WHERE LEAST(p, 1 - p) >= 0.2""")
def _(t):
    chain = P.SiteFilter(keep_indels=False, only_pass=True, max_alleles=2, min_qual=20, min_mean_dp=20, min_gq=10, frequency={"min_maf": 0.2})
    v, c = chain.apply(sites_of(t), t.calls)
    from helixframe.operators.sites import allele_counts

    return allele_counts(v, c).where("allele = 1").select("vid", F.round(F.col("n") / F.col("total"), 6).alias("p"))


for _name, _kept in (("a21_kept_sites", ""), ("a22_removed_sites", "NOT ")):

    @query(_name, f"SELECT chrom, pos FROM variants WHERE {_kept}(qual >= 50 AND NOT {INDEL})")
    def _(t, kept=not _kept):
        v = sites_of(t)
        stay, _ = P.SiteFilter(keep_indels=False, min_qual=50).apply(v, t.calls)
        return v.join(stay.select("vid"), "vid", "left_semi" if kept else "left_anti").select("chrom", "pos")


@query("a23_write_stats", f"SELECT count(*) FILTER (qual >= 50 AND NOT {INDEL}) AS kept_sites, count(*) AS sites, (SELECT count(*) FROM samples WHERE pop = 1) AS kept_samples, (SELECT count(*) FROM samples) AS samples FROM variants")
def _(t):
    v = sites_of(t)
    stay, _ = P.SiteFilter(keep_indels=False, min_qual=50).apply(v, t.calls)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(stay, "kept_sites").crossJoin(one(v, "sites")).crossJoin(one(t.samples.where("pop = 1"), "kept_samples")).crossJoin(one(t.samples, "samples"))


__all__ = ["ALLELES", "CHR", "INDEL", "info_map"]
