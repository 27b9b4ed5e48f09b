"""Queries of site, sample and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import sites as S
from helixframe.plans.registry import query
from helixframe.sources.views import Tables


def sites_of(t: Tables):
    """The variants view in the operators' form: alts, filters and aa."""
    v = t.variants
    filters = F.when(F.col("filter").isNull(), F.lit(None)).when(F.col("filter") == "PASS", F.array().cast("array<string>")).otherwise(F.split("filter", ";"))
    return v.withColumn("alts", F.filter(F.array("alt1", "alt2"), lambda x: x.isNotNull())).withColumn("filters", filters).withColumn("aa", F.regexp_extract("info", "AA=([ACGT])", 1))


#: A row per called chromosome, in SQL.
CHR = "chrs AS (SELECT vid, sample, a1 AS allele FROM calls WHERE a1 IS NOT NULL UNION ALL SELECT vid, sample, a2 FROM calls WHERE a2 IS NOT NULL)"
ALLELES = "alleles AS (SELECT vid, 0 AS allele, ref AS base FROM variants UNION ALL SELECT vid, 1, alt1 FROM variants UNION ALL SELECT vid, 2, alt2 FROM variants WHERE alt2 IS NOT NULL)"
COUNTS = f"""{CHR}, {ALLELES}, ac AS (SELECT vid, allele, count(*) AS n FROM chrs GROUP BY ALL),
 cnt AS (SELECT a.vid, a.allele, a.base, COALESCE(c.n, 0) AS n, CAST(SUM(COALESCE(c.n, 0)) OVER (PARTITION BY a.vid) AS BIGINT) AS total FROM alleles a LEFT JOIN ac c ON a.vid = c.vid AND a.allele = c.allele)"""
GENO = "g AS (SELECT vid, count(*) FILTER (a1 = 0 AND a2 = 0) AS hom_ref, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = a2 AND a1 > 0) AS hom_alt, count(*) AS n FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY vid)"
ONE = "regexp_matches(ref, '^[ACGT]$') AND regexp_matches(alt1, '^[ACGT]$') AND ref <> alt1"
TS = "concat(ref, alt1) IN ('AG', 'GA', 'CT', 'TC')"


@query("a1_allele_counts", f"WITH {COUNTS} SELECT vid, allele, base, n, total FROM cnt")
def _(t):
    return S.allele_counts(sites_of(t), t.calls)


@query("a2_allele_freq", f"WITH {COUNTS} SELECT vid, allele, base, n, total, round(n / NULLIF(total, 0), 6) AS freq FROM cnt")
def _(t):
    return S.allele_freq(sites_of(t), t.calls)


@query("a2_derived_freq", f"WITH {COUNTS}, k AS (SELECT vid, regexp_extract(info, 'AA=([ACGT])', 1) AS aa FROM variants), m AS (SELECT DISTINCT k.vid, k.aa FROM k JOIN alleles USING (vid) WHERE alleles.base = k.aa) SELECT cnt.vid, base, n, total, base = aa AS ancestral FROM cnt JOIN m USING (vid)")
def _(t):
    return S.derived_counts(sites_of(t), t.calls)


@query("a3_genotype_counts", f"WITH {GENO} SELECT * FROM g")
def _(t):
    return S.genotype_counts(t.calls)


@query("a4_het", """WITH o AS (SELECT c.* FROM calls c JOIN variants v USING (vid) WHERE alt2 IS NULL),
 s AS (SELECT vid, SUM(COALESCE(a1, 0) + COALESCE(a2, 0)) AS alt, 2 * count(*) AS n FROM o GROUP BY vid HAVING count(*) FILTER (a1 IS NULL OR a2 IS NULL) = 0),
 e AS (SELECT *, 1 - 2 * (alt / n) * (1 - alt / n) * n / (n - 1) AS e FROM s WHERE alt > 0 AND alt < n),
 b AS (SELECT sample, count(*) FILTER (a1 = a2) AS observed_hom, SUM(e) AS e, count(*) AS n FROM o JOIN e USING (vid) GROUP BY sample)
 SELECT sample, observed_hom, round(e, 6) AS expected_hom, n, round((observed_hom - e) / NULLIF(n - e, 0), 4) AS f FROM b""")
def _(t):
    return S.heterozygosity(sites_of(t), t.calls)


@query("a5_hwe", f"""WITH {GENO}, b AS (SELECT g.*, (2 * hom_ref + het) / (2 * n) AS q FROM g JOIN variants USING (vid) WHERE alt2 IS NULL),
 e AS (SELECT *, q * q * n AS x, 2 * q * (1 - q) * n AS y, (1 - q) * (1 - q) * n AS z FROM b)
 SELECT vid, hom_ref, het, hom_alt, round(x, 6) AS e_hom_ref, round(y, 6) AS e_het, round(z, 6) AS e_hom_alt,
  round(CASE WHEN x > 0 THEN (hom_ref - x) * (hom_ref - x) / x ELSE 0 END + CASE WHEN y > 0 THEN (het - y) * (het - y) / y ELSE 0 END + CASE WHEN z > 0 THEN (hom_alt - z) * (hom_alt - z) / z ELSE 0 END, 6) AS chisq FROM e""")
def _(t):
    # The exact p values are tested against enumeration in tests/.
    return S.hwe(sites_of(t), t.calls).drop("p", "p_lo", "p_hi")


@query("a5_hwe_exact")
def _(t):
    return S.hwe(sites_of(t), t.calls)


@query("a6_indv_burden", """WITH b AS (SELECT sample, count(*) FILTER (a1 = 0 AND a2 = 0) AS hom_ref, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = a2 AND a1 > 0) AS hom_alt FROM calls GROUP BY sample)
 SELECT s.sample, COALESCE(hom_ref, 0) AS hom_ref, COALESCE(het, 0) AS het, COALESCE(hom_alt, 0) AS hom_alt, (SELECT count(*) FROM variants) - COALESCE(hom_ref, 0) - COALESCE(het, 0) - COALESCE(hom_alt, 0) AS missing FROM samples s LEFT JOIN b USING (sample)""")
def _(t):
    return S.sample_burden(t.variants, t.calls, t.samples)


for _name, _once in (("a7_indv_freq_burden", ""), ("a7_indv_freq_burden2", "DISTINCT")):

    @query(_name, f"WITH {CHR}, c AS (SELECT vid, allele, count(*) AS allele_count FROM chrs WHERE allele > 0 GROUP BY ALL), o AS (SELECT {_once} vid, sample, allele FROM chrs WHERE allele > 0) SELECT sample, allele_count, count(*) AS n FROM o JOIN c USING (vid, allele) GROUP BY ALL")
    def _(t, once=bool(_once)):
        return S.frequency_burden(t.calls, once)


@query("a8_indv_depth", "SELECT sample, count(*) AS n_sites, round(avg(dp), 6) AS mean_depth FROM calls WHERE dp IS NOT NULL GROUP BY sample")
def _(t):
    return S.sample_depth(t.calls)


@query("a9_indv_missing", """WITH b AS (SELECT sample, count(*) FILTER (a1 IS NOT NULL AND gq >= 20) AS have, count(*) FILTER (gq < 20) AS f FROM calls GROUP BY sample), n AS (SELECT count(*) AS sites FROM variants), x AS (SELECT s.sample, COALESCE(have, 0) AS have, COALESCE(f, 0) AS n_filtered, sites - COALESCE(f, 0) AS n_data FROM samples s CROSS JOIN n LEFT JOIN b USING (sample))
 SELECT sample, n_data, n_filtered, n_data - have AS n_miss, round((n_data - have) / NULLIF(n_data, 0), 6) AS f_miss FROM x""")
def _(t):
    return S.sample_missing(t.variants, t.calls, t.samples, t.calls.where("gq < 20"))


@query("a10_site_missing", """WITH h AS (SELECT vid, count(a1) FILTER (gq >= 20) + count(a2) FILTER (gq >= 20) AS have, count(*) FILTER (gq < 20) AS f, count(*) FILTER (gq >= 20 AND a2 IS NULL AND phased) AS one FROM calls GROUP BY vid), x AS (SELECT vid, COALESCE(have, 0) AS have, COALESCE(f, 0) AS n_filtered, 40 - 2 * COALESCE(f, 0) - COALESCE(one, 0) AS n_data FROM variants LEFT JOIN h USING (vid))
 SELECT vid, n_data, n_filtered, n_data - have AS n_miss, round((n_data - have) / NULLIF(n_data, 0), 6) AS f_miss FROM x""")
def _(t):
    return S.site_missing(t.variants, t.calls, 20, t.calls.where("gq < 20"))


@query("a11_site_depth", "SELECT vid, CAST(SUM(dp) AS BIGINT) AS sum_depth, CAST(SUM(CAST(dp AS BIGINT) * dp) AS BIGINT) AS sumsq_depth FROM calls WHERE dp IS NOT NULL GROUP BY vid")
def _(t):
    return S.site_depth(t.calls).select("vid", "sum_depth", "sumsq_depth")


@query("a12_site_mean_depth", "SELECT vid, round(avg(dp), 6) AS mean_depth, round(var_samp(dp), 6) AS var_depth FROM calls WHERE dp IS NOT NULL GROUP BY vid")
def _(t):
    return S.site_depth(t.calls).select("vid", "mean_depth", "var_depth")


@query("a13_geno_depth", "SELECT v.vid, s.sample, COALESCE(dp, -1) AS depth FROM variants v CROSS JOIN samples s LEFT JOIN calls c ON c.vid = v.vid AND c.sample = s.sample")
def _(t):
    return S.genotype_depth(t.variants, t.calls, t.samples)


@query("a14_site_quality", "SELECT chrom, pos, qual FROM variants WHERE qual IS NOT NULL")
def _(t):
    return t.variants.where("qual is not null").select("chrom", "pos", "qual")


@query("a15_singletons", f"WITH {CHR}, b AS (SELECT vid, allele, count(*) AS n, count(DISTINCT sample) AS k, min(sample) AS sample FROM chrs GROUP BY ALL) SELECT vid, allele, CASE WHEN n = 1 THEN 'S' ELSE 'D' END AS kind, sample FROM b WHERE n = 1 OR (n = 2 AND k = 1)")
def _(t):
    return S.singletons(t.calls)


@query("a16_filter_summary", f"""SELECT CASE WHEN filter IS NULL THEN '.' WHEN filter = 'PASS' THEN '' ELSE filter END AS filter, count(*) AS n_variants, count(*) FILTER ({ONE} AND {TS}) AS n_ts, count(*) FILTER ({ONE} AND NOT {TS}) AS n_tv,
 round(count(*) FILTER ({ONE} AND {TS}) / NULLIF(count(*) FILTER ({ONE} AND NOT {TS}), 0), 6) AS ratio FROM variants WHERE alt2 IS NULL GROUP BY 1""")
def _(t):
    return S.filter_summary(sites_of(t))


@query("a17_tstv_summary", f"""WITH p AS (SELECT CASE WHEN ref < alt1 THEN concat(ref, alt1) ELSE concat(alt1, ref) END AS pair FROM variants WHERE alt2 IS NULL AND {ONE})
 SELECT model, count(*) AS n FROM (SELECT pair AS model FROM p UNION ALL SELECT CASE WHEN pair IN ('AG', 'CT') THEN 'Ts' ELSE 'Tv' END FROM p) GROUP BY model""")
def _(t):
    return S.tstv_summary(sites_of(t))


@query("a18_tstv_by_count", f"""WITH {CHR}, c AS (SELECT vid, count(*) AS c FROM chrs WHERE allele = 1 GROUP BY vid), o AS (SELECT COALESCE(c, 0) AS alt_count, {TS} AS ts FROM variants LEFT JOIN c USING (vid) WHERE alt2 IS NULL AND {ONE}),
 b AS (SELECT alt_count, count(*) FILTER (ts) AS n_ts, count(*) FILTER (NOT ts) AS n_tv FROM o GROUP BY 1)
 SELECT CAST(r.i AS BIGINT) AS alt_count, COALESCE(n_ts, 0) AS n_ts, COALESCE(n_tv, 0) AS n_tv FROM range(40) r(i) LEFT JOIN b ON b.alt_count = r.i""")
def _(t):
    return S.tstv_by_count(sites_of(t), t.calls, 20)


@query("a19_vcf_tstv", f"SELECT count(*) FILTER ({ONE} AND {TS}) AS n_ts, count(*) FILTER ({ONE} AND NOT {TS}) AS n_tv, count(*) FILTER (NOT ({ONE})) AS n_skipped, count(*) FILTER (alt2 IS NOT NULL) AS n_multiallelic FROM variants")
def _(t):
    one, ts = S.is_single(F.col("ref"), F.col("alt1")), S.is_transition(F.col("ref"), F.col("alt1"))
    return t.variants.agg(F.count_if(one & ts).alias("n_ts"), F.count_if(one & ~ts).alias("n_tv"), F.count_if(~one).alias("n_skipped"), F.count_if(F.col("alt2").isNotNull()).alias("n_multiallelic"))


@query("a20_indel_hist", """WITH a AS (SELECT ref, alt1 AS alt FROM variants UNION ALL SELECT ref, alt2 FROM variants WHERE alt2 IS NOT NULL),
 b AS (SELECT CAST(length(alt) - length(ref) AS INT) AS length, count(*) AS n FROM a WHERE regexp_matches(ref, '^[ACGT]+$') AND regexp_matches(alt, '^[ACGT]+$') AND (length(ref) <> length(alt) OR length(ref) = 1) GROUP BY 1)
 SELECT length, n, round(100.0 * n / SUM(n) OVER (), 6) AS percent FROM b""")
def _(t):
    return S.indel_histogram(sites_of(t))


@query("a31_site_pi", """WITH c AS (SELECT vid, a1 AS allele FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL UNION ALL SELECT vid, a2 FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
 p AS (SELECT vid, SUM(c) AS n, SUM(c * c) AS sq FROM (SELECT vid, allele, count(*) AS c FROM c GROUP BY ALL) GROUP BY vid) SELECT vid, round((n * n - sq) / NULLIF(n * (n - 1), 0), 6) AS pi FROM p""")
def _(t):
    return S.site_pi(t.calls)


FST = """o AS (SELECT c.*, pop FROM calls c JOIN samples USING (sample) WHERE a1 IS NOT NULL AND a2 IS NOT NULL), sz AS (SELECT vid, pop, count(*) AS n FROM o GROUP BY ALL),
 al AS (SELECT vid, a1 AS allele FROM o UNION SELECT vid, a2 FROM o), grid AS (SELECT sz.*, allele FROM sz JOIN al USING (vid)),
 got AS (SELECT o.vid, o.pop, al.allele, SUM(CAST(a1 = al.allele AS INT) + CAST(a2 = al.allele AS INT)) AS c, count(*) FILTER (a1 <> a2 AND (a1 = al.allele OR a2 = al.allele)) AS h FROM o JOIN al USING (vid) GROUP BY ALL),
 cell AS (SELECT grid.vid, allele, n, COALESCE(c, 0) / (2 * n) AS p, COALESCE(h, 0) / n AS h FROM grid LEFT JOIN got USING (vid, pop, allele)),
 b AS (SELECT vid, allele, count(*) AS r, SUM(n) AS s, SUM(n * n) AS ss, SUM(n * p) AS np, SUM(n * p * p) AS npp, SUM(n * h) AS nh FROM cell GROUP BY ALL HAVING count(*) > 1),
 q AS (SELECT vid, r, s / r AS nbar, np / s AS pbar, nh / s AS hbar, (s - ss / s) / (r - 1) AS nc, (npp - s * (np / s) * (np / s)) / ((r - 1) * (s / r)) AS var FROM b),
 terms AS (SELECT vid, nbar / nc * (var - (pbar * (1 - pbar) - var * (r - 1) / r - hbar / 4) / (nbar - 1)) AS a, nbar / (nbar - 1) * (pbar * (1 - pbar) - var * (r - 1) / r - hbar * (2 * nbar - 1) / (4 * nbar)) AS bb, hbar / 2 AS cc FROM q WHERE nbar > 1),
 fst AS (SELECT vid, SUM(a) AS num, SUM(a + bb + cc) AS den FROM terms GROUP BY vid)"""


@query("a32_weir_fst", f"WITH {FST} SELECT vid, round(CASE WHEN abs(den) > 1e-12 THEN num / den END, 10) + 0.0 AS fst FROM fst")
def _(t):
    return S.weir_fst(t.calls, t.samples)


@query("a32_weir_fst_global", f"WITH {FST} SELECT round(avg(CASE WHEN abs(den) > 1e-12 THEN num / den END), 6) AS mean_fst, round(SUM(num) / SUM(den), 6) AS weighted_fst FROM fst")
def _(t):
    return S.fst_terms(t.calls, t.samples).agg(S.rounded(F.avg(F.when(F.abs("den") > 1e-12, F.col("num") / F.col("den")))).alias("mean_fst"), S.rounded(F.sum("num") / F.sum("den")).alias("weighted_fst"))


@query("a41_record_stats", f"""WITH {CHR}, {GENO}, p AS (SELECT vid, SUM(c * c) AS sq, SUM(c) AS chr, SUM(CASE WHEN allele > 0 THEN c ELSE 0 END) AS alt FROM (SELECT vid, allele, count(*) AS c FROM chrs GROUP BY ALL) GROUP BY vid)
 SELECT v.vid, COALESCE(n, 0) AS num_called, round(COALESCE(n, 0) / 20, 6) AS call_rate, COALESCE(hom_ref, 0) AS num_hom_ref, COALESCE(het, 0) AS num_het, COALESCE(hom_alt, 0) AS num_hom_alt, 20 - COALESCE(n, 0) AS num_unknown,
 round(alt / chr, 6) AS aaf, round(chr / NULLIF(chr - 1, 0) * 2 * (alt / chr) * (1 - alt / chr), 6) AS nucl_diversity, round(1 - sq / (chr * chr), 6) AS heterozygosity
 FROM variants v LEFT JOIN g USING (vid) LEFT JOIN p USING (vid)""")
def _(t):
    return S.record_stats(sites_of(t), t.calls, 20)


@query("a45_fill_an_ac", f"WITH {COUNTS} SELECT vid, any_value(total) AS an, string_agg(CAST(n AS VARCHAR), ',' ORDER BY allele) FILTER (allele > 0) AS ac FROM cnt GROUP BY vid")
def _(t):
    c = S.allele_counts(sites_of(t), t.calls).where("allele > 0")
    return c.groupBy("vid").agg(F.first("total").alias("an"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("allele", "n"))), lambda x: x["n"].cast("string")), ",").alias("ac"))


@query("a45_fill_icf", f"WITH {GENO}, b AS (SELECT g.*, (2 * hom_ref + het) / (2 * n) AS q FROM g JOIN variants USING (vid) WHERE alt2 IS NULL) SELECT vid, round(1 - (het / n) / NULLIF(2 * q * (1 - q), 0), 6) AS icf FROM b")
def _(t):
    g = S.genotype_counts(t.calls.join(S.biallelic(sites_of(t)).select("vid"), "vid"))
    q = (2 * F.col("hom_ref") + F.col("het")) / (2 * F.col("n"))
    return g.select("vid", S.rounded(1 - S.ratio(F.col("het") / F.col("n"), 2 * q * (1 - q))).alias("icf"))
