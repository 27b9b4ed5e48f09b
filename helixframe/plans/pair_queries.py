"""Queries of pair statistics and of statistics along the genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import pairs as P
from helixframe.operators import windows as W
from helixframe.operators.autozygosity import autozygous_runs
from helixframe.plans.registry import query
from helixframe.plans.site_queries import CHR, FST, ONE, TS, sites_of
from helixframe.sources.scratch import saved

WIN = 400
_OK = "o AS (SELECT c.vid, sample, a1, a2, phased, chrom, pos FROM calls c JOIN variants v USING (vid) WHERE alt2 IS NULL AND a1 <= 1 AND a2 <= 1)"
_NEAR = f"a.chrom = b.chrom AND (b.pos > a.pos OR (b.pos = a.pos AND b.vid > a.vid)) AND b.pos - a.pos <= {WIN}"
_R2 = """SELECT vid, vid2, n AS n_indv, round((n * sxu - sx * su) * CAST(n * sxu - sx * su AS DOUBLE) / NULLIF((n * sxx - sx * sx) * CAST(n * suu - su * su AS DOUBLE), 0), 6) AS r2 FROM
 (SELECT a.vid, b.vid AS vid2, count(*) AS n, SUM(a.a1 + a.a2) AS sx, SUM(b.a1 + b.a2) AS su, SUM((a.a1 + a.a2) * (a.a1 + a.a2)) AS sxx, SUM((b.a1 + b.a2) * (b.a1 + b.a2)) AS suu, SUM((a.a1 + a.a2) * (b.a1 + b.a2)) AS sxu
  FROM o a JOIN o b ON a.sample = b.sample AND {} GROUP BY ALL)"""
_HAP = """SELECT vid, vid2, n AS n_chr, round(d * d / NULLIF(pa * (1 - pa) * pb * (1 - pb), 0), 6) AS r2, round(d, 6) AS d, round(d / NULLIF(CASE WHEN d < 0 THEN LEAST(pa * pb, (1 - pa) * (1 - pb)) ELSE LEAST(pa * (1 - pb), (1 - pa) * pb) END, 0), 6) AS dprime FROM
 (SELECT vid, vid2, n, na / n AS pa, nb / n AS pb, n11 / n - (na / n) * (nb / n) AS d FROM (SELECT a.vid, b.vid AS vid2, 2 * count(*) AS n, SUM(a.a1 * b.a1 + a.a2 * b.a2) AS n11, SUM(a.a1 + a.a2) AS na, SUM(b.a1 + b.a2) AS nb
  FROM o a JOIN o b ON a.sample = b.sample AND a.phased AND b.phased AND {} GROUP BY ALL))"""
_LIST = "a.chrom = b.chrom AND a.vid <> b.vid AND a.vid % 50 = 0"
_OTHER = "a.chrom <> b.chrom AND a.vid % 50 = 0"


@query("a24_hap_r2", f"WITH {_OK} {_HAP.format(_NEAR)}")
def _(t):
    return P.haplotype_r2(P.near_pairs(sites_of(t), t.calls, WIN))


@query("a25_geno_r2", f"WITH {_OK} {_R2.format(_NEAR)}")
def _(t):
    return P.genotype_r2(P.near_pairs(sites_of(t), t.calls, WIN))


@query("a26_geno_chisq", f"""WITH {_OK}, c AS (SELECT a.vid, b.vid AS vid2, a.a1 + a.a2 AS i, b.a1 + b.a2 AS j, count(*) AS n FROM o a JOIN o b ON a.sample = b.sample AND {_NEAR} GROUP BY ALL),
 m AS (SELECT *, SUM(n) OVER (PARTITION BY vid, vid2, i) AS ni, SUM(n) OVER (PARTITION BY vid, vid2, j) AS nj FROM c)
, x AS (SELECT vid, vid2, CAST(SUM(n) AS BIGINT) AS n_indv, SUM(n) * (SUM(n * n / (ni * nj)) - 1) AS x, CAST((count(DISTINCT i) - 1) * (count(DISTINCT j) - 1) AS INT) AS dof FROM m GROUP BY vid, vid2)
 SELECT vid, vid2, n_indv, round(x, 6) AS chisq, dof, round(CASE WHEN dof = 0 THEN NULL WHEN x < 1e-13 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 150), lambda k: exp((k + dof / 2.0) * ln(x / 2) - x / 2 - lgamma(k + dof / 2.0 + 1)))) END, 6) AS p FROM x""")
def _(t):
    return P.genotype_chisq(P.near_pairs(sites_of(t), t.calls, WIN))


@query("a27_interchrom_geno_r2", f"WITH {_OK} {_R2.format('a.chrom <> b.chrom')}")
def _(t):
    return P.genotype_r2(P.other_chromosome_pairs(sites_of(t), t.calls))


@query("a28_interchrom_hap_r2", f"WITH {_OK} {_HAP.format(_OTHER)}")
def _(t):
    return P.haplotype_r2(P.other_chromosome_pairs(sites_of(t), t.calls, t.variants.where("vid % 50 = 0")))


@query("a29_hap_r2_positions", f"WITH {_OK} {_HAP.format(_LIST)}")
def _(t):
    return P.haplotype_r2(P.listed_pairs(sites_of(t), t.calls, t.variants.where("vid % 50 = 0")))


@query("a30_geno_r2_positions", f"WITH {_OK} {_R2.format(_LIST)}")
def _(t):
    return P.genotype_r2(P.listed_pairs(sites_of(t), t.calls, t.variants.where("vid % 50 = 0")))


@query("a33_relatedness_yang", f"""WITH {_OK}, f AS (SELECT vid, SUM(a1 + a2) / (2 * count(*)) AS f FROM calls WHERE a1 <= 1 AND a2 <= 1 GROUP BY vid)
 SELECT a.sample, b.sample AS sample2, round(avg(CASE WHEN a.sample = b.sample THEN ((a.a1 + a.a2) * (a.a1 + a.a2) - (1 + 2 * f) * (a.a1 + a.a2) + 2 * f * f) / (2 * f * (1 - f)) ELSE (a.a1 + a.a2 - 2 * f) * (b.a1 + b.a2 - 2 * f) / (2 * f * (1 - f)) END) + max(CASE WHEN a.sample = b.sample THEN 1.0 ELSE 0.0 END), 6) AS ajk
 FROM o a JOIN o b ON a.vid = b.vid AND a.sample <= b.sample JOIN f ON f.vid = a.vid WHERE f > 0 AND f < 1 GROUP BY a.sample, b.sample""")
def _(t):
    return P.relatedness_yang(sites_of(t), t.calls)


@query("a34_relatedness_king", f"""WITH {_OK}, p AS (SELECT a.sample, b.sample AS sample2, count(*) FILTER (a.a1 + a.a2 = 1 AND b.a1 + b.a2 = 1) AS n_het_het, count(*) FILTER (abs(a.a1 + a.a2 - b.a1 - b.a2) = 2) AS n_opposite, count(*) FILTER (a.a1 + a.a2 = 1) AS hs, count(*) FILTER (b.a1 + b.a2 = 1) AS ht
 FROM o a JOIN o b ON a.vid = b.vid AND a.sample <= b.sample GROUP BY ALL) SELECT sample, sample2, n_het_het, n_opposite, round((n_het_het - 2 * n_opposite) / NULLIF(hs + ht, 0), 6) AS phi FROM p""")
def _(t):
    return P.relatedness_king(sites_of(t), t.calls)


@query("a35_gram_matrix", f"""WITH {_OK}, m AS (SELECT vid, avg(a1 + a2) AS m FROM o GROUP BY vid HAVING avg(a1 + a2) > 0 AND avg(a1 + a2) < 2)
 SELECT a.sample, b.sample AS sample2, round(SUM((a.a1 + a.a2 - m) * (b.a1 + b.a2 - m) / (m / 2 * (1 - m / 2))) / (SELECT count(*) FROM m), 6) AS g FROM o a JOIN o b ON a.vid = b.vid AND a.sample <= b.sample JOIN m ON m.vid = a.vid GROUP BY ALL""")
def _(t):
    return P.gram_matrix(sites_of(t), t.calls).withColumn("g", F.round("g", 6))


@query("a35_pca")
def _(t):
    return P.pca(sites_of(t), t.calls)


@query("a36_pca_snp_loadings")
def _(t):
    v = sites_of(t)
    return P.pca_loadings(v, t.calls, P.pca(v, t.calls, 2))


@query("a37_haplotype_count", """WITH b AS (SELECT iid, chrom, start_pos, end_pos FROM intervals), o AS (SELECT iid, vid, pos FROM variants v JOIN b ON b.chrom = v.chrom AND pos >= start_pos AND pos < end_pos WHERE alt2 IS NULL), n AS (SELECT iid, count(*) AS n_snp FROM o GROUP BY iid),
 h AS (SELECT iid, sample, 0 AS h, pos, a1 AS a FROM o JOIN calls USING (vid) WHERE phased AND a1 IS NOT NULL AND a2 IS NOT NULL UNION ALL SELECT iid, sample, 1, pos, a2 FROM o JOIN calls USING (vid) WHERE phased AND a1 IS NOT NULL AND a2 IS NOT NULL),
 s AS (SELECT iid, sample, h, count(*) AS k, string_agg(CAST(a AS VARCHAR), '' ORDER BY pos, a) AS hap FROM h GROUP BY ALL), u AS (SELECT iid, n_snp, hap, count(*) AS m FROM s JOIN n USING (iid) WHERE k = n_snp GROUP BY ALL), f AS (SELECT iid, n_snp, m, count(*) AS f FROM u GROUP BY ALL)
 SELECT iid, n_snp, CAST(SUM(f) AS BIGINT) AS n_unique, string_agg(concat(m, ':', f), ',' ORDER BY m, f) AS spectrum FROM f GROUP BY iid, n_snp""")
def _(t):
    return W.haplotype_counts(sites_of(t), t.calls, t.intervals.select("iid", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")))


@query("n1_snp_density", """WITH b AS (SELECT chrom, pos // 5000 AS bin, count(DISTINCT pos) AS n FROM variants GROUP BY ALL), e AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY chrom)
 SELECT e.chrom, e.bin * 5000 AS start, COALESCE(n, 0) AS n, round(COALESCE(n, 0) * 1000 / 5000, 6) AS per_kb FROM e LEFT JOIN b ON b.chrom = e.chrom AND b.bin = e.bin""")
def _(t):
    return W.snp_density(t.variants, 5000)


@query("n2_tstv_bins", f"""WITH b AS (SELECT chrom, pos // 2000 AS bin, count(*) AS n, count(*) FILTER ({TS}) AS ts, count(*) FILTER (NOT {TS}) AS tv FROM variants WHERE alt2 IS NULL AND {ONE} GROUP BY ALL), e AS (SELECT chrom, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY chrom)
 SELECT e.chrom, e.bin * 2000 AS start, COALESCE(n, 0) AS n_snps, round(COALESCE(ts / NULLIF(tv, 0), 0), 6) AS ratio FROM e LEFT JOIN b ON b.chrom = e.chrom AND b.bin = e.bin""")
def _(t):
    return W.tstv_bins(sites_of(t), 2000)


@query("n3_tstv_by_qual", f"""WITH o AS (SELECT qual, {TS} AS t FROM variants WHERE alt2 IS NULL AND {ONE} AND qual IS NOT NULL), b AS (SELECT qual, count(*) FILTER (t) AS ts, count(*) FILTER (NOT t) AS tv FROM o GROUP BY qual)
 SELECT qual, CAST(COALESCE(SUM(ts) OVER lo, 0) AS BIGINT) AS ts_below, CAST(COALESCE(SUM(tv) OVER lo, 0) AS BIGINT) AS tv_below, CAST(COALESCE(SUM(ts) OVER hi, 0) AS BIGINT) AS ts_above, CAST(COALESCE(SUM(tv) OVER hi, 0) AS BIGINT) AS tv_above FROM b
 WINDOW lo AS (ORDER BY qual ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (ORDER BY qual ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def _(t):
    return W.tstv_by_quality(sites_of(t))


@query("n4_tajima_d", f"""WITH {CHR}, h AS (SELECT 1 / i AS x, 1 / (i * i) AS y FROM range(1, 40) r(i)), k AS (SELECT SUM(x) AS a1, SUM(y) AS a2, 40.0::DOUBLE AS n FROM h), k2 AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM k),
 f AS (SELECT vid, avg(allele) AS p FROM chrs GROUP BY vid), b AS (SELECT chrom, pos // 10000 AS bin, count(*) AS s, SUM(2 * p * (1 - p) * 40 / 39) AS pi FROM variants JOIN f USING (vid) WHERE alt2 IS NULL AND p > 0 AND p < 1 GROUP BY ALL), e AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY chrom)
 SELECT e.chrom, e.bin * 10000 AS start, COALESCE(s, 0) AS n_snps, round((pi - s / a1) / NULLIF(sqrt(e1 * s + e2 * s * (s - 1)), 0), 5) AS d FROM e LEFT JOIN b ON b.chrom = e.chrom AND b.bin = e.bin CROSS JOIN k2""")
def _(t):
    return W.tajima_d(sites_of(t), t.calls, 10000, 20)


_WINDOWS = "unnest(range(GREATEST(CAST(ceil((pos - 10000) / 5000) AS BIGINT), 0), CAST(ceil(pos / 5000) AS BIGINT))) AS k"


@query("n5_window_pi", f"""WITH c AS (SELECT vid, a1 AS allele FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL UNION ALL SELECT vid, a2 FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
 p AS (SELECT vid, SUM(c) AS n, SUM(c * c) AS sq FROM (SELECT vid, allele, count(*) AS c FROM c GROUP BY ALL) GROUP BY vid), w AS (SELECT chrom, {_WINDOWS}, n * n - sq AS differ, n * (n - 1) AS pairs FROM p JOIN variants USING (vid))
 SELECT chrom, k * 5000 + 1 AS start, k * 5000 + 10000 AS "end", count(*) FILTER (differ > 0) AS n_sites, round(SUM(differ) / (SUM(pairs) + (10000 - count(*)) * 40 * 39), 8) AS pi FROM w GROUP BY chrom, k HAVING count(*) FILTER (differ > 0) > 0""")
def _(t):
    return W.window_pi(t.variants, t.calls, 10000, 5000, 20)


@query("n6_window_fst", f"WITH {FST}, w AS (SELECT chrom, {_WINDOWS}, num, den FROM fst JOIN variants USING (vid) WHERE abs(den) > 1e-12) SELECT chrom, k * 5000 + 1 AS start, count(*) AS n_sites, round(SUM(num) / NULLIF(SUM(den), 0), 6) AS weighted, round(avg(num / den), 6) AS mean FROM w GROUP BY chrom, k")
def _(t):
    return W.window_fst(t.variants, t.calls, t.samples, 10000, 5000)


@query("n7_lroh")
def _(t):
    return autozygous_runs(sites_of(t), t.calls, error=0.4, prior=0.5, threshold=0.5)


_OTHER_CALLS = "CASE WHEN gq % 9 = 0 THEN a2 ELSE a1 END"


@query("n8_switch_error", """WITH l AS (SELECT vid, sample, a1, a2 FROM calls WHERE phased AND a1 <> a2), r AS (SELECT vid, sample, CASE WHEN gq % 9 = 0 THEN a2 ELSE a1 END AS b1, CASE WHEN gq % 9 = 0 THEN a1 ELSE a2 END AS b2 FROM calls WHERE phased AND a1 <> a2),
 j AS (SELECT sample, chrom, pos, vid, a1 = b1 AS same FROM l JOIN r USING (vid, sample) JOIN variants USING (vid)), f AS (SELECT *, same <> lag(same) OVER (PARTITION BY sample, chrom ORDER BY pos, vid) AS flip FROM j) SELECT sample, count(*) AS n_het, count(*) FILTER (flip) AS n_switch FROM f GROUP BY sample""")
def _(t):
    c = t.calls
    swap = F.col("gq") % 9 == 0
    other = c.withColumn("x", F.when(swap, F.col("a2")).otherwise(F.col("a1"))).withColumn("a2", F.when(swap, F.col("a1")).otherwise(F.col("a2"))).withColumn("a1", F.col("x")).drop("x")
    return W.switch_errors(c, other, t.variants)


_CHUNKS = """o AS (SELECT c.*, chrom, pos FROM calls c JOIN variants USING (vid)), k AS (SELECT *, pos // 20000 AS r FROM o),
 ch AS (SELECT sample, chrom, pos, COALESCE(phased, false) AS phased, a1, a2, r AS rank FROM k UNION ALL SELECT sample, chrom, pos, COALESCE(phased, false), CASE WHEN (sample + r) % 3 = 0 AND pos % 7 > 0 THEN a2 ELSE a1 END, CASE WHEN (sample + r) % 3 = 0 AND pos % 7 > 0 THEN a1 ELSE a2 END, r + 1 FROM k WHERE pos % 20000 > 15000),
 fo AS (SELECT chrom, rank, lag(rank) OVER (PARTITION BY chrom ORDER BY rank) AS before FROM (SELECT DISTINCT chrom, rank FROM ch)),
 sh AS (SELECT a.sample, a.chrom, a.pos, a.rank, a.a1, COALESCE(a.a2, a.a1) AS a2, b.a1 AS b1, COALESCE(b.a2, b.a1) AS b2, a.phased AND b.phased AS ok FROM ch a JOIN fo ON fo.chrom = a.chrom AND fo.rank = a.rank JOIN ch b ON b.sample = a.sample AND b.chrom = a.chrom AND b.pos = a.pos AND b.rank = fo.before),
 pl AS (SELECT chrom, rank, pos, CASE WHEN count(*) = 1 THEN 0.25 ELSE LEAST(GREATEST(count(*) FILTER (NOT ((a1 IS NOT DISTINCT FROM b1 AND a2 IS NOT DISTINCT FROM b2) OR (a1 IS NOT DISTINCT FROM b2 AND a2 IS NOT DISTINCT FROM b1))) / count(*)::DOUBLE, 1 / count(*)::DOUBLE), 1 - 1 / count(*)::DOUBLE) END AS p FROM sh GROUP BY ALL),
 su AS (SELECT sample, chrom, rank, count(*) AS n_sites, SUM(CASE WHEN a1 = b1 THEN log10(p * p + (1 - p) * (1 - p)) ELSE log10(2 * p * (1 - p)) END) AS m, SUM(CASE WHEN a1 = b1 THEN log10(2 * p * (1 - p)) ELSE log10(p * p + (1 - p) * (1 - p)) END) AS x
  FROM sh JOIN pl USING (chrom, rank, pos) WHERE ok AND a1 <> a2 AND b1 <> b2 AND ((a1 = b1 AND a2 = b2) OR (a1 = b2 AND a2 = b1)) GROUP BY ALL),
 ev AS (SELECT sample, chrom, rank, COALESCE(n_sites, 0) AS n_sites, COALESCE(m, log10(0.5)) AS m, COALESCE(x, log10(0.5)) AS x FROM (SELECT DISTINCT sample, chrom, rank FROM ch) JOIN fo USING (chrom, rank) LEFT JOIN su USING (sample, chrom, rank) WHERE before IS NOT NULL),
 tl AS (SELECT sample, chrom, rank, n_sites, m, x, SUM(CASE WHEN x - m > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY rank) % 2 = 1 AS swapped FROM ev)"""


def _chunked(t):
    o = t.calls.join(t.variants.select("vid", "chrom", "pos"), "vid").withColumn("rank", F.floor(F.col("pos") / 20000))
    swap = ((F.col("sample") + F.col("rank")) % 3 == 0) & (F.col("pos") % 7 > 0)
    more = o.where("pos % 20000 > 15000").withColumn("x", F.when(swap, F.col("a2")).otherwise(F.col("a1"))).withColumn("a2", F.when(swap, F.col("a1")).otherwise(F.col("a2"))).withColumn("a1", F.col("x")).withColumn("rank", F.col("rank") + 1).drop("x")
    both = saved(o.unionByName(more).withColumn("chunk", F.concat_ws(":", "chrom", F.col("rank").cast("string"))), "chunks")
    return W.phase_join(both.drop("rank"), both.select("chunk", "chrom", "rank").distinct(), 1.5)


@query("n9_phased_join", f"WITH {_CHUNKS} SELECT sample, chrom, rank, n_sites, round(m, 6) AS lk_match, round(x, 6) AS lk_mismatch, round(abs(m - x), 6) AS quality, swapped FROM tl")
def _(t):
    return _chunked(t)[0].select("sample", "chrom", "rank", "n_sites", *[F.round(c, 6).alias(c) for c in ("lk_match", "lk_mismatch", "quality")], "swapped")


@query("n9_joined_calls", f"""WITH {_CHUNKS}, en AS (SELECT chrom, rank, min(pos) AS f, max(pos) AS t FROM pl GROUP BY ALL), lo AS (SELECT chrom, pos, CASE WHEN t - pos > pos - f THEN rank ELSE before END AS rank FROM pl JOIN en USING (chrom, rank) JOIN fo USING (chrom, rank)),
 ke AS (SELECT ch.*, swapped, COALESCE(abs(m - x) < 1.5, false) AS weak FROM ch ANTI JOIN lo USING (chrom, pos, rank) LEFT JOIN tl USING (sample, chrom, rank)), nu AS (SELECT *, SUM(n) OVER (PARTITION BY sample, chrom ORDER BY rank) AS block FROM (SELECT sample, chrom, rank, max(CAST(weak AS INT)) AS n FROM ke GROUP BY ALL)),
 fi AS (SELECT *, min(pos) OVER (PARTITION BY sample, chrom, block) AS ps FROM ke JOIN nu USING (sample, chrom, rank))
 SELECT sample, chrom, pos, CASE WHEN COALESCE(swapped, false) AND a2 IS NOT NULL THEN a2 ELSE a1 END AS a1, CASE WHEN COALESCE(swapped, false) AND a2 IS NOT NULL THEN a1 ELSE a2 END AS a2, phased, ps FROM fi""")
def _(t):
    return _chunked(t)[1]
