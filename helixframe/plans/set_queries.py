"""Queries that compare, intersect, merge and subset variant sets. Set a: parts but every fifth; b: but every seventh, some
moved or with another reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import mapping as M
from helixframe.operators import sets as G
from helixframe.operators.merging import diff_sites
from helixframe.operators.ranges import numbered
from helixframe.plans.registry import query
from helixframe.plans.site_queries import sites_of

_AB = """a AS (SELECT vid, chrom, pos, ref, alt1, alt2, qual, filter, size FROM variants WHERE vid % 5 <> 0),
 b AS (SELECT vid, chrom, CASE WHEN vid % 34 = 17 THEN pos + 1 ELSE pos END AS pos, CASE WHEN vid % 11 = 0 THEN 'N' WHEN vid % 13 = 0 THEN concat(ref, 'T') ELSE ref END AS ref, alt1, alt2, qual + 1 AS qual, filter, size FROM variants WHERE vid % 7 <> 0)"""
_C2 = "cb AS (SELECT vid, sample, CASE WHEN (vid + sample) % 9 = 0 THEN 1 - LEAST(a1, 1) ELSE a1 END AS a1, a2 FROM calls WHERE sample < 16)"


def two(t):
    v = sites_of(t)
    a = v.where("vid % 5 <> 0")
    b = v.where("vid % 7 <> 0").withColumn("pos", F.when(F.col("vid") % 34 == 17, F.col("pos") + 1).otherwise(F.col("pos"))).withColumn("ref", F.when(F.col("vid") % 11 == 0, "N").when(F.col("vid") % 13 == 0, F.concat("ref", F.lit("T"))).otherwise(F.col("ref"))).withColumn("qual", F.col("qual") + 1)
    return a, b


def second_calls(t):
    return t.calls.where("sample < 16").withColumn("a1", F.when((F.col("vid") + F.col("sample")) % 9 == 0, 1 - F.least("a1", F.lit(1))).otherwise(F.col("a1"))).select("vid", "sample", "a1", "a2")


@query("j16_diff_sites", f"""WITH RECURSIVE {_AB}, x AS (SELECT chrom, pos, ref, row_number() OVER (PARTITION BY chrom ORDER BY pos, ref) AS i FROM a), y AS (SELECT chrom, pos, ref, row_number() OVER (PARTITION BY chrom ORDER BY pos, ref) AS j FROM b),
 s AS (SELECT DISTINCT chrom, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS pos1, CAST(NULL AS BIGINT) AS pos2, CAST('' AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS ref1, CAST(NULL AS VARCHAR) AS ref2 FROM (SELECT chrom FROM x UNION SELECT chrom FROM y)
  UNION ALL SELECT chrom, i + CAST(kind <> '2' AS BIGINT), j + CAST(kind <> '1' AS BIGINT), CASE WHEN kind <> '2' THEN p END, CASE WHEN kind <> '1' THEN q END, kind, CASE WHEN kind <> '2' THEN r END, CASE WHEN kind <> '1' THEN t END FROM
   (SELECT s.chrom, s.i, s.j, x.pos AS p, y.pos AS q, x.ref AS r, y.ref AS t, CASE WHEN y.pos IS NULL THEN '1' WHEN x.pos IS NULL THEN '2' WHEN x.pos = y.pos THEN CASE WHEN x.ref = y.ref OR x.ref IN ('N', '.', '') OR y.ref IN ('N', '.', '') THEN 'B' ELSE 'O' END
      WHEN x.pos < y.pos THEN CASE WHEN y.pos < x.pos + length(x.ref) THEN 'O' ELSE '1' END ELSE CASE WHEN x.pos < y.pos + length(y.ref) THEN 'O' ELSE '2' END END AS kind
    FROM s LEFT JOIN x ON x.chrom = s.chrom AND x.i = s.i LEFT JOIN y ON y.chrom = s.chrom AND y.j = s.j WHERE x.pos IS NOT NULL OR y.pos IS NOT NULL))
 SELECT chrom, pos1, pos2, kind, ref1, ref2 FROM s WHERE kind <> ''""")
def _(t):
    return diff_sites(*two(t))


@query("j17_diff_indv", "WITH x AS (SELECT DISTINCT sample FROM calls WHERE sample > 2), y AS (SELECT DISTINCT sample FROM calls WHERE sample < 16) SELECT COALESCE(x.sample, y.sample) AS sample, CASE WHEN x.sample IS NULL THEN '2' WHEN y.sample IS NULL THEN '1' ELSE 'B' END AS kind FROM x FULL JOIN y ON x.sample = y.sample")
def _(t):
    return G.diff_samples(t.calls.where("sample > 2"), t.calls.where("sample < 16"))


@query("j18_walk_together", f"WITH {_AB} SELECT chrom, pos, min(vid) FILTER (s = 'a') AS a, min(vid) FILTER (s = 'b') AS b FROM (SELECT chrom, pos, vid, 'a' AS s FROM a UNION ALL SELECT chrom, pos, vid, 'b' FROM b) GROUP BY chrom, pos")
def _(t):
    return G.walk_together(dict(zip("ab", two(t), strict=True)))


@query("j20_merge_sites", f"""WITH {_AB}, u AS (SELECT *, 'a' AS src FROM a UNION ALL SELECT *, 'b' FROM b), r AS (SELECT chrom, pos, arg_max(ref, (length(ref), ref)) AS long FROM u GROUP BY ALL),
 o AS (SELECT u.*, long FROM u JOIN r ON u.chrom = r.chrom AND u.pos = r.pos), l AS (SELECT chrom, pos, concat(alt1, substr(long, length(ref) + 1)) AS alt FROM o UNION SELECT chrom, pos, concat(alt2, substr(long, length(ref) + 1)) FROM o WHERE alt2 IS NOT NULL),
 g AS (SELECT chrom, pos, string_agg(alt, ',' ORDER BY alt) AS alts FROM l GROUP BY ALL), ff AS (SELECT DISTINCT chrom, pos, unnest(CASE WHEN filter IS NULL OR filter = 'PASS' THEN [NULL] ELSE string_split(filter, ';') END) AS f FROM o), fl AS (SELECT chrom, pos, COALESCE(string_agg(f, ';' ORDER BY f), '') AS filters FROM ff GROUP BY ALL),
 q AS (SELECT chrom, pos, round(SUM(qual * CASE src WHEN 'a' THEN 20 ELSE 16 END) / SUM(CASE src WHEN 'a' THEN 20 ELSE 16 END), 2) AS qual, CAST(SUM(size) AS BIGINT) AS size, concat_ws(',', CAST(SUM(size) AS VARCHAR), CAST(count(*) AS VARCHAR), '0') AS counts, string_agg(DISTINCT src, '+' ORDER BY src) AS sources FROM o GROUP BY ALL),
 s AS (SELECT chrom, pos, string_agg(DISTINCT t, ',' ORDER BY t) AS sf FROM (SELECT chrom, pos, concat(CASE src WHEN 'a' THEN '0' ELSE '1' END, CASE WHEN filter <> 'PASS' THEN 'f' ELSE '' END) AS t FROM o) GROUP BY ALL), i AS (SELECT o.chrom, o.pos, arg_min(concat(v.info, CASE src WHEN 'b' THEN ';B' ELSE '' END), (src, o.vid)) AS info FROM o JOIN variants v ON v.vid = o.vid GROUP BY ALL),
 c AS (SELECT 'a' AS src, vid, a1, a2 FROM calls UNION ALL SELECT 'b', vid, a1, a2 FROM calls WHERE sample < 16), n AS (SELECT chrom, pos, count(x) AS an, count(x) FILTER (x > 0) AS ac FROM (SELECT chrom, pos, unnest([a1, a2]) AS x FROM c JOIN o USING (src, vid)) GROUP BY ALL)
 SELECT r.chrom, r.pos, long AS ref, alts, qual, filters, sources, sf, COALESCE(an, 0) AS an, COALESCE(ac, 0) AS ac, size, counts, info FROM r JOIN s USING (chrom, pos) JOIN i USING (chrom, pos) JOIN g USING (chrom, pos) JOIN fl USING (chrom, pos) JOIN q USING (chrom, pos) LEFT JOIN n USING (chrom, pos)""")
def _(t):
    a, b = (x.withColumn("counts", F.array("size", F.lit(1).cast("long"), F.lit(0).cast("long"))) for x in two(t))
    b = b.withColumn("info", F.concat("info", F.lit(";B")))
    got = G.merge_sites({"a": a, "b": b}, {"a": t.calls, "b": t.calls.where("sample < 16")}, {"a": 20, "b": 16}, ("size", "counts"), ("info",))[0]
    return got.withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ","))


_MERGED = f"""WITH {_AB}, u AS (SELECT *, 'a' AS src FROM a UNION ALL SELECT *, 'b' FROM b), r AS (SELECT chrom, pos, arg_max(ref, (length(ref), ref)) AS long FROM u GROUP BY ALL), o AS (SELECT u.*, long FROM u JOIN r ON u.chrom = r.chrom AND u.pos = r.pos),
 s AS (SELECT chrom, pos, src, vid, 1 AS k, concat(alt1, substr(long, length(ref) + 1)) AS alt FROM o UNION ALL SELECT chrom, pos, src, vid, 2, concat(alt2, substr(long, length(ref) + 1)) FROM o WHERE alt2 IS NOT NULL),
 l AS (SELECT chrom, pos, list(DISTINCT alt ORDER BY alt) AS alts FROM s GROUP BY ALL), p AS (SELECT src, vid, k, CAST(list_position(alts, alt) AS INT) AS new FROM s JOIN l USING (chrom, pos)),
 c AS (SELECT 'a' AS src, vid, sample, a1, a2 FROM calls UNION ALL SELECT 'b', vid, sample, a1, a2 FROM calls WHERE sample < 16)
 SELECT o.chrom, o.pos, c.src, c.sample, CASE WHEN c.a1 = 0 THEN 0 ELSE x.new END AS a1, CASE WHEN c.a2 = 0 THEN 0 ELSE y.new END AS a2 FROM c JOIN o USING (src, vid) LEFT JOIN p x ON x.src = c.src AND x.vid = c.vid AND x.k = c.a1 LEFT JOIN p y ON y.src = c.src AND y.vid = c.vid AND y.k = c.a2"""


@query("j20_merge_calls", _MERGED)
def _(t):
    a, b = two(t)
    return G.merge_sites({"a": a, "b": b}, {"a": t.calls, "b": t.calls.where("sample < 16")})[1]


@query("j20_merge_ref_for_missing", f"""{_MERGED} UNION ALL SELECT r.chrom, r.pos, w.src, w.sample, 0, 0 FROM r CROSS JOIN (SELECT 'a' AS src, sample FROM samples UNION ALL SELECT 'b', sample FROM samples WHERE sample < 16) w ANTI JOIN u ON u.chrom = r.chrom AND u.pos = r.pos AND u.src = w.src""")
def _(t):
    a, b = two(t)
    return G.merge_sites({"a": a, "b": b}, {"a": t.calls, "b": t.calls.where("sample < 16")}, samples={"a": t.samples, "b": t.samples.where("sample < 16")}, missing=0)[1]


_BASES = f"""{_C2}, al AS (SELECT vid, chrom, pos, [ref, alt1, alt2] AS l, alt2 IS NULL AS two FROM variants), x AS (SELECT vid, chrom, pos, sample, two, a1 + a2 AS dose, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN array_to_string(list_sort([l[a1 + 1], l[a2 + 1]]), '/') END AS bases FROM calls JOIN al USING (vid)),
 y AS (SELECT vid, sample, a1 + a2 AS dose2, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN array_to_string(list_sort([l[a1 + 1], l[a2 + 1]]), '/') END AS bases2 FROM cb JOIN al USING (vid)), j AS (SELECT * FROM x JOIN y USING (vid, sample))"""


for _name, _by in (("a38_diff_site_discordance", ("chrom", "pos")), ("a39_diff_indv_discordance", ("sample",))):

    @query(_name, f"WITH {_BASES} SELECT {', '.join(_by)}, count(*) AS n_common, count(*) FILTER (bases <> bases2) AS n_discordant, round(count(*) FILTER (bases <> bases2) / count(*), 6) AS rate FROM j WHERE bases IS NOT NULL AND bases2 IS NOT NULL GROUP BY ALL")
    def _(t, by=_by):
        v = sites_of(t)
        return G.discordance((v, t.calls), (v, second_calls(t)), list(by))


@query("a40_diff_discordance_matrix", f"WITH {_BASES} SELECT COALESCE(dose, 3) AS dose1, COALESCE(dose2, 3) AS dose2, count(*) AS n FROM j WHERE two GROUP BY ALL")
def _(t):
    v = sites_of(t)
    return G.discordance_matrix((v, t.calls), (v, second_calls(t)))


_CLASS = "CASE WHEN split_part({1}, '/', 1) <> split_part({1}, '/', 2) THEN CASE WHEN {0} <= 2 THEN 'het_RA' ELSE 'het_AA' END WHEN {0} = 0 THEN 'hom_RR' WHEN {1} IS NOT NULL THEN 'hom_AA' END"


@query("a44_compare_genotypes", f"""WITH {_BASES}, k AS (SELECT *, CASE WHEN bases IS NOT NULL THEN {_CLASS.format('dose', 'bases')} ELSE {_CLASS.format('dose2', 'bases2')} END AS class FROM j)
 SELECT class, count(*) FILTER (bases = bases2) AS n_match, count(*) FILTER (bases <> bases2) AS n_mismatch, count(*) FILTER (bases IS NOT NULL AND bases2 IS NULL) AS n_lost, count(*) FILTER (bases IS NULL AND bases2 IS NOT NULL) AS n_gained FROM k WHERE class IS NOT NULL GROUP BY class""")
def _(t):
    v = sites_of(t)
    return G.genotype_comparison((v, t.calls), (v, second_calls(t)))


_STRATA = f"""k AS (SELECT *, CASE WHEN bases IS NOT NULL THEN {_CLASS.format('dose', 'bases')} ELSE {_CLASS.format('dose2', 'bases2')} END AS class FROM j JOIN st USING ({{0}}))
 SELECT stratum, class, count(*) FILTER (bases = bases2) AS n_match, count(*) FILTER (bases <> bases2) AS n_mismatch, count(*) FILTER (bases IS NOT NULL AND bases2 IS NULL) AS n_lost, count(*) FILTER (bases IS NULL AND bases2 IS NOT NULL) AS n_gained FROM k WHERE class IS NOT NULL GROUP BY stratum, class"""


@query("a44_compare_by_frequency", f"""WITH {_BASES}, af AS (SELECT vid, count(*) FILTER (a > 0) / count(*) AS af FROM (SELECT vid, unnest([a1, a2]) AS a FROM calls) WHERE a IS NOT NULL GROUP BY vid), st AS (SELECT vid, round(LEAST(floor(round(af / 0.1, 9)), 9) * 0.1, 6) AS stratum FROM af), {_STRATA.format('vid')}""")
def _(t):
    v = sites_of(t)
    return G.genotype_comparison((v, t.calls), (v, second_calls(t)), G.frequency_strata(v, t.calls))


@query("a44_compare_by_depth", f"WITH {_BASES}, st AS (SELECT vid, sample, LEAST(floor(dp / 10) * 10, 50.0) AS stratum FROM calls), {_STRATA.format('vid, sample')}")
def _(t):
    v = sites_of(t)
    return G.genotype_comparison((v, t.calls), (v, second_calls(t)), t.calls.select("vid", "sample", F.least(F.floor(F.col("dp") / 10) * 10, F.lit(50)).cast("double").alias("stratum")))


@query("a44_allele_mismatches", f"""WITH {_AB}, x AS (SELECT chrom, pos, min([ref, alts]) AS k FROM (SELECT chrom, pos, ref, array_to_string(list_sort([z FOR z IN [alt1, alt2] IF z IS NOT NULL]), ',') AS alts FROM a) GROUP BY ALL), y AS (SELECT chrom, pos, min([ref, alts]) AS k FROM (SELECT chrom, pos, ref, array_to_string(list_sort([z FOR z IN [alt1, alt2] IF z IS NOT NULL]), ',') AS alts FROM b) GROUP BY ALL)
 SELECT count(*) AS n_sites, count(*) FILTER (x.k[1] <> y.k[1]) AS n_ref, count(*) FILTER (x.k[1] = y.k[1] AND x.k[2] <> y.k[2]) AS n_alt FROM x JOIN y USING (chrom, pos)""")
def _(t):
    return G.allele_mismatches(*two(t))


@query("a44_phase", """WITH x AS (SELECT chrom, pos, sample, [ref, alt1, alt2][a1 + 1] AS p, [ref, alt1, alt2][a2 + 1] AS q, gq FROM calls JOIN variants USING (vid) WHERE phased AND a1 <> a2) SELECT x.sample, count(*) AS n_both, count(*) FILTER (CASE WHEN y.gq % 9 = 0 THEN x.p = y.q AND x.q = y.p ELSE x.p = y.p AND x.q = y.q END) AS n_same FROM x JOIN x y USING (chrom, pos, sample) WHERE (x.p = y.p AND x.q = y.q) OR (x.p = y.q AND x.q = y.p) GROUP BY x.sample""")
def _(t):
    swap = F.col("gq") % 9 == 0
    turned = t.calls.select("vid", "sample", "phased", F.when(swap, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(swap, F.col("a1")).otherwise(F.col("a2")).alias("a2"))
    v = sites_of(t)
    return G.phase_comparison((v, t.calls), (v, turned))


@query("a44_non_ref_discordance", f"WITH {_BASES} SELECT round(count(*) FILTER (bases <> bases2) / (count(*) FILTER (bases <> bases2) + count(*) FILTER (bases = bases2 AND dose > 0)), 6) AS rate FROM j")
def _(t):
    v = sites_of(t)
    return G.non_reference_discordance((v, t.calls), (v, second_calls(t)))


_UNION = "u AS (SELECT DISTINCT chrom, pos, 'a' AS src FROM a UNION ALL SELECT DISTINCT chrom, pos, 'b' FROM b)"


@query("a44_compare_sites", f"WITH {_AB}, {_UNION}, g AS (SELECT chrom, pos, string_agg(src, '+' ORDER BY src) AS sources FROM u GROUP BY ALL) SELECT sources, count(*) AS n FROM g GROUP BY sources")
def _(t):
    return G.intersect_sites(dict(zip("ab", two(t), strict=True))).groupBy("sources").agg(F.count("*").alias("n"))


for _name, _cond in (("g1_isec_all", "n = 2"), ("g1_isec_at_least", "n >= 1"), ("g1_isec_one", "n = 1")):

    @query(_name, f"WITH {_AB}, {_UNION} SELECT chrom, pos, string_agg(src, '+' ORDER BY src) AS sources FROM u GROUP BY chrom, pos HAVING {_cond.replace('n ', 'count(*) ')}")
    def _(t, cond=_cond):
        least, most = {"n = 2": (2, None), "n >= 1": (1, None), "n = 1": (1, 1)}[cond]
        return G.intersect_sites(dict(zip("ab", two(t), strict=True)), least, most)


@query("g1_isec_window", f"""WITH {_AB}, {_UNION}, s AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, src) <= 40 THEN 0 ELSE 1 END AS new FROM u), g AS (SELECT *, SUM(new) OVER (PARTITION BY chrom ORDER BY pos, src ROWS UNBOUNDED PRECEDING) AS g FROM s)
 SELECT chrom, min(pos) AS pos, string_agg(DISTINCT src, '+' ORDER BY src) AS sources FROM g GROUP BY chrom, g HAVING count(DISTINCT src) = 2""")
def _(t):
    return G.intersect_sites(dict(zip("ab", two(t), strict=True)), 2, window=40)


@query("g1_complement", f"WITH {_AB} SELECT vid FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chrom = a.chrom AND b.pos = a.pos)")
def _(t):
    return G.complement(*two(t)).select("vid")


@query("g2_venn", f"WITH {_AB}, u AS (SELECT DISTINCT chrom, pos, 'a' AS src FROM a UNION ALL SELECT DISTINCT chrom, pos, 'b' FROM b UNION ALL SELECT DISTINCT chrom, pos, 'c' FROM variants WHERE vid % 3 = 0) SELECT sources, count(*) AS n FROM (SELECT chrom, pos, string_agg(src, '+' ORDER BY src) AS sources FROM u GROUP BY ALL) GROUP BY sources")
def _(t):
    a, b = two(t)
    return G.intersect_sites({"a": a, "b": b, "c": t.variants.where("vid % 3 = 0")}).groupBy("sources").agg(F.count("*").alias("n"))


_MINE = "m AS (SELECT DISTINCT vid, a FROM (SELECT vid, sample, unnest([a1, a2]) AS a FROM calls) WHERE a > 0 AND sample < 2), ot AS (SELECT DISTINCT vid, a FROM (SELECT vid, sample, unnest([a1, a2]) AS a FROM calls) WHERE a > 0 AND sample >= 2)"


@query("g3_subset_private", f"WITH {_MINE} SELECT vid FROM variants WHERE vid IN (SELECT vid FROM m) AND vid NOT IN (SELECT m.vid FROM m JOIN ot USING (vid, a))")
def _(t):
    return G.subset(sites_of(t), t.calls, t.samples.where("sample < 2"), private=True)[0].select("vid")


@query("g3_subset_trim", f"""WITH {_MINE}, k AS (SELECT vid, list(a ORDER BY a) AS kept FROM m GROUP BY vid) SELECT c.vid, sample, CASE WHEN a1 > 0 THEN CAST(list_position(kept, a1) AS INT) ELSE a1 END AS a1, CASE WHEN a2 > 0 THEN CAST(list_position(kept, a2) AS INT) ELSE a2 END AS a2 FROM calls c JOIN k USING (vid) WHERE sample < 2""")
def _(t):
    return G.subset(sites_of(t), t.calls, t.samples.where("sample < 2"), exclude_ref=True, trim=True)[1].select("vid", "sample", "a1", "a2")


_OK = "CASE WHEN {0} = 0 OR {0} IS NULL OR ({0} = 1 AND length(ref) = 1 AND ref <> alt1) THEN {0} {1}END"


for _name, _how, _sql in (("g3_subset_types", {}, f"WITH c AS (SELECT vid, sample, {_OK.format('a1', '')} AS a1, {_OK.format('a2', '')} AS a2 FROM calls JOIN variants USING (vid)) SELECT * FROM c WHERE vid IN (SELECT vid FROM c WHERE a1 IS NOT NULL OR a2 IS NOT NULL)"),
    ("g3_subset_types_to_ref", {"replace_with_ref": True, "keep_uncalled": True}, f"SELECT vid, sample, {_OK.format('a1', 'ELSE 0 ')} AS a1, {_OK.format('a2', 'ELSE 0 ')} AS a2 FROM calls JOIN variants USING (vid)")):

    @query(_name, _sql)
    def _(t, how=_how):
        return G.only_types(sites_of(t), t.calls.select("vid", "sample", "a1", "a2"), ["snp"], **how)[1]


@query("g4_union_labels", "SELECT DISTINCT unp, label FROM (SELECT unp, 'map' AS label FROM idmap WHERE unp = 'P12' OR unp LIKE 'P12-%' UNION ALL SELECT concat('P', CAST(vid % 300 AS VARCHAR)), 'site' FROM variants WHERE vid % 300 = 12)")
def _(t):
    return M.of_protein({"map": t.idmap, "site": t.variants.select(F.concat(F.lit("P"), (F.col("vid") % 300).cast("string")).alias("unp"))}, "P12")


@query("g5_delete_by_label", "SELECT iid, structid AS label FROM intervals WHERE structid <> 'S7'")
def _(t):
    return G.delete_by_label({"intervals": t.intervals.select("iid", F.col("structid").alias("label"))}, "S7")["intervals"]


@query("g6_replace_partition", "WITH n AS (SELECT structid, iid + 1000000 AS iid FROM intervals WHERE seqid < 5) SELECT structid, iid FROM intervals WHERE structid NOT IN (SELECT structid FROM n) UNION ALL SELECT structid, iid FROM n")
def _(t):
    i = t.intervals
    return G.replace_partition(i.select("structid", "iid"), i.where("seqid < 5").select("structid", (F.col("iid") + 1000000).alias("iid")), "structid")


@query("w3_insert_ignore", f"WITH {_AB}, f AS (SELECT chrom, pos, min(vid) AS vid FROM b GROUP BY ALL) SELECT chrom, pos, vid FROM a UNION ALL SELECT chrom, pos, vid FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = f.chrom AND a.pos = f.pos)")
def _(t):
    a, b = (x.select("chrom", "pos", "vid") for x in two(t))
    return G.insert_ignore(a, b, ["chrom", "pos"], ["vid"])


@query("o1_vcf_sort", "SELECT vid, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), pos) AS k FROM variants")
def _(t):
    return numbered(t.variants, *G.natural_chrom(), F.col("pos"), F.col("vid"), range_rows=500).select("vid", F.col("number").alias("k"))


@query("o2_concat", f"WITH {_AB} SELECT chrom, pos, vid, qual, NULL AS extra FROM a WHERE chrom = 'chr1' UNION ALL SELECT chrom, pos, vid, qual, 'b' FROM b WHERE chrom = 'chr2'")
def _(t):
    a, b = (x.select("chrom", "pos", "vid", "qual") for x in two(t))
    return G.concat([a.where("chrom = 'chr1'"), b.where("chrom = 'chr2'").withColumn("extra", F.lit("b"))], pad=True)


@query("o2_concat_sorted", f"WITH {_AB} SELECT chrom, pos, vid, qual, NULL AS extra FROM a WHERE chrom <= 'chr3' UNION ALL SELECT chrom, pos, vid, qual, 'b' FROM b WHERE chrom = 'chr3' UNION ALL SELECT chrom, pos, vid, qual, 'c' FROM b WHERE chrom > 'chr3'")
def _(t):
    a, b = (x.select("chrom", "pos", "vid", "qual") for x in two(t))
    parts = [b.where("chrom > 'chr3'").withColumn("extra", F.lit("c")), b.where("chrom = 'chr3'").withColumn("extra", F.lit("b")), a.where("chrom <= 'chr3'")]
    return G.concat([G.sort_sites(x, natural=False) for x in parts], pad=True, are_sorted=True)


@query("o3_shuffle_cols", "SELECT c.vid, string_agg(concat(COALESCE(CAST(a1 AS VARCHAR), '.'), '/', COALESCE(CAST(a2 AS VARCHAR), '.')), ' ' ORDER BY (c.sample * 7) % 20) AS line FROM calls c GROUP BY c.vid")
def _(t):
    return G.in_order(t.calls, t.samples.select("sample", ((F.col("sample") * 7) % 20).alias("place")))


@query("o5_exists_in", "SELECT DISTINCT structid FROM residues WHERE structid IN (SELECT structid FROM intervals)")
def _(t):
    return M.exists_in(t.residues.select("structid"), t.intervals)