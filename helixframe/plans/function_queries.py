"""Queries of functions, readers and writers, on rows and lines that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import variants as V
from helixframe.functions.residues import PROPERTIES, aa_properties
from helixframe.plans.registry import query
from helixframe.plans.site_queries import sites_of
from helixframe.sources import exports as X
from helixframe.sources import vcf as R
from helixframe.sources.scratch import folder

_ALTS = "[x FOR x IN [alt1, alt2] IF x IS NOT NULL]"
_FILTER = "CASE WHEN filter IS NULL THEN '.' ELSE filter END"


SAMPLES = list(range(20))
HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="">', '##INFO=<ID=MQ,Number=1,Type=Float,Description="">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"NA{s}" for s in SAMPLES)])]


def lines_of(t):
    """VCF lines of the views, header included."""
    v = sites_of(t).withColumn("info_text", F.col("info"))
    return t.spark.createDataFrame([(h,) for h in HEAD], "value string").union(R.vcf_lines(v, t.calls, SAMPLES).select("value"))


@query("s1_read_vcf", f"SELECT chrom, pos, id, ref, array_to_string({_ALTS}, ',') AS alts, qual, CASE WHEN filter IS NULL THEN '.' WHEN filter = 'PASS' THEN '' ELSE filter END AS filters FROM variants")
def _(t):
    return R.parse_lines(lines_of(t)).select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.coalesce(F.array_join("filters", ";"), F.lit(".")).alias("filters"))


@query("s2_parse_info", "SELECT chrom, pos, 3 * size AS dp, vid % 4 = 0 AS db, CASE WHEN vid % 19 <> 0 THEN CAST(vid % 60 AS DOUBLE) END AS mq, regexp_extract(info, 'AA=([ACGT])', 1) AS aa FROM variants")
def _(t):
    lines = lines_of(t)
    h = R.parse_header(HEAD)
    x = lambda k: R.typed_info(F.col("info"), k, h)
    return R.parse_lines(lines).select("chrom", "pos", x("DP").alias("dp"), x("DB").alias("db"), x("MQ").alias("mq"), x("AA").alias("aa"))


@query("s3_parse_calls", "SELECT v.chrom, v.pos, concat('NA', CAST(s.sample AS VARCHAR)) AS sample, a1, a2, COALESCE(phased, false) AS phased, dp, CAST(gq AS DOUBLE) AS gq FROM variants v CROSS JOIN (SELECT CAST(unnest(range(20)) AS INT) AS sample) s LEFT JOIN calls c ON c.vid = v.vid AND c.sample = s.sample")
def _(t):
    lines = lines_of(t)
    return R.parse_calls(R.parse_lines(lines), R.parse_header(HEAD)).select("chrom", "pos", "sample", "a1", "a2", "phased", "dp", "gq")


@query("s4_parse_alt", """WITH a AS (SELECT vid, chrom, pos, CASE vid % 5 WHEN 0 THEN '<DEL>' WHEN 1 THEN concat(ref, '[', chrom, ':', CAST(pos + 10 AS VARCHAR), '[') WHEN 2 THEN concat(ref, '.') ELSE alt1 END AS alt, ref, alt1 FROM variants)
 SELECT vid, alt, CASE vid % 5 WHEN 0 THEN 'symbolic' WHEN 1 THEN 'breakend' WHEN 2 THEN 'single_breakend' ELSE 'substitution' END AS alt_type, CASE WHEN vid % 5 = 1 THEN pos + 10 END AS mate, CASE vid % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN ref WHEN 2 THEN ref ELSE alt1 END AS seq FROM a""")
def _(t):
    k = F.col("vid") % 5
    alt = F.when(k == 0, "<DEL>").when(k == 1, F.concat("ref", F.lit("["), "chrom", F.lit(":"), (F.col("pos") + 10).cast("string"), F.lit("["))).when(k == 2, F.concat("ref", F.lit("."))).otherwise(F.col("alt1"))
    a = t.variants.withColumn("alt", alt).withColumn("x", R.parse_alt(F.col("alt")))
    return a.select("vid", "alt", "x.alt_type", F.col("x.pos").alias("mate"), "x.seq")


@query("s24_region_scan", "SELECT vid, pos, ref FROM variants WHERE chrom = 'chr3' AND pos >= 50000 AND pos < 90000")
def _(t):
    at = folder(t.spark, "store")
    R.store(t.variants.select("vid", "chrom", "pos", "ref"), at)
    return R.region_scan(t.spark, at, "chr3", 50_000, 90_000).select("vid", "pos", "ref")


@query("p1_parse_csq", """WITH s AS (SELECT vid, string_split(csq, '|') AS f FROM consequences) SELECT vid, replace(f[1], '&', ';') AS consequence, f[2] AS feature, NULLIF(split_part(f[3], '/', 1), '') AS ref_amino_acid, NULLIF(split_part(f[3], '/', 2), '') AS alt_amino_acid, TRY_CAST(split_part(f[4], '-', 1) AS INT) AS protein_pos, CAST(f[5] = 'YES' AS INT) AS canonical, NULLIF(replace(f[6], '&', ','), '') AS existing_variation FROM s""")
def _(t):
    return t.consequences.select("vid", V.parse_csq(F.col("csq"), ["Consequence", "Feature", "Amino_acids", "Protein_position", "CANONICAL", "Existing_variation"]).alias("c")).select("vid", "c.*")


_RECORDS = """a AS (SELECT *, regexp_extract(info, 'AA=([ACGT])', 1) AS aa, CASE WHEN vid % 3 = 0 THEN pos + 5 ELSE pos + 1 END AS e, CASE WHEN vid % 6 <> 0 AND vid % 4 = 1 THEN concat('COSM', CAST(vid AS VARCHAR)) END AS x FROM variants),
 g AS (SELECT vid, string_agg(concat(COALESCE(CAST(a1 AS VARCHAR), '.'), CASE WHEN phased THEN '|' ELSE '/' END, COALESCE(CAST(a2 AS VARCHAR), '.')), ',' ORDER BY sample) AS gt FROM calls GROUP BY vid),
 r AS (SELECT vid, chrom, pos, e AS "end", COALESCE(id, x, concat(chrom, ':', CAST(pos AS VARCHAR), '-', CAST(e AS VARCHAR))) AS id, ref, alt1 AS alt, aa, CASE WHEN alt1 = aa THEN ref ELSE alt1 END AS da,
  CASE WHEN vid % 2 = 0 THEN (vid % 100) / 100 ELSE 0.0 END AS amr_af, CAST(0 AS DOUBLE) AS afr_af, (vid % 7) / 10 AS eur_af, CAST(0 AS DOUBLE) AS eas_af, CAST(0 AS DOUBLE) AS sas_af, CAST(0 AS DOUBLE) AS asn_af, size AS ac, size / 100 AS af, gt,
  CASE WHEN vid % 5 = 0 THEN 'dbSNP;1KG' END AS snp_source, x AS existing, CASE WHEN vid % 6 <> 0 THEN concat('G', CAST(vid % 50 AS VARCHAR)) END AS gene, CASE WHEN vid % 6 <> 0 AND vid % 2 = 1 THEN concat('SYM', CAST(vid % 50 AS VARCHAR)) END AS hgnc FROM a LEFT JOIN g USING (vid))"""


def records(t):
    """Records with two consequences, but every sixth without, and frequencies of two populations."""
    n = lambda text, c: F.concat(F.lit(text), c.cast("string"))
    vid = F.col("vid")
    csq = [F.struct(F.when(vid % 4 == 1, n("COSM", vid)).alias("existing_variation"), n("G", vid % 50 + k).alias("gene"), n("SYM", vid % 50 + k).alias("symbol"), F.when(vid % 2 == 1, "HGNC").otherwise("EntrezGene").alias("symbol_source")) for k in (0, 1)]
    gts = t.calls.groupBy("vid").agg(F.split(R.ordered_join(R.call_text(), ["sample"], ","), ",").alias("gts"))
    v = sites_of(t).join(gts, "vid", "left").withColumns({
        "end": F.when(vid % 3 == 0, F.col("pos") + 5), "aa": F.concat(F.lower("aa"), F.lit("|x")), "amr_af": F.when(vid % 2 == 0, F.array((vid % 100) / 100, F.lit(0.9))), "eur_af": F.array((vid % 7) / 10), "ac": F.array("size", F.lit(1)), "af": F.array(F.col("size") / 100),
        "snp_sources": F.when(vid % 5 == 0, F.array(F.lit("dbSNP"), F.lit("1KG"))), "csq": F.when(vid % 6 != 0, F.array(*csq)),
    })
    return V.complete_record(v)


@query("p2_complete_record", f"WITH {_RECORDS} SELECT * FROM r")
def _(t):
    return records(t).drop("csq")


@query("p2_record_consequences", f"""WITH {_RECORDS} SELECT vid, id, chrom, pos, "end", CASE WHEN vid % 6 <> 0 THEN existing END AS existing_variation, CASE WHEN vid % 6 <> 0 THEN concat('G', CAST(vid % 50 + k AS VARCHAR)) END AS gene, CASE WHEN vid % 6 <> 0 THEN concat('SYM', CAST(vid % 50 + k AS VARCHAR)) END AS symbol,
 CASE WHEN vid % 6 <> 0 THEN CASE WHEN vid % 2 = 1 THEN 'HGNC' ELSE 'EntrezGene' END END AS symbol_source FROM r CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) WHERE k = 0 OR vid % 6 <> 0""")
def _(t):
    return V.record_consequences(records(t))


@query("p3_parse_vep_row", "SELECT vid, CAST(size AS INT) AS protein_position, concat('T', CAST(vid % 500 AS VARCHAR)) AS feature, CASE WHEN vid % 2 = 0 THEN 'benign' END AS sift FROM variants")
def _(t):
    r = V.parse_vep_row(vep_line())
    return t.variants.select(r["name"].cast("long").alias("vid"), r["protein_pos"].alias("protein_position"), F.upper(r["feature"]).alias("feature"), F.try_element_at(r["extra"], F.lit("sift")).alias("sift"))


def vep_line():
    """A line of an effect predictor's table by site: 14 columns, some empty."""
    n = lambda c: c.cast("string")
    vid, pos, size = F.col("vid"), F.col("pos"), F.col("size")
    place = F.concat("chrom", F.lit(":"), n(pos), F.when(vid % 3 == 0, F.concat(F.lit("-"), n(pos + 2))).otherwise(""))
    amino = F.when(vid % 4 == 0, "A/G").when(vid % 4 == 1, "M").otherwise("-")
    return F.concat_ws("\t", n(vid), place, "alt1", F.concat(F.lit("ENSG"), n(vid % 50)), F.concat(F.lit("T"), n(vid % 500)), F.lit("Transcript"), F.lit("missense_variant"), F.when(vid % 5 == 0, "-").otherwise(n(size * 3)), F.lit("?-7"), n(size), amino, F.lit("gCc/gGc"), F.coalesce("id", F.lit("-")), F.when(vid % 2 == 0, "SIFT=benign;X=1").otherwise("X=1"))


@query("p3_vep_row_columns", """SELECT vid, lower(chrom) AS chrom, pos AS start, CASE WHEN vid % 3 = 0 THEN pos + 2 ELSE pos + 1 END AS "end", lower(alt1) AS ref_allele, concat('ensg', CAST(vid % 50 AS VARCHAR)) AS gene, 'transcript' AS feature_type, 'missense_variant' AS consequence, CASE WHEN vid % 5 <> 0 THEN CAST(size * 3 AS INT) END AS cdna_pos, CAST(NULL AS INT) AS cds_pos,
 CASE WHEN vid % 4 = 0 THEN 'a' ELSE '-' END AS ref_amino_acid, CASE WHEN vid % 4 = 0 THEN 'g' ELSE '-' END AS var_amino_acid, 'gcc' AS ref_codon, 'ggc' AS var_codon, COALESCE(id, '-') AS variation FROM variants""")
def _(t):
    r = V.parse_vep_row(vep_line())
    return t.variants.select(r["name"].cast("long").alias("vid"), *[r[c].alias(c) for c in ("chrom", "start", "end", "ref_allele", "gene", "feature_type", "consequence", "cdna_pos", "cds_pos", "ref_amino_acid", "var_amino_acid", "ref_codon", "var_codon", "variation")])


@query("p4_std_chrom", "SELECT vid, chrom FROM variants WHERE chrom IN ('chr1', 'chr2', 'chr3', 'chr4', 'chr5')")
def _(t):
    bad = F.col("chrom").startswith("chrchr")
    return t.variants.where(F.when(bad, F.raise_error("a doubled chr prefix").cast("boolean")).otherwise(F.col("chrom").isin(V.STANDARD))).select("vid", "chrom")


_TYPE = "CASE WHEN length(ref) = 1 AND alt2 IS NULL THEN 'snp' WHEN length(ref) > 1 OR alt2 IS NOT NULL THEN 'indel' END"


@query("p5_p7_types", f"""SELECT vid, {_TYPE} AS var_type, CASE WHEN {_TYPE} = 'snp' THEN CASE WHEN concat(ref, alt1) IN ('AG', 'GA', 'CT', 'TC') THEN 'ts' ELSE 'tv' END WHEN alt2 IS NOT NULL THEN 'unknown' ELSE 'del' END AS var_subtype, {_TYPE} = 'indel' AND alt2 IS NULL AND length(ref) > 1 AS is_deletion FROM variants""")
def _(t):
    return sites_of(t).select("vid", V.var_type().alias("var_type"), V.var_subtype().alias("var_subtype"), V.is_deletion().alias("is_deletion"))


@query("p8_affected_range", """WITH a AS (SELECT vid, pos, ref, unnest([alt1, alt2]) AS alt FROM variants) SELECT vid, min(CASE WHEN length(alt) = length(ref) THEN pos - 1 WHEN length(ref) > length(alt) THEN pos - 1 + length(alt) ELSE pos - 1 + length(ref) END) AS start, max(pos - 1 + length(ref)) AS "end" FROM a WHERE alt IS NOT NULL GROUP BY vid""")
def _(t):
    return sites_of(t).select("vid", V.affected_range().alias("r")).select("vid", "r.*")


@query("p9_sv_end", "SELECT vid, CASE WHEN vid % 3 = 0 THEN pos + size ELSE pos + length(ref) - 1 END AS sv_end, vid % 5 <> 0 AS is_precise, filter IS NOT NULL AND filter <> 'PASS' AS is_filtered, vid % 11 = 0 AS is_monomorphic FROM variants")
def _(t):
    from helixframe.plans.filter_queries import info_map

    more = F.concat("info", F.when(F.col("vid") % 3 == 0, F.concat(F.lit(";END="), (F.col("pos") + F.col("size")).cast("string"))).otherwise(""), F.when(F.col("vid") % 5 == 0, ";IMPRECISE").otherwise(""))
    v = info_map(sites_of(t).withColumn("info", more)).withColumn("alts", F.when(F.col("vid") % 11 == 0, F.array(F.lit("."))).otherwise(F.col("alts")))
    return v.select("vid", V.sv_end().alias("sv_end"), V.is_precise().alias("is_precise"), V.is_filtered().alias("is_filtered"), V.is_monomorphic().alias("is_monomorphic"))


@query("p10_call_predicates", "SELECT c.vid, sample, CASE WHEN a1 IS NULL OR a2 IS NULL THEN NULL WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 <> a2 THEN 1 ELSE 2 END AS gt_type, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN concat([ref, alt1, alt2][a1 + 1], CASE WHEN phased THEN '|' ELSE '/' END, [ref, alt1, alt2][a2 + 1]) END AS bases, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a1 <> a2 END AS is_het, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a1 > 0 OR a2 > 0 END AS is_variant, gq < 20 AS is_filtered FROM calls c JOIN variants USING (vid)")
def _(t):
    j = t.calls.join(sites_of(t).select("vid", F.concat(F.array("ref"), "alts").alias("alleles")), "vid")
    ft = F.when(F.col("gq") < 20, F.array(F.lit("q20"))).otherwise(F.array().cast("array<string>"))
    return j.select("vid", "sample", V.gt_type().alias("gt_type"), V.gt_bases().alias("bases"), V.is_het().alias("is_het"), V.is_variant().alias("is_variant"), V.call_is_filtered(ft).alias("is_filtered"))


@query("p11_event_type", """WITH a AS (SELECT vid, ref, CASE vid % 8 WHEN 0 THEN '.' WHEN 1 THEN concat(ref, 'GG') WHEN 2 THEN '<ID>' WHEN 3 THEN concat(ref, '[c:1[') WHEN 4 THEN concat('.', ref) WHEN 5 THEN concat(ref, '.') ELSE alt1 END AS alt FROM variants)
 SELECT vid, CASE WHEN vid % 8 = 0 THEN 'r0' WHEN vid % 8 = 1 THEN 'i+2' WHEN vid % 8 = 2 THEN 'u0' WHEN vid % 8 IN (3, 4, 5) THEN 'b' WHEN length(ref) = 1 THEN CASE WHEN ref = alt THEN 'r0' ELSE 's1' END WHEN left(ref, 1) = alt OR right(ref, 1) = alt THEN 'i-2' ELSE 'o2' END AS event,
 CASE WHEN vid % 8 = 0 THEN ref WHEN vid % 8 = 1 THEN 'GG' WHEN vid % 8 IN (3, 4, 5) THEN NULL WHEN vid % 8 = 2 OR length(ref) = 1 THEN alt WHEN left(ref, 1) = alt THEN substr(ref, 2) WHEN right(ref, 1) = alt THEN left(ref, 2) ELSE alt END AS sequence FROM a""")
def _(t):
    k = F.col("vid") % 8
    alt = F.when(k == 0, ".").when(k == 1, F.concat("ref", F.lit("GG"))).when(k == 2, "<ID>").when(k == 3, F.concat("ref", F.lit("[c:1["))).when(k == 4, F.concat(F.lit("."), "ref")).when(k == 5, F.concat("ref", F.lit("."))).otherwise(F.col("alt1"))
    return t.variants.select("vid", V.event(F.col("ref"), alt).alias("e")).select("vid", F.col("e.type").alias("event"), "e.sequence")


@query("p12_normalize_alleles", "SELECT vid, pos + 2 * (vid % 4) AS pos, ref, CASE WHEN vid % 2 = 1 AND ref <> 'G' THEN concat(ref, 'G') ELSE alt1 END AS alt FROM variants WHERE length(ref) = 1")
def _(t):
    # Bases on both sides of a substitution or an insertion.
    around = lambda core: F.concat(F.expr("repeat('GT', cast(vid % 4 as int))"), core, F.expr("repeat('CA', cast(vid % 3 as int))"))
    alt = F.when((F.col("vid") % 2 == 1) & (F.col("ref") != "G"), F.concat("ref", F.lit("G"))).otherwise(F.col("alt1"))
    v = t.variants.where("length(ref) = 1").select("vid", V.normalised(around(F.col("ref")), around(alt), F.col("pos")).alias("n"))
    return v.select("vid", "n.*")


@query("p13_fill_type", "SELECT vid, CASE WHEN length(ref) = 1 THEN CASE WHEN ref = alt1 THEN 'other' ELSE 'snp' END WHEN left(ref, 1) = alt1 OR right(ref, 1) = alt1 THEN 'del' ELSE 'complex' END AS type FROM variants")
def _(t):
    return t.variants.select("vid", V.fill_type(F.col("ref"), F.col("alt1")).alias("type"))


@query("p14_derived_af", "SELECT vid, round(CASE WHEN regexp_extract(info, 'AA=([ACGT])', 1) = ref THEN (vid % 100) / 100 ELSE 1 - (vid % 100) / 100 END, 6) AS daf FROM variants")
def _(t):
    return sites_of(t).select("vid", F.round(V.derived_af((F.col("vid") % 100) / 100, F.col("aa"), F.col("ref")), 6).alias("daf"))


@query("p15_protein_variant_key", "SELECT vid, concat(split_part(a, '/', 1), split_part(csq, '|', 4), split_part(a, '/', 2)) AS key FROM (SELECT vid, csq, split_part(csq, '|', 3) AS a FROM consequences) WHERE a <> ''")
def _(t):
    c = t.consequences.select("vid", V.parse_csq(F.col("csq"), ["Consequence", "Feature", "Amino_acids"]).alias("c"), F.split("csq", r"\|")[3].alias("p")).where("c.ref_amino_acid is not null")
    return c.select("vid", F.concat("c.ref_amino_acid", "p", "c.alt_amino_acid").alias("key"))


@query("p16_p18_sequences", "SELECT seq_id, md5(seq) AS md5, concat(md5(seq), left(seq, 4), right(seq, 4)) AS modbase_id, regexp_matches(seq, '^[ACDEFGHIKLMNPQRSTVWY]+$') AS protein FROM sequences")
def _(t):
    return t.sequences.select("seq_id", F.md5("seq").alias("md5"), V.modbase_seq_id(F.col("seq")).alias("modbase_id"), F.col("seq").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$").alias("protein"))


_NAMES = ["ALA", "ARG", "MSE", "XXX", "SEP", "hyp", "LLP", "CSO"]


@query("p19_p21_residues", f"WITH m AS (SELECT res_id, {_NAMES}[1 + CAST(res_id % 8 AS INT)] AS name, z FROM residues) SELECT res_id, CASE name WHEN 'ALA' THEN 'A' WHEN 'ARG' THEN 'R' WHEN 'MSE' THEN 'M' WHEN 'SEP' THEN 'S' WHEN 'hyp' THEN 'P' WHEN 'LLP' THEN 'K' WHEN 'CSO' THEN 'C' END AS letter, round(abs(z) / CASE name WHEN 'ALA' THEN 115.0 WHEN 'ARG' THEN 225.0 WHEN 'MSE' THEN 185.0 WHEN 'SEP' THEN 115.0 WHEN 'hyp' THEN 145.0 WHEN 'LLP' THEN 200.0 WHEN 'CSO' THEN 135.0 END, 4) AS rsa FROM m")
def _(t):
    letter = V.one_letter(F.get(F.array(*map(F.lit, _NAMES)), (F.col("res_id") % 8).cast("int")))
    return t.residues.select("res_id", letter.alias("letter"), V.relative_access(F.abs("z"), letter, {letter: float(access) for letter, *_, access in PROPERTIES}).alias("rsa"))


_AA = "aa AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {s}, '{k}', {hp}, {acc})" for a, s, k, _, hp, _, _, acc in PROPERTIES) + ") v(letter, size, kind, hp, access))"


@query("p20_aa_properties", f"WITH {_AA} SELECT res_id, size, kind, CAST(hp AS DOUBLE) AS hp, round(abs(z) / access, 4) AS rsa FROM residues JOIN aa ON letter = rescode")
def _(t):
    return t.residues.join(F.broadcast(aa_properties(t.spark)), F.col("rescode") == F.col("letter")).select("res_id", "size", "kind", "hp", F.round(F.abs("z") / F.col("access"), 4).alias("rsa"))


@query("p22_model_path", """SELECT iid, concat('/swiss/P', substr(CAST(10000 + iid % 50000 AS VARCHAR), 1, 1), '/', substr(CAST(10000 + iid % 50000 AS VARCHAR), 2, 2), '/', substr(CAST(10000 + iid % 50000 AS VARCHAR), 4), '/swissmodel/', CAST(seqid AS VARCHAR), '_', CAST(seqid + 9 AS VARCHAR), '_', transcript, '_c', CAST(iid AS VARCHAR), '.pdb') AS swiss,
 concat('/af/human/P', substr(CAST(10000 + iid % 50000 AS VARCHAR), 1, 1), '/', substr(CAST(10000 + iid % 50000 AS VARCHAR), 2, 2), '/AF-P', CAST(10000 + iid % 50000 AS VARCHAR), '-F2-model_v1.cif.gz') AS alphafold FROM intervals""")
def _(t):
    unp = F.concat(F.lit("P"), (10000 + F.col("iid") % 50000).cast("string"))
    isoform = F.when(F.col("iid") % 2 == 0, F.concat(unp, F.lit("-2"))).otherwise(unp)
    swiss = V.swiss_model_path("/swiss", isoform, F.col("seqid"), F.col("seqid") + 9, F.col("transcript"), F.concat(F.lit("c"), F.col("iid").cast("string")))
    return t.intervals.select("iid", swiss.alias("swiss"), V.alphafold_path("/af", F.concat(F.lit("AF-"), unp, F.lit("-F2"))).alias("alphafold"))


@query("p23_alphafold_window", "SELECT iid, CAST(CASE WHEN iid % 6000 <= 2700 THEN 1 ELSE GREATEST(1, LEAST(ceil((seqid * 10 - 700.0) / 200) + 1, ceil((iid % 6000 - 1400) / 200.0) + 1)) END AS INT) AS fragment FROM intervals")
def _(t):
    return t.intervals.select("iid", V.alphafold_fragment(F.col("seqid") * 10, F.col("iid") % 6000).alias("fragment"))


@query("p24_mpqs_threshold", "SELECT iid FROM intervals WHERE (iid % 30) / 10.0 > 2 - ln(seqid) / (2 * ln(2))")
def _(t):
    return t.intervals.where(V.model_is_sound((F.col("iid") % 30) / 10.0, F.col("seqid"))).select("iid")


@query("p25_entity_label", """WITH q AS (SELECT DISTINCT unp AS entity FROM idmap UNION SELECT DISTINCT structid FROM intervals UNION SELECT DISTINCT transcript FROM intervals UNION SELECT concat('M', CAST(p_partkey AS VARCHAR)) FROM part UNION SELECT concat('W', CAST(s_suppkey AS VARCHAR)) FROM supplier UNION SELECT 'P7' UNION SELECT 'nothing')
 SELECT entity, CASE WHEN entity IN (SELECT concat('M', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 10) THEN 'model' WHEN entity IN (SELECT concat('W', CAST(s_suppkey AS VARCHAR)) FROM supplier UNION SELECT 'P7') THEN 'swiss' WHEN entity IN (SELECT structid FROM residues) THEN 'structure' WHEN entity IN (SELECT unp FROM idmap) THEN 'unp' WHEN entity IN (SELECT transcript FROM intervals) THEN 'gene' END AS kind FROM q""")
def _(t):
    from helixframe.operators import mapping as M

    model, swiss = t.part.select(F.concat(F.lit("M"), F.col("p_partkey").cast("string"))), t.supplier.select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")))
    p7, nothing = (t.region.limit(1).select(F.lit(x)) for x in ("P7", "nothing"))
    q = t.idmap.select("unp").union(t.intervals.select("structid")).union(t.intervals.select("transcript")).union(model).union(swiss).union(p7).union(nothing).toDF("entity")
    return M.entity_kinds(q, {"model": t.part.where("p_size > 10").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string"))), "swiss": swiss.union(p7), "structure": t.residues.select("structid"), "unp": t.idmap.select("unp"), "gene": t.intervals.select("transcript")})


@query("p26_iupac", "SELECT vid, CASE concat(LEAST(ref, alt1), GREATEST(ref, alt1)) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' WHEN 'AA' THEN 'A' WHEN 'CC' THEN 'C' WHEN 'GG' THEN 'G' WHEN 'TT' THEN 'T' END AS code FROM variants")
def _(t):
    return t.variants.select("vid", V.iupac(F.col("ref"), F.col("alt1")).alias("code"))


# Writers


_GT = "concat(COALESCE(CAST(a1 AS VARCHAR), '.'), CASE WHEN phased THEN '|' ELSE '/' END, COALESCE(CAST(a2 AS VARCHAR), '.'))"


@query("w1_write_vcf", f"""WITH c AS (SELECT v.vid, s.sample, COALESCE(concat({_GT}, ':', COALESCE(CAST(dp AS VARCHAR), '.'), ':', COALESCE(CAST(gq AS VARCHAR), '.')), './.:.:.') AS x FROM variants v CROSS JOIN (SELECT CAST(unnest(range(20)) AS INT) AS sample) s LEFT JOIN calls k ON k.vid = v.vid AND k.sample = s.sample), g AS (SELECT vid, string_agg(x, chr(9) ORDER BY sample) AS x FROM c GROUP BY vid)
 SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), COALESCE(id, '.'), ref, concat_ws(',', alt1, alt2), CASE WHEN qual = floor(qual) THEN CAST(CAST(qual AS BIGINT) AS VARCHAR) ELSE CAST(qual AS VARCHAR) END, {_FILTER}, info, 'GT:DP:GQ', x) AS line FROM variants JOIN g USING (vid)""")
def _(t):
    return R.vcf_lines(sites_of(t).withColumn("info_text", F.col("info")), t.calls, list(range(20))).select(F.col("value").alias("line"))


_DECLARED = ['##INFO=<ID=DP,Number=1,Type=Integer,Description="">', '##INFO=<ID=AA,Number=1,Type=String,Description="">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="">', '##INFO=<ID=MQ,Number=1,Type=Float,Description="">',
             '##INFO=<ID=AF,Number=A,Type=Float,Description="">', '##INFO=<ID=AD,Number=R,Type=Integer,Description="">', '##INFO=<ID=pos,Number=1,Type=Integer,Description="">']


@query("w2_vcf_to_table", """SELECT chrom, pos, id, ref, alt, qual, CASE WHEN filter IS NULL THEN '.' WHEN filter = 'PASS' THEN '' ELSE filter END AS filters, 3 * size AS dp, regexp_extract(info, 'AA=([ACGT])', 1) AS aa, vid % 4 = 0 AS db, CASE WHEN vid % 19 <> 0 THEN CAST(vid % 60 AS DOUBLE) END AS mq,
 CASE WHEN k = 1 THEN (vid % 10) / 10 ELSE 0.5 END AS af, CASE WHEN k = 1 THEN vid % 7 ELSE 3 END AS ad, CASE WHEN vid % 3 = 0 THEN vid END AS pos_2 FROM (SELECT *, unnest([1, 2]) AS k, unnest([alt1, alt2]) AS alt FROM variants) WHERE alt IS NOT NULL""")
def _(t):
    v = t.variants
    two = F.col("alt2").isNotNull()
    more = F.concat(F.lit(";AF="), (F.col("vid") % 10 / 10).cast("string"), F.when(two, ",0.5").otherwise(""), F.lit(";AD=1,"), (F.col("vid") % 7).cast("string"), F.when(two, ",3").otherwise(""), F.when(F.col("vid") % 3 == 0, F.concat(F.lit(";pos="), F.col("vid").cast("string"))).otherwise(""))
    lines = v.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", F.concat_ws(",", "alt1", "alt2"), F.col("qual").cast("string"), F.coalesce("filter", F.lit(".")), F.concat("info", more)).alias("value"))
    return R.typed_table(R.parse_lines(lines), R.parse_header(_DECLARED), per_allele=True).withColumn("filters", F.coalesce(F.array_join("filters", ";"), F.lit(".")))


@query("w4_to_012", "SELECT c.vid, sample, CASE WHEN a1 IS NULL AND a2 IS NULL THEN -1 WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 > 0 AND a2 > 0 THEN 2 ELSE 1 END AS code FROM calls c JOIN variants USING (vid) WHERE alt2 IS NULL")
def _(t):
    return t.calls.join(sites_of(t).where(F.size("alts") == 1).select("vid"), "vid").select("vid", "sample", R.code_012().alias("code"))


_ALL = "COALESCE([ref, alt1, alt2][{0} + 1], '0')"


_SECOND = "COALESCE([ref, alt1, alt2][a2 + 1], CASE WHEN phased AND a2 IS NULL THEN [ref, alt1, alt2][a1 + 1] END, '0')"


def _with_alleles(t):
    return X.with_alleles(sites_of(t), t.calls)


_PED = f"string_agg(concat({_ALL.format('a1')}, ' ', {_SECOND}), chr(9) ORDER BY pos)"


@query("w5_to_plink_ped", f"SELECT sample, md5(concat_ws(chr(9), CAST(sample AS VARCHAR), CAST(sample AS VARCHAR), '0', '0', '0', '0', string_agg(concat({_ALL.format('a1')}, ' ', {_SECOND}), chr(9) ORDER BY chrom, pos))) AS line FROM calls JOIN variants USING (vid) GROUP BY sample")
def _(t):
    rows = _with_alleles(t)
    return X.whole_lines(X.plink_ped(rows, 50_000), {"line": "\t"}, X.plink_family(rows.select("sample").distinct())).withColumn("line", F.md5("line"))


@query("w5_whole_ped_lines", f"SELECT sample, concat_ws(chr(9), CAST(sample AS VARCHAR), CAST(sample AS VARCHAR), '0', '0', '0', '0', {_PED.replace('ORDER BY pos', 'ORDER BY chrom, pos')}) AS line FROM calls JOIN variants USING (vid) GROUP BY sample")
def _(t):
    rows = _with_alleles(t)
    return X.whole_lines(X.plink_ped(rows, 50_000), {"line": "\t"}, X.plink_family(rows.select("sample").distinct()))


@query("w5_to_plink_map", "SELECT vid, concat_ws(chr(9), substr(chrom, 4), COALESCE(id, concat(chrom, ':', CAST(pos AS VARCHAR))), '0', CAST(pos AS VARCHAR)) AS line FROM variants")
def _(t):
    return X.plink_map(t.variants)


@query("w6_to_plink_tped", f"SELECT vid, concat_ws(' ', substr(any_value(chrom), 4), COALESCE(any_value(id), concat(any_value(chrom), ':', CAST(any_value(pos) AS VARCHAR))), '0', CAST(any_value(pos) AS VARCHAR), string_agg(concat({_ALL.format('a1')}, ' ', {_SECOND}), ' ' ORDER BY sample)) AS line FROM calls JOIN variants USING (vid) GROUP BY vid")
def _(t):
    return X.plink_tped(_with_alleles(t))


@query("w6_to_plink_tfam", "SELECT sample, concat_ws(chr(9), CAST(sample AS VARCHAR), CAST(sample AS VARCHAR), '0', '0', '0', '0') AS line FROM samples")
def _(t):
    return X.plink_family(t.samples)


@query("w7_to_impute", """SELECT vid, string_agg(concat(CAST(a1 AS VARCHAR), ' ', CAST(a2 AS VARCHAR)), ' ' ORDER BY sample) AS hap, any_value(concat_ws(' ', COALESCE(id, concat(chrom, '-', CAST(pos AS VARCHAR))), CAST(pos AS VARCHAR), ref, alt1)) AS legend FROM calls JOIN variants USING (vid) WHERE alt2 IS NULL GROUP BY vid HAVING bool_and(phased AND a1 IS NOT NULL AND a2 IS NOT NULL)""")
def _(t):
    return X.impute(sites_of(t), t.calls)


for _name, _expr in (("w8_to_ldhat_phased", "COALESCE(CAST(a1 AS VARCHAR), '?')"), ("w9_to_ldhat_unphased", "CASE WHEN a1 IS NULL OR a2 IS NULL THEN '?' WHEN a1 <> a2 THEN '2' ELSE CAST(a1 AS VARCHAR) END")):

    @query(_name, f"SELECT sample, chrom, pos // 50000 AS bin, string_agg({_expr}, '' ORDER BY pos) AS sites, string_agg(CAST(round(pos / 1000, 3) AS VARCHAR), ',' ORDER BY pos) AS locs FROM calls JOIN variants USING (vid) WHERE alt2 IS NULL GROUP BY ALL")
    def _(t, phased=_name.endswith("_phased")):
        return X.ldhat(sites_of(t), t.calls, phased, 50_000)


@query("w10_to_beagle_gl", "SELECT c.vid, sample, round(power(10, -gq / 10.0), 6) AS l0, round(power(10, -dp / 10.0), 6) AS l1 FROM calls c JOIN variants USING (vid) WHERE alt2 IS NULL AND dp IS NOT NULL")
def _(t):
    own = t.calls.join(sites_of(t).where(F.size("alts") == 1).select("vid"), "vid").where("dp is not null").withColumn("pl", F.array("gq", "dp"))
    got = X.beagle_likelihoods(own, "pl")
    return got.select("vid", "sample", F.col("likelihoods")[0].alias("l0"), F.col("likelihoods")[1].alias("l1"))


@query("w11_extract_info", f"SELECT chrom, pos, ref, array_to_string({_ALTS}, ',') AS alts, CAST(3 * size AS VARCHAR) AS dp, CASE WHEN vid % 19 <> 0 THEN CAST(vid % 60 AS VARCHAR) ELSE '?' END AS mq, CASE WHEN vid % 4 = 0 THEN '1' ELSE '?' END AS db FROM variants")
def _(t):
    return R.extract_info(R.parse_lines(lines_of(t)), ["DP", "MQ", "DB"])


@query("w12_extract_format", "SELECT v.chrom, v.pos, concat('NA', CAST(s.sample AS VARCHAR)) AS sample, CAST(gq AS BIGINT) AS value FROM variants v CROSS JOIN (SELECT CAST(unnest(range(20)) AS INT) AS sample) s LEFT JOIN calls c ON c.vid = v.vid AND c.sample = s.sample")
def _(t):
    return R.extract_format(R.parse_lines(lines_of(t)), R.parse_header([*HEAD[:-1], '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="">', HEAD[-1]]), "GQ")


@query("w13_vcf_query", f"SELECT vid, concat(any_value(chrom), ':', CAST(any_value(pos) AS VARCHAR), ' ', string_agg(concat(CAST(sample AS VARCHAR), '=', {_GT}), ' ' ORDER BY sample)) AS line FROM calls JOIN variants USING (vid) GROUP BY vid")
def _(t):
    return X.formatted(_with_alleles(t), "%CHROM:%POS[ %SAMPLE=%GT]", {"CHROM": F.col("chrom"), "POS": F.col("pos")}, {"SAMPLE": F.col("sample"), "GT": R.call_text()})


@query("w14_vcf_to_tab", f"SELECT vid, string_agg(concat({_ALL.format('a1').replace(chr(39) + '0' + chr(39), chr(39) + '.' + chr(39))}, '/', {_ALL.format('a2').replace(chr(39) + '0' + chr(39), chr(39) + '.' + chr(39))}), chr(9) ORDER BY sample) AS line FROM calls JOIN variants USING (vid) GROUP BY vid")
def _(t):
    return X.vcf_tab(_with_alleles(t))


_CODES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.IUPAC.items()) + "}"
_CELL = "concat(COALESCE([ref, alt1, alt2][a1 + 1], '.'), '/', COALESCE([ref, alt1, alt2][a2 + 1], '.'))"


@query("w14_vcf_to_tab_iupac", f"SELECT vid, string_agg(COALESCE({_CODES}[array_to_string(list_sort(string_split({_CELL}, '/')), '')], {_CELL}), chr(9) ORDER BY sample) AS line FROM calls JOIN variants USING (vid) GROUP BY vid")
def _(t):
    return X.vcf_tab(_with_alleles(t), ambiguity=True)


@query("w15_tab_to_vcf", f"SELECT vid, string_agg(DISTINCT b, ',' ORDER BY b) AS alts FROM (SELECT vid, ref, unnest([{_ALL.format('a1')}, {_ALL.format('a2')}]) AS b FROM calls JOIN variants USING (vid)) WHERE b <> ref AND b <> '0' GROUP BY vid")
def _(t):
    tab = _with_alleles(t).select("vid", F.col("alleles")[0].alias("ref"), F.concat_ws("/", R.base_of("a1"), R.base_of("a2")).alias("g"))
    return X.tab_to_sites(tab)


_ATTR = "SELECT structid, chain, seqid, max(CASE WHEN v > 0.5 THEN round(1 - v, 6) ELSE v END) AS value FROM (SELECT structid, chain, seqid, (iid % 100) / 100 AS v FROM intervals) GROUP BY ALL"


@query("w16_annotation_attr", _ATTR)
def residue_attribute(t):
    return X.residue_attribute(t.intervals, (F.col("iid") % 100) / 100, fold=True)


@query("w16_annotation_range", f"SELECT structid, min(value) AS least, max(value) AS greatest FROM ({_ATTR}) GROUP BY structid")
def _(t):
    return X.attribute_range(residue_attribute(t))


@query("w17_scores_json", """WITH p AS (SELECT structid, chain, seqid, max(CAST(res_id % 997 AS DOUBLE) / 8) AS score FROM residues GROUP BY ALL)
 SELECT structid, chain, concat('{', string_agg(concat('"', CAST(seqid AS VARCHAR), '":{"score":', CAST(score AS VARCHAR), '}'), ',' ORDER BY seqid), '}') AS json FROM p GROUP BY ALL""")
def _(t):
    scores = t.residues.groupBy(*X.RESIDUE).agg(F.max((F.col("res_id") % 997).cast("double") / 8).alias("score"))
    return X.scores_json(scores)
