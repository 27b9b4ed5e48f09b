"""Queries of the table readers, of structures and sequences, and the streaming jobs, on lines that Spark makes of the tables."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import variants as V
from helixframe.operators import structure as S
from helixframe.operators.stats import user_stats
from helixframe.plans.filter_queries import info_map
from helixframe.plans.function_queries import lines_of
from helixframe.plans.registry import query
from helixframe.plans.site_queries import sites_of
from helixframe.sources import tables as R
from helixframe.sources.scratch import folder, saved
from helixframe.streaming import jobs


def text(df, *cells, sep="\t"):
    return df.select(F.concat_ws(sep, *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cells]).alias("value"))


@query("s5_read_bed", 'SELECT iid, start_pos + 1 AS start, end_pos + 1 AS "end" FROM intervals')
def _(t):
    return R.shift_bed(t.intervals.select("iid", F.col("start_pos").cast("string").alias("start"), F.col("end_pos").cast("string").alias("end")), "ucsc")


@query("s6_classify_bed_name", "SELECT vid, CASE vid % 3 WHEN 0 THEN 'alleles' WHEN 1 THEN CASE WHEN id IS NULL THEN 'other' ELSE 'rsid' END ELSE 'hgvs' END AS kind FROM variants")
def _(t):
    k = F.col("vid") % 3
    name = F.when(k == 0, F.concat("ref", F.lit("/"), "alt1")).when(k == 1, F.coalesce("id", F.lit("?"))).otherwise(F.concat("chrom", F.lit(":c."), F.col("pos").cast("string"), "ref", F.lit(">"), "alt1"))
    return t.variants.select("vid", R.bed_name_kind(name).alias("kind"))


@query("s7_read_fasta", "SELECT concat('UPI', lpad(CAST(seq_id AS VARCHAR), 10, '0')) AS uniparc, md5(seq) AS md5sum, seq FROM sequences WHERE seq_id % 4 <> 0")
def _(t):
    head = F.concat(F.lit("UPI"), F.lpad(F.col("seq_id").cast("string"), 10, "0"), F.when(F.col("seq_id") % 4 != 0, " status=active").otherwise(" status=inactive"))
    records = t.sequences.select(F.concat(head, F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n")).alias("value"))
    return R.active_uniparc(R.fasta_records(records))


@query("s8_read_idmapping", "SELECT unp, id_type, ext_id FROM idmap")
def _(t):
    own = text(t.idmap, "unp", "id_type", "ext_id")
    return R.idmapping(own.union(text(t.idmap, "unp", F.lit("Unknown"), "ext_id")))


@query("s9_read_sec2prim", "SELECT DISTINCT concat('Q', CAST(c_custkey AS VARCHAR)) AS secondary, concat('P', CAST(c_custkey % 400 AS VARCHAR)) AS primary FROM customer WHERE concat('P', CAST(c_custkey % 400 AS VARCHAR)) IN (SELECT unp FROM idmap)")
def _(t):
    rows = text(t.customer, F.concat(F.lit("Q"), F.col("c_custkey").cast("string")), F.concat(F.lit("P"), (F.col("c_custkey") % 400).cast("string")), sep="   ")
    return R.sec2prim(rows, t.idmap)


@query("s10_read_swissprot", "SELECT concat('A', CAST(c_custkey AS VARCHAR)) AS ac, concat('N', CAST(c_custkey AS VARCHAR), '_HUMAN') AS name, concat('A', CAST(c_custkey AS VARCHAR)) AS primary FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT concat('B', CAST(c_custkey AS VARCHAR)), concat('N', CAST(c_custkey AS VARCHAR), '_HUMAN'), concat('A', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 3 = 0")
def _(t):
    k = F.col("c_custkey").cast("string")
    block = F.concat(F.lit("ID   N"), k, F.lit("_HUMAN   Reviewed;\nAC   A"), k, F.lit("; B"), k, F.lit(";\nOS   "), F.when(F.col("c_custkey") % 3 == 0, "Homo sapiens").otherwise("Mus musculus"), F.lit(".\n"))
    return R.swissprot(t.customer.select(block.alias("value")), "Homo sapiens")


@query("s11_read_mane", "SELECT unp, concat('ENST', CAST(k AS VARCHAR), '.1') AS enst, concat('ENSP', CAST(k AS VARCHAR), '.2') AS ensp, concat('NM_', CAST(k AS VARCHAR), '.3') AS refseq_nt, concat('NP_', CAST(k AS VARCHAR), '.4') AS refseq_np, CASE WHEN k % 2 = 0 THEN concat(unp, '-1') END AS isoform FROM (SELECT c_custkey AS k, concat('P', CAST(c_custkey AS VARCHAR)) AS unp FROM customer)")
def _(t):
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("P"), k, F.lit("\tDR   MANE-Select; ENST"), k, F.lit(".1; ENSP"), k, F.lit(".2; NM_"), k, F.lit(".3; NP_"), k, F.lit(".4."), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" [P"), k, F.lit("-1]"))).otherwise(""))
    return R.mane(t.customer.select(line.alias("value")))


@query("s12_read_sifts_xml", "SELECT lower(structid) AS pdbid, chain, CASE WHEN res_id % 9 <> 0 THEN seqid END AS resnum, CASE WHEN res_id % 5 = 0 AND res_id % 9 <> 0 THEN 'A' END AS icode, concat('P', CAST(res_id % 7 AS VARCHAR)) AS unp, seqid + 3 AS unp_resnum, concat('Pfam:PF', CAST(res_id AS VARCHAR)) AS domains, 'helix' AS secondary FROM residues")
def _(t):
    # The rows that Spark's XML reader gives, from XML text.
    r = F.col("res_id").cast("string")
    num = F.when(F.col("res_id") % 9 == 0, "null").otherwise(F.concat(F.col("seqid").cast("string"), F.when(F.col("res_id") % 5 == 0, "A").otherwise("")))
    xml = F.concat(F.lit('<residue><crossRefDb dbSource="PDB" dbAccessionId="'), F.lower("structid"), F.lit('" dbResNum="'), num, F.lit('" dbResName="ALA" dbChainId="'), "chain", F.lit('"/><crossRefDb dbSource="UniProt" dbAccessionId="P'), (F.col("res_id") % 7).cast("string"), F.lit('" dbResNum="'), (F.col("seqid") + 3).cast("string"), F.lit('"/><crossRefDb dbSource="Pfam" dbAccessionId="PF'), r, F.lit('"/><residueDetail property="nameSecondaryStructure">helix</residueDetail></residue>'))
    rows = t.residues.select(F.from_xml(xml, R.SIFTS_XML).alias("x")).select("x.*")
    return R.sifts_residues(rows).drop("resname")


@query("s13_read_sifts_json", "SELECT lower(structid) AS pdbid, transcript AS unp, chain, seqid AS unp_start, seqid + 5 AS unp_end FROM intervals")
def _(t):
    m = F.array(F.struct(F.col("chain").alias("chain_id"), F.col("seqid").alias("unp_start"), (F.col("seqid") + 5).alias("unp_end")))
    js = F.to_json(F.create_map(F.lower("structid"), F.struct(F.create_map("transcript", F.struct(m.alias("mappings"))).alias("UniProt"))))
    return R.sifts_json(t.intervals.select(js.alias("value")))


@query("s14_read_modbase", "SELECT concat('ENSP', CAST(p_partkey AS VARCHAR)) AS ensp, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS mpqs FROM part WHERE p_partkey % 5 <> 0")
def _(t):
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "XP").otherwise("ENSP"), F.col("p_partkey").cast("string"), F.lit(".2_1"))
    old = t.part.where("p_partkey % 2 = 1").select(name.alias("database_id"))
    new = t.part.where("p_partkey % 2 = 0").select(name.alias("database_id"), F.col("p_size").alias("mpqs"))
    return R.modbase_summaries(old, new).select("ensp", "mpqs")


@query("s15_read_swiss_index", "SELECT concat_ws('_', unp, CAST(p_size AS VARCHAR), CAST(p_size + 9 AS VARCHAR), 't1') AS modelid, unp, CAST(p_size AS INT) AS start, CAST(p_size + 9 AS INT) AS \"end\", 't1' AS template FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN concat('P', CAST(p_partkey % 50 AS VARCHAR), '-2') ELSE concat('P', CAST(p_partkey % 50 AS VARCHAR)) END AS unp, p_size FROM part)")
def _(t):
    ac = F.concat(F.lit("P"), (F.col("p_partkey") % 50).cast("string"))
    entry = F.struct(ac.alias("uniprot_ac"), F.when(F.col("p_partkey") % 2 == 0, F.concat(ac, F.lit("-2"))).alias("iso_id"), F.col("p_size").cast("int").alias("from"), (F.col("p_size") + 9).cast("int").alias("to"), F.lit("t1").alias("template"))
    return R.swiss_index(t.part.select(F.to_json(F.struct(F.array(entry).alias("index"))).alias("value")))


@query("s16_read_alphamissense", "SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS id, concat('A', CAST(p_size AS VARCHAR), 'G') AS protein_variant, round((p_partkey % 100) / 100.0, 2) AS score, 'benign' AS am_class FROM part")
def _(t):
    rows = text(t.part, F.concat(F.lit("T"), F.col("p_partkey").cast("string")), F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit("G")), F.format_number((F.col("p_partkey") % 100) / 100, 2), F.lit("benign"))
    head = t.spark.createDataFrame([("# text",), ("#id\tprotein_variant\tam_pathogenicity\tam_class",)], "value string")
    return R.alphamissense(head.union(rows)).select("id", "protein_variant", F.round(F.col("am_pathogenicity").cast("double"), 2).alias("score"), "am_class")


@query("s18_read_cosmis", "SELECT concat('P', CAST(p_partkey % 300 AS VARCHAR)) AS unp, CASE WHEN p_partkey % 300 % 2 = 0 THEN 'PDB' ELSE 'AF2' END AS source, p_size AS pos, p_partkey AS score FROM part")
def _(t):
    unp = F.concat(F.lit("P"), (F.col("p_partkey") % 300).cast("string")).alias("unp")
    even = F.col("p_partkey") % 300 % 2 == 0
    index = t.part.select(unp, F.when(even, "PDB").otherwise("AF2").alias("source")).distinct()
    score = lambda df: df.select(unp, F.col("p_size").alias("pos"), F.col("p_partkey").alias("score"))
    return R.cosmis(index, {"PDB": score(t.part), "AF2": score(t.part)}).select("unp", "source", "pos", "score")


@query("s19_read_rate4site", "SELECT CAST(seqid AS INT) AS pos, rescode AS letter, round(z, 3) AS score FROM residues")
def _(t):
    line = F.concat(F.lit("  "), F.col("seqid").cast("string"), F.lit("   "), "rescode", F.lit("   "), F.format_string("%.3f", F.round("z", 3)), F.lit("   [ 0.1, 0.9]  0.05   12/20"))
    return R.rate4site(t.residues.select(line.alias("value"))).select("pos", "letter", "score")


@query("s19_rate4site_summary", "SELECT structid AS file, round(min(z), 3) AS average, CAST(count(*) AS DOUBLE) / 10 AS stddev, CASE WHEN structid <> 'S3' THEN 1.5 END AS alpha FROM residues GROUP BY structid")
def _(t):
    by = t.residues.groupBy(F.col("structid").alias("file")).agg(F.format_string("%.3f", F.round(F.min("z"), 3)).alias("a"), F.format_string("%.1f", F.count("*") / 10).alias("s"))
    remarks = F.array(F.concat(F.lit("#Average = "), "a"), F.concat(F.lit("#Standard Deviation = "), "s"), F.when(F.col("file") != "S3", "#The alpha parameter 1.5").otherwise("#"), F.lit("  1   A   0.5   [ 0.1, 0.9]  0.05   12/20"))
    return R.rate4site_summary(by.select("file", F.explode(remarks).alias("value")))


@query("s20_read_interpro", "SELECT DISTINCT concat('P', CAST(c_custkey % 400 AS VARCHAR)) AS unp, concat('IPR', CAST(c_custkey AS VARCHAR)) AS match_id FROM customer WHERE concat('P', CAST(c_custkey % 400 AS VARCHAR)) IN (SELECT unp FROM idmap)")
def _(t):
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<protein id="P'), (k % 400).cast("string"), F.lit('-1"><match id="IPR'), k.cast("string"), F.lit('" name="n"/></protein>'))
    rows = t.customer.select(F.from_xml(xml, "_id string, match array<struct<_id: string, _name: string>>").alias("x")).select("x.*")
    return R.human_proteins(rows, t.idmap.select("unp")).select("unp", "match_id")


@query("s21_read_gwas", 'SELECT chrom, pos, pos + 1 AS "end", COALESCE(id, \'.\') AS snp, alt1 AS allele FROM variants')
def _(t):
    return R.gwas(t.variants.select("chrom", "pos", F.coalesce("id", F.lit(".")).alias("snp"), F.col("alt1").alias("allele")))


@query("s21_gwas_counts", "SELECT concat('rs', CAST(l_partkey % 1000 AS VARCHAR)) AS snp, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return R.gwas_counts(t.lineitem.select(F.concat(F.lit("rs"), (F.col("l_partkey") % 1000).cast("string")).alias("snp")))


@query("s22_read_panel", "SELECT sample FROM samples WHERE pop = 2")
def _(t):
    return R.panel(t.samples.select("sample", F.col("pop").cast("string").alias("population")), "2")


def atom_lines(t):
    n = lambda c: F.lpad(F.format_string("%.3f", F.round(c, 3)), 8, " ")
    r = t.residues.where("seqid > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    atom = F.element_at(F.array(F.lit(" CA "), F.lit(" CB "), F.lit(" H  ")), F.col("k") + 1)
    return r.select(F.concat(F.lit("ATOM  "), F.lpad((F.col("res_id") % 90000).cast("string"), 5, " "), F.lit(" "), atom, F.lit(" ALA "), "chain", F.lpad(F.col("seqid").cast("string"), 4, " "), F.lit("    "), n(F.col("x") + F.col("k")), n("y"), n("z"), F.lit("  1.00 10.00          "), F.when(F.col("k") == 2, " H").otherwise(" C")).alias("value"))


@query("s23_read_atoms", "SELECT chain, CAST(seqid AS INT) AS resid, count(*) * 3 AS n FROM residues WHERE seqid > 0 GROUP BY ALL")
def _(t):
    return R.atoms(atom_lines(t)).groupBy("chain", "resid").agg(F.count("*").alias("n"))


def cif_texts(t, rows=50_000):
    """mmCIF texts (structid, value) of residues: a structure in files of so many numbers, so that no row holds a growing structure."""
    n = lambda c: F.format_string("%.3f", F.round(c, 3))
    k = F.col("res_id")
    head = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id"]
    line = F.concat_ws("  ", F.lit("ATOM"), k.cast("string"), F.lit("C"), F.when(k % 2 == 0, "CA").otherwise("\"O5'\""), F.when(k % 5 == 0, "B").otherwise("."), F.lit("ALA"), F.lit("Z"), F.when(k % 7 == 0, "A").otherwise("?"), n("x"), n("y"), n("z"), F.col("seqid").cast("string"), "chain")
    texts = t.residues.groupBy("structid", F.floor(k / rows).alias("part")).agg(F.concat(F.lit("data_\n#\nloop_\n" + "".join(f"_atom_site.{h}\n" for h in head)), F.array_join(F.collect_list(line), "\n"), F.lit("\n#\n")).alias("value"))
    return texts.drop("part")


@query("s23_read_cif_atoms", """SELECT structid, 'ATOM' AS record, CAST(res_id AS INT) AS serial, CASE WHEN res_id % 2 = 0 THEN 'CA' ELSE concat('O5', chr(39)) END AS atom, CASE WHEN res_id % 5 = 0 THEN 'B' ELSE '' END AS altloc, 'ALA' AS resname, chain, CAST(seqid AS INT) AS resid, CASE WHEN res_id % 7 = 0 THEN 'A' ELSE '' END AS icode, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, 'C' AS element FROM residues""")
def _(t):
    return R.cif_atoms(cif_texts(t))


@query("t1_residue_centroid", "WITH a AS (SELECT chain, CAST(seqid AS INT) AS resid, round(x + k, 3) AS x, k, round(y, 3) AS y FROM residues, range(2) r(k) WHERE seqid > 0), b AS (SELECT chain, resid, k, avg(x) AS x, avg(y) AS y FROM a GROUP BY ALL) SELECT chain, resid, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM b GROUP BY ALL")
def _(t):
    return S.residue_centroids(R.atoms(atom_lines(t))).select("chain", "resid", "x", "y")


@query("p19_modified_residues", """WITH r AS (SELECT res_id, lower(structid) AS structid, ['ALA', 'MSE', 'Q1Q', 'Q2Q', 'Q3Q'][1 + CAST(res_id % 5 AS INT)] AS resname FROM residues), m AS (SELECT DISTINCT lower(structid) AS structid, CASE res_id % 5 WHEN 2 THEN 'Q1Q' ELSE 'Q2Q' END AS resname, CASE res_id % 5 WHEN 2 THEN 'TRP' ELSE 'LYS' END AS standard FROM residues WHERE (res_id % 5 = 2 AND structid < 'S5') OR res_id % 5 = 3)
 SELECT res_id, CASE resname WHEN 'ALA' THEN 'A' WHEN 'MSE' THEN 'M' ELSE CASE standard WHEN 'TRP' THEN 'W' WHEN 'LYS' THEN 'K' ELSE 'X' END END AS letter FROM r LEFT JOIN m USING (structid, resname)""")
def _(t):
    k = (F.col("res_id") % 5).cast("int")
    name = F.get(F.array(*map(F.lit, ("ALA", "MSE", "Q1Q", "Q2Q", "Q3Q"))), k)
    lines = t.residues.where("(res_id % 5 = 2 and structid < 'S5') or res_id % 5 = 3").select(F.format_string("MODRES %-4s %3s %s %4d  %3s  SOME RESIDUE", "structid", name, "chain", "seqid", F.when(k == 2, "TRP").otherwise("LYS")).alias("value"))
    other = t.residues.select(F.format_string("SEQRES %-4s", "structid").alias("value"))
    r = t.residues.select("res_id", F.lower("structid").alias("structid"), name.alias("resname"))
    return S.letters(r, R.modified_residues(lines.union(other)), "X").select("res_id", "letter")


@query("t2_residue_frame", "SELECT r.structid, r.chain, r.seqid, unp_pos, round(x, 4) AS x FROM residues r JOIN (SELECT structid, chain, CAST(seqid AS INT) AS seqid, max(iid % 1000) AS unp_pos FROM intervals GROUP BY ALL) a USING (structid, chain, seqid)")
def _(t):
    a = t.intervals.groupBy("structid", "chain", "seqid").agg(F.max(F.col("iid") % 1000).alias("unp_pos"))
    return S.residue_frame(t.residues, a).select("structid", "chain", "seqid", "unp_pos", F.round("x", 4).alias("x"))


_ONE = "o AS (SELECT structid, chain, seqid, min(rescode) AS rescode FROM residues GROUP BY ALL)"


def one_residue(t):
    return t.residues.groupBy("structid", "chain", "seqid").agg(F.min("rescode").alias("rescode"))


@query("t3_chain_filter", f"WITH {_ONE} SELECT structid, chain, string_agg(CASE WHEN rescode = 'W' THEN 'S' ELSE rescode END, '' ORDER BY seqid) AS seq FROM o WHERE seqid >= 1 AND chain <> 'D' AND seqid >= CAST(substr(structid, 2) AS INT) AND seqid <= 9 AND seqid % 7 > 0 GROUP BY structid, chain")
def _(t):
    own = one_residue(t).select("structid", "chain", "seqid", F.when(F.col("rescode") != "W", F.col("rescode")).alias("letter"), (F.col("seqid") % 7 == 0).alias("hetero"))
    chains = t.residues.select("structid", "chain").distinct().select("structid", "chain", F.when(F.col("chain") == "D", "MOUSE").otherwise("HUMAN").alias("species"), F.substring("structid", 2, 5).cast("int").alias("first"), F.lit(9).alias("last"))
    return S.protein_chains(own, chains)


@query("n12_gap_letters", f"WITH {_ONE}, k AS (SELECT * FROM o WHERE seqid % 3 <> 1), g AS (SELECT *, COALESCE(seqid - lag(seqid) OVER (PARTITION BY structid, chain ORDER BY seqid) - 1, 0) AS gap FROM k) SELECT structid, chain, string_agg(concat(repeat('X', gap), rescode), '' ORDER BY seqid) AS seq FROM g GROUP BY structid, chain")
def _(t):
    return S.chain_sequences(one_residue(t).where("seqid % 3 <> 1"))


@query("n11_renumber_residues", f"WITH {_ONE} SELECT structid, chain, seqid, row_number() OVER (PARTITION BY structid, chain ORDER BY seqid) + 200 * CAST(substr(structid, 2) AS BIGINT) AS number FROM o")
def _(t):
    begins = t.residues.select("structid", "chain").distinct().withColumn("begin", 1 + 200 * F.substring("structid", 2, 5).cast("int"))
    return S.renumbered(one_residue(t), begins)


@query("t4_biounits", "WITH op AS (SELECT * FROM (VALUES (1, 1.0, 0.0, 0.0, 5.0), (2, 0.0, -1.0, 1.0, 0.0)) v(op, c, s, r, t)) SELECT res_id AS serial, op, chain, round(c * x + s * y + t, 4) AS x, round(r * x + c * y, 4) AS y, round(z, 4) AS z FROM residues, op WHERE chain IN ('A', 'B')")
def _(t):
    rows = [(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.0), (2, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    ops = t.spark.createDataFrame(rows, ["op", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "t1", "t2", "t3"])
    asm = t.spark.createDataFrame([(1, c, o) for c in "AB" for o in (1, 2)], "assembly int, chain string, op long")
    return S.biounits(t.residues.withColumnRenamed("res_id", "serial"), asm, ops).select("serial", F.col("op").cast("int").alias("op"), "chain", "x", "y", "z")


@query("t5_trivial_align", """WITH r AS (SELECT seq_id AS k, unnest(range(1, length(seq) + 1)) AS i, seq FROM sequences), x AS (SELECT k, i, CASE WHEN k % 4 = 0 AND i = 30 THEN i + 9 ELSE i END AS num, CASE WHEN k % 5 = 0 AND i = length(seq) - k % 3 THEN '?' ELSE substr(seq, CASE WHEN k % 4 = 0 AND i = 30 THEN i + 9 ELSE i END, 1) END AS l, seq FROM r),
 y AS (SELECT k, num > COALESCE(lag(num) OVER (PARTITION BY k ORDER BY i), 0) AND num <= length(seq) AND substr(seq, num, 1) = l AS ok FROM x) SELECT k AS chain_key, bool_and(ok) AS trivial FROM y GROUP BY k""")
def _(t):
    # A residue of every fourth chain has another's number, and a late one of every fifth another letter.
    chain, n = F.col("seq_id"), F.length("seq")
    jump, late = (chain % 4 == 0) & (n >= 30), F.when(chain % 5 == 0, n - chain % 3)
    changed = lambda at, by, text: F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + 1, n))
    moved = F.when(jump, changed(F.lit(30), F.rpad(F.expr("substring(seq, 39, 1)"), 1, " "), F.col("seq"))).otherwise(F.col("seq"))
    letters = V.bound(moved, lambda x: F.when((late >= 1) & (late <= n), changed(late, F.lit("?"), x)).otherwise(x))
    residue = lambda l, k, jump: F.struct(F.when(jump & (k == 29), 39).otherwise(k + 1).alias("resnum"), l.alias("letter"), F.lit(False).alias("hetero"), F.lit("").alias("icode"))
    residues = V.bound(F.struct(F.split(letters, "").alias("l"), jump.alias("jump")), lambda x: F.transform(x["l"], lambda l, k: residue(l, k, x["jump"])))
    return S.trivial_alignments(t.sequences.where("length(seq) > 0").select(chain.alias("chain_key"), "seq_id", residues.alias("residues")), t.sequences)


def aligned(t):
    """Each chain's whole sequence against that of every other chain of its structure that comes after it."""
    s = S.chain_sequences(one_residue(t))
    b = s.select("structid", F.col("chain").alias("chain2"), F.col("seq").alias("b"))
    return S.global_alignments(s.join(b, "structid").where("chain < chain2").select(F.concat_ws(":", "structid", "chain", "chain2").alias("key"), F.col("seq").alias("a"), "b"))


@query("t6_global_align")
def _(t):
    return aligned(t)


@query("t7_best_alignment")
def _(t):
    return S.best_alignments(aligned(t).withColumn("gene", F.regexp_extract("key", "^(.*):", 1)), 0.1)


@query("a53_alignment_stats", """WITH p AS (SELECT seq_id AS key, unnest(range(1, CAST(length(seq) AS BIGINT) + 1)) AS i, seq FROM sequences), c AS (SELECT key, substr(seq, i, 1) AS a, CASE WHEN i % 4 = 0 THEN 'A' ELSE substr(seq, i, 1) END AS b, length(seq) AS n FROM p)
 SELECT key, round(count(*) / any_value(n), 2) AS perc_aligned, round(count(*) FILTER (CASE WHEN a = 'U' THEN 'M' ELSE a END = CASE WHEN b = 'U' THEN 'M' ELSE b END) / count(*), 2) AS perc_identity FROM c GROUP BY key""")
def _(t):
    p = t.sequences.where("length(seq) > 0").select(F.col("seq_id").alias("key"), F.posexplode(F.split("seq", "")).alias("i", "a")).withColumn("i", F.col("i") + 1)
    p = p.withColumn("b", F.when(F.col("i") % 4 == 0, "A").otherwise(F.col("a")))
    return S.alignment_stats(p.select("key", "a", "b"), t.sequences.select(F.col("seq_id").alias("key"), F.length("seq").alias("n"))).drop("score")


@query("a55_transcript_compare", "WITH p AS (SELECT seq_id, seq AS a, CASE WHEN seq_id % 3 = 0 THEN concat(left(seq, 10), 'Z', substr(seq, 12)) WHEN seq_id % 3 = 1 THEN concat(seq, 'A') ELSE seq END AS b FROM sequences WHERE length(seq) > 20) SELECT seq_id, CASE WHEN length(a) = length(b) THEN CAST(a <> b AS INT) END AS mismatches, CASE WHEN length(a) <> length(b) THEN 1.0 ELSE round(CAST(a <> b AS INT) / length(a), 6) END AS share FROM p")
def _(t):
    b = F.when(F.col("seq_id") % 3 == 0, F.concat(F.substring("seq", 1, 10), F.lit("Z"), F.expr("substring(seq, 12)"))).when(F.col("seq_id") % 3 == 1, F.concat("seq", F.lit("A"))).otherwise(F.col("seq"))
    return t.sequences.where("length(seq) > 20").select("seq_id", V.seq_identity(F.col("seq"), b).alias("x")).select("seq_id", "x.mismatches", "x.share")


@query("a55_differences", "WITH p AS (SELECT seq_id, seq AS a, CASE WHEN seq_id % 3 = 0 THEN concat(left(seq, 10), 'zy', substr(seq, 13)) WHEN seq_id % 3 = 1 THEN concat(left(seq, 4), '1', substr(seq, 6)) ELSE concat(seq, 'A') END AS b FROM sequences WHERE length(seq) > 20) SELECT seq_id, CASE seq_id % 3 WHEN 0 THEN concat('11 ', substr(a, 11, 1), '>z,12 ', substr(a, 12, 1), '>y') WHEN 1 THEN concat('5 ', substr(a, 5, 1), '>1') END AS differences, seq_id % 3 = 1 OR (seq_id % 3 = 0 AND round(2 / length(a), 6) < 0.01) AS close FROM p")
def _(t):
    b = F.when(F.col("seq_id") % 3 == 0, F.concat(F.substring("seq", 1, 10), F.lit("zy"), F.expr("substring(seq, 13)"))).when(F.col("seq_id") % 3 == 1, F.concat(F.substring("seq", 1, 4), F.lit("1"), F.expr("substring(seq, 6)"))).otherwise(F.concat("seq", F.lit("A")))
    return t.sequences.where("length(seq) > 20").select("seq_id", V.seq_differences(F.col("seq"), b).alias("differences"), V.close_enough(F.col("seq"), b).alias("close"))


_SLICE = "WITH v AS (SELECT vid, vid % 1009 AS contig, 1 + (vid * 7919) % (COALESCE(length(seq), 300) + 3) AS pos, alt1 FROM variants LEFT JOIN sequences ON seq_id = vid % 1009)"


def placed(t):
    """Variants spread over whole sequences, and some behind their ends."""
    v = t.variants.select("vid", (F.col("vid") % 1009).alias("contig"), "alt1").join(t.sequences.select(F.col("seq_id").alias("contig"), F.length("seq").alias("n")), "contig", "left")
    return v.select("vid", "contig", (1 + (F.col("vid") * 7919) % (F.coalesce("n", F.lit(300)) + 3)).alias("pos"), "alt1")


@query("t11_fill_aa", f"{_SLICE} SELECT vid, CASE WHEN seq_id IS NULL THEN 'NN' ELSE rpad(substr(seq, pos, 2), 2, 'N') END AS aa FROM v LEFT JOIN sequences ON seq_id = contig")
def _(t):
    chunks = S.chunked(t.sequences.select(F.col("seq_id").alias("contig"), "seq"), 64)
    spans = placed(t).select(F.col("vid").alias("key"), "contig", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"))
    return S.fetch(spans, chunks, 64).select(F.col("key").alias("vid"), F.col("seq").alias("aa"))


@query("t12_fill_fs", f"{_SLICE} SELECT vid, concat(lpad(CASE WHEN seq IS NULL THEN '' ELSE rpad(substr(seq, GREATEST(pos - 5, 1), LEAST(pos - 1, 5)), CAST(LEAST(pos - 1, 5) AS INT), 'N') END, CASE WHEN seq IS NULL THEN 0 ELSE 5 END, 'N'), CASE WHEN seq IS NULL THEN 'NNNNN' ELSE '' END, '[R/', alt1, ']', rpad(COALESCE(substr(seq, pos + 1, 5), ''), 5, 'N')) AS text FROM v LEFT JOIN sequences ON seq_id = contig")
def _(t):
    chunks = S.chunked(t.sequences.select(F.col("seq_id").alias("contig"), "seq"), 64)
    return S.flanks(placed(t).select("vid", "contig", "pos", F.lit("R").alias("ref"), F.col("alt1").alias("alt")), chunks, 64, 5)


@query("t12_masked_flanks", f"""{_SLICE}, m AS (SELECT DISTINCT contig, pos FROM v WHERE vid % 3 = 0), c AS (SELECT vid, contig, pos, alt1, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM v),
 x AS (SELECT c.*, CASE WHEN seq IS NULL OR c.pos + d < 1 OR c.pos + d > length(seq) THEN 'N' ELSE substr(seq, c.pos + d, 1) END AS l, m.pos IS NOT NULL AS hid FROM c LEFT JOIN sequences ON seq_id = c.contig LEFT JOIN m ON m.contig = c.contig AND m.pos = c.pos + d), y AS (SELECT vid, alt1, d, CASE WHEN hid THEN lower(l) ELSE l END AS l FROM x)
 SELECT vid, concat(string_agg(l, '' ORDER BY d) FILTER (d < 0), '[R/', any_value(alt1), ']', string_agg(l, '' ORDER BY d) FILTER (d > 0)) AS text FROM y GROUP BY vid""")
def _(t):
    chunks = S.chunked(t.sequences.select(F.col("seq_id").alias("contig"), "seq"), 64)
    masks = placed(t).where("vid % 3 = 0").select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return S.flanks(placed(t).select("vid", "contig", "pos", F.lit("R").alias("ref"), F.col("alt1").alias("alt")), chunks, 64, 5, masks, lower=True)


@query("t10_consensus", """WITH b AS (SELECT seq_id, seq, unnest(range(0, length(seq) // 10 + 1)) AS k FROM sequences), p AS (SELECT seq_id, k, substr(seq, CAST(10 * k + 1 AS BIGINT), 10) AS w FROM b),
 e AS (SELECT seq_id, k, CASE WHEN length(w) < 10 THEN w WHEN (seq_id + k) % 3 > 0 THEN concat(substr(w, 1, 2), 'ZZ', substr(w, 7, 1), 'Y', substr(w, 9)) ELSE concat(substr(w, 1, 4), 'QQQ', substr(w, 6, 2), 'Y', substr(w, 9)) END AS w FROM p) SELECT seq_id AS contig, string_agg(w, '' ORDER BY k) AS seq FROM e GROUP BY seq_id""")
def _(t):
    ref = t.sequences.select(F.col("seq_id").alias("contig"), "seq")
    own = ref.select("contig", F.posexplode(F.regexp_extract_all("seq", F.lit("(?s).{10}"), F.lit(0))).alias("k", "w"))
    piece = lambda at, n: F.substring("w", at, n)
    # The first of three is there in two of three stretches, and then takes the second one's place.
    first = F.struct((10 * F.col("k") + 3).alias("pos"), F.when((F.col("contig") + F.col("k")) % 3 > 0, piece(3, 4)).otherwise("????").alias("ref"), F.lit("ZZ").alias("alt"))
    second, third = F.struct((10 * F.col("k") + 5).alias("pos"), piece(5, 1).alias("ref"), F.lit("QQQ").alias("alt")), F.struct((10 * F.col("k") + 8).alias("pos"), piece(8, 1).alias("ref"), F.lit("Y").alias("alt"))
    return S.consensus(ref, own.select("contig", F.inline(F.array(first, second, third))), 1000)


_CODES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.IUPAC.items()) + "}"


@query("t10_sample_alternatives", f"""WITH c AS (SELECT vid, a1, a2, [ref, alt1, alt2] AS l, COALESCE(CASE WHEN a1 > 0 THEN l[a1 + 1] END, CASE WHEN a2 > 0 THEN l[a2 + 1] END) AS alt FROM calls JOIN variants USING (vid) WHERE sample = 3)
 SELECT vid, 'first' AS mode, l[a1 + 1] AS alt FROM c WHERE a1 > 0 UNION ALL SELECT vid, 'second', l[a2 + 1] FROM c WHERE a2 > 0 UNION ALL SELECT vid, 'any', alt FROM c WHERE alt IS NOT NULL
 UNION ALL SELECT vid, 'iupac', CASE WHEN a1 <> a2 THEN COALESCE({_CODES}[concat(LEAST(l[a1 + 1], l[a2 + 1]), GREATEST(l[a1 + 1], l[a2 + 1]))], alt) ELSE alt END FROM c WHERE alt IS NOT NULL""")
def _(t):
    modes = {"first": {"haplotype": 1}, "second": {"haplotype": 2}, "any": {}, "iupac": {"ambiguity": True}}
    return reduce(DataFrame.union, [S.sample_alternatives(sites_of(t), t.calls, 3, **how).select("vid", F.lit(name).alias("mode"), "alt") for name, how in modes.items()])


@query("t13_contrast", """WITH d AS (SELECT vid, sample, LEAST(a1, a2) AS x, GREATEST(a1, a2) AS y FROM calls WHERE COALESCE(dp, 0) >= 10 AND a1 IS NOT NULL AND a2 IS NOT NULL), m AS (SELECT * FROM d WHERE sample IN (1, 2, 3)), p AS (SELECT * FROM d WHERE sample IN (4, 5) AND vid IN (SELECT vid FROM m)),
 k AS (SELECT *, EXISTS (SELECT 1 FROM m WHERE m.vid = p.vid AND (m.x = p.x OR m.y = p.x)) AND EXISTS (SELECT 1 FROM m WHERE m.vid = p.vid AND (m.x = p.y OR m.y = p.y)) AS known, EXISTS (SELECT 1 FROM m WHERE m.vid = p.vid AND m.x = p.x AND m.y = p.y) AS same FROM p)
 SELECT vid, sample, CASE WHEN NOT known THEN 'allele' ELSE 'genotype' END AS novel FROM k WHERE NOT known OR NOT same""")
def _(t):
    return S.contrast(t.calls, [4, 5], [1, 2, 3], 10)


_PL = "pl AS (SELECT c.vid, sample, a1, a2, CASE WHEN alt2 IS NULL THEN 2 ELSE 3 END AS n, CASE WHEN gq % 11 <> 0 THEN CASE WHEN alt2 IS NULL THEN [gq % 60, gq % 7, dp % 50] ELSE [gq % 60, gq % 7, dp % 50, gq % 13, gq % 17, gq % 19] END END AS pl FROM calls c JOIN variants USING (vid))"


def with_likelihoods(t):
    gq, dp = F.col("gq"), F.col("dp")
    two = F.array(gq % 60, gq % 7, dp % 50)
    j = t.calls.join(t.variants.select("vid", "chrom", "pos", F.when(F.col("alt2").isNull(), 2).otherwise(3).alias("n_alleles")), "vid")
    return j.withColumn("pl", F.when(gq % 11 != 0, F.when(F.col("n_alleles") == 2, two).otherwise(F.concat(two, F.array(gq % 13, gq % 17, gq % 19)))))


@query("t13_contrast_scores", f"""WITH {_PL}, l AS (SELECT vid, sample, unnest(range(1, len(pl) + 1)) AS k, unnest(pl) AS x FROM pl WHERE pl[3] IS NOT NULL), b AS (SELECT vid, k, min(x) AS y FROM l WHERE sample IN (1, 2, 3) GROUP BY ALL), s AS (SELECT vid, sample, min(x + y) AS s FROM l JOIN b USING (vid, k) WHERE sample IN (4, 5, 6, 7) GROUP BY ALL)
 SELECT vid, min(s) AS score FROM s WHERE s > 0 GROUP BY vid""")
def _(t):
    return S.contrast_scores(with_likelihoods(t), [4, 5, 6, 7], [1, 2, 3])


@query("t14_likelihoods", f"""WITH {_PL}, h AS (SELECT vid, sample, n, CASE WHEN n = 2 THEN [pl[1], pl[3]] ELSE [pl[1], pl[3], pl[6]] END AS x FROM pl WHERE pl IS NOT NULL)
 SELECT vid, sample, array_to_string([COALESCE(CAST(z AS VARCHAR), '.') FOR z IN x], ',') AS one, COALESCE(list_position(x, list_min(x)) - 1, 0) AS best, CASE WHEN n = 2 THEN concat_ws(',', x[1], '.', COALESCE(CAST(x[2] AS VARCHAR), '.')) ELSE concat_ws(',', x[1], '.', COALESCE(CAST(x[2] AS VARCHAR), '.'), '.', '.', x[3]) END AS again FROM h""")
def _(t):
    text_of = lambda c: F.array_join(c.cast("array<string>"), ",", ".")
    own = with_likelihoods(t).where("pl is not null").withColumn("h", V.reshaped_likelihoods(F.col("pl"), F.col("n_alleles"), haploid=True))
    again = V.reshaped_likelihoods(F.col("h.values"), F.col("n_alleles"), haploid=False)["values"]
    return own.select("vid", "sample", text_of(F.col("h.values")).alias("one"), "h.best", text_of(again).alias("again"))


@query("t14_ploidy_by_likelihoods", f"""WITH {_PL}, p AS (SELECT pl.*, CASE WHEN chrom = 'chr5' AND sample % 2 = 0 THEN 1 ELSE 2 END AS p FROM pl JOIN variants USING (vid)), h AS (SELECT *, CASE WHEN n = 2 THEN [pl[1], pl[3]] ELSE [pl[1], pl[3], pl[6]] END AS x FROM p)
 SELECT vid, sample, CASE WHEN p = 1 AND pl IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL THEN COALESCE(list_position(x, list_min(x)) - 1, 0) ELSE a1 END AS a1, CASE WHEN p > 1 THEN a2 END AS a2, p AS ploidy FROM h""")
def _(t):
    regions = t.spark.createDataFrame([("chr5", 1, 10**9, "M", 1)], "chrom string, start long, end long, sex string, ploidy int")
    sexes = t.samples.select("sample", F.when(F.col("sample") % 2 == 0, "M").otherwise("F").alias("sex"))
    return S.fix_ploidy(with_likelihoods(t), regions, sexes).drop("pl")


@query("t14_fix_ploidy", "SELECT c.vid, sample, CASE WHEN p > 0 THEN a1 END AS a1, CASE WHEN p > 1 THEN a2 END AS a2, CAST(p AS INT) AS ploidy FROM (SELECT c.*, CASE WHEN chrom = 'chr5' AND pos BETWEEN 1 AND 100000 THEN CASE WHEN sample % 2 = 0 THEN 1 ELSE 2 END WHEN chrom = 'chr4' AND sample % 2 = 1 THEN 0 ELSE 2 END AS p FROM calls c JOIN variants USING (vid)) c")
def _(t):
    regions = t.spark.createDataFrame([("chr5", 1, 100000, "M", 1), ("chr4", 1, 10**9, "F", 0)], "chrom string, start long, end long, sex string, ploidy int")
    sexes = t.samples.select("sample", F.when(F.col("sample") % 2 == 0, "M").otherwise("F").alias("sex"))
    return S.fix_ploidy(t.calls.join(t.variants.select("vid", "chrom", "pos"), "vid"), regions, sexes)


@query("t15_validate", """WITH v AS (SELECT vid, chrom, CASE WHEN vid % 50 = 1 THEN -1 ELSE pos END AS pos, CASE WHEN vid % 41 = 2 THEN 'x' ELSE ref END AS ref, CASE WHEN vid % 43 = 3 THEN '!' ELSE alt1 END AS a, vid AS o, size FROM variants), h AS (SELECT vid, count(a1) + count(a2) AS an, count(*) FILTER (a1 = 1) + count(*) FILTER (a2 = 1) AS ac FROM calls GROUP BY vid), l AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY o) AS before FROM v)
 SELECT vid, 'position' AS rule FROM v WHERE pos < 0 UNION ALL SELECT vid, 'reference' FROM v WHERE ref = 'x' UNION ALL SELECT vid, 'alternative' FROM v WHERE a = '!' UNION ALL SELECT vid, 'unsorted' FROM l WHERE pos < before UNION ALL SELECT vid, 'duplicate position' FROM l WHERE pos = before UNION ALL SELECT vid, 'equal alleles' FROM v WHERE ref = a
 UNION ALL SELECT vid, 'INFO type' FROM v WHERE vid % 37 = 4 UNION ALL SELECT vid, 'INFO undeclared' FROM v WHERE vid % 47 = 5 UNION ALL SELECT DISTINCT vid, 'allele number' FROM calls WHERE a1 > 1 OR a2 > 1 UNION ALL SELECT v.vid, 'AN' FROM v LEFT JOIN h USING (vid) WHERE size <> COALESCE(an, 0) UNION ALL SELECT v.vid, 'AC' FROM v LEFT JOIN h USING (vid) WHERE size % 5 <> COALESCE(ac, 0)""")
def _(t):
    v = sites_of(t).withColumn("pos", F.when(F.col("vid") % 50 == 1, F.lit(-1).cast("long")).otherwise(F.col("pos"))).withColumn("ref", F.when(F.col("vid") % 41 == 2, "x").otherwise(F.col("ref")))
    v = v.withColumn("alts", F.array(F.when(F.col("vid") % 43 == 3, "!").otherwise(F.col("alt1")))).withColumn("order", F.col("vid"))
    info = F.map_filter(F.create_map(F.lit("DP"), F.when(F.col("vid") % 37 == 4, "x").otherwise(F.col("size").cast("string")), F.lit("ZZ"), F.when(F.col("vid") % 47 == 5, "1")), lambda _, x: x.isNotNull())
    v = v.withColumn("info", info).withColumn("an", F.col("size")).withColumn("ac", F.array(F.col("size") % 5))
    return S.validate(v, t.calls, {"DP": "Integer", "MQ": "Float"}, block_lines=70)


@query("t16_permute_snps", """WITH l AS (SELECT r.k AS round, chrom, pos, vid FROM variants, range(1, 4) r(k)), a AS (SELECT *, row_number() OVER (PARTITION BY round, chrom ORDER BY pos, vid) AS i FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY round, chrom ORDER BY md5(concat('11:', CAST(round AS VARCHAR), ':', CAST(vid AS VARCHAR))), vid, pos) AS i FROM l)
 SELECT a.round, a.chrom AS "group", a.pos AS place, b.vid AS label FROM a JOIN b ON a.round = b.round AND a.chrom = b.chrom AND a.i = b.i""")
def _(t):
    return S.permutations(t.variants.select(F.col("chrom").alias("group"), F.col("pos").alias("place"), F.col("vid").alias("label")), 3)


@query("t18_variable_residues", "WITH r AS (SELECT structid, chain, seqid, iid % 3 AS k FROM intervals), f AS (SELECT structid, bool_or(k = 1) AS any_flag FROM r GROUP BY structid) SELECT DISTINCT structid, chain, seqid FROM r JOIN f USING (structid) WHERE k = 1 OR (NOT any_flag AND k IS NOT NULL)")
def _(t):
    k = F.col("iid") % 3
    return S.variable_residues(t.intervals, k == 1, k)


@query("t19_remove_tags", "SELECT vid, CASE WHEN filter IS NULL THEN '.' WHEN filter = 'q10;s50' THEN 's50' ELSE '' END AS filters, CASE WHEN vid % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN vid % 19 = 0 THEN 0 ELSE 1 END + 1 AS n_info FROM variants")
def _(t):
    v = S.remove_tags(info_map(sites_of(t)), ["AA"], ["q10"], True)
    return v.select("vid", F.coalesce(F.array_join("filters", ";"), F.lit(".")).alias("filters"), F.size("info_map").alias("n_info"))


@query("t20_cmp_sequence", """WITH l AS (SELECT seq_id, seq, v.k, v.a FROM sequences, (VALUES (0, 1), (1, 3), (2, 7)) v(k, a)), m AS (SELECT DISTINCT seq_id, concat(left(seq, a), 'Q', substr(seq, a + 2)) AS made FROM l WHERE length(seq) >= 12),
 r AS (SELECT DISTINCT seq_id, concat(left(seq, a), CASE WHEN (seq_id + k) % 3 = 0 THEN 'Q' ELSE 'QQ' END, substr(seq, a + 2)) AS made FROM l WHERE length(seq) >= 12) SELECT m.seq_id AS "group", count(*) AS n_common FROM m JOIN r ON r.seq_id = m.seq_id AND r.made = m.made GROUP BY m.seq_id""")
def _(t):
    # Three variants in each file; every third of the second file is the first one's.
    s = t.sequences.where("length(seq) >= 12").select(F.col("seq_id").alias("group"), F.col("seq").alias("slice"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(off).alias("off")) for k, off in ((0, 1), (1, 3), (2, 7))])).alias("v")).select("group", "slice", "v.*")
    own = s.withColumn("ref", F.expr("substring(slice, off + 1, 1)"))
    left = own.select("group", "off", "ref", F.lit("Q").alias("alt"), "slice")
    right = own.select("group", "off", "ref", F.when((F.col("group") + F.col("k")) % 3 == 0, "Q").otherwise("QQ").alias("alt"), "slice")
    return S.same_sequence(left, right)


@query("a42_vcf_stats", "WITH v AS (SELECT LEAST(floor(qual / 10) * 10, 50.0) AS bin, CASE WHEN length(ref) = 1 THEN 'snp' ELSE 'indel' END AS type FROM variants) SELECT CAST(bin AS DOUBLE) AS bin, type, count(*) AS n FROM v GROUP BY GROUPING SETS ((bin, type), (type), ())")
def _(t):
    return S.binned_stats(t.variants.withColumn("type", F.when(F.length("ref") == 1, "snp").otherwise("indel")), "qual", 10, 50.0)


@query("a42_variant_counts", """WITH b AS (SELECT vid, ref, alt1, alt2, LEAST(floor(qual / 20) * 20, 60.0) AS bin FROM variants), al AS (SELECT bin, ref, unnest([x FOR x IN [alt1, alt2] IF x IS NOT NULL]) AS alt FROM b), k AS (SELECT vid, count(DISTINCT sample) AS c FROM calls WHERE a1 > 0 OR a2 > 0 GROUP BY vid),
 l AS (SELECT bin, 'change' AS stat, concat(ref, '>', alt) AS key FROM al WHERE length(ref) = 1 AND length(alt) = 1 AND ref <> alt UNION ALL SELECT bin, 'indel', CASE WHEN length(alt) > length(ref) THEN concat('+', CAST(length(alt) - length(ref) AS VARCHAR)) ELSE CAST(length(alt) - length(ref) AS VARCHAR) END FROM al WHERE length(ref) <> length(alt) AND (starts_with(ref, alt) OR starts_with(alt, ref) OR ends_with(ref, alt) OR ends_with(alt, ref))
  UNION ALL SELECT bin, 'n_alt', CASE WHEN alt2 IS NULL THEN '1' ELSE '2' END FROM b UNION ALL SELECT bin, 'carriers', CAST(COALESCE(c, 0) AS VARCHAR) FROM b LEFT JOIN k USING (vid))
 SELECT CAST(bin AS DOUBLE) AS bin, stat, key, count(*) AS n FROM l GROUP BY bin, stat, key UNION ALL SELECT NULL, stat, key, count(*) FROM l GROUP BY stat, key""")
def _(t):
    return S.variant_counts(sites_of(t), t.calls, F.col("qual"), 20, 60)


_EVENT = "CASE WHEN {a} = ref THEN 'r0' WHEN length({a}) = length(ref) THEN concat('s', CAST(len([i FOR i IN range(1, length(ref) + 1) IF substr(ref, i, 1) <> substr({a}, i, 1)]) AS VARCHAR)) WHEN starts_with(ref, {a}) OR starts_with({a}, ref) OR ends_with(ref, {a}) OR ends_with({a}, ref) THEN CASE WHEN length({a}) > length(ref) THEN concat('i+', CAST(length({a}) - length(ref) AS VARCHAR)) ELSE concat('i', CAST(length({a}) - length(ref) AS VARCHAR)) END ELSE 'o' END"
_KIND = "CASE left({t}, 1) WHEN 'r' THEN 'ref' WHEN 's' THEN 'snp' WHEN 'i' THEN 'indel' ELSE 'other' END"


@query("a42_user_stats", f"""WITH fc AS (SELECT * FROM calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL), pe AS (SELECT vid, count(*) FILTER (a1 > 0 OR a2 > 0) AS carriers, count(*) FILTER (a1 = 1 OR a2 = 1) > 0 AS one, count(*) FILTER (a1 = 2 OR a2 = 2) > 0 AS two FROM fc GROUP BY vid),
 si AS (SELECT v.*, COALESCE(carriers, 0) AS carriers, CAST(COALESCE(one, false) AS INT) + CAST(COALESCE(two, false) AS INT) AS n_alt FROM variants v LEFT JOIN pe USING (vid)),
 al AS (SELECT vid, ref, a, {_EVENT.format(a="a")} AS t FROM (SELECT vid, ref, unnest([x FOR x IN [alt1, alt2] IF x IS NOT NULL]) AS a FROM variants)),
 la AS (SELECT vid, ref, a, t, 'change' AS stat, concat(ref, '>', a) AS key FROM al WHERE t = 's1' UNION ALL SELECT vid, ref, a, t, CASE WHEN concat(ref, a) IN ('AG', 'GA', 'CT', 'TC') THEN 'ts' ELSE 'tv' END, '' FROM al WHERE t = 's1' UNION ALL SELECT vid, ref, a, t, 'indel', substr(t, 2) FROM al WHERE starts_with(t, 'i')),
 en AS (SELECT vid, 'count' AS stat, '' AS key FROM si UNION ALL SELECT vid, 'n_alt', CAST(n_alt AS VARCHAR) FROM si UNION ALL SELECT DISTINCT vid, {_KIND.format(t="t")}, '' FROM al UNION ALL SELECT vid, stat, key FROM la),
 bq AS (SELECT vid, floor(qual / 20) * 20 AS q, TRY_CAST(regexp_extract(info, 'DP=([0-9]+)', 1) AS INT) AS d FROM si),
 sc AS (SELECT vid, 'all' AS scope FROM si UNION ALL SELECT vid, concat('FILTER/', COALESCE(unnest(string_split(filter, ';')), '.')) FROM si WHERE filter IS NOT NULL UNION ALL SELECT vid, 'FILTER/.' FROM si WHERE filter IS NULL
  UNION ALL SELECT vid, concat('QUAL/', CASE WHEN q > 60 THEN '>60' ELSE CAST(CAST(q AS INT) AS VARCHAR) END) FROM bq UNION ALL SELECT vid, concat('INFO/DP/', CASE WHEN d // 50 * 50 > 100 THEN '>100' ELSE CAST(d // 50 * 50 AS VARCHAR) END) FROM bq UNION ALL SELECT vid, 'INFO/DB' FROM si WHERE info LIKE '%;DB%'),
 ca AS (SELECT fc.vid, sample, a1, a2, COALESCE(phased, false) AS ph, dp, gq, carriers FROM fc JOIN si USING (vid)),
 ce AS (SELECT DISTINCT vid, sample, unnest([a1, a2]) AS k FROM ca), ct AS (SELECT ce.vid, sample, CASE WHEN k = 0 THEN v.ref WHEN k = 1 THEN alt1 ELSE alt2 END AS a, v.ref FROM ce JOIN variants v USING (vid)), cx AS (SELECT DISTINCT vid, sample, ref, a, CASE WHEN a = ref THEN 'r0' ELSE {_EVENT.format(a="a")} END AS t FROM ct WHERE a IS NOT NULL),
 ke AS (SELECT vid, sample, 'count' AS stat, '' AS key FROM ca UNION ALL SELECT vid, sample, CASE WHEN a1 = a2 AND a1 = 0 THEN 'hom_RR' WHEN a1 = 0 OR a2 = 0 THEN 'het_RA' WHEN a1 = a2 THEN 'hom_AA' ELSE 'het_AA' END, '' FROM ca UNION ALL SELECT vid, sample, CASE WHEN ph THEN 'phased' ELSE 'unphased' END, '' FROM ca
  UNION ALL SELECT DISTINCT vid, sample, {_KIND.format(t="t")}, '' FROM cx UNION ALL SELECT cx.vid, sample, stat, key FROM cx JOIN la ON la.vid = cx.vid AND la.a = cx.a WHERE cx.t <> 'r0' UNION ALL SELECT vid, sample, 'private', '' FROM ca WHERE carriers = 1 AND (a1 > 0 OR a2 > 0)),
 ks AS (SELECT vid, sample, 'all' AS scope FROM ca UNION ALL SELECT vid, sample, concat('FORMAT/GQ/', CAST(gq // 25 * 25 AS VARCHAR)) FROM ca UNION ALL SELECT vid, sample, concat('SAMPLE/3/DP/', CASE WHEN dp IS NULL THEN '.' WHEN dp // 10 * 10 > 30 THEN '>30' ELSE CAST(dp // 10 * 10 AS VARCHAR) END) FROM ca WHERE sample = 3)
 SELECT scope, CAST(NULL AS INT) AS sample, stat, key, count(*) AS n FROM en JOIN sc USING (vid) GROUP BY ALL UNION ALL SELECT 'all', NULL, 'shared', CAST(carriers AS VARCHAR), count(*) FROM si GROUP BY carriers UNION ALL SELECT scope, sample, stat, key, count(*) FROM ke JOIN ks USING (vid, sample) GROUP BY ALL""")
def _(t):
    return user_stats(info_map(sites_of(t)), t.calls, ["FILTER", "QUAL=20:60", "INFO/DP=50:100", "INFO/DB=flag", "FORMAT/GQ=25:100", "SAMPLE/3/DP=10:30"])


@query("a42_sample_stats", """WITH c AS (SELECT sample, vid, a1, a2 FROM calls WHERE a1 > 0 OR a2 > 0), k AS (SELECT vid, count(DISTINCT sample) AS n FROM c GROUP BY vid)
 SELECT sample, count(*) AS n, count(*) FILTER (length(ref) = 1 AND alt2 IS NULL) AS n_snp, count(*) FILTER (length(ref) > 1 OR alt2 IS NOT NULL) AS n_indel, count(*) FILTER (alt2 IS NOT NULL) AS n_multi, count(*) FILTER (k.n = 1) AS n_private, count(*) FILTER (k.n > 1) AS n_shared,
 count(*) FILTER (length(ref) = 1 AND alt2 IS NULL AND concat(ref, alt1) IN ('AG', 'GA', 'CT', 'TC')) AS n_ts FROM c JOIN k USING (vid) JOIN variants USING (vid) GROUP BY sample""")
def _(t):
    return S.sample_stats(sites_of(t), t.calls)


@query("s17_read_pfam", "SELECT concat('S', CAST(p_partkey % 10 AS VARCHAR)) AS structid, p_size AS seqstart, p_size + 30 AS seqend FROM part")
def _(t):
    rows = text(t.part, F.concat(F.lit("S"), (F.col("p_partkey") % 10).cast("string")), F.lit("A"), "p_size", F.col("p_size") + 30, F.lit("PF1"), F.lit("n"))
    return R.pfam(rows).select("structid", F.col("seqstart").cast("long").alias("seqstart"), F.col("seqend").cast("long").alias("seqend"))


_CSQ = "c AS (SELECT vid, chrom, pos, split_part(csq, '|', 1) AS cons, split_part(csq, '|', 2) AS tr, split_part(csq, '|', 3) AS aa, TRY_CAST(split_part(split_part(csq, '|', 4), '-', 1) AS INT) AS ppos FROM consequences)"


def parsed(t):
    return t.consequences.select("vid", "chrom", "pos", V.parse_csq(F.col("csq"), ["Consequence", "Feature", "Amino_acids", "Protein_position"]).alias("c")).select("vid", "chrom", "pos", "c.*")


@query("f36_missense_filter", f"WITH {_CSQ} SELECT DISTINCT pos, aa FROM c WHERE cons LIKE '%missense_variant%' AND aa <> '' AND tr IN ('T5', 'T12', 'T19', 'T26')")
def _(t):
    c = parsed(t).where(F.col("consequence").contains("missense_variant") & (F.length("ref_amino_acid") == 1) & (F.length("alt_amino_acid") == 1) & F.col("feature").isin("T5", "T12", "T19", "T26"))
    return c.select("pos", F.concat_ws("/", "ref_amino_acid", "alt_amino_acid").alias("aa")).distinct()


@query("f37_gnomad_missense", f"WITH {_CSQ} SELECT c.vid, concat('G', substr(tr, 2)) AS gene, chrom, pos, tr AS transcript, aa, ppos, round(COALESCE(CASE WHEN vid % 4 <> 0 THEN (vid % 100) / 100 END, 0.0), 6) AS maf FROM c WHERE chrom = 'chr2' AND pos BETWEEN 1000 AND 150000 AND cons LIKE '%missense_variant%'")
def _(t):
    c = parsed(t).where((F.col("chrom") == "chr2") & F.col("pos").between(1000, 150000) & F.col("consequence").contains("missense_variant"))
    maf = F.when(F.col("vid") % 4 != 0, (F.col("vid") % 100) / 100)
    return c.select("vid", F.concat(F.lit("G"), F.substring("feature", 2, 9)).alias("gene"), "chrom", "pos", F.col("feature").alias("transcript"), F.coalesce(F.concat("ref_amino_acid", F.lit("/"), "alt_amino_acid"), F.lit("")).alias("aa"), F.col("protein_pos").alias("ppos"), F.round(F.coalesce(maf, F.lit(0.0)), 6).alias("maf"))


#: Terms by site, some of which count.
_TERMS = [*V.NONSYNONYMOUS, "start_lost", "protein_altering_variant", "coding_sequence_variant", "intron_variant"]


@query("f38_nonsyn_filter", f"WITH c AS (SELECT vid, split_part(csq, '|', 1) AS own, {_TERMS}[1 + CAST(vid % {len(_TERMS)} AS INT)] AS more FROM consequences), d AS (SELECT vid, concat(own, '&', more) AS cons FROM c) SELECT vid, cons FROM d WHERE list_has_any(string_split(cons, '&'), {V.NONSYNONYMOUS})")
def _(t):
    more = F.get(F.array(*map(F.lit, _TERMS)), (F.col("vid") % len(_TERMS)).cast("int"))
    c = t.consequences.select("vid", F.concat(F.split("csq", r"\|")[0], F.lit("&"), more).alias("cons"))
    return c.where(V.is_nonsynonymous(F.col("cons")))


@query("o4_view_order", "SELECT structid, chain, seqid, res_id, row_number() OVER (PARTITION BY structid ORDER BY chain, seqid, res_id) AS k FROM residues")
def _(t):
    return S.view_order(t.residues.select("structid", "chain", "seqid", "res_id"), ["chain", "seqid", "res_id"])


@query("r1_stream_ingest", "SELECT chrom, pos, COALESCE(id, '.') AS id, ref, concat_ws(',', alt1, alt2) AS alts, qual FROM variants")
def _(t):
    at = folder(t.spark, "arrive")
    data = lines_of(t)
    data.union(data.where("value like 'chr1%'")).write.text(f"{at}/in")  # some lines arrive twice
    jobs.ingest(jobs.arriving_lines(t.spark, f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/out")


@query("s25_ingest_vcf_dir", "SELECT chrom, pos, COALESCE(id, '.') AS id, ref, concat_ws(',', alt1, alt2) AS alts, qual FROM variants")
def _(t):
    at = folder(t.spark, "arrive")
    data = saved(lines_of(t), "lines")
    # A first load, then all files again with more, and then the last batch once more by itself.
    data.where("value like 'chr1%' or value like 'chr2%'").write.text(f"{at}/in")
    jobs.ingest_dir(jobs.arriving_lines(t.spark, f"{at}/in"), f"{at}/table", f"{at}/state").awaitTermination()
    data.write.mode("append").text(f"{at}/in")
    jobs.ingest_dir(jobs.arriving_lines(t.spark, f"{at}/in"), f"{at}/table", f"{at}/state").awaitTermination()
    jobs.add_new(jobs.sites_of_lines(data.where("value like 'chr2%' or value like 'chr5%'")), f"{at}/table")
    return t.spark.read.parquet(f"{at}/table").select("chrom", "pos", "id", "ref", "alts", "qual")


@query("r2_stream_counts", "SELECT CASE WHEN filter IS NULL THEN '.' WHEN filter = 'PASS' THEN '' ELSE filter END AS filter, count(*) AS n, count(*) FILTER (alt2 IS NULL AND concat(ref, alt1) IN ('AG', 'GA', 'CT', 'TC')) AS n_ts FROM variants GROUP BY 1")
def _(t):
    at, name = folder(t.spark, "arrive"), f"counts_{uuid4().hex}"
    lines_of(t).write.text(f"{at}/in")
    jobs.run_counts(jobs.arriving_lines(t.spark, f"{at}/in"), name, f"{at}/state").awaitTermination()
    return t.spark.table(name)
