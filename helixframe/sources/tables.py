"""Readers of the other inputs: intervals, sequences, identifier maps, residue alignments, models, scores and panels.

Each reader has two halves: the one that opens a path with a built-in Spark source, and the one that makes the table of its
lines or rows, which can be used on any DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of identifiers that an id map keeps. Fixed values.
ID_TYPES = ("UniParc", "UniProtKB-ID", "Gene_Name", "GeneID", "Ensembl_TRS", "Ensembl_PRO", "PDB", "RefSeq", "RefSeq_NT")


def cells(sep: str = "\t") -> Column:
    return F.split("value", sep)


def read_bed(spark: SparkSession, path: str, sep: str = "\t", indexing: str = "ucsc") -> DataFrame:
    return shift_bed(spark.read.option("sep", sep).option("header", True).csv(path), indexing)


def shift_bed(bed: DataFrame, indexing: str) -> DataFrame:
    """Ends of (chrom, start, end) to 1-based, end-exclusive: ucsc adds one to both, ensembl to the end, own to none."""
    up = {"ucsc": (1, 1), "ensembl": (0, 1), "own": (0, 0)}[indexing]
    return bed.withColumn("start", F.col("start").cast("long") + up[0]).withColumn("end", F.col("end").cast("long") + up[1])


def bed_name_kind(name: Column) -> Column:
    return F.when(name.rlike("^[ACGT-]+/[ACGT/-]+$"), "alleles").when(name.rlike("^rs[0-9]+$"), "rsid").when(name.rlike(r"^[^:]+:[cgp]\."), "hgvs").otherwise("other")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq): one record to a row, its lines joined; the last record is one too."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def fasta_records(records: DataFrame) -> DataFrame:
    text = F.regexp_replace("value", "^>", "")
    first = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    return records.where(F.trim("value") != "").select(first.alias("header"), F.regexp_replace(rest, r"\s", "").alias("seq"))


def active_uniparc(records: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(uniparc, md5sum, seq) of records marked active, ids of 13 letters; keep: a semi-join on uniparc."""
    out = records.where(F.col("header").contains("status=active")).select(F.substring("header", 1, 13).alias("uniparc"), F.md5("seq").alias("md5sum"), "seq")
    return out if keep is None else out.join(keep.select("uniparc"), "uniparc", "left_semi")


def idmapping(lines: DataFrame) -> DataFrame:
    c = cells()
    return lines.select(c[0].alias("unp"), c[1].alias("id_type"), c[2].alias("ext_id")).where(F.col("id_type").isin(*ID_TYPES))


def read_idmapping(spark: SparkSession, path: str) -> DataFrame:
    return idmapping(spark.read.text(path))


def sec2prim(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(secondary, primary) of known primaries (unp)."""
    c = F.split("value", r"\s+")
    return lines.select(c[0].alias("secondary"), c[1].alias("unp")).join(known.select("unp").distinct(), "unp", "left_semi").select("secondary", F.col("unp").alias("primary"))


def read_swissprot(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    return swissprot(spark.read.option("lineSep", "\n//\n").text(path), species)


def swissprot(blocks: DataFrame, species: str | None = None) -> DataFrame:
    """(ac, name, primary): a row per accession of a flat-file entry; the first is the primary one."""
    own = blocks.where(F.trim("value") != "")
    if species:
        own = own.where(F.col("value").contains(f"\nOS   {species}"))
    acs = F.split(F.regexp_replace(F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^AC   (.*)$"), F.lit(1)), " "), r"[\s]", ""), ";")
    rows = own.select(F.regexp_extract("value", r"(?m)^ID   (\S+)", 1).alias("name"), F.filter(acs, lambda x: x != "").alias("acs"))
    return rows.select(F.explode("acs").alias("ac"), "name", F.col("acs")[0].alias("primary"))


def mane(lines: DataFrame) -> DataFrame:
    """(unp, enst, ensp, refseq_nt, refseq_np, isoform) of DR MANE-Select lines that follow their accession by a tab."""
    p = r"^(\S+)\tDR   MANE-Select; ([^;]+); ([^;]+); ([^;]+); ([^;.]+(?:\.\d+)?)\.?(?: \[([^\]]+)\])?$"
    x = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(x(1).alias("unp"), x(2).alias("enst"), x(3).alias("ensp"), x(4).alias("refseq_nt"), x(5).alias("refseq_np"), F.when(x(6) != "", x(6)).alias("isoform"))


SIFTS_XML = "_dbResNum string, _dbResName string, crossRefDb array<struct<_dbSource: string, _dbAccessionId: string, _dbResNum: string, _dbResName: string, _dbChainId: string>>, residueDetail array<struct<_VALUE: string, _property: string>>"


def read_sifts_xml(spark: SparkSession, path: str) -> DataFrame:
    return sifts_residues(spark.read.format("xml").option("rowTag", "residue").schema(SIFTS_XML).load(path))


def sifts_residues(rows: DataFrame) -> DataFrame:
    """(pdbid, chain, resnum, icode, resname, unp, unp_resnum, domains, secondary): one row a residue. The insertion code is
    the letter behind the number; 'null' is null; several domains are joined by commas."""
    one = lambda db: F.get(F.filter("crossRefDb", lambda x: x["_dbSource"] == db), F.lit(0))
    pdb, unp = one("PDB"), one("UniProt")
    num = F.when(pdb["_dbResNum"] != "null", pdb["_dbResNum"])
    domains = F.array_join(F.array_sort(F.transform(F.filter("crossRefDb", lambda x: x["_dbSource"].isin("Pfam", "CATH", "SCOP", "InterPro")), lambda x: F.concat_ws(":", x["_dbSource"], x["_dbAccessionId"]))), ",")
    ss = F.get(F.filter("residueDetail", lambda x: x["_property"] == "nameSecondaryStructure"), F.lit(0))["_VALUE"]
    return rows.select(
        pdb["_dbAccessionId"].alias("pdbid"), pdb["_dbChainId"].alias("chain"), F.regexp_extract(num, r"^(-?\d+)", 1).try_cast("int").alias("resnum"), F.nullif(F.regexp_extract(num, r"([A-Za-z])$", 1), F.lit("")).alias("icode"),
        pdb["_dbResName"].alias("resname"), unp["_dbAccessionId"].alias("unp"), unp["_dbResNum"].try_cast("int").alias("unp_resnum"), domains.alias("domains"), ss.alias("secondary"),
    )


def sifts_json(texts: DataFrame) -> DataFrame:
    """(pdbid, unp, chain, unp_start, unp_end): nested maps pdb -> UniProt -> accession -> mappings, a row per mapping."""
    kind = "map<string, struct<UniProt: map<string, struct<mappings: array<struct<chain_id: string, unp_start: int, unp_end: int>>>>>>"
    x = texts.select(F.explode(F.from_json("value", kind)).alias("pdbid", "x")).select("pdbid", F.explode("x.UniProt").alias("unp", "m")).select("pdbid", "unp", F.explode("m.mappings").alias("m"))
    return x.select("pdbid", "unp", F.col("m.chain_id").alias("chain"), "m.unp_start", "m.unp_end")


def modbase_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two layouts of model summaries as one, missing columns null; only ENSP models; ensp without version and number."""
    both = old.unionByName(new, allowMissingColumns=True).where(F.col("database_id").startswith("ENSP"))
    return both.withColumn("ensp", F.regexp_replace(F.regexp_replace("database_id", r"_\d+$", ""), r"\.\d+$", ""))


def swiss_index(texts: DataFrame) -> DataFrame:
    """(modelid, unp, start, end, template): entries of index arrays; an isoform id wins if it has a dash; of entries with
    one id the last one holds."""
    kind = "struct<index: array<struct<uniprot_ac: string, iso_id: string, `from`: int, `to`: int, template: string>>>"
    x = texts.select(F.posexplode(F.from_json("value", kind)["index"]).alias("k", "e"))
    unp = F.when(F.col("e.iso_id").contains("-"), F.col("e.iso_id")).otherwise(F.col("e.uniprot_ac"))
    rows = x.select("k", unp.alias("unp"), F.col("e.from").alias("start"), F.col("e.to").alias("end"), "e.template")
    rows = rows.withColumn("modelid", F.concat_ws("_", "unp", F.col("start").cast("string"), F.col("end").cast("string"), "template"))
    return rows.groupBy("modelid").agg(*[F.max_by(c, "k").alias(c) for c in ("unp", "start", "end", "template")])


def read_alphamissense(spark: SparkSession, path: str) -> DataFrame:
    return alphamissense(spark.read.text(path))


def alphamissense(lines: DataFrame) -> DataFrame:
    c = cells()
    return lines.where(~F.col("value").startswith("#")).select(c[0].alias("id"), c[1].alias("protein_variant"), c[2].try_cast("float").alias("am_pathogenicity"), c[3].alias("am_class")).where("am_pathogenicity is not null")


def read_pfam(spark: SparkSession, path: str) -> DataFrame:
    return pfam(spark.read.text(path).where(~F.col("value").startswith("structid")))


def pfam(lines: DataFrame) -> DataFrame:
    """Domain ranges of a structure's chain."""
    c = cells()
    return lines.select(c[0].alias("structid"), c[1].alias("chain"), c[2].try_cast("int").alias("seqstart"), c[3].try_cast("int").alias("seqend"), c[4].alias("acc"), c[5].alias("name"))


def cosmis(index: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """index (unp, struct_id, source), joined with the scores (unp, pos, score) of its own source."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), (df.withColumn("source", F.lit(s)) for s, df in scores.items()))
    return index.join(every, ["unp", "source"])


def rate4site(lines: DataFrame) -> DataFrame:
    """(pos, letter, score, low, high, std, n): data lines of the fixed format `pos letter score [low, high] std n/m`."""
    p = r"^\s*(\d+)\s+([A-Z])\s+(-?[\d.]+)\s+\[\s*(-?[\d.]+),\s*(-?[\d.]+)\]\s+([\d.]+)\s+(\d+)/"
    x = lambda i, kind: F.regexp_extract("value", p, i).try_cast(kind)
    return lines.where(F.col("value").rlike(p)).select(x(1, "int").alias("pos"), F.regexp_extract("value", p, 2).alias("letter"), x(3, "double").alias("score"), x(4, "double").alias("low"), x(5, "double").alias("high"), x(6, "double").alias("std"), x(7, "int").alias("n"))


def rate4site_summary(lines: DataFrame) -> DataFrame:
    """(file, average, stddev, alpha) of the remarks in files' lines (file, value); null where a file has none."""
    said = lambda p: F.max(F.regexp_extract("value", p, 1).try_cast("double"))
    number = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    return lines.where(F.col("value").startswith("#")).groupBy("file").agg(said(rf"Average\s*=\s*{number}").alias("average"), said(rf"Standard Deviation\s*=\s*{number}").alias("stddev"), said(rf"alpha parameter\s*=?\s*{number}").alias("alpha"))


def read_interpro(spark: SparkSession, path: str, human: DataFrame) -> DataFrame:
    """Matches of human proteins of a very large XML: one row a protein, split by Spark's reader, then a semi-join."""
    rows = spark.read.format("xml").option("rowTag", "protein").schema("_id string, match array<struct<_id: string, _name: string>>").load(path)
    return human_proteins(rows, human)


def human_proteins(rows: DataFrame, human: DataFrame) -> DataFrame:
    return rows.withColumn("unp", F.split("_id", "-")[0]).join(human.select("unp"), "unp", "left_semi").select("unp", F.explode("match").alias("m")).select("unp", F.col("m._id").alias("match_id"), F.col("m._name").alias("match_name"))


def gwas(rows: DataFrame) -> DataFrame:
    """BED order of catalogue rows (chrom, pos, snp, allele)."""
    return rows.select("chrom", "pos", (F.col("pos") + 1).alias("end"), "snp", "allele")


def gwas_counts(rows: DataFrame, by: str = "snp") -> DataFrame:
    """(by, n): associations of each site, the most first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def panel(rows: DataFrame, population: str) -> DataFrame:
    return rows.where(F.col("population") == population).select("sample")


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    return atoms(spark.read.text(path))


def atoms(lines: DataFrame) -> DataFrame:
    """Atoms of fixed-width coordinate lines."""
    s = lambda a, n: F.trim(F.substring("value", a, n))
    return lines.where(F.col("value").rlike("^(ATOM  |HETATM)")).select(
        s(1, 6).alias("record"), s(7, 5).try_cast("int").alias("serial"), s(13, 4).alias("atom"), s(17, 1).alias("altloc"), s(18, 3).alias("resname"), s(22, 1).alias("chain"), s(23, 4).try_cast("int").alias("resid"), s(27, 1).alias("icode"),
        s(31, 8).try_cast("double").alias("x"), s(39, 8).try_cast("double").alias("y"), s(47, 8).try_cast("double").alias("z"), s(77, 2).alias("element"),
    )


def modified_residues(lines: DataFrame) -> DataFrame:
    """(structid, resname, chain, resid, icode, standard) of the MODRES records of structure files: which standard residue each
    modified one stands for."""
    s = lambda a, n: F.trim(F.substring("value", a, n))
    return lines.where(F.col("value").startswith("MODRES")).select(
        F.lower(s(8, 4)).alias("structid"), F.upper(s(13, 3)).alias("resname"), s(17, 1).alias("chain"), s(19, 4).try_cast("int").alias("resid"), s(23, 1).alias("icode"), F.upper(s(25, 3)).alias("standard"))


def read_cif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of mmCIF files, a structure each."""
    return cif_atoms(spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\..*$", "").alias("structid"), "value"))


def cif_atoms(texts: DataFrame) -> DataFrame:
    """Atoms of mmCIF texts (structid, value), with the columns of atoms() and structid. The file says in which order its
    columns stand; a column that it lacks is null. Author's names and numbers come before the labels."""
    # The names are read off a text before its lines are dealt out; beside explode() they would be read again for every line.
    own = texts.select("structid", F.regexp_extract_all("value", F.lit(r"(?m)^_atom_site\.(\S+)"), F.lit(1)).alias("names"), F.regexp_extract_all("value", F.lit(r"(?m)^(?:ATOM|HETATM)\s.*$"), F.lit(0)).alias("lines"))
    own = own.select("structid", "names", F.explode("lines").alias("line"))
    own = own.withColumn("f", F.split(F.trim("line"), r"\s+"))

    def item(*names: str) -> Column:
        found = [F.get("f", F.array_position("names", n).cast("int") - 1) for n in names]
        value = F.coalesce(*[F.when(F.array_contains("names", n), x) for n, x in zip(names, found, strict=True)])
        return F.when(~value.isin(".", "?"), F.regexp_replace(value, r"""^["'](.*)["']$""", "$1"))

    blank = lambda c: F.coalesce(c, F.lit(""))
    return own.select(
        "structid", item("group_PDB").alias("record"), item("id").try_cast("int").alias("serial"), item("auth_atom_id", "label_atom_id").alias("atom"), blank(item("label_alt_id")).alias("altloc"), item("auth_comp_id", "label_comp_id").alias("resname"),
        item("auth_asym_id", "label_asym_id").alias("chain"), item("auth_seq_id", "label_seq_id").try_cast("int").alias("resid"), blank(item("pdbx_PDB_ins_code")).alias("icode"), *[item(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], item("type_symbol").alias("element"),
    )
