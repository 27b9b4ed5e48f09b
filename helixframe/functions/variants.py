"""Functions of a variant's alleles, calls and consequences: Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of bases and their ambiguity codes (IUPAC). Fixed values.
IUPAC = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
#: Residue names and letters, some modified ones included. Fixed values.
AA3 = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U"}
#: Modified residues and the letters of those that they stand for, by name; ASX and GLX are either of two. Fixed values.
MODIFIED = {
    "2AS": "D", "3AH": "H", "5HP": "E", "ACL": "R", "AGM": "R", "AIB": "A", "ALM": "A", "ALO": "T", "ALY": "K", "ARM": "R", "ASA": "D", "ASB": "D", "ASK": "D", "ASL": "D", "ASQ": "D", "ASX": "B",
    "AYA": "A", "BCS": "C", "BHD": "D", "BMT": "T", "BNN": "A", "BUC": "C", "BUG": "L", "C5C": "C", "C6C": "C", "CCS": "C", "CEA": "C", "CGU": "E", "CHG": "A", "CLE": "L", "CME": "C", "CSD": "A",
    "CSO": "C", "CSP": "C", "CSS": "C", "CSW": "C", "CSX": "C", "CXM": "M", "CY1": "C", "CY3": "C", "CYG": "C", "CYM": "C", "CYQ": "C", "DAH": "F", "DAL": "A", "DAR": "R", "DAS": "D", "DCY": "C",
    "DGL": "E", "DGN": "Q", "DHA": "A", "DHI": "H", "DIL": "I", "DIV": "V", "DLE": "L", "DLY": "K", "DNP": "A", "DPN": "F", "DPR": "P", "DSN": "S", "DSP": "D", "DTH": "T", "DTR": "W", "DTY": "Y",
    "DVA": "V", "EFC": "C", "FLA": "A", "FME": "M", "GGL": "E", "GL3": "G", "GLX": "Z", "GLZ": "G", "GMA": "E", "GSC": "G", "HAC": "A", "HAR": "R", "HIC": "H", "HIP": "H", "HMR": "R", "HPQ": "F",
    "HTR": "W", "HYP": "P", "IIL": "I", "IYR": "Y", "KCX": "K", "LLP": "K", "LLY": "K", "LTR": "W", "LYM": "K", "LYZ": "K", "MAA": "A", "MEN": "N", "MHS": "H", "MIS": "S", "MLE": "L", "MLY": "K",
    "MPQ": "G", "MSA": "G", "MVA": "V", "NEM": "H", "NEP": "H", "NLE": "L", "NLN": "L", "NLP": "L", "NMC": "G", "OAS": "S", "OCS": "C", "OMT": "M", "PAQ": "Y", "PCA": "E", "PEC": "C", "PHI": "F",
    "PHL": "F", "PR3": "C", "PRR": "A", "PTR": "Y", "SAC": "S", "SAR": "G", "SCH": "C", "SCS": "C", "SCY": "C", "SEL": "S", "SEP": "S", "SET": "S", "SHC": "C", "SHR": "K", "SMC": "C", "SOC": "C",
    "STY": "Y", "SVA": "S", "TIH": "A", "TPL": "W", "TPO": "T", "TPQ": "A", "TRG": "K", "TRO": "W", "TYB": "Y", "TYQ": "Y", "TYS": "Y", "TYY": "Y",
}
#: Consequences that count as non-synonymous. Fixed values.
NONSYNONYMOUS = ["initiator_codon_variant", "inframe_insertion", "inframe_deletion", "missense_variant", "stop_gained", "stop_lost", "frameshift_variant", "splice_region_variant", "transcript_ablation"]
#: Populations whose frequencies a record carries. Fixed values.
POPULATIONS = ["amr", "afr", "eur", "eas", "sas", "asn"]
STANDARD = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY", "chrMT"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def one_letter(name: Column, unknown: str | None = None) -> Column:
    """A residue's letter by its name, in any case; modified residues have the letter of the one they stand for."""
    return F.coalesce(F.try_element_at(literal_map(MODIFIED | AA3), F.upper(F.trim(name))), F.lit(unknown))


def is_monomorphic(alts: str = "alts") -> Column:
    """A site without an alternative."""
    return F.size(F.filter(alts, lambda a: a != ".")) == 0


def sv_end(info: str = "info_map") -> Column:
    """END of a structural variant, or the reference's last base."""
    return F.coalesce(F.try_element_at(info, F.lit("END")).try_cast("long"), F.col("pos") + F.length("ref") - 1)


def is_precise(info: str = "info_map") -> Column:
    return ~F.coalesce(F.map_contains_key(info, F.lit("IMPRECISE")), F.lit(False))


def is_filtered(filters: str = "filters") -> Column:
    return F.coalesce(F.size(filters) > 0, F.lit(False))


def swiss_model_path(root: str, unp: Column, start: Column, end: Column, template: Column, coordinate_id: Column) -> Column:
    """Where a model of that repository lies: an accession without its isoform is cut into folders of 2, 2 and the other letters."""
    bare = F.regexp_replace(unp, "-[^-]*$", "")
    folders = F.concat_ws("/", F.lit(root), F.substring(unp, 1, 2), F.substring(unp, 3, 2), F.substring(bare, F.lit(5), F.length(bare)))
    return F.concat(folders, F.lit("/swissmodel/"), F.concat_ws("_", start.cast("string"), end.cast("string"), template, coordinate_id), F.lit(".pdb"))


def alphafold_path(root: str, model: Column) -> Column:
    """Of a model id AF-<accession>-F<n>: folders of the accession's letters 1-2 and 3-4."""
    return F.concat(F.lit(root + "/human/"), F.substring(model, 4, 2), F.lit("/"), F.substring(model, 6, 2), F.lit("/"), model, F.lit("-model_v1.cif.gz"))


def model_is_sound(mpqs: Column, longest: Column) -> Column:
    """Whether a model's quality exceeds what a chain of `longest` residues asks for."""
    return mpqs > 2 - F.log(longest) / (2 * F.log(F.lit(2.0)))


def is_sv(alts: str = "alts") -> Column:
    return F.exists(alts, lambda a: a.startswith("<") | a.contains("[") | a.contains("]"))


def is_snp() -> Column:
    return (F.length("ref") == 1) & (F.size("alts") > 0) & F.forall("alts", lambda a: a.isin("A", "C", "G", "T", "N", "*"))


def is_indel() -> Column:
    return ~is_sv() & ((F.length("ref") > 1) | F.exists("alts", lambda a: F.length(a) != F.length("ref")))


def is_transition() -> Column:
    return is_snp() & (F.size("alts") == 1) & F.concat("ref", F.get("alts", F.lit(0))).isin("AG", "GA", "CT", "TC")


def is_deletion() -> Column:
    return is_indel() & (F.size("alts") == 1) & (F.length("ref") > F.length(F.get("alts", F.lit(0))))


def var_type() -> Column:
    return F.when(is_snp(), "snp").when(is_sv(), "sv").when(is_indel(), "indel").otherwise("unknown")


def var_subtype() -> Column:
    one = F.size("alts") == 1
    return (
        F.when(is_snp(), F.when(is_transition(), "ts").when(one, "tv").otherwise("unknown"))
        .when(is_sv(), F.regexp_extract(F.get("alts", F.lit(0)), "<([^>]+)>", 1))
        .when(is_indel(), F.when(is_deletion(), "del").when(one, "ins").otherwise("unknown")).otherwise("unknown")
    )


def affected_range() -> Column:
    """Struct (start, end), 0-based half-open, over all alternatives: a shared first base of an indel is not affected."""
    start = F.col("pos") - 1
    one = lambda a: F.when(F.length(a) == F.length("ref"), F.struct(start.alias("s"), (start + F.length("ref")).alias("e"))).when(F.length("ref") > F.length(a), F.struct((start + F.length(a)).alias("s"), (start + F.length("ref")).alias("e"))).otherwise(F.struct((start + F.length("ref")).alias("s"), (start + F.length("ref")).alias("e")))
    spans = F.transform("alts", one)
    return F.struct(F.array_min(F.transform(spans, lambda x: x["s"])).alias("start"), F.array_max(F.transform(spans, lambda x: x["e"])).alias("end"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), whose value is worked out once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first letters agree: its binary digits from the greatest on, each by comparing the letters that it adds."""

    def agree(x: Column) -> Column:
        digits = F.sequence(F.ceil(F.log2(x["n"] + 1)).cast("int"), F.lit(0), F.lit(-1))

        def step(at: Column, digit: Column) -> Column:
            more = F.call_function("shiftleft", F.lit(1), digit)
            piece = lambda c: F.substring(x[c], at + 1, more)
            return F.when((at + more <= x["n"]) & (piece("a") == piece("b")), at + more).otherwise(at)

        return F.aggregate(digits, F.lit(0), step)

    return F.coalesce(bound(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n")), agree), F.lit(0))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def event(ref: Column, alt: Column) -> Column:
    """Struct (type, sequence): kind and size of an allele, and what is put in, taken out or stands there instead. r0
    reference, sN substitutions, i+N insertion, i-N deletion, oN other (the longer allele's length less the first base), u0
    symbolic, b breakend, of a mate or single."""
    bend = alt.contains("[") | alt.contains("]") | alt.rlike(r"^\.[A-Za-z]|[A-Za-z]\.$")
    short = F.least(F.length(ref), F.length(alt))
    pre = common_prefix(ref, alt)
    unlike = F.size(F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1))))
    gap = F.length(alt) - F.length(ref)
    pure = pre + common_suffix(ref, alt) >= short
    made = lambda kind, sequence: F.struct(kind.alias("type"), sequence.alias("sequence"))
    text = lambda c: c.cast("string")
    return (
        F.when(bend, made(F.lit("b"), F.lit(None).cast("string"))).when(alt.isin(".", "*"), made(F.lit("r0"), ref)).when(alt == ref, made(F.lit("r0"), alt)).when(alt.startswith("<"), made(F.lit("u0"), alt))
        .when(gap == 0, made(F.concat(F.lit("s"), text(unlike)), alt))
        .when(pure & (gap > 0), made(F.concat(F.lit("i+"), text(gap)), F.substring(alt, pre + 1, gap))).when(pure, made(F.concat(F.lit("i-"), text(-gap)), F.substring(ref, pre + 1, -gap)))
        .otherwise(made(F.concat(F.lit("o"), text(F.greatest(F.length(ref), F.length(alt)) - 1)), alt))
    )


def event_type(ref: Column, alt: Column) -> Column:
    return event(ref, alt)["type"]


def normalised(ref: Column, alt: Column, pos: Column) -> Column:
    """Struct (pos, ref, alt): shared last bases are cut, then shared first ones, at least one base of each stays."""
    least = lambda x, shared: F.least(shared, F.length(x["r"]) - 1, F.length(x["a"]) - 1)
    given = F.struct(ref.alias("r"), alt.alias("a"))

    def without_end(x: Column) -> Column:
        left = lambda c: F.substring(x["x"][c], F.lit(1), F.length(x["x"][c]) - x["cut"]).alias(c)
        return F.struct(left("r"), left("a"))

    def without_head(y: Column) -> Column:
        return bound(least(y, common_prefix(y["r"], y["a"])), lambda head: F.struct((pos + head).alias("pos"), F.substring(y["r"], head + 1, F.length(y["r"])).alias("ref"), F.substring(y["a"], head + 1, F.length(y["a"])).alias("alt")))

    cut = bound(given, lambda x: F.struct(x.alias("x"), least(x, common_suffix(x["r"], x["a"])).alias("cut")))
    return bound(bound(cut, without_end), without_head)


def fill_type(ref: Column, alt: Column) -> Column:
    t = event_type(ref, alt)
    return F.when(t == "s1", "snp").when(t.startswith("s"), "mnp").when(t.startswith("i+"), "ins").when(t.startswith("i-"), "del").when(t == "b", "break").when(t.startswith("o"), "complex").otherwise("other")


def gt_type() -> Column:
    """0 both reference, 1 different alleles, 2 both one alternative, null if incomplete."""
    a, b = F.col("a1"), F.col("a2")
    return F.when(a.isNull() | b.isNull(), None).when((a == 0) & (b == 0), 0).when(a != b, 1).otherwise(2)


def gt_bases() -> Column:
    """Bases of a call by its alleles column, '/' or '|' between; null if incomplete."""
    return F.concat(F.get("alleles", F.col("a1")), F.when(F.col("phased"), "|").otherwise("/"), F.get("alleles", F.col("a2")))


def is_het() -> Column:
    return gt_type() == 1


def is_variant() -> Column:
    """Whether a call has an alternative; null if incomplete."""
    return gt_type() > 0


def call_is_filtered(ft: Column) -> Column:
    """Whether a call failed a filter of its own; not where it has none."""
    return F.coalesce(F.size(ft) > 0, F.lit(False))


def iupac(a: Column, b: Column) -> Column:
    return F.try_element_at(literal_map(IUPAC), F.array_join(F.array_sort(F.array(a, b)), ""))


def parse_csq(csq: Column, fields: list[str]) -> Column:
    """Struct of one consequence entry by the header's order of fields. '&' separates values; amino acids are ref/alt, one
    value alone is both; positions are the number before '-', '?' is null; CANONICAL is 1 or 0; '' is null."""
    parts = F.split(csq, r"\|")
    out = []
    for i, name in enumerate(fields):
        x = F.get(parts, F.lit(i))
        x = F.when(x != "", x)
        key = name.lower()
        if key == "consequence":
            out.append(F.replace(x, F.lit("&"), F.lit(";")).alias(key))
        elif key in ("existing_variation", "domains"):
            out.append(F.replace(x, F.lit("&"), F.lit(",")).alias(key))
        elif key in ("amino_acids", "codons"):
            pair = F.split(x, "/")
            stem = {"amino_acids": "amino_acid", "codons": "codon"}[key]
            out += [pair[0].alias(f"ref_{stem}"), F.coalesce(F.get(pair, F.lit(1)), pair[0]).alias(f"alt_{stem}")]
        elif key == "canonical":
            out.append(F.when(x == "YES", 1).otherwise(0).alias(key))
        elif key.endswith("_position"):
            out.append(F.split(x, "-")[0].try_cast("int").alias(key.replace("_position", "_pos")))
        else:
            out.append(x.alias(key))
    return F.struct(*out)


def complete_record(v: DataFrame) -> DataFrame:
    """A stored record of vid, chrom, pos, id, ref, alts, end, aa and, where known, arrays `<population>_af`, ac, af, gts,
    snp_sources and csq (structs with existing_variation, gene, symbol, symbol_source).

    Defaults: end is pos + 1; frequencies, the first of each population, are 0.0; the ancestral allele in capitals; the first
    alternative with its count and frequency; the derived allele. Names, gene and HGNC symbol are those of the first
    consequence; an id that is missing is the existing name, else made of the place. csq of a record without consequences
    holds one that is null."""
    known = lambda c, kind: F.col(c) if c in v.columns else F.lit(None).cast(kind)
    first = lambda c, kind: F.get(known(c, f"array<{kind}>"), F.lit(0)).cast(kind)
    csq = known("csq", "array<struct<existing_variation:string,gene:string,symbol:string,symbol_source:string>>")
    none = F.array(F.get(csq, F.lit(-1)))
    alt, one, end = F.get("alts", F.lit(0)), F.get(csq, F.lit(0)), F.coalesce("end", F.col("pos") + 1)
    aa = F.upper(F.split("aa", r"\|")[0])
    place = F.concat(F.col("chrom"), F.lit(":"), F.col("pos").cast("string"), F.lit("-"), end.cast("string"))
    return v.select(
        "vid", "chrom", "pos", end.alias("end"), F.coalesce(F.col("id"), one["existing_variation"], place).alias("id"), "ref", alt.alias("alt"), aa.alias("aa"), F.when(alt == aa, F.col("ref")).otherwise(alt).alias("da"),
        *[F.coalesce(first(f"{p}_af", "double"), F.lit(0.0)).alias(f"{p}_af") for p in POPULATIONS], first("ac", "long").alias("ac"), first("af", "double").alias("af"),
        F.array_join(known("gts", "array<string>"), ",").alias("gt"), F.array_join(known("snp_sources", "array<string>"), ";").alias("snp_source"),
        one["existing_variation"].alias("existing"), one["gene"].alias("gene"), F.when(one["symbol_source"] == "HGNC", one["symbol"]).alias("hgnc"), F.when(F.size(csq) > 0, csq).otherwise(none).alias("csq"),
    )


def record_consequences(records: DataFrame) -> DataFrame:
    """A row per consequence of complete_record(): id, chrom, pos, end and the consequence's fields."""
    return records.select("vid", "id", "chrom", "pos", "end", F.explode("csq").alias("__c")).select("vid", "id", "chrom", "pos", "end", "__c.*")


def is_nonsynonymous(terms: Column) -> Column:
    """Whether any of the terms, '&' between them, is."""
    return F.arrays_overlap(F.split(terms, "&"), F.array(*map(F.lit, NONSYNONYMOUS)))


def derived_af(maf: Column, aa: Column, ref: Column) -> Column:
    return F.when(aa.isNull() | (aa == ".") | (aa == ref), maf).otherwise(1 - maf)


def unlike_places(a: Column, b: Column, piece: int = 64) -> Column:
    """Array of (i, x, y): the places, from 1 on, where sequences of one length differ, with both letters. Sequences are compared
    in pieces, and only those that differ letter by letter."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    pieces = F.transform(F.arrays_zip(cut(a).alias("x"), cut(b).alias("y")), lambda p, k: F.when(p["x"] != p["y"], F.struct(k.alias("k"), p["x"].alias("x"), p["y"].alias("y"))))

    def letters(p: Column) -> Column:
        one = F.arrays_zip(F.split(p["x"], "").alias("x"), F.split(p["y"], "").alias("y"))
        return F.filter(F.transform(one, lambda l, i: F.struct((p["k"] * piece + i + 1).alias("i"), l["x"].alias("x"), l["y"].alias("y"))), lambda l: l["x"] != l["y"])

    return F.flatten(F.transform(F.array_compact(pieces), letters))


def seq_identity(a: Column, b: Column) -> Column:
    """Struct (n, mismatches, share) of two sequences; of unequal lengths the share is 1.0."""
    number = F.when(F.length(a) == F.length(b), F.size(unlike_places(a, b)))
    share = lambda x: F.when(x["n"] != x["m"], 1.0).otherwise(F.round(x["unlike"] / F.greatest(x["n"], F.lit(1)), 6))
    return bound(F.struct(F.length(a).alias("n"), F.length(b).alias("m"), number.alias("unlike")), lambda x: F.struct(x["n"].alias("n"), x["unlike"].alias("mismatches"), share(x).alias("share")))


def modbase_seq_id(seq: Column) -> Column:
    return F.concat(F.md5(seq), F.substring(seq, 1, 4), F.substring(seq, -4, 4))


def alphafold_fragment(pos: Column, length: Column, most: int = 2700, window: int = 1400, step: int = 200) -> Column:
    """Which fragment model holds a residue in its middle: the only one of a short protein, else by windows, clamped."""
    last = F.ceil((length - window) / step) + 1
    k = F.greatest(F.lit(1), F.least(F.ceil((pos - window / 2) / step) + 1, last))
    return F.when(length <= most, 1).otherwise(k).cast("int")


def relative_access(acc: Column, letter: Column, most: dict[str, float]) -> Column:
    return F.round(acc / F.try_element_at(literal_map(most), letter), 4)


def parse_vep_row(line: Column) -> Column:
    """A struct of a line of an effect predictor's table, in lower case: name, chrom, start, end (the base after start if it
    has one place), ref_allele, gene, feature, feature_type, consequence, cdna_pos, cds_pos, protein_pos (null unless whole
    numbers), amino acids and codons ('-' where there aren't two), variation, and the map `extra`."""
    f = F.split(F.lower(line), "\t")
    at = lambda k: F.get(f, F.lit(k))
    place = F.split(F.substring_index(at(1), ":", -1), "-")
    start, end = F.get(place, F.lit(0)).try_cast("long"), F.get(place, F.lit(1)).try_cast("long")

    def two(k: int, first: str, second: str) -> list[Column]:
        parts = F.split(at(k), "/")
        return [F.when(F.size(parts) < 2, "-").otherwise(F.get(parts, F.lit(i))).alias(name) for i, name in enumerate((first, second))]

    names = ("ref_allele", "gene", "feature", "feature_type", "consequence")
    numbers = ("cdna_pos", "cds_pos", "protein_pos")
    return F.struct(
        at(0).alias("name"), F.substring_index(at(1), ":", 1).alias("chrom"), start.alias("start"), F.when(F.size(place) < 2, start + 1).otherwise(end).alias("end"), *[at(k).alias(name) for k, name in enumerate(names, 2)],
        *[at(k).try_cast("int").alias(name) for k, name in enumerate(numbers, 7)], *two(10, "ref_amino_acid", "var_amino_acid"), *two(11, "ref_codon", "var_codon"), at(12).alias("variation"), F.str_to_map(at(13), F.lit(";"), F.lit("=")).alias("extra"),
    )


def seq_differences(a: Column, b: Column) -> Column:
    """'place a>b' of each place where two sequences of one length differ, joined by commas; null if their lengths differ."""
    told = F.transform(unlike_places(a, b), lambda p: F.concat(p["i"].cast("string"), F.lit(" "), p["x"], F.lit(">"), p["y"]))
    return F.when(F.length(a) == F.length(b), F.array_join(told, ","))


def close_enough(a: Column, b: Column, share: float = 0.01) -> Column:
    """Whether sequences of one length differ in at most one place, or in less than a share of them."""
    return (F.length(a) == F.length(b)) & bound(seq_identity(a, b), lambda x: (x["mismatches"] <= 1) | (x["share"] < share))


def reshaped_likelihoods(values: Column, n_alleles: Column, haploid: bool, phred: bool = True) -> Column:
    """Genotype likelihoods of a diploid call (haploid: to be one) or of a haploid one, for the other ploidy: a struct of
    values, those of unlike alleles null, and best, the first allele with the best value, 0 if there is none."""
    alleles = F.sequence(F.lit(0), n_alleles - 1)
    own = F.transform(alleles, lambda i: F.get(values, (i * (i + 3) / 2).cast("int"))) if haploid else values
    pairs = F.flatten(F.transform(alleles, lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.when(i == j, F.get(values, i)))))
    best = F.array_position(own, F.array_min(own) if phred else F.array_max(own))
    return F.struct((own if haploid else pairs).alias("values"), F.coalesce(best.cast("int") - 1, F.lit(0)).alias("best"))
