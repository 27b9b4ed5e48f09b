"""Reading and writing VCF with Spark's text source.

A line is split once; INFO stays a map and calls stay unparsed until a statistic needs them. Typed values follow the header's
declarations; '.' and '' are null. FILTER: '.' null, PASS an empty array.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of reserved INFO keys that a header need not declare, structural variants' keys after the others. Fixed values.
RESERVED_INFO = {
    "AA": "String", "AC": "Integer", "AF": "Float", "AN": "Integer", "BQ": "Float", "CIGAR": "String", "DB": "Flag", "DP": "Integer", "END": "Integer", "H2": "Flag", "H3": "Flag", "MQ": "Float",
    "MQ0": "Integer", "NS": "Integer", "SB": "String", "SOMATIC": "Flag", "VALIDATED": "Flag", "1000G": "Flag", "IMPRECISE": "Flag", "NOVEL": "Flag", "SVTYPE": "String", "SVLEN": "Integer", "CIPOS": "Integer",
    "CIEND": "Integer", "HOMLEN": "Integer", "HOMSEQ": "String", "BKPTID": "String", "MEINFO": "String", "METRANS": "String", "DGVID": "String", "DBVARID": "String", "DBRIPID": "String", "MATEID": "String",
    "PARID": "String", "EVENT": "String", "CILEN": "Integer", "DPADJ": "Integer", "CN": "Integer", "CNADJ": "Integer", "CICN": "Integer", "CICNADJ": "Integer",
}
SPARK_TYPE = {"Integer": "bigint", "Float": "double", "Flag": "boolean", "String": "string", "Character": "string"}


def null_dot(c: Column) -> Column:
    return F.when(~c.isin(".", ""), c)


@dataclass
class Header:
    """Declared types and counts of INFO and FORMAT keys, and the samples' names. by_file: names of files whose samples,
    or the order of these, differ from the others'."""

    info: dict[str, tuple[str, str]]
    format: dict[str, tuple[str, str]]
    samples: list[str]
    by_file: dict[str, list[str]] = field(default_factory=dict)


def parse_header(lines: Iterable[str]) -> Header:
    """Of the lines that begin a file."""
    out = Header({}, {}, [])
    for line in lines:
        if got := re.match(r"##(INFO|FORMAT)=<(?:.*?,)?ID=([^,>]+)", line):
            number, kind = (re.search(rf"[<,]{key}=([^,>]+)", line) for key in ("Number", "Type"))
            own = out.info if got[1] == "INFO" else out.format
            own[got[2]] = (kind[1] if kind else "String", number[1] if number else "1")
        elif line.startswith("#CHROM"):
            out.samples = line.split("\t")[9:]
    return out


def file_heads(spark: SparkSession, path: str, piece: int = 1 << 16) -> dict[str, list[str]]:
    """The lines with # that begin each file of a path, by file. Only the files' beginnings are read, some kilobytes at a time, by
    Hadoop's readers, so that any store and compression will do that Spark's text source reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(name: str) -> list[str]:
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = file.getFileSystem(conf).open(file)
        codec = codecs.getCodec(file)
        reader = codec.createInputStream(stream) if codec else stream
        data = b""
        try:
            while True:
                got = bytes(reader.readNBytes(piece))
                data += got
                lines = data.split(b"\n")
                done = next((i for i, x in enumerate(lines[: len(lines) - (len(got) == piece)]) if not x.startswith(b"#")), None)
                if done is not None or len(got) < piece:
                    return [x.decode().rstrip("\r") for x in lines[:done] if x.startswith(b"#")]
        finally:
            reader.close()

    return {name: head(name) for name in spark.read.text(path).inputFiles()}


def read_header(spark: SparkSession, path: str) -> Header:
    """Declarations of all files. A file without a #CHROM line, as the parts of a written folder are, has the samples of
    those that have one; these must agree then."""
    heads = {name: parse_header(lines) for name, lines in file_heads(spark, path).items()}
    named = {name: h.samples for name, h in heads.items() if h.samples}
    out = Header({k: v for h in heads.values() for k, v in h.info.items()}, {k: v for h in heads.values() for k, v in h.format.items()}, next(iter(named.values()), []))
    if any(names != out.samples for names in named.values()):
        bare = [name for name, h in heads.items() if not h.samples]
        if bare:
            raise ValueError(f"files of {path} have different samples, and these name none: {bare[:5]}")
        out.by_file = {re.sub("^file:///", "file:/", name): names for name, names in named.items()}  # as _metadata has them
    return out


def parse_lines(lines: DataFrame, prepend_chr: bool = False, strict: bool = True) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filters, info, format, fields) of data lines; fields: the calls' texts."""
    f = F.split("value", "\t" if strict else r"[\t ]+")
    file = [F.col("file")] if "file" in lines.columns else []
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"), *file)
    chrom = F.get("f", F.lit(0))
    if prepend_chr:
        chrom = F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    flt = F.get("f", F.lit(6))
    return rows.select(
        chrom.alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), null_dot(F.get("f", F.lit(2))).alias("id"), F.get("f", F.lit(3)).alias("ref"),
        F.when(F.get("f", F.lit(4)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("f", F.lit(4)), ",")).alias("alts"), F.get("f", F.lit(5)).try_cast("double").alias("qual"),
        F.when(flt == ".", None).when(flt == "PASS", F.array().cast("array<string>")).otherwise(F.split(flt, ";")).alias("filters"),
        parse_info(F.get("f", F.lit(7))).alias("info"), F.split(F.get("f", F.lit(8)), ":").alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("fields"), *file,
    )


def read_vcf(spark: SparkSession, path: str, prepend_chr: bool = False, strict: bool = True) -> tuple[DataFrame, Header]:
    """A VCF file or a folder of them, plain or gzip (.bgz by copying it as .gz). Where files differ in their samples, rows
    carry their file."""
    lines, header = spark.read.text(path), read_header(spark, path)
    if header.by_file:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines, prepend_chr, strict), header


def parse_info(info: Column) -> Column:
    """INFO as a map from key to text; a flag has the value ''. Of a key that repeats the last value holds."""
    pairs = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: ~x.isin("", "."))
    split = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("col1"), F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("col2")))
    keys = F.transform(split, lambda x: x["col1"])
    last = F.filter(split, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["col1"]))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), split).otherwise(last))


def typed_info(info: Column, key: str, header: Header | None = None) -> Column:
    """One INFO value by its declared type, or the reserved one, or as text. Number=1 is a scalar, others are arrays. An
    integer that holds a fraction is read as a float and cut."""
    kind, number = (header.info.get(key) if header else None) or (RESERVED_INFO.get(key, "String"), "1")
    raw = F.try_element_at(info, F.lit(key))
    if kind == "Flag":
        return F.map_contains_key(info, key)
    cast = (lambda x: F.coalesce(x.try_cast("bigint"), x.try_cast("double").cast("bigint"))) if kind == "Integer" else (lambda x: x.try_cast(SPARK_TYPE[kind]))
    return cast(null_dot(raw)) if number == "1" else F.transform(F.split(raw, ","), lambda x: cast(null_dot(x)))


def column_names(keys: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """A column's name for each key: lower case, other signs as _, a number behind what is taken already."""
    used, out = {x.lower() for x in taken}, {}
    for key in keys:
        name = base = re.sub(r"\W", "_", key.lower())
        n = 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        out[key] = name
    return out


def typed_table(variants: DataFrame, header: Header, per_allele: bool = False) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filters and a typed column for every INFO key that the header declares. With per_allele a row
    for each alternative: `alt`, and of keys with a value per alternative (Number A) or per allele (R) that one's."""
    fixed = ["chrom", "pos", "id", "ref", "qual", "filters"]
    names = column_names(header.info, [*fixed, "alt", "alts", "info"])
    rows = variants.select(*fixed, "alts", *[typed_info(F.col("info"), key, header).alias(name) for key, name in names.items()])
    if not per_allele:
        return rows.select(*fixed[:4], "alts", *fixed[4:], *names.values())
    at = {"A": F.col("__k"), "R": F.col("__k") + 1}
    own = [F.get(name, at[header.info[key][1]]).alias(name) if header.info[key][1] in at and header.info[key][0] != "Flag" else F.col(name) for key, name in names.items()]
    return rows.select("*", F.posexplode_outer("alts").alias("__k", "alt")).select(*fixed[:4], "alt", *fixed[4:], *own)


def extract_info(variants: DataFrame, keys: list[str], missing: str = "?") -> DataFrame:
    """chrom, pos, ref, alts as text and the INFO values of some keys as text, a flag as 1 or 0."""
    value = lambda k: F.when(~F.coalesce(F.map_contains_key("info", k), F.lit(False)), F.lit(None)).when(F.try_element_at("info", F.lit(k)) == "", "1").otherwise(F.try_element_at("info", F.lit(k)))
    names = column_names(keys, ["chrom", "pos", "ref", "alts"])
    return variants.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), *[F.coalesce(value(k), F.lit(missing)).alias(name) for k, name in names.items()])


def extract_format(variants: DataFrame, header: Header, key: str) -> DataFrame:
    """(chrom, pos, sample, value) of one FORMAT key, as its declared type says; null where it is missing or a call lacks it."""
    kind, number = header.format.get(key, ("String", "1"))
    names = [F.get("__names", F.col("__k"))]
    if header.by_file:
        rows = variants.join(variants.sparkSession.createDataFrame(list(header.by_file.items()), "file string, __names array<string>"), "file")
    else:
        rows = variants.withColumn("__names", F.array(*map(F.lit, header.samples)) if header.samples else F.array().cast("array<string>"))
    rows = rows.withColumn("__at", F.array_position("format", key).cast("int")).select("chrom", "pos", "__names", "__at", F.posexplode("fields").alias("__k", "__text"))
    raw = null_dot(F.when(F.col("__at") > 0, F.get(F.split("__text", ":"), F.col("__at") - 1)))
    cast = lambda x: x.try_cast(SPARK_TYPE[kind])
    value = cast(raw) if number == "1" or key == "GT" else F.transform(F.split(raw, ","), lambda x: cast(null_dot(x)))
    return rows.select("chrom", "pos", names[0].alias("sample"), value.alias("value"))


def parse_calls(variants: DataFrame, header: Header) -> DataFrame:
    """variants with a row per sample: sample, gt, a1, a2 (null if missing), ploidy, phased, and dp, gq and ft where the
    format has them."""
    # FORMAT is looked through once per line, a call's text split once.
    keys = ("GT", "DP", "GQ", "FT")
    rows = variants.select("*", *[F.array_position("format", k).cast("int").alias(f"__{k}") for k in keys])
    if header.by_file:
        names = variants.sparkSession.createDataFrame(list(header.by_file.items()), "file string, __names array<string>")
        rows = rows.join(names, "file")
    else:
        rows = rows.withColumn("__names", F.array(*map(F.lit, header.samples)) if header.samples else F.array().cast("array<string>"))
    rows = rows.select("*", F.posexplode("fields").alias("__k", "__text")).select("*", F.get("__names", F.col("__k")).alias("sample"), F.split("__text", ":").alias("__values"))
    raw = lambda key: F.get("__values", F.col(f"__{key}") - 1)
    rows = rows.withColumn("gt", raw("GT")).withColumn("__alleles", F.split("gt", r"[/|]"))
    alleles, ft = F.col("__alleles"), null_dot(raw("FT"))
    return rows.select(
        *[c for c in variants.columns if c not in ("fields", "format", "file")], "sample", "gt", F.get(alleles, F.lit(0)).try_cast("int").alias("a1"), F.get(alleles, F.lit(1)).try_cast("int").alias("a2"),
        F.size(alleles).alias("ploidy"), F.col("gt").contains("|").alias("phased"), null_dot(raw("DP")).try_cast("int").alias("dp"), null_dot(raw("GQ")).try_cast("double").alias("gq"),
        F.when(ft == "PASS", F.array().cast("array<string>")).otherwise(F.split(ft, ";")).alias("ft"),
    )


def parse_alt(alt: Column) -> Column:
    """Struct (alt_type, chrom, pos, orientation, remote_orientation, seq, within_main) of an alternative allele."""
    mate = F.regexp_extract(alt, r"[\[\]]([^:\[\]]+):(\d+)[\[\]]", 1)
    place = F.regexp_extract(alt, r"[\[\]]([^:\[\]]+):(\d+)[\[\]]", 2).try_cast("long")
    bare = F.regexp_replace(mate, "[<>]", "")
    kind = F.when(alt.rlike(r"^[\[\]].*|.*[\[\]]$"), "breakend").when(alt.startswith("<"), "symbolic").when(alt.rlike(r"^\.[A-Za-z]+$|^[A-Za-z]+\.$"), "single_breakend").otherwise("substitution")
    is_mate = kind == "breakend"
    return F.struct(
        kind.alias("alt_type"), F.when(is_mate, bare).alias("chrom"), F.when(is_mate, place).alias("pos"), F.when(is_mate, alt.rlike(r"^[\[\]]")).when(kind == "single_breakend", alt.startswith(".")).alias("orientation"),
        F.when(is_mate, alt.contains("[")).alias("remote_orientation"),
        F.when(is_mate, F.regexp_replace(alt, r"[\[\]][^\[\]]*[\[\]]", "")).when(kind == "single_breakend", F.regexp_replace(alt, r"\.", "")).when(kind == "symbolic", F.regexp_replace(alt, "[<>]", "")).otherwise(alt).alias("seq"),
        F.when(is_mate, ~mate.startswith("<")).alias("within_main"),
    )


def region_scan(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """[start, end) of a Parquet copy written by store(): the partition of the chromosome, and row groups by position."""
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end))


def store(variants: DataFrame, path: str) -> None:
    """Writes variants by chromosome, sorted by position inside each file."""
    variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


# Writers


def call_text() -> Column:
    a = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat(a("a1"), F.when(F.col("phased"), "|").otherwise("/"), a("a2"))


def vcf_lines(variants: DataFrame, calls: DataFrame | None = None, samples: list | None = None) -> DataFrame:
    """Data lines (chrom, pos, value) from chrom, pos, id, ref, alts, qual, filters, info_text; calls make the columns of the
    samples in order, uncalled ones './.'."""
    v = variants
    number = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string"))
    cells = [
        F.col("chrom"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref"), F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ",")), F.coalesce(number, F.lit(".")),
        F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")), F.when(F.coalesce(F.col("info_text"), F.lit("")) == "", ".").otherwise(F.col("info_text")),
    ]
    if calls is not None:
        text = F.concat_ws(":", call_text(), F.coalesce(F.col("dp").cast("string"), F.lit(".")), F.coalesce(F.col("gq").cast("string"), F.lit(".")))
        # A site's calls are put in order once, and what lies between two of them is filled: no row exists for an uncalled cell.
        n = len(samples or [])
        order = v.sparkSession.createDataFrame([(s, k) for k, s in enumerate(samples or [])], f"sample {calls.schema['sample'].dataType.simpleString()}, __k int")
        own = calls.select("vid", "sample", text.alias("__t")).join(F.broadcast(order), "sample").groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("__k", "__t"))).alias("__s"))
        none = F.array().cast("array<struct<__k:int,__t:string>>")
        v = v.join(own, "vid", "left").withColumn("__s", F.coalesce("__s", none))
        before = lambda j: F.coalesce(F.get("__s", j - 1)["__k"], F.lit(-1))
        called = F.transform("__s", lambda x, j: F.concat(F.repeat(F.lit("./.:.:.\t"), x["__k"] - before(j) - 1), x["__t"]))
        behind = n - 1 - before(F.size("__s"))
        rest = F.when(behind > 0, F.substring(F.repeat(F.lit("\t./.:.:."), behind), 2, 8 * n))
        v = v.withColumn("__c", F.concat_ws("\t", F.when(F.size("__s") > 0, F.array_join(called, "\t")), rest) if n else F.lit(None).cast("string")).drop("__s")
        cells += [F.lit("GT:DP:GQ"), F.col("__c")]
    return v.select("chrom", "pos", F.concat_ws("\t", *cells).alias("value"))


def write_vcf(lines: DataFrame, path: str, samples: list, info: dict[str, tuple[str, str]] | None = None) -> None:
    """A folder of sorted parts: the header is a part of its own, written first."""
    head = ["##fileformat=VCFv4.2", *[f'##INFO=<ID={k},Number={n},Type={t},Description="">' for k, (t, n) in (info or {}).items()], "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *map(str, samples)] if samples else [])])]
    spark = lines.sparkSession
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(path)
    lines.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.mode("append").text(path)


def code_012() -> Column:
    """-1 both alleles missing, 0 both reference, 2 both alternative, else 1."""
    a, b = F.col("a1"), F.col("a2")
    return F.when(a.isNull() & b.isNull(), -1).when((a == 0) & (b == 0), 0).when((a > 0) & (b > 0), 2).otherwise(1)


def base_of(c: str, missing: str = "0") -> Column:
    return F.coalesce(F.get("alleles", F.col(c)), F.lit(missing))


def ordered_join(value: Column, by: list[str], sep: str) -> Column:
    """Values of a group in the order of `by`, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("__v")))), lambda x: x["__v"]), sep)
