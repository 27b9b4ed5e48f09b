"""Genomic views over the star-schema tables. One text each, which Spark and DuckDB both run; {table} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    # A site per part. alt2 is null unless the site is multi-allelic.
    "variants": """SELECT p_partkey AS vid, concat('chr', CAST(1 + p_partkey % 5 AS STRING)) AS chrom, 1 + (p_partkey * 7919) % 200000 AS pos,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('rs', CAST(p_partkey AS STRING)) END AS id,
  concat(substr('ACGT', CAST(1 + p_size % 4 AS INT), 1), CASE WHEN p_partkey % 17 = 0 THEN 'AG' ELSE '' END) AS ref,
  substr('ACGT', CAST(1 + (p_size + 1 + p_partkey % 3) % 4 AS INT), 1) AS alt1, CASE WHEN p_partkey % 23 = 0 THEN 'TTT' END AS alt2,
  CAST((p_partkey * 31) % 1000 AS DOUBLE) / 10 AS qual,
  CASE WHEN p_partkey % 10 = 0 THEN 'q10' WHEN p_partkey % 13 = 0 THEN 'q10;s50' WHEN p_partkey % 29 = 0 THEN NULL ELSE 'PASS' END AS filter,
  concat('DP=', CAST(p_size * 3 AS STRING), ';AA=', substr('ACGT', CAST(1 + (p_size + p_partkey % 2) % 4 AS INT), 1), CASE WHEN p_partkey % 4 = 0 THEN ';DB' ELSE '' END, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat(';MQ=', CAST(p_partkey % 60 AS STRING)) END) AS info,
  CAST(p_size AS BIGINT) AS size FROM {part}""",
    # A call per site and sample; a pair that is absent is uncalled. Allele 2 at some multi-allelic sites.
    "calls": """SELECT l_partkey AS vid, CAST(l_suppkey % 20 AS INT) AS sample, CAST(MIN(CAST(FLOOR(l_quantity) AS INT)) % 2 AS INT) AS a1,
  CAST(CASE WHEN l_partkey % 23 = 0 AND MAX(l_linenumber) % 3 = 0 THEN 2 WHEN l_partkey % 31 = 0 AND l_suppkey % 20 % 6 = 0 THEN NULL ELSE MAX(l_linenumber) % 2 END AS INT) AS a2,
  MIN(l_orderkey) % 4 <> 0 AS phased, CASE WHEN MIN(l_orderkey) % 37 = 0 THEN NULL ELSE CAST(SUM(CAST(FLOOR(l_quantity) AS INT)) AS INT) END AS dp, CAST(MIN(l_orderkey) % 100 AS INT) AS gq
FROM {lineitem} GROUP BY l_partkey, l_suppkey % 20""",
    "samples": "SELECT DISTINCT CAST(s_suppkey % 20 AS INT) AS sample, CAST((s_suppkey % 20) % 3 AS INT) AS pop FROM {supplier}",
    "intervals": """SELECT o_orderkey AS iid, concat('chr', CAST(1 + o_orderkey % 5 AS STRING)) AS chrom, 1 + (o_orderkey * 104729) % 200000 AS start_pos,
  1 + (o_orderkey * 104729) % 200000 + 3 + o_custkey % 300 AS end_pos, concat('T', CAST(o_custkey % 500 AS STRING)) AS transcript, CAST(1 + o_orderkey % 400 AS INT) AS seqid,
  concat('S', CAST(o_custkey % 97 AS STRING)) AS structid, substr('ABCD', CAST(1 + o_orderkey % 4 AS INT), 1) AS chain FROM {orders}""",
    "idmap": """SELECT CASE WHEN c_custkey % 4 = 0 THEN concat('P', CAST(c_custkey % 300 AS STRING), '-', CAST(1 + c_nationkey % 3 AS STRING)) ELSE concat('P', CAST(c_custkey % 300 AS STRING)) END AS unp,
  CASE c_custkey % 4 WHEN 0 THEN 'UniParc' WHEN 1 THEN 'Ensembl_TRS' WHEN 2 THEN 'UniParc' ELSE 'RefSeq_NT' END AS id_type,
  CASE WHEN c_custkey % 4 = 3 THEN concat('NM_', CAST(c_custkey % 53 AS STRING), '.', CAST(1 + c_custkey % 5 AS STRING)) WHEN c_custkey % 4 = 1 THEN concat('ENST', CAST(c_custkey % 211 AS STRING), '.', CAST(1 + c_custkey % 3 AS STRING)) ELSE concat('X', CAST(c_custkey % 211 AS STRING)) END AS ext_id FROM {customer}""",
    "residues": """SELECT vec_id AS res_id, concat('S', CAST(vec_id % 10 AS STRING)) AS structid, substr('ABCD', CAST(1 + CAST(FLOOR(vec_id / 10) AS BIGINT) % 4 AS INT), 1) AS chain,
  CAST(FLOOR(vec_id / 40) AS INT) AS seqid, CAST({element}(embedding, 1) AS DOUBLE) * 50 AS x, CAST({element}(embedding, 2) AS DOUBLE) * 50 AS y, CAST({element}(embedding, 3) AS DOUBLE) * 50 AS z,
  substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + vec_id % 20 AS INT), 1) AS rescode FROM {embeddings}""",
    "sequences": "SELECT doc_id AS seq_id, upper({strip}(text, '[^A-Za-z]', ''{g})) AS seq FROM {documents}",
    # Consequences: two transcripts per site.
    "consequences": """SELECT p_partkey AS vid, concat('chr', CAST(1 + p_partkey % 5 AS STRING)) AS chrom, 1 + (p_partkey * 7919) % 200000 AS pos, 2 + (p_partkey * 7919) % 200000 AS end_pos,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('T', CAST((p_partkey + k * 7) % 500 AS STRING)) END AS transcript,
  concat(CASE (p_partkey + k) % 4 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'synonymous_variant' WHEN 2 THEN 'missense_variant&splice_region_variant' ELSE 'intron_variant' END, '|',
    concat('T', CAST((p_partkey + k * 7) % 500 AS STRING)), '|', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(substr('ACDEFGHIKL', CAST(1 + p_size % 10 AS INT), 1), '/', substr('MNPQRSTVWY', CAST(1 + p_size % 10 AS INT), 1)) END, '|',
    CASE WHEN p_partkey % 9 = 0 THEN '?' WHEN p_partkey % 8 = 0 THEN concat(CAST(p_size AS STRING), '-', CAST(p_size + 2 AS STRING)) ELSE CAST(p_size AS STRING) END, '|', CASE WHEN p_partkey % 3 = 0 THEN 'YES' ELSE '' END, '|', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('rs', CAST(p_partkey AS STRING), '&COSM', CAST(p_partkey AS STRING)) END) AS csq
FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t""",
}
_SPARK = {"element": "element_at", "strip": "regexp_replace", "g": ""}
_DUCK = {"element": "list_extract", "strip": "regexp_replace", "g": ", 'g'"}


class Tables:
    """The tables and views of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            used = [b for b in BASE if f"{{{b}}}" in VIEWS[name]]
            text = VIEWS[name]
            for key, value in _SPARK.items():
                text = text.replace(f"{{{key}}}", value)
            return self.spark.sql(text, **{b: self.table(b) for b in used})
        if name in BASE:
            return self.table(name)
        raise AttributeError(name)


def duck(sql: str) -> str:
    """sql with the views it names put before it as common tables."""
    ctes = []
    for name, text in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            for key, value in _DUCK.items():
                text = text.replace(f"{{{key}}}", value)
            for b in BASE:
                text = text.replace(f"{{{b}}}", b)
            ctes.append(f"{name} AS ({text})")
    body = sql.strip()
    if not ctes:
        return body
    joined = ",\n".join(ctes)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {joined},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"
