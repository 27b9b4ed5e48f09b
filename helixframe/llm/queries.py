"""The queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from helixframe.llm import decontam, fingerprints, importance, lm, mixing, personal, phrases, quality, simhash, substring_dedup, suffix_dedup, toxicity, warc


def _mixing(spark, sf_dir: str):
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality": quality.op4_quality,
        "op5_language_model": lm.op5_language_model,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_mixing": _mixing,
        "op9_simhash": simhash.op9_simhash,
        "op10_decontamination": decontam.op10_decontamination,
        "op11_pii": personal.op11_pii,
        "op12_collocations": phrases.op12_collocations,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.WARC_SQL,
        "op8_mixing": mixing.MIX_SQL.format(documents="documents"),
        "op10_decontamination": decontam.DECONTAM_SQL,
        "op12_collocations": phrases.PHRASE_SQL,
        "op13_importance": importance.IMPORTANCE_SQL,
    }
