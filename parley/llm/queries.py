"""One query per operator, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, similar=80)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.urls import judge_urls, rules_table

    judged = judge_urls(_table(spark, sf_dir, "pages"), rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.language import held_out, learn_profiles, predict_language

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    profiles = learn_profiles(docs.where("not held_out"))
    return predict_language(docs, profiles, ["doc_id", "held_out"])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents"), keep_ids=False))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.wrappers import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from parley.llm.shards import digest, read_shards, write_shards
    from parley.llm.store import shared_dir

    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(_table(spark, sf_dir, "documents"), path)
    return digest(read_shards(spark, path))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.brown import held_out, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs.withColumn("held_out", held_out()))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.codes import code_digest

    return code_digest(_table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.alignment import alignment_digest

    return alignment_digest(_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.lines import line_digest

    return line_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op11_vector_code_compression": op11_vector_code_compression,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_line_dedup": op13_line_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_shards": op7_token_shards,
    "op10_lm_scoring": op10_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
}

def _url_sql() -> str:
    from parley.llm.urls import SQL

    return SQL


def _code_sql() -> str:
    from parley.llm.codes import SQL

    return SQL


def _line_sql() -> str:
    from parley.llm.lines import SQL

    return SQL


ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _url_sql(),
    "op11_vector_code_compression": _code_sql(),
    "op13_line_dedup": _line_sql(),
}
