"""One query for each operator, over its whole table, and the SQL twin where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import ann, chat_format, collocations, exact_dedup, jaccard_join, lm_score, minhash, mixing, packing, pii, quality, token_count, vector_codes
from tallyloom.llm.shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals: sums of logarithms differ in their last digits with the order of addition."""
    from pyspark.sql import functions as F

    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities to four decimals, as in op7."""
    from pyspark.sql import functions as F

    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_tokens", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "keep")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_pii, op3_mixing, op4_packing, op5_jaccard_join, op6_exact_dedup, op7_lm_score, op8_quality, op9_chat_format, op10_ann, op11_collocations, op12_vector_codes, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op7_lm_score": "SELECT doc_id, n_words, round(score, 6) AS score, round(mean_score, 6) AS mean_score FROM (" + lm_score.ORACLE + ")", "op8_quality": quality.ORACLE, "op9_chat_format": chat_format.ORACLE, "op10_ann": ann.ORACLE, "op11_collocations": collocations.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_minhash": minhash.ORACLE}
