"""The registered queries of this subpackage: each applies one operator to its
whole table and returns the result its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, exact_dedup, fuzzy_lines, html_text, language_mixture, near_dedup, packing, substring_dedup, token_counts, token_files, toxicity, whitening
from .common import table

#: The tokenizer's file, a parameter of the operators that tokenise.
TOKENIZER = "word_bpe_49k.json"
#: The byte-level file of the token files.
BYTE_TOKENIZER = "byte_bpe_50k.json"
#: The file whose pieces the unigram counts use.
VOCABULARY = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents").select("doc_id", "text"), language_mixture.held_out(F.col("doc_id"), 4, 2)
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~test)
    return toxicity.toxicity(docs, net).select("doc_id", test.alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = language_mixture.held_out(F.col("doc_id"), 3, 1)
    langs, model = language_mixture.learn(docs.where("doc_id IS NOT NULL").where(~test))
    out = language_mixture.language_mixture(docs, langs, model)
    return out.select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_exact_dedup, op3_html_text, op4_toxicity, op5_near_dedup, op6_token_counts,
                                   op7_substring_dedup, op8_language_mixture, op9_best_fit_packing, op10_fuzzy_lines, op11_token_files,
                                   op12_conversation_repair, op13_embedding_whitening)}
