"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline.llm import bpe_automaton, chat, conversation_trie, embed_dedup, ngram_join, oracles, packing, sentencepieces, sharding, spelling, substring, suffix, topk, toxicity
from keratoline.llm._spark import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_seen_passages(table(spark, sf_dir, "documents"), digest=True)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.expand(rows.unionByName(extra)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard_join, op3_best_fit_packing, op4_exact_topk, op5_embedding_near_dedup, op6_sentencepiece, op7_substring_dedup, op8_chat_format, op9_suffix_dedup, op10_sharding, op11_bpe, op12_conversation_trie, op13_spelling_variants)}
QUERIES["pipeline"] = corpus_pipeline.run
# The others have none: op1, op6 and op11 learn or look up what SQL has not, op3 needs a tokenizer, op10's splitters depend on how far its counting refines.
ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op4_exact_topk": oracles.TOP_K,
    "op5_embedding_near_dedup": oracles.EMBEDDING_DEDUP,
    "op7_substring_dedup": oracles.SUBSTRING,
    "op8_chat_format": oracles.CHAT,
    "op9_suffix_dedup": oracles.SUFFIX,
    "op12_conversation_trie": oracles.CONVERSATION_TRIE,
    "op13_spelling_variants": oracles.SPELLING,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
