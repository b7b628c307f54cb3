"""The corpus pipeline: toxic documents go, one of each group of near duplicates
stays, repeated passages go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline.llm import _spark as S
from keratoline.llm import ngram_join, packing, suffix, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, as they are, all columns whatever their names.

    A null or empty text is scored like any other and holds no word, so it
    stays; texts are read whole; repeated rows are judged alike; an empty table
    gives an empty one.
    """
    model = toxicity.fit(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"))
    score = S.unused(docs.columns, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near duplicates, and all others, as they are.

    Rows without an id, null texts and texts without words stay. Rows are told
    apart by id and content: where an id repeats, only rows in a group go, and
    of rows alike in every column one stays. An empty table gives an empty one.
    """
    return ngram_join.drop_near_duplicates(docs)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes in strings of 200 bytes that stand elsewhere too; n_chars follows.

    A null text stays null (and n_chars as it is), an empty or short one as it
    is; rows alike in every column repeat each other, so both lose their text;
    an empty table gives an empty one.
    """
    out = suffix.remove_repeats(docs)
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text"), F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is a piece of its separator alone, a long one goes on
    in further pieces; repeated rows and rows without an id are documents like
    any other; an empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("suffix_array_dedup", suffix_array_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # no stage's method is SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = S.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = S.written(stage(spark, docs, sf_dir))
        if before:
            S.removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
