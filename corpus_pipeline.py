"""Corpus pipeline: toxicity, language, near-duplicates, packing; each stage's result is written and read again.

For all stages: a null text counts as an empty one; very long texts are used whole; repeated rows are judged alike; an empty table gives
an empty one; columns beside id and text pass through whatever their names (the last stage returns pieces instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.llm.common import Stage
from roomflow.llm.langid import UNDETERMINED, fit, language_of
from roomflow.llm.packing import pack
from roomflow.llm.set_join import distinct_documents
from roomflow.llm.toxicity import THRESHOLD, fit_toxicity, toxicity_of


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of at least 0.7.

    Empty texts have a score like any other and stay unless it is that high; a score of exactly 0.7 goes. Without labels of both kinds
    all stay or, if all labels are toxic, all go. Rows without id are judged by their text.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_of(model)(_text()).getField("score") < THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told.

    These are the texts without any letter, null and empty ones among them, and all of them where no document has a language to learn
    from. Ties between languages go to the one that sorts first, and the document stays.
    """
    return docs.where(language_of(fit(docs))(_text()).getField("lang_pred") != UNDETERMINED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id, or one without id where none has any.

    Of equal rows one stays, and of several texts under one id each group's is its own. Texts without words link with nothing and all stay.
    """
    return distinct_documents(docs, Stage(spark, "pipeline-near"), size=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 1024 tokens; an empty text is one piece with the end id alone, and each repeated row has pieces of its own."""
    import public_tokenizers

    pieces = pack(docs, Stage(spark, "pipeline-packing"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the trained stages; the pipeline is tested against brute force and the operators' own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return docs
