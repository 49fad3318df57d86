"""Documents to training tokens, in stages that each call one operator of corpusloom.llm.

Every stage works on all rows its predecessor kept. Bad texts go first, so that line counts, near
duplicates and the benchmark scan see only what could be trained on; lines go before near
duplicates, as boilerplate hides them; tokens come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, jaccard_join, kneser_ney, line_dedup
from corpusloom.llm.common import materialise, table
from corpusloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier accepts."""
    return kneser_ney.classify(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    out = line_dedup.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_first(docs, stable=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and whether decoding gives the ids' tokens back."""
    out = bpe.round_trip(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("tokens", tokens)]

#: The classifier, the exact join and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
