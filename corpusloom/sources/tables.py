"""Tables in, tables out: replace-by-key writes that never overwrite what they read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.text import merged
from ..functions.urls import source_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`existing` without the keys of `new`, and `new`."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_by_key(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti")


def merge_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row a key; new values where they are given, the others kept."""
    others = [c for c in existing.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in others])
    return existing.join(fresh, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in others])


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A new folder; readers are pointed to it once it is whole."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, which is set where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = tempfile.mkdtemp(prefix="corpusloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the folder that driver and executors share and read again, which ends its lineage. Few bytes go to Python at a time."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = f"{shared(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(setting)
    spark.conf.set(setting, "8m")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(rows: DataFrame) -> DataFrame:
    """Chunks (url, chunk_number, content, source_id, ...) with their point ids, and a source for those without one."""
    source = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), source_id(F.col("url")))
    return rows.withColumn("source_id", source).withColumn("point_id", scalar.uuid5(scalar.NS_URL, F.concat_ws("_", "url", F.col("chunk_number").cast("string"))))


def add_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the new rows' URLs are replaced by the new ones; the last of equal ids stays."""
    found = documents(new)
    last = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc_nulls_last("content")))
    return replace_by_key(existing, found.withColumn("_k", last).where("_k = 1").drop("_k"), "url")


def add_code_examples(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by id code_{url}_{chunk_number}: new ones replace old ones of the same id, others stay."""
    keyed = lambda df: df.withColumn("code_id", F.concat(F.lit("code_"), F.col("url"), F.lit("_"), F.col("chunk_number").cast("string")))
    return replace_by_key(keyed(existing), keyed(new), "code_id")


def merge_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a source_id; of `payload` (a map) the new values win, other columns keep what the new row leaves out."""
    rest = merge_by_key(existing.drop("payload"), new.drop("payload"), "source_id")
    none = F.create_map().cast("map<string,string>")
    both = existing.select("source_id", F.col("payload").alias("_old")).join(new.select("source_id", F.col("payload").alias("_new")), "source_id", "full_outer")
    return rest.join(both.select("source_id", merged(F.coalesce("_old", none), F.coalesce("_new", none)).alias("payload")), "source_id")


def by_url(rows: DataFrame, urls: DataFrame, most: int = 1000) -> DataFrame:
    """The chunks of each URL in order, `most` at most of each."""
    found = rows.join(urls.select("url").distinct(), "url", "left_semi")
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("url").orderBy("chunk_number"))).where(F.col("_k") <= most).drop("_k")


def known_urls(urls: DataFrame, rows: DataFrame) -> DataFrame:
    """(url, known) of every asked URL."""
    return urls.select("url").distinct().join(rows.select("url").distinct().withColumn("known", F.lit(True)), "url", "left").select("url", F.coalesce("known", F.lit(False)).alias("known"))


def sources_listed(rows: DataFrame) -> DataFrame:
    """Sources by id, with defaults for what is missing."""
    return rows.select("source_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("total_words", F.lit(0)).cast("bigint").alias("total_words")).orderBy("source_id")
