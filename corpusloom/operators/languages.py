"""Results by programming language, and examples by their signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File extensions and their languages, in order.
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "go": "go", "java": "java", "cpp": "c++",
    "c": "c", "rs": "rust", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "cs": "csharp",
}
UNKNOWN = "unknown"


def _of_extension(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[ext]


def language(url: Column, named: Column | None = None, extension: Column | None = None, *, anywhere: bool = False) -> Column:
    """A row's language: as it is named, else by its file extension (an unknown one stands for itself), else by its URL, else unknown.

    A URL tells by the extension of its path, without query and fragment. anywhere: by the first extension in order that it contains with its dot, as looser
    searches do, by which any '.com' is C. Case counts nowhere; nulls and empty values tell nothing.
    """
    given = lambda c: F.nullif(F.lower(c), F.lit("")) if c is not None else F.lit(None).cast("string")
    ext, low = given(extension), F.lower(url)
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    own = _of_extension(F.regexp_extract(path, r"[^/.][^/]*\.([a-z0-9]+)$", 1))
    loose = F.coalesce(*[F.when(F.contains(low, F.lit(f".{e}")), F.lit(x)) for e, x in EXTENSIONS.items()])
    return F.coalesce(given(named), F.coalesce(_of_extension(ext), ext), loose if anywhere else own, F.lit(UNKNOWN))


def across(found: DataFrame, n: int = 10, *, languages: list[str] | None = None) -> DataFrame:
    """The n most similar rows (query_id, chunk_id, language, similarity) of each query and language, with `place`; ties by chunk_id. languages: only these, in any case."""
    own = found if not languages else found.where(F.col("language").isin(*[x.lower() for x in languages]))
    order = [F.desc(F.coalesce("similarity", F.lit(0.0))), "chunk_id"]
    return own.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "language").orderBy(*order))).where(F.col("place") <= n)


def across_summary(results: DataFrame) -> DataFrame:
    """(query_id, total, languages, most_relevant, mean): results of `across` by query; the language with most of them, ties by name, and the mean similarity of each (a map, by three digits)."""
    per = results.groupBy("query_id", "language").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("similarity", F.lit(0.0))), 3).alias("mean"))
    first = F.min(F.struct((-F.col("n")).alias("k"), "language"))["language"]
    return per.groupBy("query_id").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list("language")).alias("languages"), first.alias("most_relevant"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "mean")))).alias("mean"))


def by_signature(examples: DataFrame, asked: DataFrame, n: int = 10, *, key: str = "chunk_id") -> DataFrame:
    """(query_id, examples' columns, place): the first n examples by key that have what is asked: name, and class_name and repo where these are given.

    asked: (query_id, name, class_name, repo). A query without a name finds nothing.
    """
    wanted = asked.select("query_id", F.col("name").alias("_name"), F.nullif("class_name", F.lit("")).alias("_class"), F.nullif("repo", F.lit("")).alias("_repo"))
    fits = (F.col("name") == F.col("_name")) & (F.col("_class").isNull() | (F.col("_class") == F.col("class_name"))) & (F.col("_repo").isNull() | (F.col("_repo") == F.col("repo")))
    found = examples.join(wanted, fits).select("query_id", *examples.columns)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(key))).where(F.col("place") <= n)
