"""Search in code examples whose results are held against a code graph, and what is doubtful about a script's elements.

results: rows with query_id, chunk_id, similarity, source_id, code_type, class_name, method_name and name. symbols: (repo, kind,
class_name, full_class_name, name) of classes (without name), methods and functions of the graph; what is asked of it is one key a result, so
both sides meet in one join of equals. A blank or null class asks for a method of any class of the repository. Null
names ask nothing; repeated symbols count once; without a graph (symbols null) every result is valid with 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import confidence

#: Least confidences: of a valid result, of a sure one; and what a mode asks for at least.
LEAST, HIGH = 0.6, 0.8
MODES = {"fast": 0.4, "balanced": 0.0, "thorough": 0.7}
SIMILARITY, CONFIDENCE = 0.4, 0.6
# Names, weights and texts of the checks.
REPOSITORY = ("repository_exists", 0.3)
EXISTS = {"class": ("class_exists", 0.4), "method": ("method_exists", 0.4), "function": ("function_exists", 0.7)}
FURTHER = {"class": ("structure_valid", 0.3), "method": ("signature_valid", 0.3)}
SUGGESTIONS = {
    "repository": "Repository '%s' not found in knowledge graph. Consider parsing this repository first.",
    "class": "Class '%s' not found. Check class name spelling or repository parsing completeness.",
    "method": "Method '%s' not found. Verify method name or check if it's inherited.",
    "function": "Function '%s' not found. Check function name or module location.",
}
#: Confidence in an element that the graph holds, and in one that it does not.
FOUND = {"import": (0.8, 0.2), "class": (0.8, 0.2), "method": (0.7, 0.3), "function": (0.7, 0.3)}
_KEY = ["_repo", "_kind", "_owner", "_name"]
_CHECKS = "array<struct<check:string,passed:boolean,weight:double>>"


def _filled(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def _keys(symbols: DataFrame) -> DataFrame:
    """Every way in which a symbol can be asked for."""
    key = lambda owner, name: F.struct(F.col("repo").alias("_repo"), F.col("kind").alias("_kind"), owner.alias("_owner"), name.alias("_name"))
    none, cls, full, name = F.lit(""), F.col("class_name"), F.col("full_class_name"), F.col("name")
    kind = F.col("kind")
    ways = F.when(kind == "class", F.array(key(none, cls), key(none, full))).when(kind == "method", F.array(key(_filled(cls), name), key(_filled(full), name), key(none, name))).when(kind == "function", F.array(key(none, name)))
    return symbols.select(F.explode(ways).alias("_k")).select("_k.*").where("_repo IS NOT NULL AND _name IS NOT NULL").distinct()


def validate(results: DataFrame, repos: DataFrame, symbols: DataFrame | None, *, least: float = LEAST, high: float = HIGH) -> DataFrame:
    """`results` with `validation`: is_valid, confidence, checks (check, passed, weight), suggestions and validated (whether there was a graph).

    repos: (repo) of the graph. A class or method that exists passes its further check. Suggestions are for results below `high`.
    """
    made = lambda valid, c, checks, texts, there: F.struct(valid.alias("is_valid"), c.alias("confidence"), checks.alias("checks"), texts.alias("suggestions"), F.lit(there).alias("validated"))
    if symbols is None:
        return results.withColumn("validation", made(F.lit(True), F.lit(0.5), F.array().cast(_CHECKS), F.array().cast("array<string>"), False))
    kind, member = F.col("code_type"), F.coalesce(F.nullif(F.col("method_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")))
    wanted = F.when(kind == "class", F.nullif(F.col("class_name"), F.lit(""))).when(kind.isin("method", "function"), member)
    owner = F.when(kind == "method", _filled("class_name")).otherwise("")
    asked = results.withColumns({"_repo": _filled("source_id"), "_kind": kind, "_owner": owner, "_name": wanted})
    there = repos.where("repo IS NOT NULL").select(F.col("repo").alias("_repo"), F.lit(True).alias("_has_repo")).distinct()
    found = asked.join(there, "_repo", "left").join(_keys(symbols).withColumn("_has", F.lit(True)), _KEY, "left")
    has_repo, has = F.col("_has_repo").isNotNull(), F.col("_has").isNotNull()
    check = lambda name, passed, weight: F.struct(F.lit(name).alias("check"), passed.alias("passed"), F.lit(weight).alias("weight"))
    named = F.col("_name").isNotNull()
    exists = [F.when(named & (kind == k), check(n, has, w)) for k, (n, w) in EXISTS.items()]
    further = [F.when(named & has & (kind == k), check(n, F.lit(True), w)) for k, (n, w) in FURTHER.items()]
    checks = F.array_compact(F.array(check(REPOSITORY[0], has_repo, REPOSITORY[1]), F.coalesce(*exists), F.coalesce(*further)))
    texts = [F.when(~has_repo, F.format_string(SUGGESTIONS["repository"], F.col("source_id")))]
    texts += [F.when(named & ~has & (kind == k), F.format_string(SUGGESTIONS[k], F.col("_name"))) for k in EXISTS]
    out = found.withColumn("_checks", checks).withColumn("_c", confidence(F.col("_checks")))
    given = F.when(F.col("_c") < high, F.array_compact(F.array(*texts))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("validation", made(F.col("_c") >= least, F.col("_c"), F.col("_checks"), given, True)).select(*results.columns, "validation")


def ranked(validated: DataFrame, n: int = 10, *, mode: str = "balanced", least: float = LEAST) -> DataFrame:
    """The n best of each query of what reaches the confidence that the mode asks for, with `score` (of similarity and confidence) and `place`; ties by chunk_id."""
    bar = max(least, MODES[mode])
    score = SIMILARITY * F.coalesce("similarity", F.lit(0.0)) + CONFIDENCE * F.col("validation.confidence")
    kept = validated.where(F.col("validation.confidence") >= bar).withColumn("score", score)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("place") <= n)


def search_summary(queries: DataFrame, validated: DataFrame, final: DataFrame, *, high: float = HIGH) -> DataFrame:
    """One row a query: results found, of them validated, final ones, sure ones, and the shares of found and of final ones; 0 where there are none."""
    first = validated.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_found"), F.count("validation").alias("validated"))
    last = final.groupBy("query_id").agg(F.count(F.lit(1)).alias("final_count"), F.count_if(F.col("validation.confidence") >= high).alias("high_confidence"))
    out = queries.select("query_id").distinct().join(first, "query_id", "left").join(last, "query_id", "left").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns({"validation_rate": share("validated", "total_found"), "high_confidence_rate": share("high_confidence", "final_count")})


# elements of scripts ------------------------------------------------------------------------------


def found_confidence(kind: Column, found: Column) -> Column:
    """Confidence in an element of a script by whether the graph holds it; null for other kinds."""
    pairs = [F.when(kind == k, F.when(found, yes).otherwise(no)) for k, (yes, no) in FOUND.items()]
    return F.coalesce(*pairs)


def _severity(c: Column, high: float = 0.3) -> Column:
    return F.when(c < high, "high").otherwise("medium")


def doubtful(elements: DataFrame, least: float = 0.5) -> DataFrame:
    """Elements (kind, confidence, ...) below `least`, with `type` and `severity`; a null confidence is 0."""
    c = F.coalesce("confidence", F.lit(0.0))
    return elements.where(c < least).withColumns({"confidence": c, "type": F.lit("structural"), "severity": _severity(c)})


def doubtful_by_examples(examples: DataFrame, *keys: str, good: float = 0.7) -> DataFrame:
    """(keys, confidence, examples_found, type, severity): elements none of whose examples (confidence; null is 0) is good, with the mean of these; an element without examples is none of them."""
    c = F.coalesce("confidence", F.lit(0.0))
    means = examples.groupBy(*keys).agg(F.max(c).alias("_best"), F.avg(c).alias("confidence"), F.count(F.lit(1)).alias("examples_found"))
    return means.where(F.col("_best") < good).drop("_best").withColumns({"type": F.lit("semantic"), "severity": _severity(F.col("confidence"))})


def suggestions(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys, suggestions): texts, each once and sorted, for imports (module, name) and classes (name) of each key that the graph lacks (found)."""
    # Texts.
    text = F.when(F.col("kind") == "import", F.format_string("Import '%s.%s' not found in knowledge graph. Check module name or parse the relevant repository.", _filled("module"), _filled("name")))
    text = text.when(F.col("kind") == "class", F.format_string("Class '%s' not found. Check class name spelling or ensure the relevant repository is parsed.", _filled("name")))
    missing = elements.where(~F.coalesce("found", F.lit(False))).select(*keys, text.alias("_text")).where("_text IS NOT NULL").distinct()
    return missing.groupBy(*keys).agg(F.sort_array(F.collect_list("_text")).alias("suggestions"))
