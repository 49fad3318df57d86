"""Validation of uses of a code graph: parameters, look-ups, confidences, summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code_graph import resolve_classes


#: Names that are broadcast at a time.
NAMES = 1000
#: Rows of a table of modules or symbols that is broadcast.
SENT = 20_000


def signature(expected: Column) -> Column:
    """What a call is held against, parsed once: whether anything is expected, bounds of the positional arguments, free forms, names and needed names.

    expected: 'name:type', '=default' behind it if optional, '[keyword_only]' before it, '*name' or '**name'.
    '[positional_only]' takes no keyword. Entries without a colon or star say nothing.
    """
    kind = lambda p: F.regexp_extract(F.btrim(p), r"^\[([^\]]*)\]", 1)
    entries = F.transform(expected, lambda p: F.struct(F.btrim(F.regexp_replace(F.btrim(p), r"^\[[^\]]*\]", "")).alias("text"), kind(p).alias("kind")))
    # a value that is used many times is made once
    once = lambda value, use: F.transform(F.array(value), use)[0]
    names = lambda ps: F.transform(ps, lambda p: F.substring_index(p["text"], ":", 1))

    def own(parsed: Column, named: Column) -> Column:
        only = lambda keyword, optional: F.filter(named, lambda p: ((p["kind"] == "keyword_only") == keyword) & (p["text"].contains("=") == optional))
        return F.struct(
            (expected.isNull() | (F.size(expected) == 0)).alias("nothing"), F.size(only(F.lit(False), F.lit(False))).alias("least"), F.size(F.filter(named, lambda p: p["kind"] != "keyword_only")).alias("most"),
            F.exists(parsed, lambda p: p["text"].startswith("*") & ~p["text"].startswith("**")).alias("varargs"), F.exists(parsed, lambda p: p["text"].startswith("**")).alias("any_name"),
            names(F.filter(named, lambda p: p["kind"] != "positional_only")).alias("names"), names(only(F.lit(True), F.lit(False))).alias("needed"),
        )

    return once(entries, lambda parsed: once(F.filter(parsed, lambda p: ~p["text"].startswith("*") & p["text"].contains(":")), lambda named: own(parsed, named)))


def fitted(own: Column, n_args: Column, kwargs: Column) -> Column:
    """(status, confidence) of a call against a `signature`. A keyword does not stand in for a positional argument."""
    result = lambda status, c: F.struct(F.lit(status).alias("status"), F.lit(c).alias("confidence"))
    return (
        F.when(own["nothing"], result("UNCERTAIN", 0.5))
        .when(~own["varargs"] & (n_args > own["most"]), result("INVALID", 0.8))
        .when(n_args < own["least"], result("INVALID", 0.8))
        .when(~own["any_name"] & (F.size(F.array_except(kwargs, own["names"])) > 0), result("INVALID", 0.7))
        .when(F.size(F.array_except(own["needed"], kwargs)) > 0, result("INVALID", 0.8))
        .otherwise(result("VALID", 0.9))
    )


def parameters(expected: Column, n_args: Column, kwargs: Column) -> Column:
    """(status, confidence) of a call with `n_args` positional arguments and the names `kwargs`, see `signature`."""
    return fitted(signature(expected), n_args, kwargs)


def _sent(df: DataFrame) -> DataFrame:
    """Broadcast, if it has at most SENT rows: rows of few modules would else meet in few tasks."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def usages(uses: DataFrame, modules: DataFrame, symbols: DataFrame, *, untyped: float = 0.8, missing: float = 0.2, valid: float = 0.8) -> DataFrame:
    """Each use (module, symbol, n_args, kwargs) with in_graph, status and confidence.

    A use without a module is uncertain (`untyped`), one of a module outside the graph too (0.8), a missing symbol not
    found (`missing`), a call that its parameters (symbols: module, symbol, expected) exclude invalid with their
    confidence, anything else valid (`valid`). Signatures are parsed once a symbol, not once a use.
    """
    known = modules.select("module").distinct().withColumn("in_graph", F.lit(True))
    # a symbol has as many signatures as it has been declared with
    one = symbols.groupBy("module", "symbol").agg(F.array_sort(F.collect_set("expected")).alias("_expected"), F.lit(True).alias("there"))
    one = one.select("module", "symbol", F.transform("_expected", signature).alias("_signatures"), "there")
    found = uses.join(_sent(known), "module", "left").join(_sent(one), ["module", "symbol"], "left")
    # one signature, as most symbols have, needs no list of what each of them says
    against = lambda e: fitted(e, F.col("n_args"), F.col("kwargs"))
    found = found.withColumn("_first", against(F.get("_signatures", F.lit(0))))
    other = F.exists(F.when(F.size("_signatures") > 1, F.col("_signatures")), lambda e: against(e)["status"] != "INVALID")
    fit = F.when(F.coalesce(F.size("_signatures"), F.lit(0)) > 0, F.when((F.col("_first.status") == "INVALID") & ~F.coalesce(other, F.lit(False)), F.col("_first")))
    result = lambda status, c: F.struct(F.lit(status).alias("status"), F.lit(c).alias("confidence"))
    outside = F.when(F.col("module").isNull(), result("UNCERTAIN", untyped)).when(F.col("in_graph").isNull(), result("UNCERTAIN", 0.8))
    ladder = outside.when(F.col("there").isNull(), result("NOT_FOUND", missing)).when(fit["status"] == "INVALID", fit).otherwise(result("VALID", valid))
    return found.withColumn("_result", ladder).withColumn("in_graph", F.col("in_graph").isNotNull()).select(*uses.columns, "in_graph", "_result.*")


def methods(uses: DataFrame, classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Method calls on a variable's type: its module; null where the type is unknown."""
    return usages(uses, classes, symbols, untyped=0.3, missing=0.1, valid=0.9)


def resolved(uses: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """Uses whose module is a class's name, with its full name in the graph where `code_graph.resolve_classes` finds one."""
    names = resolve_classes(uses.select(F.col("module").alias("name")), classes, modules).withColumnRenamed("name", "module")
    return uses.join(names, "module", "left").withColumn("module", F.coalesce("full_name", "module")).select(*uses.columns)


def attributes(uses: DataFrame, classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attribute reads (module, symbol) on a variable's type: found among attributes or methods, whatever their parameters."""
    plain = lambda df: df.select("*", F.lit(0).alias("n_args"), F.array().cast("array<string>").alias("kwargs"))
    bare = symbols.select("module", "symbol", F.lit(None).cast("array<string>").alias("expected"))
    return usages(plain(uses.drop("n_args", "kwargs")), classes, bare, untyped=0.3, missing=0.2, valid=0.8).drop("n_args", "kwargs")


def hallucinations(checked: DataFrame, *place: str) -> DataFrame:
    """(place, symbol, type) of uses (kind, symbol, status) known to be wrong.

    What is not found counts once a place, name and type; calls with wrong parameters count each time.
    """
    wrong = checked.where(F.col("kind").isin("method", "attribute") & (F.col("status") == "NOT_FOUND"))
    lost = wrong.select(*place, "symbol", F.concat(F.upper("kind"), F.lit("_NOT_FOUND")).alias("type")).distinct()
    return lost.unionByName(checked.where("status = 'INVALID'").select(*place, "symbol", F.lit("INVALID_PARAMETERS").alias("type")))


def combined(results: DataFrame, *keys: str) -> DataFrame:
    """Mean confidence by the graph and by examples, 0.5 where there is none, and 0.6 of one and 0.4 of the other."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    out = results.groupBy(*keys).agg(mean("graph_confidence").alias("graph"), mean("semantic_confidence").alias("semantic"))
    return out.withColumn("combined", 0.6 * F.col("graph") + 0.4 * F.col("semantic"))


def overall(checked: DataFrame, key: str) -> DataFrame:
    """Mean confidence of a key's uses in the graph; 1 without any."""
    return checked.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("in_graph"), F.col("confidence"))), F.lit(1.0)).alias("confidence"))


def report(checked: DataFrame, *keys: str) -> DataFrame:
    """Uses by status, and the share of those known to be wrong."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n("VALID").alias("valid"), n("INVALID").alias("invalid"), n("NOT_FOUND").alias("not_found"), n("UNCERTAIN").alias("uncertain"))
    bad = F.col("invalid") + F.col("not_found")
    return out.withColumn("hallucination_rate", bad / F.greatest(F.lit(1), F.col("valid") + bad))


def rates(results: DataFrame, *keys: str, high: float = 0.8) -> DataFrame:
    """Rows, those validated, and the shares of these and of high confidence; 0 without rows."""
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0))
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("validated").alias("validated"), share(F.col("validated")).alias("validation_rate"), share(F.col("confidence") >= high).alias("high_confidence_rate"))


def owners(modules: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(module, repo, n, rank): the repositories with most files whose first name part is the module's; ties by name."""
    first = lambda c: F.split(c, "\\.")[0]
    counts = files.groupBy(first(F.col("file_module")).alias("head"), "repo").agg(F.count(F.lit(1)).alias("n"))
    found = modules.select("module", first(F.col("module")).alias("head")).distinct().join(counts, "head")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "repo"))).where(F.col("rank") <= most).drop("head")


def fuzzy_names(asked: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(asked, name, rank): names that equal or hold what is asked, or are held by it, case and - or _ aside.

    asked is a query set, broadcast in blocks of about NAMES.
    """
    plain = lambda c: F.translate(F.lower(c), "-", "_")
    blocks = max(1, -(-asked.count() // NAMES))
    block = F.pmod(F.xxhash64("asked"), F.lit(blocks))
    near = lambda own: names.select("name", plain(F.col("name")).alias("_n")).join(F.broadcast(own.select("asked", plain(F.col("asked")).alias("_a"))), F.contains("_n", "_a") | F.contains("_a", "_n"))
    both = functools.reduce(DataFrame.unionByName, [near(asked.where(block == i) if blocks > 1 else asked) for i in range(blocks)])
    order = F.when(F.col("_n") == F.col("_a"), 1).when(F.contains("_n", "_a"), 2).otherwise(3)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(order, "name"))).where(F.col("rank") <= most).select("asked", "name", "rank")


def similar_names(asked: DataFrame, names: DataFrame, most: int = 5, *, case: bool = False) -> DataFrame:
    """(asked, name, rank): other names that hold the first three characters of what is asked, or all of it if it has fewer, by name.

    case: whether capital letters count. Names are dealt by each of their parts of one to three characters, so the join
    is one of equals; an empty name finds nothing.
    """
    plain = (lambda c: F.col(c)) if case else (lambda c: F.lower(c))
    head = F.left(plain("asked"), F.lit(3))
    heads = asked.select("asked", head.alias("_part")).where("_part <> ''").distinct()
    parts = lambda n: F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr(plain("name"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    dealt = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(parts(1), parts(2), parts(3)))).alias("_part"))
    found = heads.join(dealt, "_part").where("name <> asked")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("name"))).where(F.col("rank") <= most).select("asked", "name", "rank")
