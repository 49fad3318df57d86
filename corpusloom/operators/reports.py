"""Reports about the checked uses of scripts: items by status, libraries, advice, Markdown, and totals of all scripts.

checked: (script, kind, full, name, line, status, confidence, message, in_graph), a row for each use. kind is import, class,
method, attribute or function; full is the module of an import, the full name of a class or function, the type of a
method's or attribute's object, or null. A report is one row a script, so its lists are as long as the script has uses; everything
that counts is counted before. Items are in order of line, kind, name and full name. Nulls: a use without a full name
is in no report; a null message is empty. Repeated rows count each time, but for methods and attributes, see `items`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("import", "class", "method", "attribute", "function")
STATUSES = ("VALID", "INVALID", "NOT_FOUND", "UNCERTAIN")

# Names and texts of a report.
TYPES = {"import": "IMPORT", "class": "CLASS_INSTANTIATION", "method": "METHOD_CALL", "attribute": "ATTRIBUTE_ACCESS", "function": "FUNCTION_CALL"}
ADVICE = {
    "METHOD_NOT_FOUND": "Found %d non-existent methods in knowledge graph libraries. Consider checking the official documentation for correct method names.",
    "ATTRIBUTE_NOT_FOUND": "Found %d non-existent attributes in knowledge graph libraries. Verify attribute names against the class documentation.",
    "INVALID_PARAMETERS": "Found %d parameter mismatches in knowledge graph libraries. Check function signatures for correct parameter names and types.",
}
NO_ADVICE = "No hallucinations detected in knowledge graph libraries. External library usage appears to be working as expected."
MODERATE = "Overall confidence is moderate. Most validations were for external libraries not in the knowledge graph."
MODERATE_BELOW = 0.7
SHOWN = 10


def _kind_no(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _marked(checked: DataFrame) -> DataFrame:
    """`checked` with `_listed`, whether a report lists the row: all of a script's rows meet once, in windows over the script."""
    own = Window.partitionBy("script")
    import_in = (F.col("kind") == "import") & F.col("in_graph") & F.col("full").isNotNull()
    heads = F.collect_set(F.when(import_in, F.col("full"))).over(own)
    # the rows that count once stand apart from the others of their line, name and type
    member = F.coalesce(F.col("kind").isin("method", "attribute"), F.lit(False))
    same = Window.partitionBy("script", "_member", "line", "name", "full").orderBy(F.desc("kind"), "status", "confidence", "message")
    known = checked.withColumns({"_known": heads, "_member": member})
    # whole names and their first parts; a first part is told by what follows it
    dotted = F.exists("_known", lambda m: F.substring_index(m, ".", 1) == F.substring_index("full", ".", 1))
    inside = F.when(F.contains("full", F.lit(".")), dotted).otherwise(F.exists("_known", lambda m: F.contains(m, F.col("full"))))
    listed = F.when(F.col("kind") == "import", import_in).otherwise(F.col("script").isNotNull() & (F.col("full") != "") & inside)
    first = ~F.col("_member") | (F.row_number().over(same) == 1)
    out = known.withColumn("_listed", F.coalesce(listed & F.col("kind").isNotNull(), F.lit(False))).drop("_known")
    return out.withColumn("_listed", F.col("_listed") & first).drop("_member")


def items(checked: DataFrame) -> DataFrame:
    """Uses that a report lists, with `type`: imports in the graph, and what comes from a module that the script imports from it.

    A dotted full name belongs to the graph if its first part is one of these modules or their first part; one without a dot if
    such a module contains it. A method or attribute counts once a line, name and type; the method first, then the first status.
    """
    return _marked(checked).where("_listed").drop("_listed").withColumn("type", _type())


def _type() -> Column:
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("kind")]


def _summed(checked: DataFrame, confidence: DataFrame, *more: Column) -> DataFrame:
    """`summary` with more aggregates of a script's `_marked` rows, all in one pass."""
    names = [x.lower() for x in STATUSES]
    placed = F.col("_listed") & F.col("script").isNotNull()
    counts = [*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], *[F.count_if(placed & (F.col("status") == x)).alias(x.lower()) for x in STATUSES]]
    out = _marked(checked).groupBy("script").agg(*counts, *more).join(confidence.select("script", F.col("confidence").alias("overall")), "script", "left")
    bad = F.col("invalid") + F.col("not_found")
    total = sum((F.col(x) for x in names), F.lit(0).cast("bigint"))
    return out.withColumns({"total": total, "hallucination_rate": bad / F.greatest(F.lit(1), F.col("valid") + bad), "overall": F.coalesce("overall", F.lit(1.0))})


def summary(checked: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row a script: its uses by kind, its items by status, the share of those known to be wrong, and its overall confidence (script, confidence; 1 where missing)."""
    return _summed(checked, confidence)


def libraries(checked: DataFrame) -> DataFrame:
    """(script, module, status, confidence, classes, methods, attributes, functions): what each import (its first line counts) is used for.

    A use belongs to the module that its full name names before the last dot. Lists of (line, name, class_name, status, confidence), by line.
    """
    first = F.row_number().over(Window.partitionBy("script", "full").orderBy("line", "status", "confidence"))
    modules = checked.where("kind = 'import' AND full IS NOT NULL").withColumn("_k", first).where("_k = 1").select("script", F.col("full").alias("module"), "status", "confidence")
    last = F.substring_index("full", ".", -1)
    use = F.struct("line", "name", F.when(F.col("kind").isin("method", "attribute"), last).alias("class_name"), "status", "confidence")
    used = checked.where("kind <> 'import'").where(F.contains("full", F.lit("."))).withColumn("module", F.substr("full", F.lit(1), F.length("full") - F.length(last) - 1))
    plural = {"class": "classes", "method": "methods", "attribute": "attributes", "function": "functions"}
    lists = used.groupBy("script", "module").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, use))).alias(p) for k, p in plural.items()])
    none = F.array().cast(lists.schema["classes"].dataType)
    return modules.join(lists, ["script", "module"], "left").withColumns({p: F.coalesce(p, none) for p in plural.values()})


def advised(scripts: DataFrame, wrong: DataFrame) -> DataFrame:
    """`scripts` (script, overall and others) with `n_wrong` and `advice`: texts by what is wrong (script, type); what is of no known type counts as wrong without a text."""
    counts = wrong.groupBy("script").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("type") == k).alias(f"_{k}") for k in ADVICE])
    texts = [F.when(F.col(f"_{k}") > 0, F.format_string(text, F.col(f"_{k}"))) for k, text in ADVICE.items()]
    nothing = F.when(F.col("_n").isNull(), F.lit(NO_ADVICE))
    moderate = F.when(F.col("overall") < MODERATE_BELOW, F.lit(MODERATE))
    out = scripts.join(counts, "script", "left")
    return out.select(*scripts.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_wrong"), F.array_compact(F.array(*texts, nothing, moderate)).alias("advice"))


def recommendations(scripts: DataFrame, wrong: DataFrame) -> DataFrame:
    """(script, advice): `advised` for each script (script, overall)."""
    return advised(scripts.select("script", "overall"), wrong).select("script", "advice")


def reports(checked: DataFrame, confidence: DataFrame, wrong: DataFrame) -> DataFrame:
    """The whole report of each script: `summary`, its items by status, libraries, what is wrong (script, type, location, description, suggestion) and advice."""
    item = F.struct("line", _kind_no(F.col("kind")).alias("kind_no"), "name", "full", _type().alias("type"), "confidence", F.coalesce("message", F.lit("")).alias("message"))
    placed = F.col("_listed") & F.col("script").isNotNull()
    listed = [F.array_sort(F.collect_list(F.when(placed & (F.col("status") == x), item))).alias(f"{x.lower()}_items") for x in STATUSES]
    libs = libraries(checked)
    per_module = libs.groupBy("script").agg(F.array_sort(F.collect_list(F.struct(*[c for c in libs.columns if c != "script"]))).alias("libraries"))
    found = wrong.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("location", "type", "description", "suggestion"))).alias("wrong"))
    out = advised(_summed(checked, confidence, *listed), wrong).drop("n_wrong")
    for part in (per_module, found):
        out = out.join(part, "script", "left")
        out = out.withColumns({c: F.coalesce(c, F.array().cast(part.schema[c].dataType)) for c in part.columns if c != "script"})
    return out


def _percent(share: Column, digits: int) -> Column:
    """As a percentage; halves go to the even digit."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def _block(title: str, lines: Column, of: Column | str) -> Column:
    """Lines of a section, made of the list `of`, with its title and an empty line behind it; none where that is empty. The list is asked, as asking the lines would make them twice."""
    return F.when(F.size(of) > 0, F.concat(F.array(F.lit(title), F.lit("")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def _line(x: Column) -> Column:
    return F.concat(F.lit("- **"), x["type"], F.lit("** `"), F.coalesce(x["name"], F.lit("")), F.lit("` (Line "), x["line"].cast("string"), F.lit(") - "), x["message"])


def markdown(report: DataFrame, at: Column | str) -> Column:
    """A report's text, its date being `at`. Of the valid items the first SHOWN are listed; shares of no items are 0."""
    share = lambda n: _percent(F.coalesce(F.try_divide(F.col(n), F.col("total")), F.lit(0.0)), 1)
    counted = lambda label, n: F.concat(F.lit(f"- **{label}:** "), F.col(n).cast("string"), F.lit(" ("), share(n), F.lit(")"))
    date = F.lit(at) if isinstance(at, str) else at
    head = [F.lit("# AI Hallucination Detection Report"), F.lit(""), F.concat(F.lit("**Script:** `"), F.col("script").cast("string"), F.lit("`")), F.concat(F.lit("**Analysis Date:** "), date), F.concat(F.lit("**Overall Confidence:** "), _percent(F.col("overall"), 2)), F.lit("")]
    numbers = [
        F.lit("## Summary"), F.lit(""), F.concat(F.lit("- **Total Validations:** "), F.col("total").cast("string")),
        counted("Valid", "valid"), counted("Invalid", "invalid"), counted("Not Found", "not_found"), counted("Uncertain", "uncertain"),
        F.concat(F.lit("- **Hallucination Rate:** "), _percent(F.col("hallucination_rate"), 1)), F.lit(""),
    ]
    title = lambda x: F.initcap(F.replace(F.lower(x["type"]), F.lit("_"), F.lit(" ")))
    place = lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), title(x))
    wrong = F.flatten(F.transform("wrong", lambda x, i: F.array_compact(F.array(place(x, i), F.concat(F.lit("**Location:** "), x["location"]), F.concat(F.lit("**Description:** "), x["description"]), F.when(x["suggestion"] != "", F.concat(F.lit("**Suggestion:** "), x["suggestion"])), F.lit("")))))
    mark = lambda x: F.when(x["status"] == "VALID", "✅").otherwise("❌")
    used = lambda x, text: F.concat(F.lit("  - "), mark(x), F.lit(" `"), text, F.lit("` ("), _percent(x["confidence"], 1), F.lit(")"))

    def uses(label: str, lists: Column, text) -> Column:
        lines = F.transform(lists, lambda x: used(x, text(x)))
        return F.when(F.size(lists) > 0, F.concat(F.array(F.lit(f"**{label}:**")), lines)).otherwise(F.array().cast("array<string>"))

    def library(x: Column) -> Column:
        own = F.array(F.concat(F.lit("### "), x["module"]), F.concat(F.lit("**Import Status:** "), x["status"]), F.concat(F.lit("**Import Confidence:** "), _percent(x["confidence"], 2)))
        member = lambda u: F.concat(u["class_name"], F.lit("."), u["name"])
        return F.concat(
            own, uses("Classes Used", x["classes"], lambda u: u["name"]), uses("Methods Called", x["methods"], lambda u: F.concat(member(u), F.lit("()"))),
            uses("Attributes Accessed", x["attributes"], member), uses("Functions Called", x["functions"], lambda u: F.concat(u["name"], F.lit("()"))), F.array(F.lit("")),
        )

    # a section whose parts end in an empty line of their own needs none behind them
    open_block = lambda title, lines, of: F.when(F.size(of) > 0, F.concat(F.array(F.lit(title), F.lit("")), lines)).otherwise(F.array().cast("array<string>"))
    valid = F.col("valid_items")
    more = F.when(F.size(valid) > SHOWN, F.array(F.concat(F.lit("- ... and "), (F.size(valid) - SHOWN).cast("string"), F.lit(" more valid items")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(*head, *numbers), open_block("## 🚨 Hallucinations Detected", wrong, "wrong"), open_block("## 📚 Libraries Analyzed", F.flatten(F.transform("libraries", library)), "libraries"),
        _block("## 💡 Recommendations", F.transform("advice", lambda x: F.concat(F.lit("- "), x)), "advice"), F.array(F.lit("## 📋 Detailed Validation Results"), F.lit("")),
        _block("### ❌ Invalid Items", F.transform("invalid_items", _line), "invalid_items"), _block("### 🔍 Not Found Items", F.transform("not_found_items", _line), "not_found_items"),
        _block("### ✅ Valid Items (Sample)", F.concat(F.transform(F.slice(valid, 1, SHOWN), _line), more), valid),
    )
    return F.array_join(lines, "\n", "")


def batch(numbers: DataFrame, wrong: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, worst): one row of all scripts' sums, shares and mean confidence, and the scripts with most that is wrong, ties by script. numbers: `summary`."""
    counts = wrong.groupBy("script").agg(F.count(F.lit(1)).alias("n_wrong"))
    every = numbers.join(counts, "script", "left").fillna(0, ["n_wrong"])
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "valid", "invalid", "not_found", "n_wrong")]
    totals = every.agg(F.count(F.lit(1)).alias("scripts"), *sums, F.avg("overall").alias("confidence"))
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("total")), F.lit(0.0)).alias(f"{x}_share")
    totals = totals.select("*", *[share(x) for x in ("valid", "invalid", "not_found")])
    return totals, every.select("script", "n_wrong", "overall").orderBy(F.desc("n_wrong"), "script").limit(worst)


def save(report: DataFrame, path: str, *, at: Column | str | None = None) -> None:
    """Reports as a new folder of JSON lines, or, with a date, of Parquet rows (script, markdown)."""
    if at is None:
        report.write.mode("errorifexists").json(path)
    else:
        report.select("script", markdown(report, at).alias("markdown")).write.mode("errorifexists").parquet(path)
