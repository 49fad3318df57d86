"""Reports of scripts, one of them letter by letter."""

from __future__ import annotations

from corpusloom.operators import reports as rep

USES = [
    ("a.py", "import", "shop.models", "shop.models", 1, "VALID", 0.9, "there", True),
    ("a.py", "import", "requests", "requests", 2, "UNCERTAIN", 0.8, "outside", False),
    ("a.py", "class", "shop.models.User", "User", 3, "VALID", 0.8, "there", True),
    # a call is read as an attribute as well, and counts once
    ("a.py", "method", "shop.models.User", "save", 4, "VALID", 0.9, "fits", True),
    ("a.py", "attribute", "shop.models.User", "save", 4, "NOT_FOUND", 0.2, "lost", True),
    ("a.py", "method", "shop.models.User", "fly", 5, "NOT_FOUND", 0.1, "no fly", True),
    ("a.py", "function", "shop.models.load", "load", 6, "INVALID", 0.0625, None, True),
    ("a.py", "method", "requests.Session", "get", 7, "UNCERTAIN", 0.8, "outside", False),
    ("a.py", "method", None, "who", 8, "UNCERTAIN", 0.3, "unknown", False),
    ("a.py", "attribute", "models", "plain", 9, "UNCERTAIN", 0.3, "part of a module", False),
    ("b.py", "import", "os", "os", 1, "UNCERTAIN", 0.8, "outside", False),
]
TEXT = """# AI Hallucination Detection Report

**Script:** `a.py`
**Analysis Date:** today
**Overall Confidence:** 61.25%

## Summary

- **Total Validations:** 6
- **Valid:** 3 (50.0%)
- **Invalid:** 1 (16.7%)
- **Not Found:** 1 (16.7%)
- **Uncertain:** 1 (16.7%)
- **Hallucination Rate:** 40.0%

## 🚨 Hallucinations Detected

### 1. Method Not Found
**Location:** Line 5
**Description:** fly
**Suggestion:** save

### 2. Invalid Parameters
**Location:** Line 6
**Description:** load

## 📚 Libraries Analyzed

### requests
**Import Status:** UNCERTAIN
**Import Confidence:** 80.00%
**Methods Called:**
  - ❌ `Session.get()` (80.0%)

### shop.models
**Import Status:** VALID
**Import Confidence:** 90.00%
**Classes Used:**
  - ✅ `User` (80.0%)
**Methods Called:**
  - ✅ `User.save()` (90.0%)
  - ❌ `User.fly()` (10.0%)
**Attributes Accessed:**
  - ❌ `User.save` (20.0%)
**Functions Called:**
  - ❌ `load()` (6.2%)

## 💡 Recommendations

- Found 1 non-existent methods in knowledge graph libraries. Consider checking the official documentation for correct method names.
- Found 1 parameter mismatches in knowledge graph libraries. Check function signatures for correct parameter names and types.
- Overall confidence is moderate. Most validations were for external libraries not in the knowledge graph.

## 📋 Detailed Validation Results

### ❌ Invalid Items

- **FUNCTION_CALL** `load` (Line 6) - 

### 🔍 Not Found Items

- **METHOD_CALL** `fly` (Line 5) - no fly

### ✅ Valid Items (Sample)

- **IMPORT** `shop.models` (Line 1) - there
- **CLASS_INSTANTIATION** `User` (Line 3) - there
- **METHOD_CALL** `save` (Line 4) - fits
"""


def _given(spark, uses=USES):
    checked = spark.createDataFrame(uses, "script string, kind string, full string, name string, line long, status string, confidence double, message string, in_graph boolean")
    overall = spark.createDataFrame([("a.py", 0.6125)], "script string, confidence double")
    wrong = spark.createDataFrame([("a.py", "METHOD_NOT_FOUND", "Line 5", "fly", "save"), ("a.py", "INVALID_PARAMETERS", "Line 6", "load", "")], "script string, type string, location string, description string, suggestion string")
    return checked, overall, wrong


def test_markdown(spark):
    report = rep.reports(*_given(spark))
    texts = {r["script"]: r["text"] for r in report.select("script", rep.markdown(report, "today").alias("text")).collect()}
    assert texts["a.py"] == TEXT
    # a script without items: shares of nothing are 0, no sections without lines
    assert "- **Valid:** 0 (0.0%)" in texts["b.py"] and "**Overall Confidence:** 100.00%" in texts["b.py"]
    assert rep.NO_ADVICE in texts["b.py"] and "Items" not in texts["b.py"] and "🚨" not in texts["b.py"]


def test_valid_items_are_shown_ten_at_most(spark):
    uses = [USES[0], *[("a.py", "function", "shop.f", f"f{i}", i, "VALID", 0.8, "ok", True) for i in range(12)]]
    report = rep.reports(*_given(spark, uses))
    text = report.select(rep.markdown(report, "today").alias("text")).first()["text"]
    assert text.count("**FUNCTION_CALL**") + text.count("**IMPORT**") == 10 and "- ... and 3 more valid items" in text


def test_batch(spark):
    checked, overall, wrong = _given(spark)
    totals, worst = rep.batch(rep.summary(checked, overall), wrong)
    row = totals.first()
    assert (row["scripts"], row["total"], row["valid"], row["n_wrong"], row["confidence"]) == (2, 6, 3, 2, 0.80625)
    assert [(r["script"], r["n_wrong"]) for r in worst.collect()] == [("a.py", 2), ("b.py", 0)]
    totals, worst = rep.batch(rep.summary(checked.limit(0), overall), wrong)
    assert (totals.first()["scripts"], totals.first()["valid_share"], worst.count()) == (0, 0.0, 0)


def test_save(spark, tmp_path):
    report = rep.reports(*_given(spark))
    rep.save(report, f"{tmp_path}/json")
    rep.save(report, f"{tmp_path}/text", at="today")
    assert {r["script"]: r["total"] for r in spark.read.json(f"{tmp_path}/json").collect()} == {"a.py": 6, "b.py": 0}
    assert spark.read.parquet(f"{tmp_path}/text").where("script = 'a.py'").first()["markdown"] == TEXT


def test_uses_meet_once(spark):
    """Signatures are parsed once a symbol, below the joins, and a summary shuffles its uses once."""
    from corpusloom.operators import checks as c

    uses = spark.createDataFrame([("m", "f", 1, ["k"]), ("m", "f", 1, ["b"]), ("m", "g", 3, []), ("n", "f", 0, [])], "module string, symbol string, n_args bigint, kwargs array<string>")
    symbols = spark.createDataFrame([("m", "f", ["a:int", "b:str=1"]), ("m", "f", ["a:int", "[keyword_only] k:int"]), ("m", "g", ["a:int"])], "module string, symbol string, expected array<string>")
    found = c.usages(uses, symbols, symbols)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and "regexp" not in plan[: plan.index("Join")]
    assert sorted((r.symbol, r.module, r.status, r.confidence) for r in found.collect()) == [("f", "m", "VALID", 0.8), ("f", "m", "VALID", 0.8), ("f", "n", "UNCERTAIN", 0.8), ("g", "m", "INVALID", 0.8)]
    checked = spark.range(3).selectExpr("id script", "'import' kind", "'m' full", "'x' name", "1 line", "'VALID' status", "0.5D confidence", "'' message", "true in_graph")
    plan = rep.summary(checked, c.overall(checked, "script"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
