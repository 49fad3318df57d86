"""Registered queries of the iterative search, of reports about scripts, of code examples, and of languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as c
from ..operators import examples as ex
from ..operators import iterative as it
from ..operators import languages as ln
from ..operators import rag
from ..operators import reports as rep
from ..operators import rerank as rr
from ..operators import validated as val
from ..sources import tables as t
from .catalog import _query
from .search import _best, _rag
from .services import _STATUS, _STUB, _checked

# every third document is known; the others are what a search elsewhere finds and a fetch brings in


def _library(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions (the items of the benchmark), known rows, and those elsewhere."""
    doc = F.col("doc_id")
    rows = t.table(spark, d, "documents").select(F.concat_ws("/", "source", doc.cast("string")).alias("url"), doc, F.coalesce("text", F.lit("")).alias("content"))
    items = t.table(spark, d, "benchmark").groupBy(F.col("item_id").alias("query_id")).agg(F.max("text").alias("query"))
    return items, rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0")


def _elsewhere(there: DataFrame, found: int = 20):
    """A search among other rows, its addresses ranked by an injected scorer, and their fetch."""

    def find(asked: DataFrame) -> DataFrame:
        hits = it.by_words(asked, there, found).select("query_id", "row.url", F.lit(None).cast("string").alias("title"), F.col("row.content").alias("snippet"))
        return rr.ranked_urls(hits.join(asked.select("query_id", "query"), "query_id"), rr.word_overlap, least=0.1, most=3)

    return find, lambda urls: there.join(urls, "url", "left_semi")


@_query()
def iterative_search(spark, d):
    """Each item asked up to three times (held against a plain loop in tests)."""
    items, known, there = _library(spark, d)
    find, fetch = _elsewhere(there)
    answers, _, _ = it.search(items, known, t.stored, judge=it.judge_words(it.by_words), find=find, fetch=fetch)
    return answers.select("query_id", "last_query", "iterations", F.round("completeness", 6).alias("completeness"), F.array_join("gaps", " ").alias("gaps"), "status")


@_query()
def deep_search(spark, d):
    """Each item by its sentences, eight at most (held against a plain loop in tests)."""
    items, known, there = _library(spark, d)
    find, fetch = _elsewhere(there)
    sentences = F.slice(F.filter(F.transform(F.split("query", r"[.\n]"), lambda x: F.btrim(x)), lambda x: x != ""), 1, 8)
    topics = items.select("query_id", F.posexplode(sentences).alias("topic_no", "topic")).withColumn("query", F.col("topic"))
    head = lambda n: F.array_join(F.slice(it.words(F.col("query")), 1, n), " ")
    expand = lambda rows: rows.withColumns({"variations": F.array(head(3)), "broad": head(1), "specific": F.concat_ws(" ", "topic", "query")})
    cover = lambda pairs: rr.scored(pairs, rr.word_overlap, query="topic", into="score")
    answers, history, coverage = it.deep_search(items, topics, known, t.stored, retrieve=it.by_words, cover=cover, expand=expand, find=find, fetch=fetch)
    steps = history.groupBy("query_id").agg(F.count(F.lit(1)).alias("steps"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"))
    topics_met = coverage.groupBy("query_id").agg(F.count_if("covered").alias("n_covered"), F.count(F.lit(1)).alias("n_topics"))
    out = answers.join(steps, "query_id").join(topics_met, "query_id")
    return out.select("query_id", "iterations", F.round("completeness", 6).alias("completeness"), "status", "n_topics", "n_covered", "steps", "stored")


# reports: orders by number stand in for scripts, their lines for uses; every module is imported where it is used in the first line

_PLACED = f"""SELECT l_orderkey // 3 AS script, CASE l_linenumber WHEN 1 THEN 'import' WHEN 2 THEN 'class' WHEN 3 THEN 'method' WHEN 4 THEN 'attribute' WHEN 5 THEN 'function' WHEN 6 THEN 'method' ELSE 'attribute' END AS kind,
CASE l_linenumber WHEN 1 THEN module WHEN 2 THEN module || '.' || symbol WHEN 5 THEN CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE module || '.' || symbol END ELSE CASE WHEN l_orderkey % 7 = 0 THEN module ELSE module || '.Made' END END AS "full",
symbol AS name, (l_linenumber - 1) % 3 AS line, status, confidence::DOUBLE AS confidence, in_graph FROM ({_STATUS})"""
_KNOWN = f"""SELECT DISTINCT script, unnest([\"full\", string_split(\"full\", '.')[1]]) AS m FROM p WHERE kind = 'import' AND in_graph"""
_ITEMS = f"""WITH p AS ({_PLACED}), m AS ({_KNOWN}), k AS (SELECT p.* FROM p WHERE kind <> 'import' AND "full" <> '' AND EXISTS (SELECT 1 FROM m WHERE m.script = p.script AND CASE WHEN contains("full", '.') THEN m.m = string_split("full", '.')[1] ELSE contains(m.m, "full") END)),
i AS (SELECT * FROM p WHERE kind = 'import' AND in_graph UNION ALL SELECT * FROM k WHERE kind IN ('class', 'function') UNION ALL
SELECT * FROM k WHERE kind IN ('method', 'attribute') QUALIFY row_number() OVER (PARTITION BY script, line, name, "full" ORDER BY kind DESC, status, confidence) = 1)"""
_WRONG = "SELECT DISTINCT script, line, name, upper(kind) || '_NOT_FOUND' AS type FROM p WHERE status = 'NOT_FOUND' AND kind IN ('method', 'attribute') UNION ALL SELECT script, line, name, 'INVALID_PARAMETERS' FROM p WHERE status = 'INVALID'"
_SUMMED = f"""{_ITEMS}, w AS ({_WRONG}), s AS (SELECT script, count_if(kind = 'import') AS n_import, count_if(kind = 'method') AS n_method, round(coalesce(avg(CASE WHEN in_graph THEN confidence END), 1), 6) AS overall FROM p GROUP BY script),
n AS (SELECT script, count(*) AS total, count_if(status = 'VALID') AS valid, count_if(status = 'INVALID') AS invalid, count_if(status = 'NOT_FOUND') AS not_found, count_if(status = 'UNCERTAIN') AS uncertain FROM i GROUP BY script),
a AS (SELECT script, count(*) AS n_wrong, count_if(type = 'METHOD_NOT_FOUND') AS m, count_if(type = 'ATTRIBUTE_NOT_FOUND') AS a, count_if(type = 'INVALID_PARAMETERS') AS v FROM w GROUP BY script)
SELECT script, n_import, n_method, overall, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, coalesce(invalid, 0) AS invalid, coalesce(not_found, 0) AS not_found, coalesce(uncertain, 0) AS uncertain, coalesce(n_wrong, 0) AS n_wrong,
sha256(concat_ws(' ', CASE WHEN m > 0 THEN printf('{rep.ADVICE["METHOD_NOT_FOUND"]}', m) END, CASE WHEN a.a > 0 THEN printf('{rep.ADVICE["ATTRIBUTE_NOT_FOUND"]}', a.a) END, CASE WHEN v > 0 THEN printf('{rep.ADVICE["INVALID_PARAMETERS"]}', v) END,
CASE WHEN n_wrong IS NULL THEN '{rep.NO_ADVICE}' END, CASE WHEN overall < 0.7 THEN '{rep.MODERATE}' END)) AS advice_sha256 FROM s LEFT JOIN n USING (script) LEFT JOIN a USING (script)"""


def _reported(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked uses of scripts, their overall confidences, and what is wrong. Uses are checked once, as all parts of a report read them."""
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    dotted = F.concat_ws(".", "module", "symbol")
    made = F.when(order % 7 == 0, F.col("module")).otherwise(F.concat("module", F.lit(".Made")))
    full = F.when(n == 1, F.col("module")).when(n == 2, dotted).when(n == 5, F.when(order % 5 != 0, dotted)).otherwise(made)
    kind = F.element_at(F.array(*map(F.lit, ("import", "class", "method", "attribute", "function", "method", "attribute"))), n.cast("int"))
    checked = _checked(spark, d).select(F.expr("l_orderkey div 3").alias("script"), kind.alias("kind"), full.alias("full"), F.col("symbol").alias("name"), ((n - 1) % 3).alias("line"), "status", "confidence", F.lower("status").alias("message"), "in_graph")
    checked = t.stored(checked, "checked")
    wrong = c.hallucinations(checked.withColumnRenamed("name", "symbol"), "script", "line")
    located = wrong.select("script", "type", F.concat(F.lit("Line "), F.col("line").cast("string")).alias("location"), F.col("symbol").alias("description"), F.lit("").alias("suggestion"))
    overall = c.overall(checked, "script").withColumn("confidence", F.round("confidence", 6))
    return checked, overall, located


@_query(_SUMMED)
def script_reports(spark, d):
    """Numbers and advice of each script's report."""
    checked, overall, wrong = _reported(spark, d)
    numbers = rep.summary(checked, overall)
    return rep.advised(numbers, wrong).select("script", "n_import", "n_method", "overall", "total", "valid", "invalid", "not_found", "uncertain", "n_wrong", F.sha2(F.array_join("advice", " "), 256).alias("advice_sha256"))


_NAMES = "coalesce(string_agg(concat_ws(':', line, name, {}status), ',' ORDER BY line, name, {}status, confidence) FILTER (WHERE kind = '{}'), '')"
_CLASS = "string_split(\"full\", '.')[-1], "


@_query(f"""WITH p AS ({_PLACED}), m AS (SELECT script, "full" AS module, status FROM p WHERE kind = 'import' QUALIFY row_number() OVER (PARTITION BY script, "full" ORDER BY line, status, confidence) = 1),
u AS (SELECT script, regexp_replace("full", '\\.[^.]*$', '') AS module, {_NAMES.format("", "", "class")} AS classes, {_NAMES.format(_CLASS, _CLASS, "method")} AS methods, {_NAMES.format(_CLASS, _CLASS, "attribute")} AS attributes, {_NAMES.format("", "", "function")} AS functions
FROM p WHERE kind <> 'import' AND contains("full", '.') GROUP BY 1, 2)
SELECT script, module, status, coalesce(classes, '') AS classes, coalesce(methods, '') AS methods, coalesce(attributes, '') AS attributes, coalesce(functions, '') AS functions FROM m LEFT JOIN u USING (script, module)""")
def script_libraries(spark, d):
    """What each script uses its imports for."""
    out = rep.libraries(_reported(spark, d)[0])
    text = lambda x: F.concat_ws(":", x["line"].cast("string"), x["name"], x["class_name"], x["status"])
    return out.select("script", "module", "status", *[F.array_join(F.transform(n, text), ",").alias(n) for n in ("classes", "methods", "attributes", "functions")])


@_query(f"""SELECT count(*) AS scripts, sum(total)::BIGINT AS total, sum(valid)::BIGINT AS valid, sum(invalid)::BIGINT AS invalid, sum(not_found)::BIGINT AS not_found, sum(n_wrong)::BIGINT AS n_wrong, round(avg(overall), 6) AS confidence,
round(sum(valid) / sum(total), 6) AS valid_share FROM ({_SUMMED})""")
def batch_totals(spark, d):
    checked, overall, wrong = _reported(spark, d)
    totals, _ = rep.batch(rep.summary(checked, overall), wrong)
    return totals.select("scripts", "total", "valid", "invalid", "not_found", "n_wrong", F.round("confidence", 6).alias("confidence"), F.round("valid_share", 6).alias("valid_share"))


@_query(f"SELECT script, n_wrong, overall FROM ({_SUMMED}) ORDER BY n_wrong DESC, script LIMIT 5")
def batch_worst(spark, d):
    checked, overall, wrong = _reported(spark, d)
    return rep.batch(rep.summary(checked, overall), wrong)[1]


@_query()
def report_markdown(spark, d):
    """Each script's report as Markdown (held against a literal one in tests)."""
    report = rep.reports(*_reported(spark, d))
    return report.select("script", rep.markdown(report, "2024-02-01").alias("markdown")).select("script", F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


# validated search: chunks are code examples; the graph holds classes, methods and functions that some of them name

_CODE = """SELECT query_id, chunk_id, s, source_id, CASE chunk_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'function' ELSE 'unknown' END AS code_type,
CASE WHEN chunk_id % 8 = 1 THEN NULL ELSE 'C' || (chunk_id % 11) END AS class_name, 'm' || (chunk_id % 17) AS member"""
_VALID = f"""SELECT *, CASE code_type WHEN 'class' THEN CASE WHEN has THEN (0.3 * r + 0.7) / 1.0 ELSE 0.3 * r / 0.7 END WHEN 'method' THEN CASE WHEN has THEN (0.3 * r + 0.7) / 1.0 ELSE 0.3 * r / 0.7 END WHEN 'function' THEN 0.3 * r + 0.7 * has::INT ELSE r END::DOUBLE AS c FROM (
SELECT f.*, (source_id IN (SELECT source FROM documents WHERE source < 'src7'))::INT AS r, CASE code_type
WHEN 'class' THEN EXISTS (SELECT 1 FROM documents d WHERE d.source = source_id AND doc_id % 2 = 0 AND class_name IN ('C' || (doc_id % 11)))
WHEN 'method' THEN EXISTS (SELECT 1 FROM documents d WHERE d.source = source_id AND doc_id % 3 = 0 AND member = 'm' || (doc_id % 17) AND (class_name IS NULL OR class_name = 'C' || (doc_id % 11)))
ELSE EXISTS (SELECT 1 FROM documents d WHERE d.source = source_id AND doc_id % 5 = 0 AND member = 'm' || (doc_id % 17)) END AS has FROM ({_CODE} FROM ({_best(20)})) f)"""
_FINAL = f"SELECT *, 0.4 * s + 0.6 * c AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.4 * s + 0.6 * c DESC, chunk_id) AS place FROM ({_VALID}) WHERE c >= {{}}"


def _validated(spark, d) -> tuple[DataFrame, DataFrame]:
    asked, rows = _rag(spark, d)
    doc, word = F.col("doc_id"), lambda mark, c, n: F.concat(F.lit(mark), (c % n).cast("string"))
    found = rag.candidates(asked, rows, 20).select("query_id", "similarity", "row.chunk_id", "row.source_id")
    chunk = F.col("chunk_id")
    kind = F.element_at(F.array(*map(F.lit, ("class", "method", "function", "unknown"))), (chunk % 4 + 1).cast("int"))
    results = found.withColumns({"code_type": kind, "class_name": F.when(chunk % 8 != 1, word("C", chunk, 11)), "method_name": F.when(chunk % 2 == 0, word("m", chunk, 17)), "name": word("m", chunk, 17)})
    docs = t.table(spark, d, "documents")
    cls, name, none = word("C", doc, 11), word("m", doc, 17), F.lit(None).cast("string")
    symbol = lambda where, kind, c, n: docs.where(where).select(F.col("source").alias("repo"), F.lit(kind).alias("kind"), c.alias("class_name"), F.concat(F.lit("pkg."), c).alias("full_class_name"), n.alias("name"))
    symbols = symbol("doc_id % 2 = 0", "class", cls, none).unionByName(symbol("doc_id % 3 = 0", "method", cls, name)).unionByName(symbol("doc_id % 5 = 0", "function", none, name))
    return asked, val.validate(results, docs.where("source < 'src7'").select(F.col("source").alias("repo")), symbols)


@_query(f"SELECT query_id, chunk_id, code_type, round(c, 6) AS confidence, c >= 0.6 AS is_valid, round(score, 6) AS score, place FROM ({_FINAL.format(0.6)}) WHERE place <= 10")
def validated_search(spark, d):
    """The ten best of twenty examples a query by similarity and by what the graph says of them."""
    out = val.ranked(_validated(spark, d)[1], 10)
    return out.select("query_id", "chunk_id", "code_type", F.round("validation.confidence", 6).alias("confidence"), "validation.is_valid", F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place"))


@_query(f"""SELECT query_id, total_found, total_found AS validated, coalesce(final_count, 0) AS final_count, coalesce(high, 0)::BIGINT AS high_confidence, round(coalesce(high / final_count, 0), 6) AS high_confidence_rate FROM (SELECT query_id, count(*) AS total_found FROM ({_VALID}) GROUP BY query_id)
LEFT JOIN (SELECT query_id, count(*) AS final_count, count_if(c >= 0.8) AS high FROM ({_FINAL.format(0.7)}) WHERE place <= 10 GROUP BY query_id) USING (query_id)""")
def validated_search_summary(spark, d):
    """Numbers of each query's thorough search."""
    asked, found = _validated(spark, d)
    out = val.search_summary(asked, found, val.ranked(found, 10, mode="thorough"))
    return out.select("query_id", "total_found", "validated", "final_count", "high_confidence", F.round("high_confidence_rate", 6).alias("high_confidence_rate"))


_ELEMENTS = f"SELECT l_orderkey % 1000 AS script, CASE l_linenumber % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'function' END AS kind, module, symbol AS name, status <> 'NOT_FOUND' AND in_graph AS found FROM ({_STATUS})"


def _elements(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("import", "class", "method", "function"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return _checked(spark, d).select((F.col("l_orderkey") % 1000).alias("script"), kind.alias("kind"), "module", F.col("symbol").alias("name"), ((F.col("status") != "NOT_FOUND") & F.col("in_graph")).alias("found"))


@_query(f"""SELECT script, kind, type, severity, count(*) AS n, round(avg(c), 6) AS confidence FROM (SELECT script, kind, 'structural' AS type, c, CASE WHEN c < 0.3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, CASE WHEN kind IN ('import', 'class') THEN CASE WHEN found THEN 0.8 ELSE 0.2 END ELSE CASE WHEN found THEN 0.7 ELSE 0.3 END END::DOUBLE AS c FROM ({_ELEMENTS})) WHERE c < 0.5
UNION ALL SELECT script, kind, 'semantic', a, CASE WHEN a < 0.3 THEN 'high' ELSE 'medium' END FROM (SELECT query_id AS script, code_type AS kind, max(c) AS b, avg(c) AS a FROM ({_VALID}) GROUP BY 1, 2) WHERE b < 0.7) GROUP BY script, kind, type, severity""")
def doubtful_elements(spark, d):
    """Elements that the graph lacks, and kinds of examples of a query none of which is good."""
    by_graph = val.doubtful(_elements(spark, d).withColumn("confidence", val.found_confidence(F.col("kind"), F.col("found"))))
    examples = _validated(spark, d)[1].select(F.col("query_id").alias("script"), F.col("code_type").alias("kind"), "validation.confidence")
    both = by_graph.select("script", "kind", "type", "severity", "confidence").unionByName(val.doubtful_by_examples(examples, "script", "kind").select("script", "kind", "type", "severity", "confidence"))
    return both.groupBy("script", "kind", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@_query(f"""SELECT script, array_to_string(list_sort(list(DISTINCT x)), '|') AS suggestions FROM (SELECT script, CASE kind WHEN 'import' THEN 'Import ''' || module || '.' || name || ''' not found in knowledge graph. Check module name or parse the relevant repository.'
ELSE 'Class ''' || name || ''' not found. Check class name spelling or ensure the relevant repository is parsed.' END AS x FROM ({_ELEMENTS}) WHERE NOT found AND kind IN ('import', 'class')) GROUP BY script""")
def script_suggestions(spark, d):
    return val.suggestions(_elements(spark, d), "script").select("script", F.array_join("suggestions", "|").alias("suggestions"))


# code examples: customers are classes and their orders methods, as in the class stubs; parts are functions

_TYPED = "CASE WHEN o_orderstatus = 'F' THEN 'Any' ELSE 'Dict[str, int]' END"
_PARAMS = "'self, day: int=' || (o_orderkey % 9) || ', *rest, key: str'"


@_query(f"""SELECT full_name, code_type, sha256(text) AS text_sha256 FROM (
SELECT 'shop.n' || c_nationkey || '.Customer' || c_custkey AS full_name, 'class' AS code_type, 'Python class Customer' || c_custkey || ' in shop.n' || c_nationkey || chr(10) || 'Full name: shop.n' || c_nationkey || '.Customer' || c_custkey || chr(10) || CASE WHEN n > 0 THEN 'Contains ' || n || ' methods' || chr(10) ELSE '' END || 'Code: ' || code AS text
FROM ({_STUB}) JOIN customer USING (c_custkey) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
UNION ALL SELECT 'shop.n' || c_nationkey || '.Customer' || c_custkey || '.order' || o_orderkey, 'method', 'Python method order' || o_orderkey || ' in class Customer' || c_custkey || ' from shop.n' || c_nationkey || chr(10) || 'Parameters: ' || {_PARAMS} || CASE WHEN o_orderstatus = 'F' THEN '' ELSE chr(10) || 'Returns: Dict[str, int]' END || chr(10) ||
'Code: def order' || o_orderkey || '(' || {_PARAMS} || ') -> ' || {_TYPED} || ':' || chr(10) || '    \"\"\"Method implementation\"\"\"' || chr(10) || '    pass' FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'f' || p_partkey, 'function', 'Python function f' || p_partkey || ' from ' || chr(10) || 'Parameters: size' || chr(10) || 'Code: def f' || p_partkey || '(size) -> Any:' || chr(10) || '    \"\"\"Function implementation\"\"\"' || chr(10) || '    pass' FROM part WHERE p_partkey % 3 <> 0)""")
def code_examples(spark, d):
    """Records of all classes, methods and functions, and the texts they are embedded by."""
    key, string = lambda c: F.col(c).cast("string"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    method = F.struct(F.col("o_orderkey"), string("order", key("o_orderkey")).alias("name"), F.array(F.lit("self"), string("day: int=", (F.col("o_orderkey") % 9).cast("string")), F.lit("*rest"), F.lit("key: str")).alias("params_list"), F.when(F.col("o_orderstatus") != "F", "Dict[str, int]").alias("return_type"))
    own = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(method)).alias("methods"))
    module = string("shop.n", key("c_nationkey"))
    classes = t.table(spark, d, "customer").join(own, "c_custkey", "left").select(F.lit("shop").alias("repo"), F.lit("a.py").alias("path"), module.alias("module"), string("Customer", key("c_custkey")).alias("name"), string(module, ".Customer", key("c_custkey")).alias("full_name"), "methods")
    mark = F.when(F.col("p_partkey") % 3 == 0, "_f").otherwise("f")
    functions = t.table(spark, d, "part").select(F.lit("shop").alias("repo"), F.lit("b.py").alias("path"), F.lit(None).cast("string").alias("module"), F.concat(mark, key("p_partkey")).alias("name"), F.array(F.lit("size")).alias("params_list"), F.lit(None).cast("string").alias("return_type"))
    return ex.examples(classes, functions).select("full_name", "code_type", F.sha2(ex.embedding_text(), 256).alias("text_sha256"))


# languages: chunks lie in files of several kinds

_EXT = "list_value('.py', '.TS?x=1', '.com/a', '.rs#top', '', '.JS')[(chunk_id % 6 + 1)::INT]"
_LANG = "list_value('python', 'typescript', 'unknown', 'rust', 'unknown', 'javascript')[(chunk_id % 6 + 1)::INT]"
_ACROSS = f"SELECT query_id, chunk_id, s, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY s DESC, chunk_id) AS place FROM (SELECT *, CASE WHEN chunk_id % 7 = 0 THEN 'go' ELSE {_LANG} END AS lang FROM ({_best(30)})) QUALIFY place <= 10"


def _across(spark, d) -> DataFrame:
    asked, rows = _rag(spark, d)
    chunk = F.col("chunk_id")
    found = rag.candidates(asked, rows, 30).select("query_id", "similarity", "row.chunk_id", "row.source_id")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".TS?x=1", ".com/a", ".rs#top", "", ".JS"))), (chunk % 6 + 1).cast("int"))
    url = F.concat(F.lit("http://x.com/"), "source_id", F.lit("/f"), chunk.cast("string"), ext)
    return ln.across(found.withColumn("language", ln.language(url, F.when(chunk % 7 == 0, "Go"))))


@_query(f"SELECT query_id, chunk_id, lang AS language, place FROM ({_ACROSS})")
def cross_language(spark, d):
    return _across(spark, d).select("query_id", "chunk_id", "language", F.col("place").cast("bigint").alias("place"))


@_query(f"""SELECT query_id, sum(n)::BIGINT AS total, string_agg(lang || ':' || n || ':' || m, ',' ORDER BY lang) AS languages, arg_min(lang, (-n, lang)) AS most_relevant FROM (SELECT query_id, lang, count(*) AS n, round(1000 * round(avg(s), 3))::BIGINT AS m FROM ({_ACROSS}) GROUP BY query_id, lang) GROUP BY query_id""")
def cross_language_summary(spark, d):
    found = _across(spark, d)
    counts = found.groupBy("query_id", "language").agg(F.count(F.lit(1)).alias("n"))
    out = ln.across_summary(found).select("query_id", "total", "most_relevant", "mean")
    per = counts.join(out, "query_id").withColumn("_l", F.concat_ws(":", "language", F.col("n").cast("string"), F.round(1000 * F.col("mean")[F.col("language")]).cast("bigint").cast("string")))
    return per.groupBy("query_id", "total", "most_relevant").agg(F.array_join(F.sort_array(F.collect_list("_l")), ",").alias("languages"))


@_query("""SELECT query_id, chunk_id, place FROM (SELECT q.vec_id AS query_id, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.doc_id) AS place FROM embeddings q JOIN documents d ON d.doc_id % 17 = q.vec_id % 17
AND (q.vec_id % 4 = 0 OR d.doc_id % 11 = q.vec_id % 11) AND (q.vec_id % 3 > 0 OR d.source = 'src' || (q.vec_id % 5)) WHERE q.vec_id % 50 = 0) WHERE place <= 10""")
def code_by_signature(spark, d):
    """Examples of a method's name, some of one class or repository."""
    word = lambda mark, c, n: F.concat(F.lit(mark), (F.col(c) % n).cast("string"))
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), word("m", "doc_id", 17).alias("name"), word("C", "doc_id", 11).alias("class_name"), F.col("source").alias("repo"))
    vec = F.col("vec_id")
    asked = t.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(vec.alias("query_id"), word("m", "vec_id", 17).alias("name"), F.when(vec % 4 != 0, word("C", "vec_id", 11)).alias("class_name"), F.when(vec % 3 == 0, word("src", "vec_id", 5)).otherwise("").alias("repo"))
    return ln.by_signature(docs, asked).select("query_id", "chunk_id", F.col("place").cast("bigint").alias("place"))
