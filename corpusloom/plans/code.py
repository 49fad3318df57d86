"""Registered queries of source files and of the code graph, over sources and modules that Spark makes from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checks as c
from ..operators import code_graph as g
from ..operators import scopes, structure
from ..sources import tables as t
from .catalog import _query

_str = lambda c: F.col(c).cast("string")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# declarations -----------------------------------------------------------------------------------

# a customer's file holds a class with a method an order; signs in strings and comments declare nothing
_DECLARED = ("path", "kind", "name", "owner", "base", "names", "flags", "line", "doc", "exported")


def _scripts(spark, d) -> DataFrame:
    key, order = _str("c_custkey"), _str("o_orderkey")
    method = _joined("  /** Order ", order, ". */\n  static async order", order, "(a, b = {x: '}'}) { return `${a}}`.match(/}\\/*/); } // class No", order, " {}\n")
    orders = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", method.alias("m")))), lambda x: x["m"]), "").alias("methods"))
    own = t.table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    segment = F.lower("c_mktsegment")
    text = _joined(
        "import base, {make as made, other} from '@shop/", segment, "/x';\nconst glob = \"a/*.ts\";\n/* class Gone", key, " {} */\n/**\n * Customer ", key, ".\n */\nexport class Customer", key, " extends base.Thing {\n  limit = \"}\";\n",
        F.coalesce("methods", F.lit("")), "}\nexport const make", key, " = (x) => ({x});\nexport { made as again", key, " };\n",
    )
    return own.select(_joined("c", key, ".js").alias("path"), text.alias("content"))


_ORDERS = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders"
_FILE = "SELECT 'c' || c_custkey || '.js' AS path, c_custkey AS k, lower(c_mktsegment) AS segment FROM customer"


@_query(f"""WITH f AS ({_FILE}), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), e AS (SELECT f.*, coalesce(n, 0) AS n FROM f LEFT JOIN n ON o_custkey = k)
SELECT path, 'import' AS kind, '@shop/' || segment || '/x' AS name, '' AS owner, NULL AS base, 'base,made,other' AS names, 'es6' AS flags, 1 AS line, NULL AS doc, false AS exported FROM f
UNION ALL SELECT path, 'variable', 'glob', '', NULL, '', 'const', 2, NULL, false FROM f
UNION ALL SELECT path, 'class', 'Customer' || k, '', 'base.Thing', '', '', 7, 'Customer ' || k || '.', true FROM f
UNION ALL SELECT path, 'export', 'Customer' || k, '', NULL, '', 'named,class', 7, 'Customer ' || k || '.', false FROM f
UNION ALL SELECT path, 'field', 'limit', 'Customer' || k, NULL, '', '', 8, NULL, false FROM f
UNION ALL SELECT 'c' || o_custkey || '.js', 'method', 'order' || o_orderkey, 'Customer' || o_custkey, NULL, '', 'static,async', 8 + 2 * o.k, 'Order ' || o_orderkey || '.', false FROM ({_ORDERS}) o JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT path, 'arrow', 'make' || k, '', NULL, '', '', 10 + 2 * n, NULL, true FROM e
UNION ALL SELECT path, 'variable', 'make' || k, '', NULL, '', 'const', 10 + 2 * n, NULL, true FROM e
UNION ALL SELECT path, 'export', 'make' || k, '', NULL, '', 'named,const', 10 + 2 * n, NULL, false FROM e
UNION ALL SELECT path, 'export', 'again' || k, '', NULL, '', 'named,value', 11 + 2 * n, NULL, false FROM e""")
def js_structure(spark, d):
    """Declarations of the customers' JavaScript files."""
    found = structure.structure(_scripts(spark, d))
    return found.withColumns({c: F.array_join(c, ",") for c in ("names", "flags")}).select(*_DECLARED)


@_query("SELECT 'c' || c_custkey || '.js' AS path, '@shop/' || lower(c_mktsegment) AS dependency FROM customer")
def js_dependencies(spark, d):
    return structure.dependencies(structure.structure(_scripts(spark, d)))


@_query("""SELECT 'n' || c_nationkey || '/o' || o_orderkey || '.go' AS path, 'Add' || o_orderkey AS name, 'Customer' || CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE c_custkey END AS owner, '*Customer' || CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE c_custkey END || '[T]' AS base,
CASE WHEN o_orderkey % 4 <> 0 THEN 'n' || c_nationkey || '/c' || c_custkey || '.go' END AS owner_path, '{ s := "}" + `{` ; return }' AS body FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey > 0""")
def go_receivers(spark, d):
    """Methods in files of orders, with the structs in the files of customers that they belong to; every fourth has none."""
    key, folder = _str("c_custkey"), _joined("n", _str("c_nationkey"), "/")
    customers = t.table(spark, d, "customer").where("c_custkey > 0")
    structs = customers.select(_joined(folder, "c", key, ".go").alias("path"), _joined("package n\n// Customer", key, " buys.\ntype Customer", key, "[T any] struct {\n\ta, B int `json:\"}\"`\n\t*Base\n}\n").alias("content"))
    order = _str("o_orderkey")
    receiver = F.when(F.col("o_orderkey") % 4 == 0, F.lit("0")).otherwise(key)
    methods = t.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(_joined(folder, "o", order, ".go").alias("path"), _joined('package n\nconst g = "a/*.go"\nfunc (c *Customer', receiver, "[T]) Add", order, "(n int) (a, b int) { s := \"}\" + `{` ; return }\nconst h = \"b/*/x\"\n").alias("content"))
    return structure.with_receivers(structure.structure(structure.dealt(structs.unionByName(methods)))).select("path", "name", "owner", "base", "owner_path", "body")


# uses in scripts --------------------------------------------------------------------------------


@_query("""SELECT 's' || o_orderkey || '.py' AS path, kind, owner, name, line FROM orders, (VALUES (0, 'import', 'shop.models', 'User', 1), (0, 'class', 'shop.models', 'User', 2), (0, 'method', 'shop.models.User', 'save', 3), (1, 'method', 'shop.models.User', 'close', 6),
(1, 'class', 'shop.models', 'User', 5), (0, 'method', 'shop.models.User', 'find', 9), (2, 'attribute', 'shop.models.User', 'age', 12)) v(part, kind, owner, name, line) WHERE part = 0 OR part = 1 AND o_orderkey % 2 = 1 OR part = 2 AND o_orderkey % 3 = 0""")
def script_scopes(spark, d):
    """Uses in a script an order: a context in odd ones, another binding of the name in even ones, a parameter's type in every third."""
    odd, third = F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") % 3 == 0
    text = _joined(
        "from shop.models import User\nu = User()\nu.save()\nu = 5\n", F.when(odd, "with User() as u:\n    u.close()\n").otherwise("for u in []:\n    u.close()\n"), "def f(v", F.when(third, ": User").otherwise(""), "):\n    def g():\n        w.find()\n",
        "    u.nothing()\n    g()\n    print(v.age)\nw: User\n",
    )
    scripts = t.table(spark, d, "orders").select(_joined("s", _str("o_orderkey"), ".py").alias("path"), F.replace(text, F.lit("    u.nothing()\n    g()\n"), F.lit("    u = 1\n    u.nothing()\n")).alias("content"))
    return scopes.uses(scripts, t.stored).select("path", "kind", "owner", "name", "line")


_ATTRIBUTE = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE 's' || (l_suppkey % 40) END AS module, CASE WHEN l_partkey % 3 = 0 THEN 'name' WHEN l_partkey % 3 = 1 THEN 'size' ELSE 'gone' END AS symbol FROM lineitem"


@_query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN u.module IS NULL OR m.module IS NULL THEN 'UNCERTAIN' WHEN symbol = 'gone' THEN 'NOT_FOUND' ELSE 'VALID' END AS status, (CASE WHEN u.module IS NULL THEN 0.3 WHEN m.module IS NULL THEN 0.8 WHEN symbol = 'gone' THEN 0.2 ELSE 0.8 END)::DOUBLE AS confidence
FROM ({_ATTRIBUTE}) u LEFT JOIN (SELECT DISTINCT 's' || (s_suppkey % 30) AS module FROM supplier) m ON m.module = u.module""")
def attribute_validation(spark, d):
    """Attribute reads against classes (suppliers by number) with an attribute and a method."""
    third = F.col("l_partkey") % 3
    reads = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, _joined("s", (F.col("l_suppkey") % 40).cast("string"))).alias("module"), F.when(third == 0, "name").when(third == 1, "size").otherwise("gone").alias("symbol"))
    classes = t.table(spark, d, "supplier").select(_joined("s", (F.col("s_suppkey") % 30).cast("string")).alias("module")).distinct()
    symbols = classes.select("module", F.explode(F.array(F.lit("name"), F.lit("size"))).alias("symbol"))
    return c.attributes(reads, classes, symbols).select("l_orderkey", "l_linenumber", "status", "confidence")


# the code graph ---------------------------------------------------------------------------------

# nations are repositories, customers their files, a class a market segment of a file, orders methods that share names
_MODULE = "'n' || c_nationkey || '.c' || c_custkey"
_PATH = "'n' || c_nationkey || '/c' || c_custkey || '.py'"
_IMPORT = "'n' || (c_nationkey + c_custkey % 2) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.c' || (c_custkey - c_custkey % 10) || '.Thing' END"


def _modules(spark, d) -> DataFrame:
    key, nation = F.col("c_custkey"), _str("c_nationkey")
    names = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(_joined(F.col("o_orderstatus"), (F.col("o_orderkey") % 7).cast("string")))).alias("names"))
    own = t.table(spark, d, "customer").join(names, F.col("o_custkey") == key, "left")
    module = _joined("n", nation, ".c", key.cast("string"))
    method = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.array(F.lit("a:int")).alias("params")))
    # twice the same class in a file: the graph holds it once
    one = F.struct(F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("full_name"), method.alias("methods"), F.array(F.struct(F.lit("limit").alias("name"), F.lit("int").alias("type"))).alias("attributes"))
    item = lambda name: F.struct(name.alias("name"))
    target = _joined("n", (F.col("c_nationkey") + key % 2).cast("string"), F.when(key % 3 == 0, "").otherwise(_joined(".c", (key - key % 10).cast("string"), ".Thing")))
    return own.select(
        _joined("repo", nation).alias("repo"), _joined("n", nation, "/c", key.cast("string"), ".py").alias("path"), module.alias("module"), F.array(target, target).alias("imports"), F.array(one, one).alias("classes"),
        F.array(item(_joined("f", (key % 3).cast("string"))), item(F.lit("main"))).alias("functions"), F.array(item(F.lit("I"))).alias("interfaces"), F.when(key % 2 == 0, F.array(item(F.lit("T")))).alias("types"),
    )


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    nations = t.table(spark, d, "nation").select(_joined("repo", _str("n_nationkey")).alias("repo"))
    branches = nations.select("repo", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("at")).select("repo", _joined("b", _str("at")).alias("name"), "at")
    nodes, edges = g.shred(_modules(spark, d), branches, nations.select("repo", _joined(F.col("repo"), "-1").alias("hash")))
    return t.stored(nodes, "nodes"), t.stored(edges, "edges")


_TARGET = f"""SELECT i.path, i.name, coalesce((SELECT min({_PATH}) FROM customer WHERE {_MODULE} = regexp_replace(i.name, '\\.Thing$', '')),
(SELECT arg_min({_PATH}, {_MODULE}) FROM customer WHERE 'n' || c_nationkey = i.name)) AS target FROM (SELECT {_PATH} AS path, {_IMPORT} AS name FROM customer) i"""
_METHOD = f"SELECT DISTINCT c_nationkey, {_MODULE} || '.' || c_mktsegment || '::' || o_orderstatus || (o_orderkey % 7) AS key FROM customer JOIN orders ON o_custkey = c_custkey"
_NODES = f"""SELECT 'Repository' AS label, c_nationkey, 'repo' || c_nationkey AS key FROM (SELECT DISTINCT c_nationkey FROM customer)
UNION ALL SELECT 'File', c_nationkey, {_PATH} FROM customer UNION ALL SELECT 'Class', c_nationkey, {_MODULE} || '.' || c_mktsegment FROM customer UNION ALL SELECT 'Method', c_nationkey, key FROM ({_METHOD})
UNION ALL SELECT 'Attribute', c_nationkey, {_MODULE} || '.' || c_mktsegment || '::limit' FROM customer UNION ALL SELECT 'Function', c_nationkey, {_PATH} || '::f' || (c_custkey % 3) FROM customer UNION ALL SELECT 'Function', c_nationkey, {_PATH} || '::main' FROM customer
UNION ALL SELECT 'Interface', c_nationkey, {_PATH} || '::I' FROM customer UNION ALL SELECT 'Type', c_nationkey, {_PATH} || '::T' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'Branch', n_nationkey, 'repo' || n_nationkey || '::b' || b FROM nation, range(3, 13) r(b) UNION ALL SELECT 'Commit', n_nationkey, 'repo' || n_nationkey || '-1' FROM nation"""


@_query(f"SELECT label, key FROM ({_NODES})")
def graph_nodes(spark, d):
    return _graph(spark, d)[0].select("label", "key")


@_query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE label WHEN 'File' THEN 'CONTAINS' WHEN 'Method' THEN 'HAS_METHOD' WHEN 'Attribute' THEN 'HAS_ATTRIBUTE' WHEN 'Branch' THEN 'HAS_BRANCH' WHEN 'Commit' THEN 'HAS_COMMIT' ELSE 'DEFINES' END AS kind FROM ({_NODES}) WHERE label <> 'Repository'
UNION ALL SELECT 'IMPORTS' FROM (SELECT DISTINCT path, target FROM ({_TARGET}) WHERE target IS NOT NULL)) GROUP BY kind""")
def graph_edges(spark, d):
    return _graph(spark, d)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT label, count_if(c_nationkey % 5 = 2) AS deleted, count_if(c_nationkey % 5 <> 2) AS kept FROM ({_NODES}) GROUP BY label""")
def graph_delete(spark, d):
    """Nodes by label that every fifth repository takes with it, and those that stay."""
    nodes, edges = _graph(spark, d)
    repos = t.table(spark, d, "nation").where("n_nationkey % 5 = 2").select(_joined("repo", _str("n_nationkey")).alias("repo"))
    rest, _, counts = g.delete(nodes, edges, repos)
    kept = rest.groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(counts, "label", "full_outer").select("label", F.coalesce("deleted", F.lit(0)).cast("bigint").alias("deleted"), F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


@_query(f"SELECT 'repo' || c_nationkey AS repo, {_PATH} AS path, {_PATH} || '::' || f AS function FROM customer, (VALUES (0), (1)) v(k), LATERAL (SELECT CASE WHEN k = 0 THEN 'main' ELSE 'f' || (c_custkey % 3) END AS f) x")
def repo_functions(spark, d):
    return g.functions_of(_graph(spark, d)[1])


@_query(f"SELECT DISTINCT path AS file, {_MODULE} AS imports FROM ({_TARGET}) JOIN customer ON {_PATH} = target WHERE contains({_MODULE}, 'n7.')")
def files_importing(spark, d):
    return g.files_importing(*_graph(spark, d), "n7.")


@_query(f"SELECT path, name, target FROM ({_TARGET})")
def import_resolution(spark, d):
    modules = _modules(spark, d)
    return g.resolve_imports(modules.select("path", F.explode("imports").alias("name")), modules.select("path", "module"))


# parts are asked for as they are called, by a module that leads to their brand, and by one that nobody owns
_CLASSES = "SELECT DISTINCT p_type AS name, p_brand || '.t' || (p_size % 3) || '.' || p_type AS full_name, p_brand AS repo FROM part"
_WANTED = "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_brand || '.t' || (p_size % 3) || '.' || p_type WHEN 1 THEN p_brand || '.other.' || p_type ELSE 'nobody.t' || (p_size % 3) || '.' || p_type END AS name FROM part"


@_query(f"""SELECT w.name, coalesce(min(c.full_name), min(i.full_name)) AS full_name FROM ({_WANTED}) w LEFT JOIN ({_CLASSES}) c ON w.name = c.full_name LEFT JOIN ({_CLASSES}) i ON i.repo = string_split(w.name, '.')[1] AND i.name = string_split(w.name, '.')[-1] GROUP BY w.name""")
def class_resolution(spark, d):
    part = t.table(spark, d, "part")
    dotted = lambda *c: F.concat_ws(".", *c, "p_type")
    third = _joined("t", (F.col("p_size") % 3).cast("string"))
    classes = part.select(F.col("p_type").alias("name"), dotted("p_brand", third).alias("full_name"), F.col("p_brand").alias("repo")).distinct()
    key = F.col("p_partkey") % 3
    asked = part.select(F.when(key == 0, dotted("p_brand", third)).when(key == 1, dotted("p_brand", F.lit("other"))).otherwise(dotted(F.lit("nobody"), third)).alias("name"))
    return g.resolve_classes(asked, classes, part.select(F.concat_ws(".", "p_brand", third).alias("module"), F.col("p_brand").alias("repo")).distinct())
