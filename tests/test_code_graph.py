"""The code graph: written once a key, deleted with all it holds, names that end at one file or class whatever the order of rows."""

from __future__ import annotations

from corpusloom.operators import checks
from corpusloom.operators import code_graph as g

_ITEM = "array<struct<name:string>>"
SCHEMA = f"repo string, path string, module string, imports array<string>, classes array<struct<name:string,full_name:string,methods:{_ITEM},attributes:{_ITEM}>>, functions {_ITEM}, interfaces {_ITEM}, types {_ITEM}"


def _modules(spark, turned=False):
    k = lambda name, full=None, methods=(), attributes=(): (name, full, [(m,) for m in methods], [(a,) for a in attributes])
    rows = [
        ("r", "r/a.py", "r.a", ["r.b.X", "s", "none"], [k("A", None, ["m", "m", "n"], ["x"]), k("A", None, ["o"])], [("f",), ("f",)], [], None),
        ("r", "r/b.py", "r.b", None, [k("B", "shared.B", ["go"])], [], [("I",)], [("T",)]),
        ("s", "s/c.py", "s.c", ["r.a"], [k("B", "shared.B", ["go", "stop"])], [("f",)], [], []),
        ("s", "s/d.py", "s.c.d", [], [], [], [], []),
    ]
    return spark.createDataFrame(rows[::-1] if turned else rows, SCHEMA)


def test_write_and_delete(spark):
    branches = spark.createDataFrame([("r", f"b{i}", i) for i in range(13)] + [("s", "main", 1)], "repo string, name string, at int")
    commits = spark.createDataFrame([("r", "h1"), ("s", "h2")], "repo string, hash string")
    nodes, edges = g.shred(_modules(spark), branches, commits)
    rows = {(r["label"], r["key"]) for r in nodes.collect()}
    assert nodes.count() == len(rows)
    assert {k for label, k in rows if label == "Method"} == {"r.a.A::m", "r.a.A::n", "r.a.A::o", "shared.B::go", "shared.B::stop"}
    assert {k for label, k in rows if label in ("Class", "Attribute", "Function", "Interface", "Type")} == {"r.a.A", "shared.B", "r.a.A::x", "r/a.py::f", "s/c.py::f", "r/b.py::I", "r/b.py::T"}
    assert {k for label, k in rows if label == "Branch"} == {f"r::b{i}" for i in range(3, 13)} | {"s::main"}
    imports = {(r["src"], r["dst"]) for r in edges.where("kind = 'IMPORTS'").collect()}
    assert imports == {("r/a.py", "r/b.py"), ("r/a.py", "s/c.py"), ("s/c.py", "r/a.py")}
    assert {tuple(r) for r in g.functions_of(edges).collect()} == {("r", "r/a.py", "r/a.py::f"), ("s", "s/c.py", "s/c.py::f")}
    assert {tuple(r) for r in g.files_importing(nodes, edges, "s.").collect()} == {("r/a.py", "s.c")}
    rest, left, counts = g.delete(nodes, edges, spark.createDataFrame([("r",), ("unknown",)], "repo string"))
    assert {tuple(r) for r in counts.collect()} == {("Repository", 1), ("File", 2), ("Class", 2), ("Method", 5), ("Attribute", 1), ("Function", 1), ("Interface", 1), ("Type", 1), ("Branch", 10), ("Commit", 1)}
    assert {(r["label"], r["key"]) for r in rest.collect()} == {("Repository", "s"), ("File", "s/c.py"), ("File", "s/d.py"), ("Function", "s/c.py::f"), ("Branch", "s::main"), ("Commit", "h2")}
    assert {r["kind"] for r in left.collect()} == {"CONTAINS", "DEFINES", "HAS_BRANCH", "HAS_COMMIT"} and left.count() == 5


def test_order_of_rows_decides_nothing(spark):
    one, two = ({tuple(r) for r in g.shred(_modules(spark, turned))[0].collect()} for turned in (False, True))
    assert one == two
    files = [("p2", "a.b"), ("p1", "a.b"), ("p3", "a.b.c"), ("p4", "z.y.x"), ("p5", "z.y")]
    imports = [("q", n) for n in ("a.b", "a.b.c.D", "a.bc", "a", "z", "a.b.q", "", None, "nothing")]
    for turned in (1, -1):
        found = g.resolve_imports(spark.createDataFrame(imports[::turned], "path string, name string"), spark.createDataFrame(files[::turned], "path string, module string"))
        assert {r["name"]: r["target"] for r in found.collect()} == {"a.b": "p1", "a.b.c.D": "p3", "a.bc": None, "a": "p1", "z": "p5", "a.b.q": "p1", "nothing": None}
        classes = spark.createDataFrame([("A", "r.x.A", "r"), ("A", "r.b.A", "r"), ("C", "s.C", "s")][::turned], "name string, full_name string, repo string")
        modules = spark.createDataFrame([("r.x", "r"), ("r.b", "r"), ("r.z", "s"), ("s.q", "s")][::turned], "module string, repo string")
        asked = spark.createDataFrame([(n,) for n in ("A", "r.x.A", "r.gone.A", "s.t.C", "r.q.C", "u.A", None)], "name string")
        assert {r["name"]: r["full_name"] for r in g.resolve_classes(asked, classes, modules).collect()} == {"A": "r.b.A", "r.x.A": "r.x.A", "r.gone.A": "r.b.A", "s.t.C": "s.C", "r.q.C": None, "u.A": None}


def test_validation_ladders(spark):
    symbols = spark.createDataFrame([("c", "m", ["a:int"]), ("c", "m", ["a:int", "b:int"]), ("c", "st", ["[positional_only] a:int", "b:int"]), ("c", "x", None)], "module string, symbol string, expected array<string>")
    uses = spark.createDataFrame([("c", "m", 2, []), ("c", "m", 1, []), ("c", "m", 3, []), ("c", "st", 2, []), ("c", "st", 1, ["a"]), ("c", "x", 9, ["q"]), ("c", "gone", 0, []), (None, "m", 0, []), ("k", "m", 0, [])], "module string, symbol string, n_args int, kwargs array<string>")
    for own in (symbols, symbols.orderBy("symbol", "expected").repartition(3)):
        got = {(r["module"], r["symbol"], r["n_args"], len(r["kwargs"])): (r["status"], r["confidence"]) for r in checks.methods(uses, symbols, own).collect()}
        assert got == {("c", "m", 2, 0): ("VALID", 0.9), ("c", "m", 1, 0): ("VALID", 0.9), ("c", "m", 3, 0): ("INVALID", 0.8), ("c", "st", 2, 0): ("VALID", 0.9), ("c", "st", 1, 1): ("INVALID", 0.8), ("c", "x", 9, 1): ("VALID", 0.9), ("c", "gone", 0, 0): ("NOT_FOUND", 0.1), (None, "m", 0, 0): ("UNCERTAIN", 0.3), ("k", "m", 0, 0): ("UNCERTAIN", 0.8)}
    reads = {(r["module"], r["symbol"]): (r["status"], r["confidence"]) for r in checks.attributes(uses.select("module", "symbol").distinct(), symbols, symbols).collect()}
    assert reads == {("c", "m"): ("VALID", 0.8), ("c", "st"): ("VALID", 0.8), ("c", "x"): ("VALID", 0.8), ("c", "gone"): ("NOT_FOUND", 0.2), (None, "m"): ("UNCERTAIN", 0.3), ("k", "m"): ("UNCERTAIN", 0.8)}
    classes = spark.createDataFrame([("m", "c", "r")], "name string, full_name string, repo string")
    moved = checks.resolved(uses.where("module = 'c'").limit(1).withColumn("module", checks.F.lit("m")), classes, spark.createDataFrame([], "module string, repo string"))
    assert [r["module"] for r in moved.collect()] == ["c"]


def test_similar_names(spark):
    names = spark.createDataFrame([(n,) for n in ("abcd", "xab", "AB", "forGet", "get_all", "")], "name string")
    asked = spark.createDataFrame([("ab",), ("get",), ("",), ("a",)], "asked string")
    found = lambda case: {(r["asked"], r["name"]) for r in checks.similar_names(asked, names, case=case).collect()}
    assert found(True) == {("ab", "abcd"), ("ab", "xab"), ("get", "get_all"), ("a", "abcd"), ("a", "xab"), ("a", "get_all")}
    assert found(False) == found(True) | {("ab", "AB"), ("get", "forGet"), ("a", "AB")}
