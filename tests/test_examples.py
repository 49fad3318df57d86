"""Texts of code examples, letter by letter."""

from __future__ import annotations

from corpusloom.operators import examples as ex

_SCHEMA = "language string, code_type string, name string, module string, parent_name string, signature string, documentation string, visibility string, is_async boolean, is_static boolean, children array<string>, parameters array<string>, return_type string, receiver string, value string, extra map<string,string>"


def _rows(spark, *rows):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _SCHEMA)
    return table.select(*ex.contexts()).collect()


def test_signatures_and_uses(spark):
    cases = [
        ({"language": "Python", "code_type": "class", "name": "A"}, "class A:", "# Usage:\ninstance = A()\n# Access methods: instance.method_name()"),
        ({"language": "Python", "code_type": "function", "name": "f", "parameters": ["a", "b: int"], "return_type": "%n"}, "def f(a, b: int) -> %n:", "# Usage:\nresult = f(arg0, arg1)"),
        ({"language": "Python", "code_type": "method", "name": "m"}, "def m():", "# Usage:\ninstance.m(args)"),
        ({"language": "Python", "code_type": "variable", "name": "v"}, "v: Any", "# Usage: v"),
        ({"language": "JavaScript", "code_type": "function", "name": "f", "parameters": ["a"], "return_type": "x", "is_async": True}, "async function f(a) {", "// Usage:\nconst result = f(args);"),
        ({"language": "JavaScript", "code_type": "interface", "name": "I"}, "const I = undefined", "// Usage: I"),
        ({"language": "TypeScript", "code_type": "function", "name": "f", "return_type": "string"}, "function f(): string {", "// Usage:\nconst result = f(args);"),
        ({"language": "TypeScript", "code_type": "interface", "name": "I"}, "interface I {", "// Usage:\nconst obj: I = { /* implement interface */ };"),
        ({"language": "TypeScript", "code_type": "type", "name": "T"}, "type T = any", "// Usage: T"),
        ({"language": "Go", "code_type": "method", "name": "M", "receiver": "s *S", "parameters": ["a int"], "return_type": "error"}, "func (s *S) M(a int) error {", "// Usage:\ninstance.M(args)"),
        ({"language": "Go", "code_type": "struct", "name": "S"}, "type S struct {", "// Usage:\ninstance := S{}\n// Access fields: instance.FieldName"),
        ({"language": "Go", "code_type": "variable", "name": "v"}, "var v interface{}", "// Usage: v"),
        ({"language": "Rust", "code_type": "struct", "name": "S"}, "Rust struct S", "Usage example for Rust struct S"),
        ({"language": "Go", "code_type": "function", "name": "f", "signature": "func f()"}, "Go function f: func f()", "// Usage:\nresult := f(args)"),
    ]
    found = _rows(spark, *[c[0] for c in cases])
    assert [(r["signature_context"], r["usage_context"]) for r in found] == [c[1:] for c in cases]


def test_semantic_and_full(spark):
    row = {"language": "Python", "code_type": "class", "name": "A", "module": "m", "parent_name": "P", "signature": "class A", "documentation": "Does.", "visibility": "public", "is_static": True, "children": list("abcdef"), "extra": {"z": "1", "b": "2, 3"}}
    got, bare = _rows(spark, row, {"language": "Go", "code_type": "struct", "name": "S"})
    assert got["semantic_context"] == "Python class 'A' in P from m\nDescription: Does.\nContains: a, b, c, d, e"
    assert got["full_context"] == "Python class A in P from m\nSignature: class A\nDocumentation: Does.\nProperties: visibility: public, static\nContains: a, b, c, d, e, f\nLanguage-specific: b: 2, 3; z: 1"
    assert (bare["semantic_context"], bare["full_context"]) == ("Go struct 'S' from module", "Go struct S from ")


def test_records(spark):
    classes = spark.createDataFrame([("r", "a.py", "m", "A", "m.A", [("go", ["self"], None), ("_hidden", [], None), (None, None, None)]), ("r", "a.py", None, None, None, None), ("r", "a.py", None, "B", "B", None)], "repo string, path string, module string, name string, full_name string, methods array<struct<name:string,params_list:array<string>,return_type:string>>")
    functions = spark.createDataFrame([("r", "b.py", "", "f", None, "int"), ("r", "b.py", "x", "_g", [], None), ("r", "b.py", "x", None, [], None)], "repo string, path string, module string, name string, params_list array<string>, return_type string")
    rows = {r["full_name"]: r for r in ex.examples(classes, functions).withColumn("text", ex.embedding_text()).collect()}
    assert set(rows) == {"m.A", "m.A.go", "B", "f"}
    assert (rows["m.A"]["method_count"], rows["B"]["method_count"], rows["m.A.go"]["class_name"]) == (2, 0, "A")
    assert rows["m.A.go"]["text"] == 'Python method go in class A from m\nParameters: self\nCode: def go(self) -> Any:\n    """Method implementation"""\n    pass'
    assert rows["f"]["text"] == 'Python function f from \nReturns: int\nCode: def f() -> int:\n    """Function implementation"""\n    pass'
    assert rows["B"]["text"].startswith("Python class B in \nFull name: B\nCode: class B:")
