"""Literal sources and their symbols, uses and declarations."""

from __future__ import annotations

import ast

from corpusloom.operators import code as k

PY = '''
import os.path, app.core
from app.models import User as U
@dataclass
class A(Base):
    x: int = 1
    limit: ClassVar[int] = 3
    _hidden = 1
    x = 2
    def __init__(self, size):
        self.size: float = size
        self.name = size
    @property
    def area(self) -> float: ...
    async def run(self, a, b: str = "t", *args: int, key, other=[], **kw): ...
    def _own(self): ...
def f(x: List[int] = None, y=g(1)) -> None: ...
'''


def _files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def test_python_symbols(spark):
    rows = k.python_symbols(_files(spark, PY, "def broken(:", None, "")).collect()
    got = {(r["path"], r["kind"], r["owner"], r["name"]): (r["params"], r["returns"]) for r in rows}
    assert len(rows) == len(got)
    assert {key[3] for key in got if key[1] == "import"} == {"os.path", "app.core", "app.models"}
    assert got["f0", "method", "A", "run"][0] == ["a:Any", "b:str='t'", "[var_positional] *args:int=None", "[keyword_only] key:Any", "[keyword_only] other:Any=[]", "[var_keyword] **kw:Dict[str, Any]=None"]
    assert got["f0", "function", "", "f"] == (["x:List[int]=None", "y:Any=..."], "None")
    assert {key[3]: v[1] for key, v in got.items() if key[1] == "attribute"} == {"x": "int", "limit": "ClassVar[int]", "size": "float", "name": "Any", "area": "float"}
    assert {key for key in got if key[0] != "f0"} == {("f1", "error", "", "")}
    assert not any(key[3].startswith("_") for key in got)


def test_python_uses(spark):
    script = "import app.db as db\nfrom app.models import User\nu = User(1, name='x')\nu.save(*rows, force=True)\nprint(u.age)\ndb.connect('a')\nUser.load(3)\n"
    rows = k.python_uses(_files(spark, script, "x ===")).collect()
    got = {(r["kind"], r["owner"], r["name"], r["n_args"], tuple(r["kwargs"]), r["line"]) for r in rows if r["path"] == "f0"}
    assert got == {
        ("import", "app.db", "", 0, (), 1), ("import", "app.models", "User", 0, (), 2), ("class", "app.models", "User", 1, ("name",), 3),
        ("method", "app.models.User", "save", 0, ("force",), 4), ("attribute", "app.models.User", "age", 0, (), 5), ("function", "app.db", "connect", 1, (), 6), ("method", "app.models.User", "load", 1, (), 7),
    }
    assert [r["kind"] for r in rows if r["path"] == "f1"] == ["error"]


def test_internal(spark):
    names = spark.createDataFrame([("app.core",), ("os",), (".near",), ("apple",)], "name string")
    modules = spark.createDataFrame([("app.models",), ("app.db",)], "module string")
    assert sorted(r["name"] for r in k.internal(names, modules).collect()) == [".near", "app.core"]


def test_declarations(spark):
    go = 'package shop\nimport "fmt"\nimport (\n\t"net/http"\n\tx "a/b"\n)\n// type Gone struct {\ntype Cart struct {\n\tn int\n}\ntype Buyer interface { Pay() }\nfunc New(n int) *Cart { return nil }\nfunc (c *Cart) Add(n int) {}\n/* func No() {} */\n'
    js = "import a, {b} from 'left';\nimport './side';\nconst c = require(\"com\");\nexport default class Shop extends B {}\nexport async function buy(x) {}\nconst pay = async (x, y) => x;\nlet one = x => x;\n// class No {}\ninterface I { a: string }\nexport type T = string;\nenum E { A }\nconst url = 'http://x';\n"
    found = lambda text, language: {(r["kind"], r["name"]) for r in k.declarations(_files(spark, text, None, ""), language).collect()}
    assert found(go, "go") == {("package", "shop"), ("import", "fmt"), ("import", "net/http"), ("import", "a/b"), ("struct", "Cart"), ("interface", "Buyer"), ("function", "New"), ("method", "Add")}
    assert found(js, "javascript") == {("import", "left"), ("import", "./side"), ("import", "com"), ("class", "Shop"), ("function", "buy"), ("arrow", "pay"), ("arrow", "one"), ("interface", "I"), ("type", "T"), ("type", "E")}


def test_plain_types_are_as_unparsed():
    for text in ("int", "a.b.C", "Dict[str, int]", "a.B[C[int], None]", "x[()]", "x[1]", "x[1,]", "x[a:b]", "Literal['a']", "x[*a, b]", "int | None", "(1).real", "-1", "1.5", "...", "True", "f(x)", "'a'", "list[Callable[[int], str]]", "(a if b else c).d", "[1][0]"):
        node = ast.parse(text, mode="eval").body
        assert k._text(node) == ast.unparse(node) and k._plain(node) in (None, ast.unparse(node))
    assert k._plain(ast.parse("Dict[str, a.B]", mode="eval").body) == "Dict[str, a.B]" and k._plain(ast.parse("f(x)", mode="eval").body) is None


def test_files_are_dealt_out_before_they_are_parsed(spark):
    files = spark.createDataFrame([(f"f{i}", f"class A{i}:\n    def m(self): ...\n") for i in range(100)], "path string, content string").coalesce(1)
    assert k.python_symbols(files).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert k.python_symbols(files).where("kind = 'method'").count() == 100


def test_scripts_are_held_against_symbols_that_are_parsed_once(spark, sf_dir, monkeypatch):
    from corpusloom.plans import catalog

    assert "script_validation" in catalog.queries()
    from corpusloom.plans import services

    written = []
    monkeypatch.setattr(services.t, "stored", lambda df, name, own=services.t.stored: written.append(name) or own(df, name))
    rows = services.script_validation(spark, sf_dir).groupBy("status").count().collect()
    assert written == ["symbols"] and {r["status"] for r in rows} == {"VALID", "INVALID", "NOT_FOUND"}
