"""Literal JavaScript, TypeScript and Go sources, and the lexer's brackets."""

from __future__ import annotations

import pyarrow as pa

from corpusloom.operators import structure
from corpusloom.operators.lexing import lex

JS = '''import a, {b as c, d} from 'left';
import * as ns from "ns"; import type {T1} from './t'; import './side';
const { x: y, z = 1 } = require("com");
const lazy = await import('@scope/pkg/sub');
/**
 * The shop.
 * @class
 */
export default class Shop extends Base.Inner<T> implements I {
  static #count = 0; name: string = "a{b";
  tags = ['}'];
  @dec({a: 1}) size?: number
  constructor(a, b = {x: 1}) { super(); this.f = () => { class Inner { go() {} } } }
  /** pays */
  async pay(x: number): Promise<{ok: boolean}> { if (x) { return /}/.test(`${x ? `}` : "{"}`); } }
  get total() { return 1 }
  static *gen() { yield 1 }
  handler = async (e) => { while (true) {} };
  abstract over(a: string): void;
}
export async function buy(x) { const inner = 1; function deep() {} }
const pay = async (x, y) => x;
let one = x => x, two = 2;
export const Card: React.FC<P> = ({a}) => (<div/>);
// class No {}
const a1 = "a/*.ts"; class Foo {}
const b1 = "lib/**/*.ts"; class Bar {}
interface I extends A, B { a: string }
export type T = string;
const enum E { A }
export * from 'all'; export { m as n, o } from './mod'; export { p };
module.exports = { one, two: 2 };
export default pay;
for (const k of ks) { var [i, j] = k; }
'''

GO = '''// Package shop sells.
package shop
import "fmt"
import (
	"net/http"
	x "github.com/o/r/sub" // c
	"gopkg.in/yaml"
)
// Cart holds.
// More.
type Cart[T any] struct {
	n, M int `json:"}"`
	Items map[string][]T
	*Base
	sync.Mutex
}
type Buyer interface {
	Pay(a int) error
	fmt.Stringer
}
type (
	ID int
	alias = string
)
func New(n int) *Cart { return &Cart{n: 1} }
func (c *Cart[T]) Add(n int) (a, b int) { s := "}" ; return }
/* func No() {} */
const g = "a/*.go"
func Lost() {}
const h = "b/*/x"
const (
	A = iota
	b
)
var e1, e2 = f(1,
  2), 3
func (Cart) val() map[string]int { var q int; return nil }
'''


def _rows(spark, path, content):
    found = structure.structure(spark.createDataFrame([(path, content), ("x.py", "class A: pass"), (None, "x"), ("y.go", None), ("z.js", "")], "path string, content string"))
    return found.collect()


def test_javascript(spark):
    rows = _rows(spark, "src/a.ts", JS)
    assert {r.language for r in rows} == {"TypeScript"} and {r.path for r in rows} == {"src/a.ts"}
    of = lambda kind: [r for r in rows if r.kind == kind]
    assert {(r.name, r.owner, r.base) for r in of("class")} == {("Shop", "", "Base.Inner"), ("Inner", "constructor", None), ("Foo", "", None), ("Bar", "", None)}
    assert [(r.name, r.owner, tuple(r.flags)) for r in of("method")] == [("constructor", "Shop", ()), ("go", "Inner", ()), ("pay", "Shop", ("async",)), ("total", "Shop", ("get",)), ("gen", "Shop", ("static", "generator")), ("over", "Shop", ("abstract",))]
    assert {(r.name, r.base) for r in of("field")} == {("#count", None), ("name", "string"), ("tags", None), ("size", "number"), ("handler", None)}
    shop = next(r for r in rows if r.kind == "class" and r.name == "Shop")
    assert shop.doc == "The shop.\n@class" and shop.line == 9 and shop.exported and shop.body.startswith("{\n  static #count") and shop.body.endswith("void;\n}")
    pay = next(r for r in of("method") if r.name == "pay")
    assert pay.doc == "pays" and pay.body == '{ if (x) { return /}/.test(`${x ? `}` : "{"}`); } }'
    assert [(r.name, r.names, r.flags) for r in of("import")] == [("left", ["a", "c", "d"], ["es6"]), ("ns", ["ns"], ["es6"]), ("./t", ["T1"], ["es6"]), ("./side", [], ["es6"]), ("com", ["y", "z"], ["commonjs"]), ("@scope/pkg/sub", [], ["dynamic"])]
    assert {(r.name, r.base, r.flags[0]) for r in of("export")} == {("Shop", None, "default"), ("buy", None, "named"), ("Card", None, "named"), ("T", None, "named"), ("*", "all", "all"), ("n", "./mod", "named"), ("o", "./mod", "named"), ("p", None, "named"), ("one", None, "commonjs"), ("two", None, "commonjs"), ("pay", None, "default")}
    assert {(r.name, r.owner, tuple(r.flags)) for r in of("function")} == {("buy", "", ("async",)), ("deep", "buy", ())}
    assert {r.name for r in of("arrow")} == {"pay", "one", "Card"} and {r.name for r in of("component")} == {"Card"}
    assert {(r.kind, r.name, r.base) for r in rows if r.kind in ("interface", "type", "enum")} == {("interface", "I", "A, B"), ("type", "T", None), ("enum", "E", None)}
    assert {r.name for r in of("variable")} == {"y", "z", "lazy", "inner", "pay", "one", "two", "Card", "a1", "b1", "i", "j"}


def test_go(spark):
    rows = _rows(spark, "pkg/a.go", GO)
    found = {(r.kind, r.name, r.owner, r.base, r.exported) for r in rows}
    assert found == {
        ("package", "shop", "", None, False), ("import", "fmt", "", None, False), ("import", "net/http", "", None, False), ("import", "github.com/o/r/sub", "", None, False), ("import", "gopkg.in/yaml", "", None, False),
        ("struct", "Cart", "", None, True), ("field", "n", "Cart", "int", False), ("field", "M", "Cart", "int", True), ("field", "Items", "Cart", "map[string][]T", True), ("embedded", "Base", "Cart", "*Base", True), ("embedded", "Mutex", "Cart", "sync.Mutex", True),
        ("interface", "Buyer", "", None, True), ("method", "Pay", "Buyer", None, True), ("embedded", "Stringer", "Buyer", "fmt.Stringer", True), ("type", "ID", "", "int", True), ("type", "alias", "", "string", False),
        ("function", "New", "", None, True), ("method", "Add", "", "*Cart[T]", True), ("function", "Lost", "", None, True), ("method", "val", "", "Cart", False),
        ("constant", "g", "", None, False), ("constant", "h", "", None, False), ("constant", "A", "", None, True), ("constant", "b", "", None, False), ("variable", "e1", "", None, False), ("variable", "e2", "", None, False), ("variable", "q", "val", "int", False),
    }
    by = {r.name: r for r in rows}
    assert by["Cart"].doc == "Cart holds.\nMore." and by["shop"].doc == "Package shop sells." and by["sub" if "sub" in by else "github.com/o/r/sub"].names == ["x"]
    assert by["Add"].body == '{ s := "}" ; return }' and by["Add"].names == ["c"]


def test_packages_join_over_files(spark):
    files = [("p/a.go", "type A struct {}"), ("p/b.go", "func (a *A) M() {}\nfunc (z Z) N() {}"), ("q/c.go", "func (a A) O() {}"), ("p/d.js", "import '@s/x/y'; import './z'; import 'r/t'"), ("p/e.go", GO)]
    found = structure.structure(spark.createDataFrame(files, "path string, content string"))
    assert {(r["name"], r["owner"], r["owner_path"]) for r in structure.with_receivers(found).collect()} == {("M", "A", "p/a.go"), ("N", "Z", None), ("O", "A", None), ("Add", "Cart", "p/e.go"), ("val", "Cart", "p/e.go")}
    assert {tuple(r) for r in structure.dependencies(found).collect()} == {("p/d.js", "@s/x"), ("p/d.js", "r"), ("p/e.go", "github.com/o/r"), ("p/e.go", "gopkg.in")}
    assert {r["name"] for r in structure.go_exports(found).where("path = 'p/e.go'").collect()} == {"Cart", "Buyer", "ID", "New", "Add", "Lost"}


def test_odd_texts_end():
    for text in ("{", "}", "`${", "`a${b}`}", "class", "class {", "/", "'", "/*", "import", "export", "const", "const {", "function (", "type (", "func (", "x = /[/", "a" * 10_000, "{" * 3000):
        for path in ("a.js", "a.go"):
            structure.declared(path, text)
    s = lex("a{b(c)}d", "javascript")
    assert s.partner == {1: 6, 6: 1, 3: 5, 5: 3} and s.brace == [-1, -1, 1, 1, 1, 1, -1, -1]


def test_rows_of_few_files_are_held_at_a_time(monkeypatch):
    # batches as a worker sends them back, of one batch of many files
    class Files:
        where = select = lambda self, *a: self
        mapInArrow = lambda self, run, schema: run(iter(self.batches))
        mapInPandas = lambda self, run, schema: run(b.to_pandas() for b in self.batches)

    files = Files()
    files.batches = [pa.RecordBatch.from_pylist([{"path": f"c{i}.js", "content": f"class C{i} {{ {'go() {} ' * 40}}}"} for i in range(3000)])]
    taken = [len(b) for b in structure.structure(files)]
    assert sum(taken) == 3000 * 41 and max(taken) < 3000 * 41 // 3
    monkeypatch.setattr(structure, "HELD", 1)
    assert [len(b) for b in structure.structure(files)] == [41] * 3000


def test_receivers_read_files_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(structure, "stored", lambda df, name, own=structure.stored: written.append(name) or own(df, name))
    files = spark.createDataFrame([(f"p/f{i}.go", f"package p\ntype T{i} struct {{}}\nfunc (t *T{i}) M() {{}}\nfunc (t U) N() {{}}\n") for i in range(50)], "path string, content string").coalesce(1)
    out = structure.with_receivers(structure.structure(structure.dealt(files)))
    assert written == ["receivers"] and "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["name"], r["owner"], r["owner_path"]) for r in out.collect()} == {x for i in range(50) for x in ((f"p/f{i}.go", "M", f"T{i}", f"p/f{i}.go"), (f"p/f{i}.go", "N", "U", None))}


def test_go_tokens_are_told_apart_with_lines_and_brackets():
    s = lex("a := `x\n}` // c\n\n/* d\n */ ) {[}] <-é '}' £", "go")
    assert s.text == ["a", ":=", "`x\n}`", ")", "{", "[", "}", "]", "<-", "é", "'}'", "£"]
    assert s.kind == ["name", "sign", "string", "sign", "sign", "sign", "sign", "sign", "sign", "name", "string", "sign"]
    assert s.line == [1, 1, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5] and s.partner == {5: 7, 7: 5} and s.brace[4:] == [-1] + [4] * 7
    assert s.comments == {3: [("// c", 2, 2), ("/* d\n */", 4, 5)]}
