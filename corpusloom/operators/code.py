"""Symbols and uses of source files as rows, and code text from rows of a code graph."""

from __future__ import annotations

import ast
import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import scopes, structure

_SYMBOL = "path string, kind string, owner string, name string, params array<string>, returns string, line int"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_HELD = (ast.ClassDef, *_FUNCTION, ast.Import, ast.ImportFrom)
_BLOCK = (ast.stmt, ast.ExceptHandler, ast.match_case)


def _plain(node: ast.AST) -> str | None:
    """What ast.unparse gives for names, dotted names, whole numbers, None and truth values, and subscripts of such, which it takes long for; null for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant):
        return repr(node.value) if node.value is None or isinstance(node.value, int) else None
    if isinstance(node, ast.Attribute):
        # a number needs a blank before its dot
        own = None if isinstance(node.value, ast.Constant) else _plain(node.value)
        return own and f"{own}.{node.attr}"
    if isinstance(node, ast.Subscript) and not isinstance(node.value, ast.Constant):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) and len(node.slice.elts) > 1 else [node.slice]
        parts = [_plain(node.value), *map(_plain, inner)]
        return None if None in parts else f"{parts[0]}[{', '.join(parts[1:])}]"
    return None


def _text(node: ast.AST) -> str:
    return _plain(node) or ast.unparse(node)


def _type(node: ast.AST | None, otherwise: str = "Any") -> str:
    return _text(node) if node is not None else otherwise


def _default(node: ast.AST) -> str:
    """Plain values as written; a list, a dict or anything else by its brackets or dots alone."""
    if isinstance(node, ast.List | ast.Dict):
        return "[]" if isinstance(node, ast.List) else "{}"
    return _text(node) if isinstance(node, ast.Constant | ast.Name | ast.Attribute) else "..."


def _params(f: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Parameters but self and cls, as operators.checks.parameters reads them."""
    # fixed values: the format `[kind] name:type=default`, and the types and defaults of * and **
    a = f.args
    given = [*a.posonlyargs, *a.args]
    plain = [None] * (len(given) - len(a.defaults)) + list(a.defaults)
    out = [("[positional_only] " if i < len(a.posonlyargs) else "", p.arg, _type(p.annotation), d and _default(d)) for i, (p, d) in enumerate(zip(given, plain, strict=True)) if p.arg not in ("self", "cls")]
    if a.vararg:
        out.append(("[var_positional] ", f"*{a.vararg.arg}", _type(a.vararg.annotation), "None"))
    out += [("[keyword_only] ", p.arg, _type(p.annotation), d and _default(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(("[var_keyword] ", f"**{a.kwarg.arg}", _type(a.kwarg.annotation, "Dict[str, Any]"), "None"))
    return [f"{kind}{name}:{type_}" + (f"={default}" if default else "") for kind, name, type_, default in out]


def _class_attributes(c: ast.ClassDef) -> Iterator[tuple[str, str, int, int]]:
    """(name, type, line, strength) of each place that sets an attribute; fields of a data class are strongest,
    then places with a type, then those of an instance."""
    fields = any(w in ast.unparse(d) for d in c.decorator_list for w in ("dataclass", "attr.", "attrs", "define"))
    for item in c.body:
        if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
            own = fields and "ClassVar" not in ast.unparse(item.annotation)
            yield item.target.id, _type(item.annotation), item.lineno, 4 * fields + 2 + own
        elif isinstance(item, ast.Assign):
            for target in item.targets:
                if isinstance(target, ast.Name) and target.id == "__slots__" and isinstance(item.value, ast.List | ast.Tuple | ast.Set):
                    yield from ((e.value, "Any", item.lineno, 1) for e in item.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str))
                elif isinstance(target, ast.Name):
                    yield target.id, type(item.value.value).__name__ if isinstance(item.value, ast.Constant) else "Any", item.lineno, 0
        elif isinstance(item, _FUNCTION) and any(isinstance(d, ast.Name) and d.id == "property" for d in item.decorator_list):
            yield item.name, _type(item.returns), item.lineno, 1 + 2 * (item.returns is not None)
        elif isinstance(item, _FUNCTION) and item.name == "__init__":
            for node in ast.walk(item):
                typed = isinstance(node, ast.AnnAssign)
                for target in [node.target] if typed else node.targets if isinstance(node, ast.Assign) else []:
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        yield target.attr, _type(node.annotation) if typed else "Any", node.lineno, 1 + 2 * typed


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """All statements, level by level as ast.walk gives them, without their expressions."""
    level: list[ast.AST] = [tree]
    while level:
        yield from level
        level = [x for n in level for f in n._fields for x in (getattr(n, f, None),) if isinstance(x, list) for x in x if isinstance(x, _BLOCK)]


def _symbols(path: str, content: str) -> Iterator[tuple]:
    nodes = [n for n in _statements(ast.parse(content)) if isinstance(n, _HELD)]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    in_class = {id(item) for c in classes for item in c.body}
    public = lambda n: isinstance(n, _FUNCTION) and not n.name.startswith("_")
    for c in classes:
        yield path, "class", "", c.name, [], None, c.lineno
        yield from ((path, "method", c.name, m.name, _params(m), _type(m.returns), m.lineno) for m in c.body if public(m))
        strongest: dict[str, tuple[int, int, str]] = {}
        for name, type_, line, strength in _class_attributes(c):
            if not name.startswith("_"):
                strongest[name] = max(strongest.get(name, (-1, 0, "")), (strength, -line, type_))
        yield from ((path, "attribute", c.name, name, [], type_, -line) for name, (_, line, type_) in strongest.items())
    for n in nodes:
        if public(n) and id(n) not in in_class:
            yield path, "function", "", n.name, _params(n), _type(n.returns), n.lineno
        elif isinstance(n, ast.Import):
            yield from ((path, "import", "", a.name, [], None, n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module:
            yield path, "import", "", n.module, [], None, n.lineno


def _parsed(files: DataFrame, each, schema: str, nothing: tuple) -> DataFrame:
    def rows(path: str, content: str) -> list[tuple]:
        try:
            return list(each(path, content))
        except (SyntaxError, ValueError, RecursionError):
            return [(path, "error", *nothing)]

    return structure.parsed(structure.dealt(files), rows, schema)


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, params, returns, line) of Python files (path, content).

    Kinds: class, method and function (public ones), attribute (the strongest of its places), import, and error
    for a file that can't be parsed. A null content gives nothing. Files are parsed one by one where they lie.
    """
    return _parsed(files, _symbols, _SYMBOL, ("", "", [], None, 0))


def python_uses(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, n_args, kwargs, line): what scripts import, call and read of imported modules, by `scopes.uses`."""
    return scopes.uses(files, stored)


def internal(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports (name) of the project: relative ones, and those that begin with a part of a module's (module) name."""
    head = lambda c: F.split(c, "\\.")[0]
    own = modules.select(head(F.col("module")).alias("_head")).distinct()
    return imports.join(own, (head(F.col("name")) == F.col("_head")), "left").where(F.col("_head").isNotNull() | F.col("name").startswith(".")).drop("_head")


#: Kinds of `structure` that `declarations` counts as one, by language.
_KINDS = {"go": {"type": None, "field": None, "embedded": None, "constant": None, "variable": None}, "javascript": {"enum": "type", "method": None, "field": None, "component": None, "variable": None, "export": None}}


def declarations(files: DataFrame, language: str) -> DataFrame:
    """(path, kind, name) of Go or JavaScript files (path, content), each once; `structure` has members, bodies, exports and comments."""
    ending = F.lit(".go" if language == "go" else ".ts")
    found = structure.structure(files.select(F.concat("path", ending).alias("path"), "content"))
    kind = functools.reduce(lambda c, k: c.when(F.col("kind") == k[0], F.lit(k[1])), _KINDS[language].items(), F.when(F.lit(False), "")).otherwise(F.when((F.col("kind") != "method") | F.col("base").isNotNull(), F.col("kind")))
    own = F.expr(f"left(path, length(path) - {3})")
    return found.select(own.alias("path"), kind.alias("kind"), "name").where("kind IS NOT NULL").distinct()


def class_stub(name: Column, methods: Column, most: int = 5) -> Column:
    """Text of a class from its public methods (name, params_list, return_type), the first `most` of them."""
    public = F.filter(methods, lambda m: F.coalesce((m["name"] != "") & ~m["name"].startswith("_"), F.lit(False)))
    head = lambda m: F.concat(F.lit("    def "), m["name"], F.lit("("), F.coalesce(F.array_join(m["params_list"], ", "), F.lit("")), F.lit(") -> "), F.coalesce(m["return_type"], F.lit("Any")), F.lit(": ...\n"))
    body = F.when(F.size(public) > 0, F.array_join(F.transform(F.slice(public, 1, most), head), "")).otherwise("    pass\n")
    return F.concat(F.lit("class "), name, F.lit(':\n    """Class with the following public methods:"""\n'), body)


def function_stub(name: Column, params_list: Column, returns: Column, what: str = "Function") -> Column:
    """Text of a function or method from its name, parameters and type."""
    return F.concat(F.lit("def "), name, F.lit("("), F.coalesce(F.array_join(params_list, ", "), F.lit("")), F.lit(") -> "), F.coalesce(returns, F.lit("Any")), F.lit(f':\n    """{what} implementation"""\n    pass'))
