"""Uses of imported modules in Python scripts, by scopes and the last binding before each use.

Scripts of equal content use the same, so each content is parsed and resolved once, and its uses go to all its paths. A content
is parsed into events: bindings of names, and uses of dotted names, each with the scopes it can see; names that no import leads to are left out.
Which binding holds at a use is then found for all scripts at once: bindings and uses of a name in a scope are
ordered by place, and a running last value gives the binding before each use; the innermost scope that binds the
name decides. What a name is bound to may itself be a name, so this runs in ROUNDS: imports first, then
what they make. A name that is bound to something unknown gives no use, until it is bound anew.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import structure

#: Instances of instances: `a = X()` is one round, `with a as b` one more.
ROUNDS = 3
#: Events of all contents whose uses are broadcast to the paths.
SENT = 20_000
#: Parts of names that are taken for classes although they begin with a small letter.
CLASS_PARTS = ("Model", "Provider", "Client", "Agent", "Manager", "Handler", "Builder", "Factory", "Service", "Controller", "Processor")
EVENTS = "path string, id bigint, event string, scope int, scopes array<int>, name string, rest string, at bigint, line int, kind string, n_args int, kwargs array<string>, target string"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_PLACE = 1 << 20


class _Reader(ast.NodeVisitor):
    """Events of one script, in one walk."""

    def __init__(self, path: str):
        self.path, self.rows, self.scopes, self.n, self.lines = path, [], [0], 0, 0

    def row(self, event: str, name: str, rest: str, node, kind: str, scope: int | None = None, n_args: int = 0, kwargs=(), target: str | None = None, end: bool = False) -> None:
        # a binding holds behind its statement, so what the statement reads comes before it
        line, col = (node.end_lineno, node.end_col_offset) if end else (node.lineno, node.col_offset)
        own = self.scopes[-1] if scope is None else scope
        self.rows.append((self.path, len(self.rows), event, own, self.scopes[::-1], name, rest, line * _PLACE + min(col, _PLACE - 1), node.lineno, kind, n_args, list(kwargs), target))

    def known(self) -> list[tuple]:
        """The events but uses and bindings of names that no import leads to, whatever the scopes: those come to nothing."""
        live = {r[5] for r in self.rows if r[9] == "module"}
        # a name that is made of a live one is live
        while more := {r[5] for r in self.rows if r[2] == "bind" and r[12] in live} - live:
            live |= more
        return [r for r in self.rows if r[2] == "import" or r[5] in live]

    def generic_visit(self, node) -> None:
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.AST):
                        self.visit(x)
            elif isinstance(value, ast.AST):
                self.visit(value)

    def _nothing(self, node) -> None:
        """A name, a plain value or a mark holds no event of its own."""

    visit_Name = visit_Constant = visit_Load = visit_Store = visit_Del = _nothing

    @staticmethod
    def dotted(node) -> tuple[str, str] | None:
        """(first name, the rest) of a dotted name, with `()` behind each part that is called."""
        parts = []
        while True:
            if isinstance(node, ast.Call):
                parts.append("()")
                node = node.func
            elif isinstance(node, ast.Attribute):
                parts.append(f".{node.attr}")
                node = node.value
            elif isinstance(node, ast.Await):
                node = node.value
            else:
                break
        return (node.id, "".join(reversed(parts))) if isinstance(node, ast.Name) else None

    def bind(self, target, value, end, kind: str = "value") -> None:
        if isinstance(target, ast.Name):
            found = self.dotted(value) if value is not None else None
            name, rest = found or ("", "")
            self.row("bind", target.id, rest, end, kind, target=name, end=True)
        elif isinstance(target, ast.Tuple | ast.List):
            values = value.elts if isinstance(value, ast.Tuple | ast.List) and len(value.elts) == len(target.elts) else [None] * len(target.elts)
            for t, v in zip(target.elts, values, strict=True):
                self.bind(t, v, end)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, None, end)

    def visit_Import(self, node) -> None:
        for a in node.names:
            head = a.name.split(".")[0]
            self.row("import", a.name, "", node, "import", target="")
            self.row("bind", a.asname or head, "", node, "module", target=a.name if a.asname else head, end=True)

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.row("import", module, "", node, "import", target=a.name)
            self.row("bind", a.asname or a.name, "", node, "module", target=module + ("" if module.endswith(".") else ".") + a.name, end=True)

    def visit_Assign(self, node) -> None:
        self.visit(node.value)
        for target in node.targets:
            self.bind(target, node.value, node)
            self.inner(target)

    def visit_AnnAssign(self, node) -> None:
        if node.value is not None:
            self.visit(node.value)
        if isinstance(node.target, ast.Name):
            call = isinstance(node.value, ast.Call)
            self.bind(node.target, node.value if call else node.annotation, node, "value" if call else "annotation")
        self.inner(node.target)

    def visit_AugAssign(self, node) -> None:
        self.visit(node.value)
        self.bind(node.target, None, node)
        self.inner(node.target)

    def visit_NamedExpr(self, node) -> None:
        self.visit(node.value)
        self.bind(node.target, node.value, node)

    def inner(self, target) -> None:
        """What a target itself reads: `a.b = 1` reads a."""
        if isinstance(target, ast.Attribute | ast.Subscript):
            self.visit(target)
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self.inner(t)

    def _for(self, node) -> None:
        self.visit(node.iter)
        self.bind(node.target, None, node.iter)
        for x in node.body + node.orelse:
            self.visit(x)

    visit_For = visit_AsyncFor = _for

    def _with(self, node) -> None:
        for item in node.items:
            self.visit(item.context_expr)
            if item.optional_vars is not None:
                self.bind(item.optional_vars, item.context_expr, item.context_expr, "context")
        for x in node.body:
            self.visit(x)

    visit_With = visit_AsyncWith = _with

    def visit_ExceptHandler(self, node) -> None:
        if node.type is not None:
            self.visit(node.type)
        if node.name:
            self.row("bind", node.name, "", node.type or node, "value", target="", end=node.type is not None)
        for x in node.body:
            self.visit(x)

    def visit_Delete(self, node) -> None:
        for t in node.targets:
            self.bind(t, None, node)

    def _function(self, node) -> None:
        a = node.args
        named = not isinstance(node, ast.Lambda)
        for x in [*(node.decorator_list if named else []), *a.defaults, *(d for d in a.kw_defaults if d is not None)]:
            self.visit(x)
        params = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        for p in params:
            if p.annotation is not None:
                self.visit(p.annotation)
        if named:
            self.row("bind", node.name, "", node, "value", target="")
        self.n += 1
        # names of a class body are not seen by what the class holds
        before = self.scopes
        self.scopes = [s for s in before if s >= 0] + [self.n]
        for p in params:
            found = self.dotted(p.annotation) if p.annotation is not None else None
            name, rest = found or ("", "")
            self.row("bind", p.arg, rest, p, "annotation", target=name)
        for x in node.body if named else [node.body]:
            self.visit(x)
        self.scopes = before

    visit_FunctionDef = visit_AsyncFunctionDef = visit_Lambda = _function

    def visit_ClassDef(self, node) -> None:
        for x in [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]:
            self.visit(x)
        self.row("bind", node.name, "", node, "value", target="")
        self.n += 1
        before = self.scopes
        self.scopes = [*before, -self.n]
        for x in node.body:
            self.visit(x)
        self.scopes = before

    def visit_Call(self, node) -> None:
        found = self.dotted(node.func)
        if found:
            self.row("use", *found, node, "call", n_args=sum(not isinstance(a, ast.Starred) for a in node.args), kwargs=[k.arg for k in node.keywords if k.arg])
            # what a call is made of: calls within its own name, not attributes that only lead to it
            inner = node.func
            while isinstance(inner, ast.Attribute | ast.Await):
                inner = inner.value
            if isinstance(inner, ast.Call):
                self.visit(inner)
        else:
            self.visit(node.func)
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(x)

    def visit_Attribute(self, node) -> None:
        found = self.dotted(node)
        if found:
            self.row("use", *found, node, "read")
            inner = node.value
            while isinstance(inner, ast.Attribute | ast.Await):
                inner = inner.value
            if isinstance(inner, ast.Call):
                self.visit(inner)
        else:
            self.visit(node.value)


def events(scripts: DataFrame) -> DataFrame:
    """Bindings and uses of all scripts (path, content); one `error` for a script that can't be parsed; a null content gives nothing."""

    def rows(path: str, content: str) -> list[tuple]:
        reader = _Reader(path)
        try:
            reader.visit(ast.parse(content))
            return reader.known()
        except (SyntaxError, ValueError, RecursionError):
            return [(path, 0, "error", 0, [], "", "", 0, 0, "error", 0, [], None)]

    return structure.parsed(structure.dealt(scripts.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content")), rows, EVENTS)


def is_class(full: Column) -> Column:
    """Whether a dotted name is taken for a class: a capital last part, or one of CLASS_PARTS in it."""
    last = F.element_at(F.split(full, "\\."), -1)
    return last.rlike("^_*[A-Z]") | full.rlike("|".join(CLASS_PARTS))


def made(full: Column) -> Column:
    """What a dotted name with calls stands for: `m.X()` and `m.X().__enter__()` are instances of m.X; another call's result is unknown."""
    bare = F.regexp_replace(full, r"\(\)$", "")
    return F.when(~full.contains("()"), full).when(~bare.contains("()") & is_class(bare), F.concat(bare, F.lit("()")))


def _resolved(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """`asked` (path, id, scopes, name, at and others) with `full`: what the name is bound to where it is read; null if unknown.

    bindings: path, scope, name, at, full (null: bound to something unknown). Ids are told apart within a path. Rows are dealt by their
    path once, which the windows and the grouping share, and what is asked travels along, so nothing is joined back.
    """
    others = [c for c in asked.columns if c not in ("path", "id", "name", "at")]
    rest = F.struct(*others)
    # what is read in no scope is a row of its own, too
    scopes = F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.array(F.lit(None).cast("int")))
    seen = asked.select("path", "id", "name", "at", rest.alias("rest"), F.posexplode(scopes).alias("depth", "scope"))
    seen = seen.select("*", F.lit(None).cast("struct<full:string>").alias("bound"), F.lit(1).alias("reads"))
    # a struct around what is bound tells an unknown value from no binding
    bound = bindings.select("path", F.lit(None).cast("bigint").alias("id"), "name", "at", F.lit(None).cast(seen.schema["rest"].dataType).alias("rest"), F.lit(None).cast("int").alias("depth"), "scope", F.struct(F.col("full").cast("string").alias("full")).alias("bound"), F.lit(0).alias("reads"))
    order = Window.partitionBy("path", "scope", "name").orderBy("at", "reads")
    before = F.last("bound", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a function may read what its surroundings bind later: as nothing is bound before, that is the first of all
    after = F.first("bound", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = seen.unionByName(bound).repartition("path").withColumn("hit", F.coalesce(before, F.when(F.col("depth") > 0, after))).where("reads = 1")
    first = found.groupBy("path", "id").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("depth"))).alias("hit"), F.collect_list(F.when(F.col("depth") == 0, F.struct("name", "at", "rest"))).alias("every"))
    # repeated rows stay repeated
    return first.select("path", "id", "hit", F.explode("every").alias("own")).select("path", "id", "own.name", "own.at", "own.rest.*", F.col("hit.full").alias("full"))


def bindings(all_events: DataFrame) -> DataFrame:
    """(path, scope, name, at, full): what each binding makes of its name, after ROUNDS. What a round asks travels along, so nothing is joined back."""
    bound = all_events.where("event = 'bind'")
    module = F.col("kind") == "module"
    # a dotted name of a module, or nothing that is known yet
    known = bound.select("path", "scope", "name", "at", F.when(module, F.col("target")).alias("full"))
    plain = bound.where(module | (F.col("target") == "")).select("path", "scope", "name", "at", F.when(module, F.col("target")).alias("full"))
    own = F.struct("scope", "name", "kind", "rest").alias("own")
    asked = bound.where(~module & (F.col("target") != "")).select("path", "id", "scopes", F.col("target").alias("name"), "at", own)
    for _ in range(ROUNDS - 1):
        root = F.concat("full", "own.rest")
        # an annotation and a call name a class; a context gives what it is entered with
        value = F.when(F.col("own.kind") == "annotation", F.when(is_class(F.col("full")) | is_class(root), F.concat(root, F.lit("()")))).otherwise(made(root))
        known = plain.unionByName(_resolved(asked, known).select("path", "own.scope", "own.name", "at", value.alias("full")))
    return known


def _of_contents(contents: DataFrame, work) -> tuple[DataFrame, bool]:
    """What contents (path, content) import, call and read, and whether that is little enough to be broadcast."""
    found = work(events(contents), "events")
    asked = found.where("event = 'use'").select("path", "id", "scopes", "name", "rest", "at", "line", "kind", "n_args", "kwargs")
    full = F.concat("full", "rest")
    known = _resolved(asked, bindings(found)).where("full IS NOT NULL").withColumn("whole", full)
    # the last part is what is used, the parts before it are its owner; one call on the way makes an instance
    last = F.regexp_extract("whole", r"\.([^.]*)$", 1)
    owner = F.regexp_replace("whole", r"\.[^.]*$", "")
    bare = F.regexp_replace(owner, r"\(\)$", "")
    instance = owner.endswith("()")
    usable = (last != "") & ~last.contains("()") & ~bare.contains("()") & (~instance | is_class(bare))
    call, of_class = F.col("kind") == "call", instance | is_class(bare)
    kind = F.when(call & of_class, "method").when(call & is_class(F.col("whole")), "class").when(call, "function").when(of_class, "attribute")
    used = known.where(usable).select("path", kind.alias("kind"), bare.alias("owner"), last.alias("name"), "n_args", "kwargs", "line").where("kind IS NOT NULL")
    imports = found.where("event = 'import'").select("path", F.lit("import").alias("kind"), F.col("name").alias("owner"), F.col("target").alias("name"), "n_args", "kwargs", "line")
    errors = found.where("event = 'error'").select("path", F.lit("error").alias("kind"), F.lit("").alias("owner"), F.lit("").alias("name"), "n_args", "kwargs", "line")
    return imports.unionByName(used).unionByName(errors), found.limit(SENT + 1).count() <= SENT


def uses(scripts: DataFrame, work) -> DataFrame:
    """(path, kind, owner, name, n_args, kwargs, line): what scripts import, call and read of imported modules.

    Kinds: import, class, method (of an instance or a class), function, attribute (read of an instance or a class), error.
    owner is the dotted name of the module or class. `work(df, name)` writes a table and reads it again: events are
    read several times, and parsed once.
    """
    # half of a SHA-256 tells contents apart
    key = F.base64(F.substring(F.unhex(F.sha2("content", 256)), 1, 16))
    keyed = scripts.where("path IS NOT NULL AND content IS NOT NULL").select("path", key.alias("_content"), "content")
    found, few = _of_contents(keyed.select(F.col("_content").alias("path"), "content").distinct(), work)
    found = found.withColumnRenamed("path", "_content")
    return keyed.select("path", "_content").join(F.broadcast(found) if few else found, "_content").drop("_content")
