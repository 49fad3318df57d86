"""Code examples from a code graph: a row for each class, public method and function, and the texts they are embedded by.

Texts follow the language and kind of a row. Null or empty parts are left out; null names give no row. Repeated rows give repeated
examples; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code import class_stub, function_stub

_COLUMNS = ("repo", "path", "module", "language", "code_type", "name", "full_name", "code_text", "parameters", "return_type", "class_name", "method_count")


def _public(name: Column) -> Column:
    return (name != "") & ~name.startswith("_")


def examples(classes: DataFrame, functions: DataFrame, *, language: str = "python") -> DataFrame:
    """Records of all classes (repo, path, module, name, full_name, methods: array of name, params_list and return_type), their public methods and the public functions (repo, path, module, name, params_list, return_type).

    A class counts all its methods; its text holds the first public ones.
    """
    none = lambda kind: F.lit(None).cast(kind)
    module = F.coalesce("module", F.lit(""))
    row = lambda df, **c: df.select(*[c[n].alias(n) for n in _COLUMNS])
    shared = {"repo": F.col("repo"), "path": F.col("path"), "module": module, "language": F.lit(language)}
    named = classes.where("name IS NOT NULL")
    methods = F.coalesce("methods", F.array().cast(classes.schema["methods"].dataType))
    own = row(named, **shared, code_type=F.lit("class"), name=F.col("name"), full_name=F.col("full_name"), code_text=class_stub(F.col("name"), methods), parameters=none("array<string>"), return_type=none("string"), class_name=none("string"), method_count=F.size(F.filter(methods, lambda m: m["name"].isNotNull())))
    each = named.withColumn("_m", F.explode("methods")).where(_public(F.col("_m.name")))
    name, params, returns = F.col("_m.name"), F.col("_m.params_list"), F.col("_m.return_type")
    members = row(each, **shared, code_type=F.lit("method"), name=name, full_name=F.concat_ws(".", "full_name", "_m.name"), code_text=function_stub(name, params, returns, "Method"), parameters=params, return_type=returns, class_name=F.col("name"), method_count=none("int"))
    free = functions.where(_public(F.col("name")))
    full = F.concat_ws(".", F.nullif(module, F.lit("")), "name")
    plain = row(free, **shared, code_type=F.lit("function"), name=F.col("name"), full_name=full, code_text=function_stub(F.col("name"), F.col("params_list"), F.col("return_type")), parameters=F.col("params_list"), return_type=F.col("return_type"), class_name=none("string"), method_count=none("int"))
    return own.unionByName(members).unionByName(plain)


def _given(c: Column | str) -> Column:
    """Null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _listed(c: Column | str, mark: str = ", ") -> Column:
    return F.nullif(F.array_join(c, mark), F.lit(""))


def embedding_text() -> Column:
    """The text of an example's embedding: what it is, its parts, and its code."""
    kind, name, module = F.col("code_type"), F.coalesce("name", F.lit("")), F.coalesce("module", F.lit(""))
    line = lambda label, c: F.concat(F.lit(label), c)
    code, types = line("Code: ", F.coalesce("code_text", F.lit(""))), [line("Parameters: ", _listed("parameters")), line("Returns: ", _given("return_type"))]
    count = F.when(F.col("method_count") > 0, F.format_string("Contains %d methods", F.col("method_count")))
    as_class = F.concat_ws("\n", F.concat(F.lit("Python class "), name, F.lit(" in "), module), line("Full name: ", F.coalesce("full_name", F.lit(""))), count, code)
    inside = F.concat_ws(" ", F.concat(F.lit("Python method "), name), line("in class ", _given("class_name")), line("from ", module))
    free = F.concat(F.lit("Python function "), name, F.lit(" from "), module)
    other = F.concat(F.lit("Python "), kind, F.lit(" "), name, F.lit(": "), F.coalesce("code_text", F.lit("")))
    return F.when(kind == "class", as_class).when(kind == "method", F.concat_ws("\n", inside, *types, code)).when(kind == "function", F.concat_ws("\n", free, *types, code)).otherwise(other)


# Templates of signatures and uses by language and kind. %n is the name, %p the parameters, %r the result's
# type, %s a method's receiver, %a the word async, %g arguments of a call, %t the type or value that a row gives, each with the marks around it.
SIGNATURES = {
    "Python": {"class": "class %n:", "function": "def %n(%p)%r:", "method": "def %n(%p)%r:", "": "%n: %t"},
    "JavaScript": {"class": "class %n {", "function": "%afunction %n(%p) {", "method": "%afunction %n(%p) {", "": "const %n = %t"},
    "TypeScript": {"class": "class %n {", "interface": "interface %n {", "type": "type %n = %t", "function": "%afunction %n(%p)%r {", "method": "%afunction %n(%p)%r {", "": "const %n = %t"},
    "Go": {"struct": "type %n struct {", "interface": "type %n interface {", "function": "func %n(%p)%r {", "method": "func %s%n(%p)%r {", "": "var %n %t"},
}
USES = {
    "Python": {"class": "# Usage:\ninstance = %n()\n# Access methods: instance.method_name()", "function": "# Usage:\nresult = %n(%g)", "method": "# Usage:\ninstance.%n(args)", "": "# Usage: %n"},
    "JavaScript": {"class": "// Usage:\nconst instance = new %n();\n// Access methods: instance.methodName()", "function": "// Usage:\nconst result = %n(args);", "": "// Usage: %n"},
    "TypeScript": {"class": "// Usage:\nconst instance = new %n();\n// Access methods: instance.methodName()", "interface": "// Usage:\nconst obj: %n = { /* implement interface */ };", "function": "// Usage:\nconst result = %n(args);", "": "// Usage: %n"},
    "Go": {"struct": "// Usage:\ninstance := %n{}\n// Access fields: instance.FieldName", "function": "// Usage:\nresult := %n(args)", "method": "// Usage:\ninstance.%n(args)", "": "// Usage: %n"},
}
RESULTS = {"Python": " -> ", "TypeScript": ": ", "Go": " "}
DEFAULTS = {"Python": "Any", "JavaScript": "undefined", "TypeScript": "undefined", "Go": "interface{}"}


def _from(templates: dict[str, dict[str, str]], parts: dict[str, Column], otherwise: Column) -> Column:
    """The text of the row's language and kind, with its parts in place of the marks."""

    def filled(template: str) -> Column:
        # the text between marks, and the marks' values; a value is never read as a template
        out, rest = [], template
        while "%" in rest:
            before, _, rest = rest.partition("%")
            out += [F.lit(before), parts[rest[0]]]
            rest = rest[1:]
        return F.concat(*out, F.lit(rest))

    found = [F.when(F.col("language") == lang, F.coalesce(*[F.when(F.col("code_type") == kind, filled(x)) for kind, x in own.items() if kind], filled(own[""]))) for lang, own in templates.items()]
    return F.coalesce(*found, otherwise)


def contexts() -> list[Column]:
    """signature, semantic, usage and full_context of rows with language, code_type, name, module, parent_name, signature, documentation, visibility, is_async, is_static, children, parameters, return_type, receiver, value and extra (map; for the full context)."""
    language, name = F.col("language"), F.coalesce("name", F.lit(""))
    asynchronous, static = F.coalesce("is_async", F.lit(False)), F.coalesce("is_static", F.lit(False))
    result = F.coalesce(*[F.when(language == lang, F.concat(F.lit(mark), _given("return_type"))) for lang, mark in RESULTS.items()], F.lit(""))
    plain = F.coalesce(*[F.when(language == lang, F.lit(x)) for lang, x in DEFAULTS.items()], F.lit(""))
    value = F.coalesce(_given("value"), F.when((F.col("code_type") == "type") & (language == "TypeScript"), F.lit("any")).otherwise(plain))
    arguments = F.array_join(F.transform(F.coalesce("parameters", F.array().cast("array<string>")), lambda p, i: F.concat(F.lit("arg"), i.cast("string"))), ", ")
    parts = {"n": name, "p": F.coalesce(_listed("parameters"), F.lit("")), "r": result, "s": F.coalesce(F.concat(F.lit("("), _given("receiver"), F.lit(") ")), F.lit("")), "a": F.when(asynchronous, "async ").otherwise(""), "g": arguments, "t": value}
    what = F.concat_ws(" ", "language", "code_type")
    signature = F.coalesce(F.concat(what, F.lit(" "), name, F.lit(": "), _given("signature")), _from(SIGNATURES, parts, F.concat(what, F.lit(" "), name)))
    inside = F.coalesce(F.concat(F.lit(" in "), _given("parent_name")), F.lit(""))
    line = lambda label, c: F.concat(F.lit(label), c)
    semantic = F.concat_ws("\n", F.concat(what, F.lit(" '"), name, F.lit("'"), inside, F.lit(" from "), F.coalesce(_given("module"), F.lit("module"))), line("Description: ", _given("documentation")), line("Contains: ", _listed(F.slice("children", 1, 5))))
    usage = _from(USES, parts, F.concat(F.lit("Usage example for "), what, F.lit(" "), name))
    properties = _listed(F.array_compact(F.array(line("visibility: ", _given("visibility")), F.when(asynchronous, "async"), F.when(static, "static"))))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "; ")
    full = F.concat_ws(
        "\n", F.concat(what, F.lit(" "), name, inside, F.lit(" from "), F.coalesce("module", F.lit(""))), line("Signature: ", _given("signature")), line("Documentation: ", _given("documentation")),
        line("Properties: ", properties), line("Contains: ", _listed("children")), line("Language-specific: ", _given(extra)),
    )
    return [signature.alias("signature_context"), semantic.alias("semantic_context"), usage.alias("usage_context"), full.alias("full_context")]
