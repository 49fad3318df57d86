"""Declarations of JavaScript, TypeScript and Go files as rows: members by the class or struct that holds them, bodies, imports and exports.

A file is lexed once where it lies (`lexing`), so what stands in strings, templates and comments declares nothing.
Rows: path, language, kind, name, owner (the innermost declared class, interface, struct or function around it),
base (what it extends, a receiver, a type, or the module of an import or export), names (imported names), flags, line,
body (its braces and what they hold), doc, exported. Methods of Go join their structs over the files of a package.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .lexing import OPEN, Source, lex

SCHEMA = "path string, language string, kind string, name string, owner string, base string, names array<string>, flags array<string>, line int, body string, doc string, exported boolean"
#: Characters of files whose rows are held at a time.
HELD = 1 << 18
#: Tasks for each slot that files are dealt out to: a small table of many files would else be one task's work.
TASKS = 4
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
#: Languages by the end of a file's name.
LANGUAGES = {".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".go": "Go"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "abstract", "override", "declare", "accessor"}
_PREFIXES = {"export", "default", "abstract", "async", "declare", "public", "private", "protected", "static", "readonly", "override"}
_GO_WORDS = {"package", "import", "type", "func", "const", "var"}
_HOLDERS = {"class", "interface", "struct", "enum", "function", "arrow", "method"}


class _Found:
    """Declarations of one file, in the order in which they begin."""

    def __init__(self, source: Source, content: str):
        self.s, self.content, self.rows = source, content, []

    def add(self, kind: str, name: str, first: int, *, base: str | None = None, names=(), flags=(), body: int = -1, exported: bool = False) -> None:
        """first: its first token; body: its opening brace, if it has one."""
        last = self.s.closing(body) if body >= 0 else first
        text = self.content[self.s.offset(body) : self.s.offset(last) + 1] if body >= 0 else None
        self.rows.append({"kind": kind, "name": name, "base": base, "names": list(names), "flags": list(flags), "line": self.s.line[first], "body": text, "exported": exported, "first": first, "span": (body, last) if body >= 0 else None})

    def owned(self, doc) -> Iterator[tuple]:
        """The rows with their owners: the last holder that is still open where they begin."""
        opened: list[tuple[int, int, str]] = []
        spans = sorted((r["span"][0], r["span"][1], r["name"]) for r in self.rows if r["span"] and r["kind"] in _HOLDERS)
        for r in sorted(self.rows, key=lambda r: r["first"]):
            while spans and spans[0][0] < r["first"]:
                opened.append(spans.pop(0))
            # holders are nested, so those that have ended lie on top of the others
            while opened and opened[-1][1] < r["first"]:
                opened.pop()
            yield r["kind"], r["name"], opened[-1][2] if opened else "", r["base"], r["names"], r["flags"], r["line"], r["body"], doc(r["first"]), r["exported"]


def _quoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "\"'`" and text[-1] == text[0] else text.strip("\"'`")


# JavaScript and TypeScript ----------------------------------------------------------------------


def _names_in(s: Source, brace: int, mark: str) -> list[str]:
    """Names that a list in braces binds: those behind `mark` where it is used."""
    out, i, last = [], brace + 1, s.closing(brace)
    while i < last:
        end = next((j for j in _level(s, i, last) if s.get(j) == ","), last)
        part = [t for t in range(i, end) if s.kind[t] == "name" and s.get(t) not in ("as", "type")]
        if part:
            marked = [j + 1 for j in range(i, end) if s.get(j) == mark]
            default = next((j for j in range(i, end) if s.get(j) == "="), end)
            named = [t for t in part if t < default]
            out.append(s.get(marked[0]) if marked and s.named(marked[0]) else s.get(named[0] if named else part[0]))
        i = end + 1
    return out


def _level(s: Source, i: int, last: int) -> Iterator[int]:
    """Tokens from i to before `last` that lie in no bracket opened on the way."""
    while i < last:
        yield i
        i = s.closing(i) + 1 if s.get(i) in OPEN and s.kind[i] == "sign" else i + 1


def _angles(s: Source, i: int) -> int:
    """Behind the type parameters that begin at i, if any do."""
    if s.get(i) != "<":
        return i
    depth = 0
    for j in _level(s, i, len(s.text)):
        depth += (s.get(j) == "<") - (s.get(j) == ">")
        if not depth:
            return j + 1
    return i


def _brace_after(s: Source, i: int, stop: str = ";") -> int:
    """The next brace at this level before `stop`, or -1."""
    for j in _level(s, i, len(s.text)):
        # a brace behind one of these signs belongs to a type
        if s.get(j) == "{" and s.kind[j] == "sign" and s.get(j - 1) not in (":", "<", "|", "&", ",", "=>", "?"):
            return j
        if s.get(j) in (stop, ")", "]", "}"):
            break
    return -1


def _first_token(s: Source, i: int) -> int:
    while s.get(i - 1) in _PREFIXES:
        i -= 1
    return i


def _arrow(s: Source, i: int) -> int:
    """The place behind => of an arrow function that begins at i, or -1."""
    i = _angles(s, i + (s.get(i) == "async"))
    if s.named(i) and s.get(i + 1) == "=>":
        return i + 2
    if s.get(i) != "(":
        return -1
    after = s.closing(i) + 1
    if s.get(after) == ":":
        # a type of what is returned
        for j in _level(s, after, len(s.text)):
            if s.get(j) == "=>":
                return j + 1
            if s.get(j) in (";", "=") or s.get(j) in ("const", "let", "var", "function", "class"):
                return -1
    return after + 1 if s.get(after) == "=>" else -1


def _members(found: _Found, brace: int) -> None:
    """Methods and fields that lie directly in a class body."""
    s, i, last = found.s, brace + 1, found.s.closing(brace)
    while i < last:
        if s.get(i) == "@":
            i = s.closing(i + 2) + 1 if s.get(i + 2) == "(" else i + 2
            continue
        first, flags = i, []
        while s.get(i) in _MODIFIERS and s.get(i + 1) not in ("(", "=", ";", ":", "?", "!", "}"):
            flags.append(s.get(i))
            i += 1
        if s.get(i) == "*":
            flags.append("generator")
            i += 1
        if s.get(i) == "[":
            name, i = found.content[s.offset(i) : s.offset(s.closing(i)) + 1], s.closing(i) + 1
        elif i < last and s.kind[i] in ("name", "string", "number"):
            name, i = _quoted(s.get(i)), i + 1
        else:
            i = s.closing(i) + 1 if s.get(i) in OPEN else i + 1
            continue
        i = _angles(s, i + (s.get(i) in ("?", "!")))
        if s.get(i) == "(":
            body = _brace_after(s, s.closing(i) + 1)
            found.add("method", name, first, flags=flags, body=body)
            i = s.closing(body) + 1 if body >= 0 else next((j + 1 for j in _level(s, s.closing(i) + 1, last) if s.get(j) == ";"), last)
            continue
        found.add("field", name, first, flags=flags, base=_type_of(found, i, last))
        i = _statement_end(s, i, last)


def _type_of(found: _Found, i: int, last: int) -> str | None:
    s = found.s
    if s.get(i) != ":":
        return None
    end = next((j for j in _level(s, i + 1, last) if s.get(j) in ("=", ";", ",") or s.line[j] > s.line[i] and s.get(j - 1) not in ("|", "&", ":")), last)
    return found.content[s.offset(i + 1) : s.at[end - 1] + len(s.get(end - 1))] if end > i + 1 else None


def _statement_end(s: Source, i: int, last: int) -> int:
    """Behind the statement that goes on at i: its semicolon, or a line that no sign carries on."""
    before = i - 1
    for j in _level(s, i, last):
        if s.get(j) == ";":
            return j + 1
        if s.line[j] > s.line[before] and s.kind[j] != "sign" and (s.kind[before] != "sign" or s.get(before) in ")]}") or s.line[j] > s.line[before] and s.get(j) in ("@", "*", "["):
            return j
        before = s.closing(j) if s.get(j) in OPEN and s.closing(j) < last else j
    return last


def _javascript(found: _Found) -> None:
    s = found.s
    component = lambda name: name[:1].isupper()
    for i, word in enumerate(s.text):
        if s.kind[i] != "name" or s.get(i - 1) in (".", "?."):
            continue
        first = _first_token(s, i)
        exported = s.get(first) == "export"
        follows = s.get(i + 1)
        if word == "class" and s.named(i + 1):
            name = "" if follows == "extends" else follows
            after = _angles(s, i + 2)
            body = _brace_after(s, after)
            base = next((j + 1 for j in _level(s, i + 1, body) if s.get(j) == "extends"), -1) if body >= 0 else -1
            stop = next((j for j in _level(s, base, body) if s.get(j) in ("implements", "<")), body)
            found.add("class", name, first, base=found.content[s.offset(base) : s.offset(stop)].strip() if base >= 0 else None, body=body, exported=exported, flags=[w for w in s.text[first:i] if w in ("abstract", "default")])
            if body >= 0:
                _members(found, body)
        elif word == "function":
            star = follows == "*"
            at = i + 1 + star
            if s.named(at) and s.get(_angles(s, at + 1)) == "(":
                body = _brace_after(s, s.closing(_angles(s, at + 1)) + 1)
                flags = ["async"] * (s.get(i - 1) == "async") + ["generator"] * star
                found.add("function", s.get(at), first, flags=flags, body=body, exported=exported)
                if component(s.get(at)):
                    found.add("component", s.get(at), first, exported=exported)
        elif word in ("const", "let", "var") and follows != "enum":
            _variables(found, i, first, word, exported)
        elif word in ("interface", "enum") and s.named(i + 1) and s.get(first - 1) != "=":
            body = _brace_after(s, i + 2)
            if body >= 0:
                base = next((j + 1 for j in range(i + 2, body) if s.get(j) == "extends"), -1)
                found.add(word, follows, i - 1 if s.get(i - 1) == "const" else first, base=found.content[s.offset(base) : s.offset(body)].strip() if base >= 0 else None, body=body, exported=exported or s.get(_first_token(s, i - 1)) == "export")
        elif word == "type" and s.named(i + 1) and s.get(_angles(s, i + 2)) == "=":
            found.add("type", follows, first, exported=exported)
        elif word == "import":
            _import(found, i)
        elif word == "export":
            _export(found, i)
        elif word == "module" and s.text[i + 1 : i + 4] == [".", "exports", "="]:
            names = _names_in(s, i + 4, "") if s.get(i + 4) == "{" else [s.get(i + 4)] if s.named(i + 4) else []
            for name in names:
                found.add("export", name, i, flags=["commonjs"])


def _variables(found: _Found, i: int, first: int, word: str, exported: bool) -> None:
    s, at = found.s, i + 1
    while at < len(s.text):
        if s.get(at) == "{":
            names, after = _names_in(s, at, ":"), s.closing(at) + 1
        elif s.get(at) == "[":
            names, after = [s.get(j) for j in _level(s, at + 1, s.closing(at)) if s.named(j)], s.closing(at) + 1
        elif s.named(at):
            names, after = [s.get(at)], at + 1
        else:
            return
        if s.get(after) in ("of", "in"):
            return
        value = next((j for j in _level(s, after, len(s.text)) if s.get(j) in ("=", ";", ",", ")", "}") or s.get(j) in ("const", "let", "var")), -1) if s.get(after) in (":", "!") else after
        begins = value + 1 if s.get(value) == "=" else -1
        arrow = _arrow(s, begins) if begins >= 0 else -1
        body = arrow if arrow >= 0 and s.get(arrow) == "{" else -1
        if begins >= 0 and s.get(begins) == "require" and s.get(begins + 1) == "(" and s.kind[min(begins + 2, len(s.kind) - 1)] == "string":
            found.add("import", _quoted(s.get(begins + 2)), first, names=names, flags=["commonjs"])
        if arrow >= 0:
            found.add("arrow", names[0], first, flags=["async"] * (s.get(begins) == "async"), body=body, exported=exported)
            if names[0][:1].isupper():
                found.add("component", names[0], first, exported=exported)
        for name in names:
            found.add("variable", name, first, flags=[word], exported=exported)
        end = body if body >= 0 else begins if begins >= 0 else after
        before = max(at, end - 1)
        for j in _level(s, end, len(s.text)):
            if s.get(j) == ",":
                break
            if s.get(j) in (";", ")", "}", "]") or s.line[j] > s.line[before] and s.kind[j] != "sign" and (s.kind[before] != "sign" or s.get(before) in ")]}"):
                return
            before = min(s.closing(j), len(s.text) - 1) if s.get(j) in OPEN else j
        else:
            return
        at = j + 1


def _import(found: _Found, i: int) -> None:
    s, at, names = found.s, i + 1, []
    if s.get(at) == "(":
        if at + 1 < len(s.kind) and s.kind[at + 1] == "string":
            found.add("import", _quoted(s.get(at + 1)), i, flags=["dynamic"])
        return
    at += s.get(at) == "type" and s.get(at + 1) != "from"
    while at < len(s.text) and s.kind[at] != "string":
        if s.get(at) == "{":
            names += _names_in(s, at, "as")
            at = s.closing(at)
        elif s.get(at) == "*" and s.get(at + 1) == "as":
            names.append(s.get(at + 2))
            at += 2
        elif s.named(at) and s.get(at) != "from":
            names.append(s.get(at))
        elif s.get(at) not in (",", "from"):
            return
        at += 1
    if at < len(s.text):
        found.add("import", _quoted(s.get(at)), i, names=names, flags=["es6"])


def _export(found: _Found, i: int) -> None:
    s, at = found.s, i + 1
    source = lambda j: _quoted(s.get(j + 1)) if s.get(j) == "from" and j + 1 < len(s.kind) and s.kind[j + 1] == "string" else None
    if s.get(at) == "*":
        alias = s.get(at + 2) if s.get(at + 1) == "as" else None
        if origin := source(at + 1 + 2 * bool(alias)):
            found.add("export", alias or "*", i, base=origin, flags=["all"])
        return
    if s.get(at) == "type" and s.get(at + 1) == "{":
        at += 1
    if s.get(at) == "{":
        for name in _names_in(s, at, "as"):
            found.add("export", name, i, base=source(s.closing(at) + 1), flags=["named", "value"])
        return
    default = s.get(at) == "default"
    at += default
    while s.get(at) in ("async", "abstract", "declare"):
        at += 1
    word = s.get(at)
    if word in ("const", "let", "var") and s.get(at + 1) != "enum":
        names = _names_in(s, at + 1, ":") if s.get(at + 1) == "{" else [s.get(at + 1)]
        for name in names:
            found.add("export", name, i, flags=["named", word])
    elif word in ("class", "function", "interface", "type", "enum", "const"):
        at += 1 + (s.get(at + 1) in ("*", "enum"))
        named = s.named(at) and s.get(at) != "extends"
        found.add("export", s.get(at) if named else "default", i, flags=["default" if default else "named", word])
    elif default:
        found.add("export", word if s.named(at) else "default", i, flags=["default", "value"])


# Go ---------------------------------------------------------------------------------------------


def _specs(s: Source, i: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last token) of each specification after the word at i: one, or a list in brackets."""
    if s.get(i + 1) == "(":
        at, last = i + 2, s.closing(i + 1)
        while at < last:
            end = _line_end(s, at, last)
            if end > at:
                yield at, end
            at = max(end, at) + (s.get(end) == ";")
    else:
        yield i + 1, _line_end(s, i + 1, len(s.text))


def _line_end(s: Source, i: int, last: int) -> int:
    """Behind the tokens of a line at this level; brackets and commas carry it on."""
    before = i
    for j in _level(s, i, last):
        if s.get(j) == ";" or j > i and s.line[j] > s.line[before] and s.get(before) not in (",", "=", "+", "|", "&", "."):
            return j
        if s.get(j) in (")", "]", "}") and s.kind[j] == "sign":
            return j
        before = min(s.closing(j), len(s.text) - 1) if s.get(j) in OPEN else j
    return last


def _go(found: _Found) -> None:
    s, content = found.s, found.content
    public = lambda name: name[:1].isupper()
    text = lambda a, b: content[s.offset(a) : s.at[b - 1] + len(s.get(b - 1))] if b > a else ""
    for i, word in enumerate(s.text):
        if word not in _GO_WORDS or s.kind[i] != "name" or s.get(i - 1) == ".":
            continue
        if word == "package" and s.named(i + 1) and s.brace[i] < 0:
            found.add("package", s.get(i + 1), i)
        elif word == "import" and s.brace[i] < 0:
            for a, b in _specs(s, i):
                if s.kind[b - 1] == "string":
                    found.add("import", _quoted(s.get(b - 1)), a, names=[s.get(a)] if b - a > 1 else [])
        elif word == "type":
            for a, b in _specs(s, i):
                if s.named(a):
                    _go_type(found, i if a == i + 1 else a, a, b, text, public)
        elif word == "func":
            receiver = s.get(i + 1) == "("
            at = s.closing(i + 1) + 1 if receiver else i + 1
            if not s.named(at):
                continue
            after = at + 1
            if s.get(after) == "[":
                after = s.closing(after) + 1
            if s.get(after) != "(":
                continue
            body = next((j for j in _level(s, s.closing(after) + 1, _line_end(s, s.closing(after) + 1, len(s.text))) if s.get(j) == "{" and s.get(j - 1) not in ("interface", "struct")), -1)
            inner = s.text[i + 2 : s.closing(i + 1)] if receiver else []
            base = "".join(inner[1:] if len(inner) > 1 and inner[0] != "*" else inner) if receiver else None
            found.add("method" if receiver else "function", s.get(at), i, base=base, names=[inner[0]] if base and len(inner) > 1 and inner[0] != "*" else [], body=body, exported=public(s.get(at)))
        elif word in ("const", "var"):
            for a, b in _specs(s, i):
                names, at = [], a
                while s.named(at) and at < b:
                    names.append(s.get(at))
                    if s.get(at + 1) != ",":
                        break
                    at += 2
                end = next((j for j in _level(s, at + 1, b) if s.get(j) == "="), b)
                for name in names:
                    found.add("constant" if word == "const" else "variable", name, i if a == i + 1 else a, base=text(at + 1, end) or None, exported=public(name))


def _go_type(found: _Found, first: int, a: int, b: int, text, public) -> None:
    s, name = found.s, found.s.get(a)
    at = a + 1
    if s.get(at) == "[" and s.get(s.closing(at) + 1) in ("struct", "interface", "func", "map") or s.get(at) == "[" and s.named(at + 1) and s.closing(at) > at + 2:
        at = s.closing(at) + 1
    at += s.get(at) == "="
    if s.get(at) not in ("struct", "interface") or s.get(at + 1) != "{":
        found.add("type", name, first, base=text(at, b) or None, exported=public(name))
        return
    body, kind = at + 1, s.get(at)
    found.add(kind, name, first, body=body, exported=public(name))
    i, last = body + 1, s.closing(body)
    while i < last:
        end = _line_end(s, i, last)
        if end <= i:
            i += 1
            continue
        stop = end - 1 if s.kind[end - 1] == "string" else end
        if kind == "interface" and s.named(i) and s.get(i + 1) == "(":
            found.add("method", s.get(i), i, exported=public(s.get(i)))
        elif s.named(i) and stop - i > 1 and s.get(i + 1) != ".":
            names = [i]
            while s.get(names[-1] + 1) == "," and s.named(names[-1] + 2):
                names.append(names[-1] + 2)
            for n in names:
                found.add("field", s.get(n), i, base=text(names[-1] + 1, stop), exported=public(s.get(n)))
        elif stop > i:
            # an embedded type is a field of its own last name
            own = next((s.get(j) for j in range(stop - 1, i - 1, -1) if s.named(j)), "")
            found.add("embedded", own, i, base=text(i, stop), exported=public(own))
        i = end + (s.get(end) == ";")


# rows -------------------------------------------------------------------------------------------


def _doc(s: Source, language: str):
    def before(i: int) -> str | None:
        comments = s.comments.get(i, [])
        if language != "go":
            last = comments[-1][0] if comments else ""
            if not last.startswith("/**"):
                return None
            return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in last[3:].removesuffix("*/").strip().split("\n"))
        lines, below = [], s.line[i]
        for own, _, end in reversed(comments):
            if not own.startswith("//") or end != below - 1:
                break
            lines.append(own[2:].strip())
            below = end
        return "\n".join(reversed(lines)) or None

    return before


def declared(path: str, content: str) -> list[tuple]:
    """The rows of one file; none for a name whose end is not known."""
    language = LANGUAGES.get(re.sub(r"^.*(?=\.)", "", path.lower()))
    if not language:
        return []
    own = "go" if language == "Go" else "javascript"
    source = lex(content, own)
    found = _Found(source, content)
    (_go if own == "go" else _javascript)(found)
    return [(path, language, *row) for row in found.owned(_doc(source, own))]


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt out by their paths to TASKS tasks for each slot."""
    return files.repartition(TASKS * files.sparkSession.sparkContext.defaultParallelism, "path")


def parsed(files: DataFrame, each: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `each` finds in each file (path, content). A worker holds the rows of about HELD characters of files at a
    time (a longer file is held alone), however many files Spark sends it at once."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                text = content.as_py()
                rows += each(path.as_py(), text)
                held += len(text)
                if rows and held >= HELD:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return files.where("content IS NOT NULL").select("path", "content").mapInArrow(run, schema)


def structure(files: DataFrame) -> DataFrame:
    """Declarations of all files (path, content) whose names end as one of LANGUAGES; a null content gives nothing."""
    return parsed(files.where("path IS NOT NULL"), declared, SCHEMA)


def dependencies(declarations: DataFrame) -> DataFrame:
    """(path, dependency): packages that a file imports from outside: owner and name with @, three parts of a github.com path,
    the first part of another Go path with a dot; of JavaScript no relative or absolute paths, of Go not the standard library."""
    name, parts = F.col("name"), F.split("name", "/")
    first = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    go = F.when(name.startswith("github.com/") & (F.size(parts) >= 3), first(3)).when(parts[0].contains("."), parts[0])
    script = F.when(~name.rlike("^[./]") & (name != ""), F.when(name.startswith("@"), first(2)).otherwise(parts[0]))
    found = declarations.where("kind = 'import'").select("path", F.when(F.col("language") == "Go", go).otherwise(script).alias("dependency"))
    return found.where("dependency IS NOT NULL").distinct()


def go_exports(declarations: DataFrame) -> DataFrame:
    """(path, name) of structs, interfaces, functions, methods and types of Go files whose names begin with a capital letter."""
    return declarations.where("language = 'Go' AND exported AND owner = '' AND kind IN ('struct', 'interface', 'function', 'method', 'type')").select("path", "name").distinct()


def with_receivers(declarations: DataFrame) -> DataFrame:
    """Methods of Go joined with the type of their receiver, which any file of the folder (a package) may declare: owner is the type's name and `owner_path` its file, null where no file declares it.

    What both sides of the join need is written first, as files would else be read for each."""
    declarations = stored(declarations.where("language = 'Go' AND (kind IN ('struct', 'type') AND owner = '' OR kind = 'method' AND base IS NOT NULL)"), "receivers")
    folder = F.regexp_replace("path", "[^/]*$", "")
    types = declarations.where("language = 'Go' AND kind IN ('struct', 'type') AND owner = ''").groupBy(folder.alias("folder"), F.col("name").alias("type")).agg(F.min("path").alias("owner_path"))
    receiver = F.regexp_replace("base", r"^\*|\[.*$", "")
    methods = declarations.where("language = 'Go' AND kind = 'method' AND base IS NOT NULL").withColumn("folder", folder).withColumn("type", receiver)
    return methods.join(types, ["folder", "type"], "left").withColumn("owner", F.col("type")).drop("folder", "type")
