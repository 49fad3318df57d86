"""Tokens of JavaScript, TypeScript and Go sources, with what lies inside strings, templates and comments left out of the code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SHARED = r"""
(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))
|(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?)
|(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[\w$]+)|(?P<number>\d[\w.]*)
"""
_JS = re.compile(_SHARED + r"|(?P<other>'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<sign>=>|\.\.\.|\?\.|[^\s\w])", re.VERBOSE)
_GO = re.compile(_SHARED + r"|(?P<other>'(?:\\[\s\S]|[^'\\\n])*'?|`[^`]*`?)|(?P<sign>:=|\.\.\.|<-|[^\s\w])", re.VERBOSE)
#: A regular expression may begin where a value may: after these signs and words.
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_BEFORE_VALUE = {*"(,=:[!&|?{};+-*%<>~^", "=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_BLANK = re.compile(r"\s+")
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Source:
    """Tokens of a file: their text, kind, place and line; each bracket's partner, each token's innermost brace, and comments by the token they stand before."""

    text: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)
    brace: list[int] = field(default_factory=list)
    comments: dict[int, list[tuple[str, int, int]]] = field(default_factory=dict)
    end: int = 0

    def get(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "name"

    def closing(self, i: int) -> int:
        """The token that closes the bracket at i; the end where none does."""
        return self.partner.get(i, len(self.text))

    def offset(self, i: int) -> int:
        """Where token i begins; the end of the text behind the last one."""
        return self.at[i] if i < len(self.at) else self.end


def _lex_go(content: str) -> Source:
    """The same for Go, whose tokens don't depend on those before them."""
    out = Source(end=len(content))
    text, kinds, at, lines, inside, partner = out.text, out.kind, out.at, out.line, out.brace, out.partner
    stack: list[int] = []
    braces, line, before = [-1], 1, 0
    for found in _GO.finditer(content):
        place, kind, own = found.start(), found.lastgroup, found[0]
        line += content.count("\n", before, place)
        before = place
        if kind == "line" or kind == "block":
            out.comments.setdefault(len(text), []).append((own, line, line + own.count("\n")))
            continue
        n = len(text)
        closes = kind == "sign" and own in CLOSE and stack and text[stack[-1]] == OPEN[CLOSE.index(own)]
        if closes:
            first = stack.pop()
            partner[first], partner[n] = n, first
            if own == "}":
                braces.pop()
        text.append(own)
        kinds.append("string" if kind == "other" else kind)
        at.append(place)
        lines.append(line)
        inside.append(braces[-1])
        if not closes and kind == "sign" and own in OPEN:
            stack.append(n)
            if own == "{":
                braces.append(n)
    return out


def lex(content: str, language: str) -> Source:
    """One pass over the text. A bracket that nothing closes reaches to the end; one that closes nothing is a sign."""
    if language == "go":
        return _lex_go(content)
    out, pattern = Source(end=len(content)), _JS
    stack: list[int] = []
    braces = [-1]  # those of the stack that are braces
    templates: list[int] = []  # brackets of ${ that return to a template
    at, line = 0, 1

    def add(kind: str, text: str, place: int) -> None:
        out.text.append(text)
        out.kind.append(kind)
        out.at.append(place)
        out.line.append(line)
        out.brace.append(braces[-1])

    def template(place: int) -> int:
        """Reads on in a template from `place`; the place behind it, or behind its next ${."""
        nonlocal line
        found = _TEMPLATE.match(content, place)
        line += content.count("\n", place, found.end())
        if content.startswith("${", found.end()):
            add("sign", "{", found.end() + 1)
            stack.append(len(out.text) - 1)
            braces.append(len(out.text) - 1)
            templates.append(len(out.text) - 1)
            return found.end() + 2
        return found.end() + 1

    while at < len(content):
        if blank := _BLANK.match(content, at):
            line += blank[0].count("\n")
            at = blank.end()
            continue
        if content[at] == "`":
            add("string", "`", at)
            at = template(at + 1)
            continue
        found = None
        if content[at] == "/" and content[at + 1 : at + 2] not in ("/", "*") and (not out.text or out.text[-1] in _BEFORE_VALUE):
            found = _REGEX.match(content, at)
        if found:
            add("string", found[0], at)
            at = found.end()
            continue
        found = pattern.match(content, at)
        if not found:
            at += 1
            continue
        kind, own = found.lastgroup, found[0]
        if kind in ("line", "block"):
            out.comments.setdefault(len(out.text), []).append((own, line, line + own.count("\n")))
        elif kind == "sign" and own in CLOSE and stack and out.text[stack[-1]] == OPEN[CLOSE.index(own)]:
            first = stack.pop()
            if own == "}":
                braces.pop()
            add("sign", own, at)
            out.partner[first], out.partner[len(out.text) - 1] = len(out.text) - 1, first
            if templates and templates[-1] == first:
                templates.pop()
                at = template(found.end())
                continue
        else:
            add("string" if kind == "other" else kind, own, at)
            if kind == "sign" and own in OPEN:
                stack.append(len(out.text) - 1)
                if own == "{":
                    braces.append(len(out.text) - 1)
        line += own.count("\n")
        at = found.end()
    return out
