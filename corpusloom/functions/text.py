"""Markdown sections and code blocks, arguments and lists, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADER = r"(?m)^(#+)[ \t]+(.+)$"


def headers(text: Column) -> Column:
    """Headers of a piece of Markdown with their marks, joined by semicolons."""
    marks, names = (F.regexp_extract_all(text, F.lit(_HEADER), F.lit(i)) for i in (1, 2))
    return F.array_join(F.zip_with(marks, names, lambda m, n: F.concat(m, F.lit(" "), n)), "; ")


def _stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r"))


def code_blocks(text: Column, least: int = 1000, around: int = 1000) -> Column:
    """(language, code, before, after) of each fenced block whose code has `least` characters.

    Every second part between fences is a block; an opening fence without a closing one begins none.
    """
    # the parts are cut once, not for each block
    def found(parts: Column) -> Column:
        n = F.size(parts)
        # a part comes with three characters at least, so no more of them reach into what is kept
        near = around // 3 + 1
        before = lambda i: F.array_join(F.slice(parts, F.greatest(i - near + 1, F.lit(1)), F.least(i, F.lit(near))), "```")
        after = lambda i: F.array_join(F.slice(parts, i + 2, F.least(F.lit(near), F.greatest(n - i - 1, F.lit(0)))), "```")

        def block(i: Column) -> Column:
            part = F.element_at(parts, i + 1)
            first = _stripped(F.substring_index(part, "\n", 1))
            named = part.contains("\n") & (first != "") & ~first.contains(" ") & (F.length(first) < 20)
            code = F.when(named, F.substr(part, F.instr(part, "\n") + 1)).otherwise(part)
            return F.struct(F.when(named, first).otherwise("").alias("language"), code.alias("code"), _stripped(F.right(before(i), F.lit(around))).alias("before"), _stripped(F.left(after(i), F.lit(around))).alias("after"))

        places = F.when(n > 2, F.sequence(F.lit(1), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, block), lambda b: F.length(b["code"]) >= least)

    return F.element_at(F.transform(F.array(F.split(text, "```")), found), 1)


def list_argument(value: Column) -> Column:
    """A JSON list where the text is one, else the text alone."""
    given = F.from_json(F.when(_stripped(value).startswith("["), value), "array<string>")
    return F.coalesce(given, F.array(value))


def trimmed(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.btrim(x)), lambda x: x != "")


def topic_queries(query: Column, topics: Column, given: Column) -> Column:
    """A query for each topic: the one given for it, else the query with the topic."""
    return F.map_from_entries(F.transform(F.array_distinct(topics), lambda t: F.struct(t.alias("key"), F.coalesce(F.try_element_at(given, t), F.concat(query, F.lit(" "), t)).alias("value"))))


def merged(old: Column, new: Column) -> Column:
    """Both maps; the new one's values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def present(values: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(values, lambda _, v: F.coalesce(v != "", F.lit(False)))


def megabytes(size: Column) -> Column:
    """A size such as '12.5 GiB' in MB; null if it is none."""
    number, unit = F.regexp_extract(size, r"^\s*([0-9.]+)\s*([KMGT]?)i?B?\s*$", 1), F.regexp_extract(size, r"^\s*([0-9.]+)\s*([KMGT]?)i?B?\s*$", 2)
    scale = F.when(unit == "K", 1 / 1024).when(unit == "M", 1.0).when(unit == "G", 1024.0).when(unit == "T", 1024.0 * 1024).otherwise(1 / 1024 / 1024)
    return F.nullif(number, F.lit("")).try_cast("double") * scale
