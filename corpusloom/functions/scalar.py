"""Column functions: vectors, scores, ids, URLs, text. Nothing here runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 name spaces.
NS_URL, NS_DNS = "6ba7b8119dad11d180b400c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8"
#: Fixed value: words that a search query drops.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def recency_decay(age_days: Column, half_life: float = 14.0, least: float = 0.1) -> Column:
    """1 for an unknown or future time, then halves every half-life, down to `least`."""
    return F.when(age_days.isNull() | (age_days <= 0), 1.0).otherwise(F.greatest(F.pow(F.lit(0.5), age_days / half_life), F.lit(least)))


def with_recency(similarity: Column, decay: Column, weight: float = 0.3) -> Column:
    return (1 - weight) * similarity + weight * decay


def uuid5(namespace: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def hash_embedding(name: Column, size: int = 1536) -> Column:
    """The bytes of a SHA-256, scaled to -1..1 and repeated to `size`."""
    h = F.sha2(name, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.conv(h.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def domain(url: Column) -> Column:
    """Host with port, lower case, without one www.; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", ""), F.lit(""))


def clean_url(url: Column) -> Column:
    """Without outer blanks and quotes; empty unless it is http or https."""
    bare = F.regexp_replace(F.btrim(url), "^[\"' ]+|[\"' ]+$", "")
    return F.when(bare.rlike("^https?://"), bare).otherwise("")


def url_kind(url: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url.endswith("sitemap.xml") | path.contains("sitemap"), "sitemap").when(url.endswith(".txt"), "text").otherwise("page")


def sanitize_url(url: Column) -> Column:
    """Query, fragment and paths that name secrets do not reach a log."""
    host = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    # fixed values: the marks and the words that name a secret
    marks = F.concat(F.when(url.contains("?"), "?[QUERY_REDACTED]").otherwise(""), F.when(url.contains("#"), "#[FRAGMENT_REDACTED]").otherwise(""))
    return F.when(F.lower(path).rlike("token|key|auth|secret|password"), F.concat(host, F.lit("/[SENSITIVE_PATH]"))).otherwise(F.concat(host, path, marks))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda x: x != "")


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and page furniture."""
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        html = F.regexp_replace(html, f"<{tag}[^>]*>[\\s\\S]*?</{tag}>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def optimize_query(query: Column) -> Column:
    """Lower-case words without stop words, unless all are stop words."""
    own = words(F.lower(query))
    kept = F.filter(own, lambda x: ~x.isin(*STOP_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(own), " ")


def truncated(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def severity(score: Column) -> Column:
    # fixed values: the limits and their names
    return F.when(score >= 0.9, "very_high").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def _last(text: Column, mark: str) -> Column:
    """0-based place of the last `mark`, or -1."""
    return F.when(text.contains(mark), F.length(text) - F.instr(F.reverse(text), mark[::-1]) - len(mark) + 1).otherwise(-1)


def chunks(text: Column, size: int = 5000) -> Column:
    """Greedy pieces of at most `size` characters.

    A piece ends before its last code fence, else its last blank line, else behind its last sentence,
    where that lies beyond 30 % of `size`; otherwise it is cut hard. Blank pieces go, except the last.
    """
    strip = lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")
    least = size * 0.3
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  what it binds is computed once

    def place(piece: Column) -> Column:
        marks = F.struct(_last(piece, "```").alias("fence"), _last(piece, "\n\n").alias("blank"), _last(piece, ". ").alias("end"))
        return once(marks, lambda m: F.when(m["fence"] > least, m["fence"]).when(m["blank"] >= 0, F.when(m["blank"] > least, m["blank"]).otherwise(size)).when(m["end"] >= 0, F.when(m["end"] > least, m["end"] + 1).otherwise(size)).otherwise(size).cast("int"))

    def step(state: Column, _: Column) -> Column:
        # the state holds what is left of the text, so no step looks through what is done
        piece, last = F.left(state["rest"], F.lit(size)), F.substr(state["rest"], F.lit(size + 1)) == ""
        cut = once(F.struct(piece.alias("piece"), last.alias("last")), lambda p: F.struct(p["piece"].alias("piece"), p["last"].alias("last"), F.when(p["last"], size).otherwise(place(p["piece"])).alias("cut")))

        def more(c: Column) -> Column:
            return once(strip(F.left(c["piece"], c["cut"])), lambda own: F.struct(
                F.when(c["last"], "").otherwise(F.substr(state["rest"], c["cut"] + 1)).alias("rest"),
                c["last"].alias("done"),
                F.when(c["last"] | (own != ""), F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"),
            ))

        return F.when(state["done"], state).otherwise(once(cut, more))

    start = F.struct(text.alias("rest"), (F.length(text) == 0).alias("done"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), (F.length(text) / least).cast("int") + 1), start, step)["out"]
