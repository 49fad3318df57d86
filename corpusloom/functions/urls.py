"""Checks of URLs and hosts as columns; nothing is looked up on a network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses that a recursive crawl leaves out.
LEFT_OUT = (
    r"/commit/", r"/commits/", r"/blame/", r"/compare/", r"/pull/\d+/commits", r"/pull/\d+/files", r"/issues/\d+/events", r"/actions/runs/",
    r"/network/dependencies", r"/pulse", r"/graphs/", r"/security/", r"/-/commit/", r"/-/commits/", r"/-/merge_requests/\d+/diffs",
    r"/search\?", r"/tag/", r"/tags\?", r"/releases\?", r"\?page=\d+$", r"/archive/", r"\.git$", r"\.zip$", r"\.tar\.gz$", r"/rss$", r"/atom$",
)
#: Names and suffixes of hosts inside a network.
LOCAL_NAMES = ("localhost", "localhost.localdomain", "127.0.0.1", "::1", "0.0.0.0", "0000:0000:0000:0000:0000:0000:0000:0001", "::ffff:127.0.0.1")
LOCAL_SUFFIXES = (".local", ".internal", ".corp", ".localhost")
#: First and last IPv4 addresses that are not public (IANA special-purpose registry).
NOT_PUBLIC = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
#: IPv6: loopback, unspecified, mapped IPv4, unique local, link-local, documentation.
NOT_PUBLIC_6 = "^(::1|::|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*)$"
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
#: What a bare domain with a path looks like, and what a cut address may have begun with.
BARE_DOMAIN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(/.*)?$"
BEGINNINGS = ("https://www.", "https://", "http://www.", "http://")
SCHEMES = ("http://", "https://", "raw:")


def _once(value: Column, use) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(ip: str) -> int:
    return int.from_bytes(bytes(map(int, ip.split("."))))


def left_out(url: Column) -> Column:
    return url.rlike("|".join(LEFT_OUT))


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; empty if there is none."""
    found = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    return F.lower(F.when(found.startswith("["), F.regexp_extract(found, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(found, ":.*$", "")))


def _groups(address: Column) -> Column:
    """The eight numbers of an IPv6 address in any spelling; another number of them where it is none. An IPv4 tail counts as two zeros."""
    halves = F.split(F.regexp_replace(address, r"\d+\.\d+\.\d+\.\d+$", "0:0"), "::", 2)
    none = F.array().cast("array<string>")
    side = lambda i: F.coalesce(F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda x: x != ""), none)
    missing = 8 - F.size(side(0)) - F.size(side(1))
    zeros = F.when((F.size(halves) > 1) & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(none)
    return F.transform(F.concat(side(0), zeros, side(1)), lambda x: F.when(x.rlike("^[0-9a-f]{1,4}$"), F.conv(x, 16, 10).cast("int")))


def public_address(address: Column) -> Column:
    """Whether an IPv6 address, however it is spelled, is outside of loopback, unspecified, IPv4 mapped or compatible, unique local, link-local and documentation ranges; false for what is no address."""

    def judged(g: Column) -> Column:
        zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        first = g[0]
        inside = zero(6) | (zero(5) & (g[5] == 0xFFFF)) | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF) | ((first == 0x2001) & (g[1] == 0xDB8))
        return F.when((F.size(g) == 8) & F.forall(g, lambda x: x.isNotNull()), ~inside).otherwise(False)

    return _once(_groups(F.regexp_replace(address, "%.*$", "")), judged)


def safe_host(name: Column) -> Column:
    """False for an empty, local or internal name and an address that is not public. A name that is no address is not resolved."""

    def judged(bare: Column) -> Column:
        value = F.when(bare.rlike(IPV4), F.aggregate(F.transform(F.split(bare, "\\."), lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: F.when(x <= 255, a * 256 + x)))
        inside = _once(value, lambda v: F.exists(F.array(*[F.struct(F.lit(number(lo)).alias("lo"), F.lit(number(hi)).alias("hi")) for lo, hi in NOT_PUBLIC]), lambda r: F.coalesce(v.between(r["lo"], r["hi"]), F.lit(False))))
        suffix = "(" + "|".join(x.replace(".", "\\.") for x in LOCAL_SUFFIXES) + ")$"
        return ~((bare == "") | bare.isin(*LOCAL_NAMES) | bare.rlike(suffix) | inside | (bare.contains(":") & ~public_address(bare)))

    return F.coalesce(_once(F.lower(F.btrim(name)), judged), F.lit(False))


def checked(url: Column) -> Column:
    """(valid, url, error): blanks go, a bare domain with a path gets https, a fragment goes."""

    def whole(bare: Column) -> Column:
        other = bare.rlike("^(https?://|file://|raw:)")
        fixed = F.when(bare.contains("/") & ~other & bare.rlike(BARE_DOMAIN), F.concat(F.lit("https://"), bare)).otherwise(bare)
        return F.struct(bare.alias("bare"), fixed.alias("whole"))

    def error(p: Column) -> Column:
        web = p["whole"].rlike("^https?://")
        found = (
            F.when(p["bare"] == "", "empty")
            .when(p["bare"].startswith("..."), "truncated")
            .when(~p["whole"].rlike("^(https?://|raw:)"), "scheme")
            .when(web & (F.size(F.split(p["whole"], "://")) > 2), "protocols")
            .when(web & p["whole"].rlike("^https?://(/|$)"), "domain")
            .when(web & (host(p["whole"]) == ""), "host")
            .when(web & ~safe_host(host(p["whole"])), "unsafe")
        )
        return F.struct(p["whole"].alias("whole"), found.alias("error"))

    made = _once(_once(_once(F.btrim(F.coalesce(url, F.lit("")), F.lit(" \t\n\r")), whole), error), lambda r: F.struct(r["error"].isNull().alias("valid"), F.when(r["error"].isNull(), F.regexp_replace(r["whole"], "#[\\s\\S]*$", "")).alias("url"), r["error"].alias("error")))
    return made


def truncation_hints(url: Column) -> Column:
    """Complete addresses that a URL which begins with dots may stand for."""
    rest = F.substr(F.btrim(url), F.lit(4))
    return F.when(F.btrim(url).startswith("...") & rest.contains("/") & ~rest.startswith("/"), F.array(*[F.concat(F.lit(p), rest) for p in BEGINNINGS]))


def repository(url: Column) -> Column:
    """(owner, name) of a repository address with exactly these two parts; null otherwise."""
    at = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?/?$"
    return F.when(url.rlike(at), F.struct(F.regexp_extract(url, at, 1).alias("owner"), F.regexp_extract(url, at, 2).alias("name")))


def source_id(url: Column) -> Column:
    """Host with port as it is written, without www.; the path where there is no host."""
    found = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", ""), "[?#][\\s\\S]*$", "")
    return F.regexp_replace(F.coalesce(F.nullif(found, F.lit("")), path), "^www\\.", "")


def sitemap_locations(xml: Column) -> Column:
    """Addresses of a sitemap or an index of sitemaps in any name space; none of a document that is not well-formed."""
    entry = "array<struct<loc:string>>"
    read = F.from_xml(xml, f"url {entry}, sitemap {entry}", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(read["url"]["loc"], none), F.coalesce(read["sitemap"]["loc"], none))
    return F.filter(F.transform(found, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))
