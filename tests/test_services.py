"""Literal cases of URL checks, Markdown, parameters and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as x
from corpusloom.functions import urls as u
from corpusloom.operators import checks as c
from corpusloom.operators import graph as g
from corpusloom.sources import tables as t


def _each(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_urls(spark):
    given = [" https://a.org/x#y ", "a.org/x", "...a.org/x", "ftp://a.org", "http://", "http://a://b", "http://127.0.0.1/", "http://[fe80::1]/", "https://u:p@sub.corp:80/", "", None, "http://300.1.1.1/", "raw:x"]
    found = _each(spark, given, u.checked)
    assert [r["error"] for r in found] == [None, None, "truncated", "scheme", "domain", "protocols", "unsafe", "unsafe", "unsafe", "empty", "empty", None, None]
    assert found[0]["url"] == "https://a.org/x" and found[1]["url"] == "https://a.org/x"
    assert _each(spark, ["...a.org/x", "a.org"], u.truncation_hints) == [["https://www.a.org/x", "https://a.org/x", "http://www.a.org/x", "http://a.org/x"], None]
    assert _each(spark, ["https://github.com/o/r.git", "https://github.com/o", "https://x.org/o/r"], u.repository) == [("o", "r"), None, None]
    assert _each(spark, ["<urlset><url><loc> a </loc></url><url/></urlset>", "<sitemapindex><sitemap><loc>b</loc></sitemap></sitemapindex>", "<urlset", ""], u.sitemap_locations) == [["a"], ["b"], [], []]


def test_markdown(spark):
    md = "before ```py\ncode here\n``` middle ```no language here``` after ```open"
    found = _each(spark, [md, "", "no fence"], lambda v: x.code_blocks(v, least=1))
    assert [tuple(b) for b in found[0]] == [("py", "code here\n", "before", "middle ```no language here``` after ```open"), ("", "no language here", "before ```py\ncode here\n``` middle", "after ```open")]
    assert found[1:] == [[], []]
    assert _each(spark, ["# A\ntext\n## B c\n#none", ""], x.headers) == ["# A; ## B c", ""]
    assert _each(spark, ['["a", "b"]', "[not json", "one"], x.list_argument) == [["a", "b"], ["[not json"], ["one"]]
    assert _each(spark, ["2 GiB", "512K", "x"], x.megabytes) == [2048.0, 0.5, None]


def test_parameters(spark):
    cases = [([], 0, []), (["a:int"], 0, ["a"]), (["a:int"], 2, []), (["a:int", "*args"], 5, []), (["a:int"], 1, ["z"]), (["a:int", "**kw"], 1, ["z"]), (["[keyword_only] k:int"], 0, []), (["[keyword_only] k:int"], 0, ["k"]), (["self"], 0, [])]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(cases)], "i int, e array<string>, n int, k array<string>").select("i", c.parameters(F.col("e"), F.col("n"), F.col("k")).alias("r")).collect()
    assert [tuple(r["r"]) for r in sorted(rows)] == [("UNCERTAIN", 0.5), ("INVALID", 0.8), ("INVALID", 0.8), ("VALID", 0.9), ("INVALID", 0.7), ("VALID", 0.9), ("INVALID", 0.8), ("VALID", 0.9), ("VALID", 0.9)]


def test_equal_rows_stay(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 1), (3, 2)], "a int, b int")
    assert sorted(map(tuple, g.join_any_key(left, right, "k", ("a", "b")).collect())) == [(1, 1, 1), (1, 1, 1), (2, 3, 2)]


def test_empty_tables(spark):
    old = spark.createDataFrame([], "url string, chunk_number long, content string, source_id string")
    new = spark.createDataFrame([("http://www.a.org/x", 1, "c", None)] * 2, old.schema)
    out = t.add_documents(t.documents(old), new).collect()
    assert len(out) == 1 and out[0]["source_id"] == "a.org"
    assert t.known_urls(new, old).collect()[0]["known"] is False


def test_method_ladder(spark):
    symbols = spark.createDataFrame([("M", "f", ["a:int"])], "module string, symbol string, expected array<string>")
    cases = [(None, "f", 1), ("N", "f", 1), ("M", "g", 1), ("M", "f", 2), ("M", "f", 1), ("M", "g", 1)]
    uses = spark.createDataFrame([(i, "method", *v, []) for i, v in enumerate(cases)], "i int, kind string, module string, symbol string, n_args int, kwargs array<string>")
    checked = c.methods(uses, symbols, symbols)
    assert [(r["status"], r["confidence"]) for r in checked.orderBy("i").collect()] == [("UNCERTAIN", 0.3), ("UNCERTAIN", 0.8), ("NOT_FOUND", 0.1), ("INVALID", 0.8), ("VALID", 0.9), ("NOT_FOUND", 0.1)]
    assert sorted(map(tuple, c.hallucinations(checked, "module").collect())) == [("M", "f", "INVALID_PARAMETERS"), ("M", "g", "METHOD_NOT_FOUND")]


def test_addresses_inside_a_network_in_any_spelling(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions import urls as u

    inside = ["::1", "0:0:0:0:0:0:0:1", "0::1", "0000:0000:0000:0000:0000:0000:0000:0001", "::", "0:0::0", "::ffff:8.8.8.8", "0:0:0:0:0:ffff:7f00:1", "::127.0.0.1", "fd12::1", "FC00:0::", "fe80::1%eth0", "febf::", "2001:db8::5", "2001:0DB8:0:0::5", "1:2", "1:2:3:4:5:6:7:8:9", "g::1", ":::"]
    outside = ["2001:4860:4860::8888", "2606:4700:0:0:0:0:0:1111", "fec0::1", "2001:db9::"]
    rows = spark.createDataFrame([(x,) for x in inside + outside], "name string").select("name", u.safe_host(F.col("name")).alias("safe"), u.checked(F.concat(F.lit("http://["), "name", F.lit("]/x")))["valid"].alias("valid")).collect()
    assert {r["name"] for r in rows if r["safe"]} == set(outside)
    assert {r["name"] for r in rows if r["valid"]} == set(outside)
