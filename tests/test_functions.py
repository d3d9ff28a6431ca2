import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from crawlquarry.functions import content, html, policy, urls


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


URLS = [
    "HTTPS://Example.COM/path/?z=3&a=1&m=2#anchor", "http://example.com", "http://example.com/", "http://example.com/a//", "http://e.com/a/b;p=1/", "http://e.com/a/b;p=1", "http://e.com/?a=&b&c=1", "http://e.com/x?q=a+b&q=%20c%2B~*",
    "http://U:P@E.com:80/A?b=%C3%A9", "https://e.com?x=1", "http://e.com/a?x=1&x=0", "ftp://E.com/Dir/", "http://e.com/%7Euser?x=%7E",
]


def test_normalize_equals_python(spark):
    rng = random.Random(4)
    many = URLS + [f"http://{rng.choice('aB')}.Com/{rng.choice(['', 'x/', 'Y;z', '//w'])}{rng.choice(['', '?a=1', '?b=2&a=1&c=', '?k=v%20w+u'])}{rng.choice(['', '#f'])}" for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in many], "u string").select("u", urls.normalize_url("u").alias("n"))
    for r in df.collect():
        assert r.n == html.normalize(r.u), r.u
    assert one(spark, None, urls.normalize_url("x")) is None


def test_golden_urls(spark):
    assert one(spark, URLS[0], urls.normalize_url("x")) == "https://example.com/path?a=1&m=2&z=3"
    assert one(spark, "http://e.com/a/b/c?x=1", urls.branch_key("x")) == "/a/b"
    assert one(spark, "http://e.com", urls.branch_key("x")) == "/"
    for host, want in (("www.example.com", "example.com"), ("127.0.0.1:8080", "127.0.0.1"), ("localhost", "localhost"), ("a.b.co.uk", "co.uk")):
        assert one(spark, host, urls.registrable_domain("x")) == want


@pytest.mark.parametrize("url,want", [
    ("https://e.com/go/x", "redirect_hub"), ("https://e.com/go/a/b", "generic_page"), ("https://e.com/docs/x", "document_page"), ("https://e.com/docs", "generic_page"), ("https://e.com/rfc9110.html", "document_page"),
    ("https://e.com/a/archive/b", "registry_listing"), ("https://e.com/tables", "registry_listing"), ("https://e.com/", "generic_page"), ("https://e.com/tablespoon", "generic_page"),
])
def test_archetypes(spark, url, want):
    assert one(spark, url, urls.archetype("x")) == want


@pytest.mark.parametrize("url,want", [
    ("http://e.com/", "allowed"), ("ftp://e.com/", "unsupported_scheme"), ("http:///x", "missing_host"), ("http://u@e.com/", "userinfo_not_allowed"), ("http://2130706433/", "blocked_legacy_ipv4_literal"), ("http://0x7f.0.0.1/", "blocked_legacy_ipv4_literal"),
    ("http://127.1/", "blocked_legacy_ipv4_literal"), ("http://010.0.0.1/", "blocked_legacy_ipv4_literal"), ("http://localhost/", "blocked_hostname"), ("http://a.localhost./", "blocked_hostname"), ("http://10.0.0.5/", "blocked_ip_literal"),
    ("http://100.64.0.1/", "blocked_ip_literal"), ("http://198.19.255.255/", "blocked_ip_literal"), ("http://8.8.8.8/", "allowed"), ("http://e.com:8080/", "blocked_port"), ("https://e.com:443/", "allowed"), ("http://e.com:99999/", "invalid_url"), ("http://[::1/", "invalid_url"),
])
def test_egress(spark, url, want):
    assert one(spark, url, urls.egress_reason("x")) == want


def test_blocked_ranges_equal_ipaddress(spark):
    rng = random.Random(8)
    ips = [f"{rng.choice([10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 0, 255])}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(400)]
    nets = [ipaddress.ip_network(f"{a}/{b}") for a, b in urls.BLOCKED_V4]
    for r in spark.createDataFrame([(i,) for i in ips], "x string").select("x", urls.blocked_v4(F.col("x")).alias("y")).collect():
        assert r.y == any(ipaddress.ip_address(r.x) in n for n in nets)
    v6 = {"::1": True, "[fe80::1]": True, "::ffff:8.8.8.8": True, "2606:4700::1111": False, "fd00::1": True, "e.com": False}
    for r in spark.createDataFrame([(i,) for i in v6], "x string").select("x", urls.blocked_v6("x").alias("y")).collect():
        assert r.y == v6[r.x]


def test_content_rules(spark):
    row = lambda t, n, u: spark.createDataFrame([(t, n, u)], "t string, n long, u string").select(content.fetch_reason("t", "n", "u").alias("y")).first().y
    assert row("Text/HTML; charset=x", 10, "u") == "read" and row("image/png", 1, "u") == "binary_content_type" and row("text/html", 2_000_001, "u") == "content_length_too_large"
    assert row(None, None, "http://e.com/a.PDF?x") == "binary_url_suffix" and row(None, None, "http://e.com/.gz") == "read" and row("application/vnd.ms-x+xml", 1, "u") == "read"
    for e, want in (("http_404", "http_4xx"), ("http_503", "http_5xx"), ("http_x", "http_other"), ("timeout", "timeout"), ("Server disconnected without sending a response.", "connection_error"), ("weird", "other"), ("", None), (None, None)):
        assert one(spark, e, content.error_category("x")) == want
    assert one(spark, "x  http://a.b/c u:p@h", content.redact_error("x")) == "x <redacted-url> <redacted-credentials>@h"
    assert one(spark, None, content.redact_error("x")).startswith("Observation failed")
    assert one(spark, '<html><noscript></noscript>' + "x" * 900, content.needs_browser("x")) and one(spark, "<p>" + "x " * 400 + "</p>", content.needs_browser("x")) is False
    assert one(spark, "<TITLE a>\n Hi </title>", content.title("x")) == "Hi"
    assert one(spark, "<meta name='robots' content=' NoFollow '>", content.meta_robots("x")) == "nofollow"


def test_policy(spark):
    assert [one(spark, k, policy.retry_backoff("x"), "int") for k in (0, 1, 2, 3, 9, 60)] == [30, 30, 60, 120, 1800, 1800]
    assert one(spark, 2, policy.retry_score(F.lit(1.25), "x"), "int") == 0.45 and one(spark, 9, policy.retry_score(F.lit(1.0), "x"), "int") == 0.25
    assert [one(spark, k, policy.host_backoff("x"), "int") for k in (0, 1, 2, 6)] == [0, 30, 60, 600]
    assert one(spark, [100.0, 300.0], policy.ewma_fold(F.col("x")), "array<double>") == 140
    assert one(spark, 450.0, policy.latency_penalty("x"), "double") == 2


def test_html():
    h = '<a href="/page1">One <b>two</b></a><a href="page1/#x">1</a><a href="//c.com/y">C</a><a href="mailto:x">m</a><a href="">e</a><a>n</a><a href="javascript:x">j</a>'
    assert html.anchors(h, "http://example.com/dir/current/") == [("http://example.com/page1", "One two"), ("http://example.com/dir/current/page1", "1"), ("https://c.com/y", "C")]
    doc = '<div id="m" class="a b"><p>x</p><span><p data-k="v"> y </p></span></div><p>z</p>'
    assert html.css(doc, "#m > p") == ["x"] and html.css(doc, "div p") == ["x", "y"] and html.css(doc, 'p[data-k="v"]') == ["y"] and html.css(doc, "div.b p[data-k], body", "data-k") == ["v"] and html.css(None, "p") == []


def test_html_columns(spark):
    df = spark.createDataFrame([(1, '<meta name="a" content="1"><meta property="a" content="2"><body> x <b> y </b><script>no</script></body>', "http://e.com"), (2, None, "http://e.com")], "k int, html string, url string")
    got = df.select("k", html.meta_column(F.col("html")).alias("m"), html.body_text(F.col("html")).alias("t")).orderBy("k").collect()
    assert got[0].m == {"a": "2"} and got[0].t == "xy" and got[1].m == {} and got[1].t == ""
    assert html.anchor_rows(df, key="k").count() == 0
    assert one(spark, '//div[@id="x"]/a[@href]', html.xpath_to_css("x")) == 'div[id="x"] > a[href]' and one(spark, "", html.xpath_to_css("x")) is None
