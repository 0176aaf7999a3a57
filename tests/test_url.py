import pytest
from pyspark.sql import functions as F

from gossamer.functions import url as U

CASES = [
    # scheme and host lose their case, the path keeps it; spaces around go
    ("hTTps://Shop.Museum.ORG/Tickets/Adult", "https://shop.museum.org/Tickets/Adult"),
    (" \thttp://river.net/map\n", "http://river.net/map"),
    ("//river.net/map", "https://river.net/map"),
    # ports
    ("http://river.net:80/", "http://river.net/"),
    ("https://river.net:443/map", "https://river.net/map"),
    ("http://river.net:443/map", "http://river.net:443/map"),
    ("https://river.net:9000/map", "https://river.net:9000/map"),
    # paths
    ("http://river.net", "http://river.net/"),
    ("http://river.net/boats/", "http://river.net/boats"),
    ("http://river.net//boats///sail", "http://river.net/boats/sail"),
    ("http://river.net/boats/./sail/../oar", "http://river.net/boats/oar"),
    ("http://river.net/one/two/three/../../four", "http://river.net/one/four"),
    ("http://river.net/../../up", "http://river.net/up"),
    ("http://river.net/f\u00fcr", "http://river.net/f%C3%BCr"),
    # fragments, users, queries
    ("http://river.net/map#north", "http://river.net/map"),
    ("http://ann:pw@river.net/map", "http://river.net/map"),
    ("http://ann@river.net/map", "http://river.net/map"),
    ("http://river.net/map?zoom=4&layer=depth&area=9", "http://river.net/map?area=9&layer=depth&zoom=4"),
    ("http://river.net/map?gclid=77&utm_campaign=may&zoom=4", "http://river.net/map?zoom=4"),
    ("http://river.net/map?residence=1&b", "http://river.net/map?b="),
    ("http://river.net/map?b=2&a=x+y&a=1", "http://river.net/map?a=1&a=x+y&b=2"),
    ("http://river.net/map?", "http://river.net/map?"),
    ("http://river.net/map?utm_term=1", "http://river.net/map"),
    ("http://river.net/map?k=~*", "http://river.net/map?k=~%2A"),
    ("\r\nhttp://ann:pw@RIVER.net:80//boats/x/../?ref=r&size=3#top ", "http://river.net/boats?size=3"),
    # not URLs that a crawler takes
    (":///nothing", None),
    ("JavaScript:go()", None),
    ("data:image/gif;base64,R0lG", None),
    ("ftp://river.net/list", None),
    ("mailto:ann@river.net", None),
    ("/boats/sail", None),
    ("../boats", None),
    ("http:///map", None),
    ("http://river.net/%zz", None),
    ("http://river.net:x1/map", None),
    ("", None),
    (None, None),
]


def test_normalize(spark):
    df = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "i int, raw string")
    got = {r["i"]: r["n"] for r in df.select("i", U.normalize_url("raw").alias("n")).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert got[i] == want, (raw, got[i], want)


@pytest.mark.parametrize(("a", "b", "equal"), [("http://river.net/map?zoom=4&area=9", "HTTP://River.net:80/map/?area=9&zoom=4", True), ("http://river.net/map", "http://river.net/maps", False)])
def test_hash(spark, a, b, equal):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(U.seen_key("a").alias("a"), U.seen_key("b").alias("b")).first()
    assert len(r["a"]) == 64 and (r["a"] == r["b"]) is equal


def test_parts(spark):
    df = spark.createDataFrame([("https://Ann@River.NET:8088/p",)], "u string")
    r = df.select(U.extract_host("u").alias("h"), U.normalize_link(F.lit("HTTP://a@B.com:80?q=1#f")).alias("l"), U.url_row("u", 2, 1, "s").alias("row")).first()
    assert r["h"] == "river.net:8088"
    assert r["l"] == "http://a@b.com/?q=1"
    assert (r["row"]["host"], r["row"]["depth"], r["row"]["priority"]) == ("river.net:8088", 2, 1)


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/quay", "https://river.net/quay"), ("tide.html", "https://river.net/boats/tide.html"), ("../quay", "https://river.net/quay"), ("?day=1", "https://river.net/boats/?day=1"),
        ("//lake.net/x", "https://lake.net/x"), ("http://lake.net/y", "http://lake.net/y"), ("./a/./b/..", "https://river.net/boats/a/"), ("", "https://river.net/boats/"),
    ],
)
def test_relative(spark, href, want):
    assert spark.range(1).select(U.resolve_relative(F.lit("https://river.net/boats/"), F.lit(href)).alias("u")).first()["u"] == want


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(U.requires_js(F.lit("https://h/September"))) and not one(U.requires_js(F.lit("https://h/x")))
    assert one(U.requires_js_by_host(F.lit("https://x.com/a"))) and one(U.requires_js_by_host(F.lit("https://my.APP.io/"))) and not one(U.requires_js_by_host(F.lit("https://h.com/")))
    assert [one(U.error_category(F.lit(e))) for e in ("Timeout hit", "DNS", "Connection refused", "bad TLS", "?")] == ["timeout", "dns", "connection", "tls", "other"]
    assert one(U.raw_path(F.lit("abcd"))) == "html/ab/abcd.html.gz"
    assert [one(U.should_skip_link(F.lit(x))) for x in ("MAILTO:x", "#a", "/a", " ")] == [True, True, False, True]
