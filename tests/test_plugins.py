from pyspark.sql import functions as F

from gossamer.plans.plugins import Extractor, Plugins, register_page_links


def test_plugins(spark):
    seen = []
    plugins = Plugins(
        filters={"no pdf": lambda u: ~u.endswith(".pdf"), "https": lambda u: u.startswith("https:")},
        extractors=[Extractor("size", lambda u: u.contains("a.com"), lambda h, u: F.length(h))],
        handlers={"one": lambda df, e: seen.append((e, df.count())), "two": lambda df, e: seen.append((e, -1))},
    )
    urls = spark.createDataFrame([("https://a.com/x",), ("https://a.com/x.pdf",), ("http://a.com/",)], "normalized string")
    assert [r[0] for r in plugins.filtered(urls).collect()] == ["https://a.com/x"]
    assert Plugins().filtered(urls).count() == 3
    pages = spark.createDataFrame([("https://a.com/", "<a href=/x>1</a><a href=/y>2</a>"), ("https://b.com/", "")], "url string, html string")
    assert {r["url"]: r["size"] for r in plugins.extracted(pages).collect()} == {"https://a.com/": 32, "https://b.com/": None}
    plugins.handle(pages, 7)
    assert seen == [(7, 2), (7, -1)]
    register_page_links(spark)
    pages.createOrReplaceTempView("plugin_pages")
    rows = spark.sql("SELECT p.url, l.* FROM plugin_pages p, LATERAL page_links(p.html, p.url) l ORDER BY position").collect()
    assert [r["link"] for r in rows] == ["https://a.com/x", "https://a.com/y"]
