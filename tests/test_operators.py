import itertools
import random

import pytest
from pyspark.sql import functions as F

from gossamer.config import EngineConfig
from gossamer.operators import dedup, frontier, metrics, politeness, search
from gossamer.plans import crawl
from gossamer.sources import pages as P
from gossamer.sources import seeds as S
from gossamer.sources import storage


def seeds_of(spark, urls):
    return S.seed_urls(spark, urls)


def test_add_urls(spark):
    urls = ["https://a.com/1", "HTTPS://A.com/1/", "bad", "https://b.com/", "https://a.com/2"]
    first = frontier.add_urls(seeds_of(spark, urls), spark.createDataFrame([], "url_hash string"))
    assert [(r["seq"], r["normalized"]) for r in first.orderBy("seq").collect()] == [(0, "https://a.com/1"), (3, "https://b.com/"), (4, "https://a.com/2")]
    again = frontier.add_urls(seeds_of(spark, urls), first)
    assert again.isEmpty()


def test_seed_reports(spark, tmp_path):
    seen = frontier.canonical(seeds_of(spark, ["https://known.com/"]))
    status = S.seed_status(seeds_of(spark, ["https://known.com", "https://n.com/a", "https://n.com/a#x", "ftp://x"]), seen)
    assert {r["seq"]: r["status"] for r in status.collect()} == {0: "exists", 1: "added", 2: "exists", 3: "invalid"}
    assert S.seed_report(status).first().asDict() == {"submitted": 4, "added": 1, "skipped": 2, "invalid": 1}
    assert [r["message"] for r in S.seed_errors(status).collect()] == ["ftp://x: unsupported scheme"]
    (tmp_path / "s.txt").write_text(" https://a.com \n\n\t# no\n\u2003https://b.com\t\n")
    assert [r["raw"] for r in S.seed_file(spark, str(tmp_path / "s.txt")).orderBy("seq").collect()] == ["https://a.com", "https://b.com"]


def queue_of(spark, rows):
    return spark.createDataFrame([(s, h, p, f"{h}{s}") for s, h, p in rows], "seq long, host string, priority int, url_hash string")


def test_next_batch(spark):
    q = queue_of(spark, [(1, "a", 5), (2, "b", 1), (3, "a", 0), (4, "c", 2), (5, "c", 9)])
    scores = {r["host"]: (r["score"], r["pending"]) for r in frontier.host_scores(q).collect()}
    assert scores == {"a": (0, 2), "b": (1, 1), "c": (9, 2)}
    polite = spark.createDataFrame([("a", 1000, 500), ("b", 1000, None)], "host string, last_fetch_ms long, delay_ms long")
    got = lambda now: [(r["host"], r["seq"]) for r in frontier.next_batch(q, polite, now).orderBy("score", "host").collect()]
    assert got(1500) == [("c", 4)]
    assert got(1501) == [("a", 1), ("c", 4)]
    assert got(2001) == [("a", 1), ("b", 2), ("c", 4)]
    assert frontier.next_url(q, polite, 2001).first()["seq"] == 1
    assert frontier.next_batch(q, polite, 9999, EngineConfig(host_window=1)).count() == 1
    taken = frontier.next_batch(q, polite, 1501)
    assert {r["host"]: (r["last_fetch_ms"], r["delay_ms"]) for r in frontier.touch(polite, taken, 1501).collect()} == {"a": (1501, 500), "b": (1000, 1000), "c": (1501, 1000)}
    assert frontier.without_taken(q, taken).count() == 3
    assert [r["position"] for r in frontier.host_queue(q).orderBy("seq").collect()] == [1, 1, 2, 1, 2]


@pytest.mark.parametrize("hosts", ["xyz", "x" * 9 + "y"])
def test_schedule_matches_simulation(spark, hosts):
    """Also where one host has nine rows of ten, and so several pieces."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(hosts), rnd.randint(0, 3000)) for i in range(400)]
    got = {r["seq"]: r["dispatch_ms"] for r in politeness.schedule(spark.createDataFrame(rows, "seq long, host string, arrival_ms long"), 100).collect()}
    last = {}
    for seq, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
        last[host] = max(at, last[host] + 100) if host in last else at
        assert got[seq] == last[host]


def test_backoff(spark):
    rows = [(i, "h", s) for i, s in enumerate([200, 500, 429, 503, 200, 500] + [500] * 8)]
    got = [r["delay_ms"] for r in politeness.backoff_states(spark.createDataFrame(rows, "seq long, host string, status_code int")).orderBy("seq").collect()]
    assert got == [1000, 2000, 4000, 8000, 1000, 2000, 4000, 8000, 16000, 32000, 60000, 60000, 60000, 60000]


def test_backoff_and_queue_of_a_hot_host(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot"] * 9 + ["b", None]), rnd.choice([200, 200, 500, 503, 429, None])) for i in range(600)]
    log = spark.createDataFrame(rows, "seq long, host string, status_code int").repartition(5)
    got = {r["seq"]: r["delay_ms"] for r in politeness.backoff_states(log).collect()}
    positions = {r["seq"]: r["position"] for r in frontier.host_queue(log).collect()}
    streak, count = {}, {}
    for seq, host, status in rows:
        bad = status is not None and (status == 429 or status >= 500)
        streak[host] = streak.get(host, 0) + 1 if bad else 0
        count[host] = count.get(host, 0) + 1
        assert (got[seq], positions[seq]) == (min(60_000, 1000 * 2 ** streak[host]), count[host])
    assert len(got) == len(positions) == 600


def test_robots(spark):
    bodies = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /x\nCrawl-delay: 3", 0), ("b.com", 404, "User-agent: *\nDisallow: /", 0)], "host string, status int, body string, fetched_ms long")
    table = politeness.robots_table(bodies)
    urls = spark.createDataFrame([("a.com", "https://a.com/x/1"), ("a.com", "https://a.com/y"), ("b.com", "https://b.com/x"), ("c.com", "https://c.com/x")], "host string, normalized string")
    assert {r["normalized"]: r["allowed"] for r in politeness.with_robots(urls, table).collect()} == {"https://a.com/x/1": False, "https://a.com/y": True, "https://b.com/x": True, "https://c.com/x": True}
    assert politeness.valid_robots(table, 24 * 3600 * 1000).count() == 0 and politeness.valid_robots(table, 5).count() == 2
    assert [r["host"] for r in politeness.invalidate_robots(table, ["a.com"]).collect()] == ["b.com"]
    hosts = spark.createDataFrame([("a.com",), ("c.com",), ("d.com",)], "host string")
    later = spark.createDataFrame([("a.com", 200, "", 7), ("c.com", 200, "User-agent: *\nDisallow: /c*d\nDisallow: /end$", 7)], "host string, status int, body string, fetched_ms long")
    fetched = politeness.prefetch_robots(table, hosts, later, 5)
    assert {r["host"]: r["expires_ms"] for r in fetched.collect()} == {"a.com": 24 * 3600 * 1000, "b.com": 24 * 3600 * 1000, "c.com": 24 * 3600 * 1000 + 7}
    more = spark.createDataFrame([("c.com", f"https://c.com{p}") for p in ("/cxd", "/c", "/end", "/end2", "/^x")], "host string, normalized string")
    assert [r["allowed"] for r in politeness.with_robots(more, fetched).orderBy("normalized").collect()] == [True, True, False, False, True]
    polite = spark.createDataFrame([("a.com", 5, None), ("z.com", 5, 7000)], "host string, last_fetch_ms long, delay_ms long")
    assert frontier.host_view(queue_of(spark, [(1, "a.com", 1), (2, "a.com", 1)]), polite, "a.com").first().asDict() == {"host": "a.com", "pending": 2, "last_fetch_ms": 5, "delay_ms": None}
    assert frontier.host_view(queue_of(spark, [(1, "b.com", 1)]), polite, "none.com").first().asDict() == {"host": "none.com", "pending": 0, "last_fetch_ms": None, "delay_ms": None}
    assert {r["host"]: r["delay_ms"] for r in politeness.host_delays(polite, table).collect()} == {"a.com": 3000, "b.com": 1000, "z.com": 7000}


def greedy(rows, distance):
    kept = []
    for seq, h in sorted(rows):
        if all((h ^ k) .bit_count() > distance for _, k in kept):
            kept.append((seq, h))
    return {s for s, _ in kept}


def test_greedy_and_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for seq in range(120):
        base = rnd.choice([0, 0xFFFF, 0x123456789ABC, 1 << 62])
        for _ in range(rnd.randint(0, 5)):
            base ^= 1 << rnd.randint(0, 62)
        rows.append((seq, base))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, simhash long")
    assert {r["seq"] for r in dedup.greedy_keep(df, 3).collect()} == greedy(rows, 3)
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(rows, 2) if (a[1] ^ b[1]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in dedup.near_row_pairs(df, 3).collect()} == want
    assert {r["seq"] for r in dedup.greedy_keep(df.repartition(3), 3).collect()} == greedy(rows, 3)
    as_set = lambda b: {(r["h1"], r["h2"]) for r in dedup.near_pairs(df, 3, blocks=b).collect()}
    assert as_set(4) == as_set(6) == as_set(7)


def test_greedy_in_ranges(spark, monkeypatch):
    """Large classes are taken in ranges of arrival, and pairs are made with what is kept only."""
    monkeypatch.setattr(dedup, "_AT_ONCE", 10)
    made = []
    plain = dedup._first_wins
    monkeypatch.setattr(dedup, "_first_wins", lambda edges, most: made.append(edges.count()) or plain(edges, most))
    rng = random.Random(5)
    centre = rng.getrandbits(62)
    rows = [(i, centre ^ sum({1 << rng.randrange(62) for _ in range(rng.randint(0, 3))}) if i % 2 else rng.getrandbits(62)) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, simhash long").repartition(5)
    assert {r["seq"] for r in dedup.greedy_keep(df, 3).collect()} == greedy(rows, 3)
    assert len(made) == 4 and sum(made) < dedup.near_pairs(df, 3).count() / 3
    near = dedup.near_pairs(df, 3)
    assert near.count() == near.select("h1", "h2").distinct().count()


def test_greedy_does_not_stop_early(spark):
    df = spark.createDataFrame([(i, (1 << 3 * i) - 1) for i in range(7)], "seq long, simhash long")
    assert {r["seq"] for r in dedup.greedy_keep(df, 3).collect()} == {0, 2, 4, 6}
    with pytest.raises(RuntimeError):
        dedup.greedy_keep(df, 3, max_rounds=2)
    assert [dedup.blocks_for(n, 3) for n in (1000, 10**6, 10**9, 10**11)] == [4, 5, 6, 8]


def test_check_and_store(spark):
    rows = [(1, "h1", 0), (2, "h1", 0), (3, "h2", 1), (4, "h3", 0b1111), (5, "h4", 0b1110000000)]
    got = {r["seq"]: r["duplicate"] for r in dedup.check_and_store(spark.createDataFrame(rows, "seq long, content_hash string, simhash long")).collect()}
    assert got == {1: "none", 2: "exact", 3: "near", 4: "none", 5: "near"}
    new = [(11, "h1", 0), (12, "n1", 3), (13, "n2", 0xFFFF << 40), (14, "n2", 0xFFFF << 40), (15, "n3", (0xFFFF << 40) + 1), (16, "n4", 0b1110000001)]
    history = spark.createDataFrame([("h1", 0), ("h3", 0b1111)], "content_hash string, simhash long")
    got = {r["seq"]: r["duplicate"] for r in dedup.check_and_store(spark.createDataFrame(new, "seq long, content_hash string, simhash long"), history=history).collect()}
    assert got == {11: "exact", 12: "near", 13: "none", 14: "exact", 15: "near", 16: "none"}
    kept = spark.createDataFrame(rows, "seq long, content_hash string, simhash long")
    assert dedup.signature_stats(kept).first().asDict() == {"exact": 4, "simhashes": 4}


SITE = {
    "https://s.com/": '<title>Root page</title><a href="/a">a</a><a href="/b?utm_source=x">b</a><a href="/private">p</a>' + "root words " * 9,
    "https://s.com/a": '<title>Alpha</title><a href="/c">c</a><a href="/">r</a>' + "alpha crawler text about spiders " * 5,
    "https://s.com/b": '<title>Beta</title><a href="/gone">g</a>' + "beta something entirely different here " * 5,
    "https://s.com/c": '<title>Gamma</title><a href="/d">d</a>' + "gamma deep page content with other words " * 5,
    "https://s.com/d": "<title>Delta</title>" + "delta deepest page nobody reaches " * 5,
    "https://s.com/private": "<title>No</title>secret",
}


def test_crawl(spark):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    robots = politeness.robots_table(spark.createDataFrame([("s.com", 200, "User-agent: *\nDisallow: /private", 0)], "host string, status int, body string, fetched_ms long"))
    state = crawl.crawl(seeds_of(spark, ["https://s.com", "https://s.com/#again"]), pages, robots, EngineConfig(max_depth=2))
    log = {r["normalized"]: r["outcome"] for r in state.log.collect()}
    assert log == {"https://s.com/": "completed", "https://s.com/a": "completed", "https://s.com/b": "completed", "https://s.com/private": "blocked", "https://s.com/c": "completed", "https://s.com/gone": "failed"}
    depth = {r["url"]: r["depth"] for r in state.stored.collect()}
    assert depth == {"https://s.com/": 0, "https://s.com/a": 1, "https://s.com/b": 1, "https://s.com/c": 2}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    assert {r["url"]: r["depth"] for r in crawl.reachable(spark.createDataFrame([("a",)], "url string"), edges, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    full = spark.createDataFrame([(str(a), str(b)) for a in range(12) for b in range(12)] + [("11", "x"), ("x", "y"), (None, "z")], "src string, dst string")
    depths = {r["url"]: r["depth"] for r in crawl.reachable(spark.createDataFrame([("0",), (None,)], "url string"), full, 9).collect()}
    assert depths == {"0": 0, **{str(n): 1 for n in range(1, 12)}, "x": 2, "y": 3}


def parsed_site(spark):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "seq long, url string, html string")
    return P.parsed(rows)


def test_parsed_and_guards(spark):
    rows = spark.createDataFrame([(1, "https://x.com/", "<title>T</title>hi", "image/png"), (2, "https://x.com/2", "x" * 50, "text/html")], "seq long, url string, html string, content_type string")
    got = {r["seq"]: r for r in P.parsed(rows, EngineConfig(max_body_bytes=40)).collect()}
    assert got[1]["error"] == "unsupported content type: image/png" and got[1]["content_hash"] == "" and got[1]["content_length"] == 18
    assert got[2]["error"] == "body too large" and got[2]["links"] == []
    ok = parsed_site(spark).where("url = 'https://s.com/a'").first()
    assert ok["title"] == "Alpha" and ok["links"] == ["https://s.com/c", "https://s.com/"] and ok["domain"] == "s.com" and len(ok["content_hash"]) == 64 and ok["links_count"] == 2


def test_search(spark, tmp_path):
    pages = parsed_site(spark).cache()
    rows = search.search(pages, "Alpha the spiders").collect()
    assert [r["url"] for r in rows] == ["https://s.com/a"] and "<em>spiders</em>" in rows[0]["snippet"]
    assert search.search(pages, "page", size=2).count() == 2 and search.search(pages, "page", size=0).count() == 0
    assert search.search(pages, "the").count() == 0 and search.search(pages, "alpha", domain="no.com").count() == 0
    assert search.total_hits(pages, "words").first()["total"] == 2
    assert search.postings(pages).where("term = 'spiders' and field = 'content'").first()["tf"] == 5
    assert search.get_by_url(pages, "https://s.com/b").first()["title"] == "Beta"
    assert [r["url"] for r in search.search(pages, "page words", sort_by="url", descending=False).collect()][0] == "https://s.com/"
    index = search.Index.build(pages, str(tmp_path / "index"))
    for query in ("Alpha the spiders", "page words", "the", "nothing"):
        assert index.search(query).collect() == search.search(pages, query).collect()
        assert index.total_hits(query, "s.com").collect() == search.total_hits(pages, query, "s.com").collect()
    every = [r["url"] for r in index.search("page words text").collect()]
    assert [r["url"] for r in index.search("page words text", offset=1, size=2).collect()] == every[1:3] and len(every) > 2
    assert index.search("page", domain="no.com").count() == 0


def test_storage(spark, tmp_path):
    pages = parsed_site(spark)
    raw, index = str(tmp_path / "raw"), str(tmp_path / "index")
    storage.store_raw(pages, raw)
    storage.store_raw(pages, raw)
    h = pages.where("url = 'https://s.com/a'").first()["content_hash"]
    assert storage.raw_stats(spark, raw).first()["objects"] == 6
    assert storage.raw_body(spark, raw, h).first()["html"] == SITE["https://s.com/a"] and storage.raw_exists(spark, raw, h)
    storage.delete_raw(spark, raw, [h])
    assert not storage.raw_exists(spark, raw, h) and storage.raw_stats(spark, raw).first()["objects"] == 5
    rows = storage.index_rows(pages)
    storage.upsert(index, rows)
    storage.upsert(index, rows.where("url = 'https://s.com/b'").withColumn("title", F.lit("new")).withColumn("seq", F.lit(99).cast("long")))
    stored = {r["url"]: r["title"] for r in storage.read_table(spark, index).collect()}
    assert len(stored) == 6 and stored["https://s.com/b"] == "new" and stored["https://s.com/a"] == "Alpha"
    # a writer that was lost leaves a part without the mark: it does not count, and the next writer replaces it
    (tmp_path / "index" / "version-3").mkdir()
    assert storage.versions(spark, index)[-1] == 2 and storage.read_table(spark, index).count() == 6
    storage.upsert(index, rows.limit(1))
    assert storage.versions(spark, index) == [2, 3]
    # a deletion that was lost between its two renames
    prefix = h[:2] if (tmp_path / "raw" / f"prefix={h[:2]}").exists() else next(p.name for p in (tmp_path / "raw").glob("prefix=*")).removeprefix("prefix=")
    (tmp_path / "raw" / f"prefix={prefix}").rename(tmp_path / "raw" / f"_before-prefix={prefix}")
    storage.repair_raw(spark, raw)
    assert storage.raw_stats(spark, raw).first()["objects"] == 5
    q = spark.createDataFrame([(1, "u", "n", "x", "h", 0, 1, "")], "seq long, raw string, normalized string, url_hash string, host string, depth int, priority int, source_url string")
    assert storage.queue_from_json(storage.queue_to_json(q)).first()["priority"] == 1


LOG = "seq long, worker_id string, url string, host string, status_code int, error string, fetch_seconds double, content_length int, links_count int, depth int, outcome string, ts timestamp"


def test_metrics(spark):
    from datetime import datetime

    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    log = spark.createDataFrame(
        [(1, "w1", "https://react.io/", "a", 200, "", 0.15, 3000, 4, 0, "completed", at(1)), (2, "w1", "https://b.com/", "b", 404, "", 0.5, 100, 0, 0, "failed", at(30)),
         (3, "w2", "https://c.com/", "c", 0, "Timeout", 0.0, 0, 2, 10, "failed", at(70)), (4, "w2", "https://d.com/", "c", 200, "", 9.0, 2000, 2, 1, "duplicate", at(80))], LOG)
    assert {(r["worker_id"], r["status"]): r["value"] for r in metrics.fetch_status(log).collect()} == {("w1", "success"): 1, ("w1", "error"): 1, ("w2", "error"): 1, ("w2", "success"): 1}
    assert {r["error_type"] for r in metrics.error_counts(log).collect()} == {"http_4xx", "timeout"}
    hist = {round(r["le"], 1): r["bucket_count"] for r in metrics.histogram(log, "fetch_seconds", metrics.FETCH_SECONDS).collect()}
    assert hist[0.1] == 1 and hist[0.2] == 2 and hist[0.8] == 3 and hist[float("inf")] == 4
    assert {r["worker_id"]: r["value"] for r in metrics.links_extracted(log, 10).collect()} == {"w1": 4, "w2": 2}
    assert metrics.duplicates(log).first()["value"] == 1 and metrics.blocked(log).first()["value"] == 0 and metrics.js_required(log).first()["value"] == 1
    rates = metrics.outcome_rates(log).orderBy("start").collect()
    assert [r["pages"] for r in rates] == [2, 2] and rates[0]["error_rate"] == 0.5
    assert metrics.active_workers(log, "2024-01-01 00:01:00").first()["value"] == 1
    assert metrics.worker_stats(log).where("worker_id = 'w2'").first()["errors"] == 1
    q = queue_of(spark, [(1, "a", 5), (2, "b", 1), (3, "a", 0)])
    assert metrics.composite(q, log, log).first().asDict() == {"pending": 3, "hosts": 2, "completed": 1, "failed": 2, "indexed": 4}
    stats = frontier.frontier_stats(q, log).first()
    assert stats["total_pending"] == 3 and stats["shown"] == {"a": 2, "b": 1}
    many = queue_of(spark, [(i, f"h{i}", 1) for i in range(21)])
    assert frontier.frontier_stats(many, log).first()["shown"] == {} and frontier.frontier_stats(many.where("seq > 0"), log).first()["shown"]["h20"] == 1


def test_clear_queue(spark):
    for name in ("frontier_queue", "frontier_taken", "seen_urls", "robots_rules"):
        spark.range(5).write.mode("overwrite").saveAsTable(name)
    assert frontier.stored_tables(spark, "frontier*") == ["frontier_queue", "frontier_taken"]
    assert frontier.clear_queue(spark) == 2
    assert [spark.table(n).count() for n in ("frontier_queue", "frontier_taken", "seen_urls", "robots_rules")] == [0, 0, 0, 5]
    for name in ("frontier_queue", "frontier_taken", "seen_urls", "robots_rules"):
        spark.sql(f"DROP TABLE {name}")


def test_postings_need_no_shuffle(spark, tmp_path):
    """Terms are counted within their row; the index is written in segments, whose statistics are those of a scan."""
    texts = ["b a b the a b", None, "", "the of", " ".join(str(i % 7) for i in range(100)), "one"]
    pages = spark.createDataFrame([(f"u{i}", t, t, None, "d", None) for i, t in enumerate(texts)], "url string, title string, content string, meta_description string, domain string, crawled_at timestamp").repartition(3)
    made = search.postings(pages)
    assert "Exchange" not in made._jdf.queryExecution().optimizedPlan().toString().replace("Repartition", "") and "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["url"], r["term"]): (r["tf"], r["length"]) for r in made.where("field = 'content'").collect()}
    assert got == {("u0", "b"): (3, 3), ("u5", "one"): (1, 1)} | {("u4", str(i)): (15 if i < 2 else 14, 100) for i in range(7)}
    index = search.Index.build(pages, str(tmp_path / "index"))
    assert sorted(spark.read.parquet(f"{index.folder}/stats").collect()) == sorted(search.field_stats(pages).collect())
    for how in ({"sort_by": "domain"}, {"sort_by": "url", "descending": False, "offset": 1, "size": 1}, {"sort_by": "score"}, {}):
        assert index.search("b one 3", **how).collect() == search.search(pages, "b one 3", **how).collect()
    assert [r["url"] for r in index.search("b one 3", sort_by="url", size=2).collect()] == ["u5", "u4"]
