"""Registered queries and their DuckDB equivalents. Every query reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.config import EngineConfig
from gossamer.functions import html as H
from gossamer.functions import keys
from gossamer.functions import text as T
from gossamer.functions import url as U
from gossamer.functions.bloom import Bloom
from gossamer.operators import dedup, frontier, metrics, politeness, search
from gossamer.plans import crawl
from gossamer.sources import pages as P
from gossamer.sources import seeds, storage
from gossamer.session import ensure_checkpoint_dir
from gossamer.streaming import crawl_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _millis() -> Column:
    """Milliseconds of the events' zone-less timestamps, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")


# ---- inputs shared by queries, each with its SQL twin ----

_R = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"
_TRACKING = "|".join(U.TRACKING_PARAMETERS)


def _norm_sql(source: str, column: str, names: str) -> str:
    """SQL for the canonical form of the URLs in ``column``, for inputs without dot segments, users and escapes."""
    return f"""
SELECT {names}, host, scheme || '://' || host || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized FROM (
  SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(auth, ':80$', '') ELSE regexp_replace(auth, ':443$', '') END AS host,
    CASE WHEN length(flat) > 1 THEN regexp_replace(array_to_string(list_transform(string_split(flat, ''), lambda c: CASE WHEN regexp_matches(c, '[^ -~]') THEN url_encode(c) ELSE c END), ''), '/$', '') ELSE '/' END AS p,
    array_to_string(list_sort(list_filter(string_split(substr(query, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^({_TRACKING})$') AND NOT regexp_matches(split_part(x, '=', 1), '(?i)(session|sid|jsession|phpsess)'))), '&') AS q
  FROM (SELECT *, lower(regexp_extract({column}, {_R}, 1)) AS scheme, lower(regexp_extract({column}, {_R}, 2)) AS auth,
      regexp_replace(regexp_extract({column}, {_R}, 3), '/+', '/', 'g') AS flat, regexp_extract({column}, {_R}, 4) AS query FROM {source}))"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs as a queue: arrival by page_id, priority by its remainder."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("raw"), F.lit(0).alias("depth"), (F.col("page_id") % 5).cast("int").alias("priority"), F.lit("").alias("source_url"))
    return frontier.first_of_batch(frontier.canonical(rows))


_QUEUE = f"norm AS ({_norm_sql('pages', 'url', 'page_id, url')}), queue AS (SELECT normalized, min(page_id) AS seq, arg_min(host, page_id) AS host, (min(page_id) % 5)::INT AS priority FROM norm GROUP BY normalized)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a crawl log."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("user_id") % 4).alias("worker_id"), F.concat(F.lit("https://h"), "user_id", F.lit(".com/"), "event_type").alias("url"), F.concat(F.lit("h"), "user_id").alias("host"),
        F.when(failed, F.when(F.col("event_id") % 2 == 0, 503).otherwise(0)).otherwise(200).alias("status_code"), F.when(failed & (F.col("event_id") % 2 == 1), F.concat(F.lit("dial: Connection refused "), "event_id")).otherwise("").alias("error"),
        F.col("value").alias("fetch_seconds"), (F.col("event_id") * 37 % 100_000).cast("int").alias("content_length"), (F.col("event_id") % 7).cast("int").alias("links_count"), (F.col("event_id") % 12).cast("int").alias("depth"),
        F.when(failed, "failed").when(F.col("event_type") == "signup", "duplicate").when(F.col("event_type") == "view", "blocked").otherwise("completed").alias("outcome"), "ts",
    )


_LOG = """log AS (SELECT event_id AS seq, 'w' || (user_id % 4) AS worker_id, 'https://h' || user_id || '.com/' || event_type AS url, 'h' || user_id AS host,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 0 END ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'dial: Connection refused ' || event_id ELSE '' END AS error, value AS fetch_seconds,
  (event_id * 37 % 100000)::INT AS content_length, (event_id % 7)::INT AS links_count, (event_id % 12)::INT AS depth,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'duplicate' WHEN 'view' THEN 'blocked' ELSE 'completed' END AS outcome, ts FROM events)"""


# ---- URLs and the frontier ----


@query(_norm_sql("pages", "url", "page_id"))
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = U.url_struct("url")
    return table(spark, sf_dir, "pages").select("page_id", u["host"].alias("host"), u["normalized"].alias("normalized"))


@query(f"WITH norm AS ({_norm_sql('pages', 'url', 'page_id')}) SELECT page_id, sha256(normalized) AS url_hash, lower(regexp_matches(normalized, 'angular|react|vue|ember|backbone')::VARCHAR) = 'true' AS scripted FROM norm")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.seen_key("url").alias("url_hash"), U.requires_js(U.normalize_url("url")).alias("scripted"))


@query(f"""WITH raws AS (SELECT page_id * 3 + i AS seq, CASE i WHEN 0 THEN url WHEN 1 THEN url || '#again' ELSE upper(regexp_extract(url, '^[a-z]+')) || regexp_replace(url, '^[a-z]+', '') END AS raw FROM pages, range(3) t(i)),
norm AS ({_norm_sql('raws', 'raw', 'seq, raw')}) SELECT normalized, sha256(normalized) AS url_hash, min(seq) AS seq FROM norm GROUP BY normalized""")
def url_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = F.array(F.col("url"), F.concat("url", F.lit("#again")), F.concat(F.upper(F.regexp_extract("url", "^[a-z]+", 0)), F.regexp_replace("url", "^[a-z]+", "")))
    raws = table(spark, sf_dir, "pages").select("page_id", F.posexplode(variants).alias("i", "raw")).select((F.col("page_id") * 3 + F.col("i")).alias("seq"), "raw")
    return frontier.first_of_batch(frontier.canonical(raws)).select("normalized", "url_hash", "seq")


@query(f"WITH {_QUEUE} SELECT host, count(*) AS pending, arg_max(priority, seq) AS score FROM queue GROUP BY host")
def frontier_host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.host_scores(_queue(spark, sf_dir)).select("host", "pending", "score")


@query(f"WITH {_QUEUE} SELECT normalized, host, row_number() OVER (PARTITION BY host ORDER BY seq) AS position FROM queue")
def frontier_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.host_queue(_queue(spark, sf_dir)).select("normalized", "host", F.col("position").cast("long").alias("position"))


@query(f"WITH {_QUEUE} SELECT host, 'frontier:host:' || host AS queue_key, 'politeness:' || host AS politeness_key, count(*) AS depth FROM queue GROUP BY host")
def state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.queue_depth(_queue(spark, sf_dir)).select("host", keys.key("host_queue", "host").alias("queue_key"), keys.key("politeness", "host").alias("politeness_key"), "depth")


@query(f"WITH {_QUEUE} SELECT seq, normalized, host, priority FROM queue")
def queue_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue items out as JSON and in again."""
    return storage.queue_from_json(storage.queue_to_json(_queue(spark, sf_dir))).select("seq", "normalized", "host", "priority")


_NOW = 20_000
_POLITE = "polite AS (SELECT host, max(length(normalized)) * 500 AS last_fetch_ms FROM queue GROUP BY host)"


@query(f"""WITH {_QUEUE}, {_POLITE}, scores AS (SELECT host, arg_max(priority, seq) AS score FROM queue GROUP BY host),
top AS (SELECT * FROM scores ORDER BY score, host LIMIT 101), ready AS (SELECT top.* FROM top JOIN polite USING (host) WHERE {_NOW} > last_fetch_ms + 1000)
SELECT host, arg_min(normalized, seq) AS normalized, any_value(score) AS score FROM queue JOIN ready USING (host) GROUP BY host""")
def frontier_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    return frontier.next_batch(queue, _polite(queue), _NOW).select("host", "normalized", "score")


def _polite(queue: DataFrame) -> DataFrame:
    return queue.groupBy("host").agg((F.max(F.length("normalized")) * 500).cast("long").alias("last_fetch_ms")).withColumn("delay_ms", F.lit(None).cast("long"))


@query(f"""WITH {_QUEUE}, {_POLITE}, scores AS (SELECT host, arg_max(priority, seq) AS score FROM queue GROUP BY host),
top AS (SELECT * FROM scores ORDER BY score, host LIMIT 101), ready AS (SELECT top.* FROM top JOIN polite USING (host) WHERE {_NOW} > last_fetch_ms + 1000 ORDER BY score, host LIMIT 1)
SELECT host, arg_min(normalized, seq) AS normalized FROM queue JOIN ready USING (host) GROUP BY host""")
def frontier_next_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    return frontier.next_url(queue, _polite(queue), _NOW).select("host", "normalized")


@query(f"WITH {_QUEUE}, {_POLITE} SELECT host, count(*) AS pending, any_value(last_fetch_ms)::BIGINT AS last_fetch_ms FROM queue JOIN polite USING (host) WHERE host = (SELECT min(host) FROM queue) GROUP BY host")
def frontier_host_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    host = queue.agg(F.min("host")).first()[0]
    return frontier.host_view(queue, _polite(queue), host).select("host", "pending", "last_fetch_ms")


@query(f"""WITH {_LOG}, {_QUEUE}, h AS (SELECT count(DISTINCT host) AS hosts FROM queue) SELECT (SELECT count(*) FROM queue) AS total_pending, (SELECT hosts FROM h) AS hosts,
count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed, (SELECT CASE WHEN hosts <= 20 THEN hosts ELSE 0 END FROM h)::BIGINT AS shown FROM log""")
def frontier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.frontier_stats(_queue(spark, sf_dir), _log(spark, sf_dir)).withColumn("shown", F.size("shown").cast("long"))


@query("""SELECT lower(n_name) AS host, n_nationkey * 1000 + 86400000 AS expires_ms FROM nation WHERE n_nationkey * 1000 + 86400000 > 86410000 AND n_name <> 'CHINA'
UNION ALL SELECT lower(n_name), 90000000 + 86400000 FROM nation WHERE n_nationkey * 1000 + 86400000 <= 86410000 OR n_name = 'CHINA'""")
def robots_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules expire after a day; one host's are dropped by hand; what is missing is fetched anew."""
    hosts = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("host"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /x\n").alias("body"), (F.col("n_nationkey") * 1000).cast("long").alias("fetched_ms"))
    kept = politeness.invalidate_robots(politeness.robots_table(hosts), ["china"])
    again = hosts.withColumn("fetched_ms", F.lit(90_000_000).cast("long"))
    return politeness.prefetch_robots(kept, hosts.select("host"), again, 86_410_000).select("host", "expires_ms")


@query(f"""WITH {_QUEUE}, r AS (SELECT *, regexp_replace(normalized, '^[^:/?#]+://[^/?#]*', '') AS path FROM queue)
SELECT normalized, NOT starts_with(path, '/s') OR starts_with(path, '/st') AS allowed, 2000::BIGINT AS crawl_delay_ms FROM r""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    bodies = queue.select("host").distinct().select("host", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /s\nAllow: /st\nCrawl-delay: 2\n").alias("body"), F.lit(0).cast("long").alias("fetched_ms"))
    return politeness.with_robots(queue, politeness.robots_table(bodies)).select("normalized", "allowed", "crawl_delay_ms")


@query("""WITH k AS (SELECT event_id, 'h' || user_id AS host, epoch_us(ts) // 1000 AS arrival_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS k FROM events)
SELECT event_id AS seq, host, arrival_ms, k * 3600000 + max(arrival_ms - k * 3600000) OVER (PARTITION BY host ORDER BY arrival_ms, event_id ROWS UNBOUNDED PRECEDING) AS dispatch_ms FROM k""")
def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("h"), "user_id").alias("host"), _millis().alias("arrival_ms"))
    return politeness.schedule(rows, 3_600_000).select("seq", "host", "arrival_ms", "dispatch_ms")


@query(f"""WITH {_LOG}, b AS (SELECT *, (status_code = 429 OR status_code >= 500)::INT AS bad FROM log), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY host ORDER BY seq) AS block FROM b)
SELECT seq, host, least(1000 * power(2, sum(bad) OVER (PARTITION BY host, block ORDER BY seq)), 60000)::BIGINT AS delay_ms FROM g""")
def backoff_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return politeness.backoff_states(_log(spark, sf_dir)).select("seq", "host", "delay_ms")


@query("""WITH raws AS (SELECT page_id AS seq, url AS raw FROM pages UNION ALL SELECT page_id + 1000000000, regexp_replace(url, '^https?', 'ftp') FROM pages UNION ALL SELECT page_id + 2000000000, url || '#x' FROM pages)
SELECT (SELECT count(*) FROM raws) AS submitted, count(DISTINCT normalized) AS added, (SELECT 2 * count(*) FROM pages) - count(DISTINCT normalized) AS skipped, (SELECT count(*) FROM pages) AS invalid FROM (""" + _norm_sql("pages", "url", "page_id") + ")")
def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    row = lambda shift, raw: pages.select((F.col("page_id") + shift).alias("seq"), raw.alias("raw"))
    raws = row(0, F.col("url")).unionByName(row(1_000_000_000, F.regexp_replace("url", "^https?", "ftp"))).unionByName(row(2_000_000_000, F.concat("url", F.lit("#x"))))
    return seeds.seed_report(seeds.seed_status(raws, spark.createDataFrame([], "url_hash string")))


@query("SELECT page_id AS seq, regexp_replace(url, '^https?', 'ftp') || ': unsupported scheme' AS message FROM pages")
def seed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.regexp_replace("url", "^https?", "ftp").alias("raw"))
    return seeds.seed_errors(seeds.seed_status(raws, spark.createDataFrame([], "url_hash string")))


@query("SELECT url AS raw FROM pages WHERE url <> '' AND NOT starts_with(url, '#')")
def seed_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs written as a file with blank lines, comments and white space around, and read back."""
    folder = _folder(spark, "seeds")
    lines = F.array(F.concat(F.lit(" \t"), "url", F.lit("\u2003 ")), F.lit("\t# a note"), F.lit(" \r"))
    table(spark, sf_dir, "pages").select(F.explode(lines)).write.text(folder)
    return seeds.seed_file(spark, folder).select("raw")


_PATHS = {"/a/b/../c": "/a/c", "/a/./b/.": "/a/b", "/../../x": "/x", "/a/b/c/../..": "/a", "/": "/", "": "", "/a/..": "", "/x/../../y/": "/y/", "/...": "/..."}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PATHS.items()) + ") v(path, flat)")
def url_dot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", U.resolve_dot_segments("path").alias("flat"))


@query(f"WITH norm AS ({_norm_sql('pages', 'url', 'page_id')}) SELECT page_id, normalized, host, sha256(normalized) AS url_hash, 2 AS depth, 7 AS priority, host IN ('twitter.com', 'x.com', 'instagram.com', 'facebook.com', 'linkedin.com') OR regexp_matches(normalized, '(?i)(app\\.|spa\\.|dashboard\\.)') AS scripted FROM norm")
def url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL records with all their parts, and whether their hosts are known to need a browser."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.url_row("url", 2, 7, "seed").alias("u"))
    return rows.select("page_id", "u.normalized", "u.host", U.url_hash("u.normalized").alias("url_hash"), "u.depth", "u.priority", U.requires_js_by_host("u.normalized").alias("scripted"))


@query(f"WITH {_QUEUE} SELECT (SELECT count(DISTINCT normalized) FROM queue) AS urls, 0::BIGINT AS missed, true AS close, true AS few_false")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter of all queued URLs: none is missed, its count is within 5 %, and few others seem to be in it."""
    urls = _queue(spark, sf_dir).select("normalized")
    n = urls.distinct().count()
    bloom = Bloom.of(urls, "normalized", max(n, 1_000), 0.01)
    told = [bloom.might_contain(r[0]) for r in urls.toLocalIterator()]
    false = sum(bloom.might_contain(f"https://never.seen/{i}") for i in range(2_000))
    return spark.createDataFrame([(n, told.count(False), abs(bloom.count() - n) <= 0.05 * n + 1, false <= 60)], "urls long, missed long, close boolean, few_false boolean")


# ---- pages ----

_LINKS = rf"""hrefs AS (SELECT page_id, url, generate_subscripts(l, 1) AS pos, unnest(l) AS href FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda h: trim(replace(replace(h, '&quot;', '"'), '&amp;', '&'))) AS l FROM pages)),
resolved AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:]+://[^/?#]*') || href
  ELSE regexp_extract(url, '^[^:]+://[^/?#]*') || coalesce(nullif(regexp_replace(regexp_extract(url, {_R}, 3), '[^/]*$', ''), ''), '/') || href END AS abs FROM hrefs WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(javascript:|mailto:|tel:|data:|#|about:|blob:)')),
plain AS (SELECT page_id, pos, array_to_string(list_transform(string_split(regexp_replace(abs, '#.*$', ''), ''), lambda c: CASE WHEN regexp_matches(c, '[^ -~]') THEN url_encode(c) ELSE c END), '') AS link FROM resolved),
links AS (SELECT page_id, link, min(pos) AS pos FROM plain GROUP BY page_id, link)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", H.parse_html("html", "url").alias("p"))


@query(r"SELECT page_id, coalesce(nullif(trim(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&')), ''), '') AS title FROM pages".replace('\\"', '"'))
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("page_id", F.col("p.title").alias("title"))


@query(f"WITH {_LINKS} SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS position FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("page_id", F.posexplode("p.links").alias("position", "link"))
    return rows.select("page_id", "link", F.col("position").cast("long").alias("position"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?is)<(script|style|noscript|iframe|nav|footer|header|aside)\b.*?</(script|style|noscript|iframe|nav|footer|header|aside)>', '', 'g'), '(?is)<!--.*?-->|<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS content FROM b""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("page_id", F.col("p.content").alias("content"))


def _plain_sql(markup: str) -> str:
    """The text of some markup: tags and comments out, entities in, white space collapsed."""
    out = f"regexp_replace({markup}, '(?is)<!--.*?-->|<[^>]*>', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g'))"


_NO_CONTENT = "'(?is)<(script|style|noscript|iframe|nav|footer|header|aside)\\b.*?</(script|style|noscript|iframe|nav|footer|header|aside)>', '', 'g'"


@query(f"""WITH m AS (SELECT page_id, url, replace(replace(html, '</title>', '</title><meta name="Description" content="page ' || page_id || '"><meta property="og:type" content="article"><link rel="canonical" href="' || url || '">'),
  '<article>', '<article><img src="/i/' || page_id || '.png"><img src="data:,x"><h2> Part ' || page_id || ' </h2>') AS html FROM pages),
t AS (SELECT page_id, url, {_plain_sql("regexp_extract(html, '(?is)<article>(.*?)(?:</article>|$)', 1)")} AS main, {_plain_sql(f"regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), {_NO_CONTENT})")} AS whole,
  trim({_plain_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}) AS h1 FROM m)
SELECT page_id, 'canonical=' || url || ';description=page ' || page_id || ';og:type=article' AS metadata, 'Part ' || page_id || CASE WHEN h1 <> '' THEN '|' || h1 ELSE '' END AS headings,
  regexp_extract(url, '^[^:]+://[^/?#]*') || '/i/' || page_id || '.png' AS images, CASE WHEN strlen(main) > 100 THEN main ELSE whole END AS main_content FROM t""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, headings, images and main content of each page, after some markup has been added to it."""
    head = F.concat(F.lit('</title><meta name="Description" content="page '), "page_id", F.lit('"><meta property="og:type" content="article"><link rel="canonical" href="'), "url", F.lit('">'))
    part = F.concat(F.lit('<article><img src="/i/'), "page_id", F.lit('.png"><img src="data:,x"><h2> Part '), "page_id", F.lit(" </h2>"))
    marked = table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.replace(F.col("html"), F.lit("</title>"), head), F.lit("<article>"), part).alias("html"))
    p = marked.select("page_id", H.parse_html("html", "url").alias("p"))
    entries = F.array_sort(F.transform(F.map_entries("p.metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return p.select("page_id", F.array_join(entries, ";").alias("metadata"), F.array_join("p.headings", "|").alias("headings"), F.array_join("p.images", "|").alias("images"), "p.main_content")


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'unsupported content type: image/png' WHEN octet_length(encode(html)) > 4000 THEN 'body too large' ELSE '' END AS error, octet_length(encode(html))::INT AS content_length FROM pages")
def page_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "image/png").otherwise("Application/XHTML+xml")
    rows = P.responses(table(spark, sf_dir, "pages").withColumn("content_type", kind))
    return P.guarded(rows, EngineConfig(max_body_bytes=4_000)).select("page_id", "error", "content_length")


@query(f"WITH {_LINKS}, norm AS ({_norm_sql('(SELECT page_id, link FROM links)', 'link', 'page_id, link')}), own AS ({_norm_sql('pages', 'url', 'page_id')}) SELECT normalized, min(page_id) AS first_page, 1 AS depth FROM norm WHERE normalized NOT IN (SELECT normalized FROM own) GROUP BY normalized")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _records(spark, sf_dir).select(F.col("page_id").alias("seq"), "url", "p.links", F.lit(0).alias("depth"), F.lit(0).alias("priority"))
    links = frontier.expand_links(pages, EngineConfig().max_depth).withColumnRenamed("order", "seq")
    seen = frontier.canonical(pages.select(F.col("url").alias("raw")))
    return frontier.add_urls(links, seen).select("normalized", F.col("seq.seq").alias("first_page"), "depth")


@query(f"WITH norm AS ({_norm_sql('pages', 'url', 'page_id')}) SELECT page_id, CASE WHEN regexp_matches(lower(normalized), 'angular|react|vue|ember|backbone') THEN 'dynamic' ELSE 'static' END AS route FROM norm")
def js_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.render_route(U.normalize_url("url")).alias("route"))


@query("SELECT 'html/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.html.gz' AS path, substr(sha256(html), 1, 2) AS prefix, any_value(strlen(html))::BIGINT AS bytes FROM pages GROUP BY sha256(html)")
def raw_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.raw_rows(table(spark, sf_dir, "pages").withColumn("content_hash", T.content_hash("html")))
    return rows.select("path", "prefix", F.octet_length("html").cast("long").alias("bytes"))


@query("WITH o AS (SELECT sha256(html) AS h, any_value(strlen(html)) AS n FROM pages GROUP BY 1) SELECT count(*) - 1 AS objects, (sum(n) - arg_min(n, h))::BIGINT AS bytes, false AS deleted_exists FROM o")
def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bodies stored, twice over, and one deleted again: what the store holds then."""
    folder = _folder(spark, "raw")
    rows = table(spark, sf_dir, "pages").withColumn("content_hash", T.content_hash("html"))
    first = rows.agg(F.min("content_hash")).first()[0]
    storage.store_raw(rows, folder)
    storage.store_raw(rows, folder)
    storage.delete_raw(spark, folder, [first])
    return storage.raw_stats(spark, folder).select("objects", F.col("bytes").cast("long").alias("bytes"), F.lit(storage.raw_exists(spark, folder, first)).alias("deleted_exists"))


@query("WITH h AS (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS domain FROM pages) SELECT domain, count(*) AS pages FROM h GROUP BY domain ORDER BY pages DESC, domain LIMIT 10")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_domains(table(spark, sf_dir, "pages").select(U.extract_host("url").alias("domain")))


@query(f"""WITH {_LINKS}, n AS (SELECT page_id, count(*) AS links FROM links GROUP BY page_id),
own AS ({_norm_sql('pages', 'url', 'page_id, html')}), firsts AS (SELECT arg_min(host, page_id) AS host, min(page_id) AS page_id FROM own GROUP BY sha256(html))
SELECT host, count(*) AS pages, coalesce(sum(links), 0)::BIGINT AS links, min(page_id) AS first_page FROM firsts LEFT JOIN n USING (page_id) GROUP BY host""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed once, exact copies dropped, reported by host."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", "html", U.extract_host(U.normalize_url("url")).alias("host")).withColumn("content_hash", T.content_hash("html"))
    firsts = dedup.exact_first(pages)
    parsed = firsts.select("host", "seq", F.size(H.parse_html("html", "url")["links"]).cast("long").alias("links"))
    return parsed.groupBy("host").agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.min("seq").alias("first_page"))


def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the table of pages, seeded with all of them, under robots rules of their hosts: outcomes by host."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(U.extract_host(U.normalize_url("url")).alias("host")).distinct()
    bodies = hosts.select("host", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /t\nAllow: /th\n").alias("body"), F.lit(0).cast("long").alias("fetched_ms"))
    start = pages.select(F.col("page_id").alias("seq"), F.col("url").alias("raw"), F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit("").alias("source_url"))
    state = crawl.crawl(start, pages.select("url", "html"), politeness.robots_table(bodies), EngineConfig(max_depth=1))
    return state.log.groupBy("host", "outcome").agg(F.count("*").alias("urls"))


@query(f"WITH RECURSIVE {_LINKS}, own AS ({_norm_sql('pages', 'url', 'page_id, url')}), w AS (SELECT normalized AS url, 0 AS depth FROM own UNION SELECT l.link, 1 FROM links l) SELECT url, min(depth)::INT AS depth FROM w GROUP BY url")
def link_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select(U.normalize_url("url").alias("src"), F.explode("p.links").alias("dst"))
    starts = table(spark, sf_dir, "pages").select(U.normalize_url("url").alias("url"))
    return crawl.reachable(starts, rows, EngineConfig().max_depth)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT page_id % 997 AS src, unnest([(page_id * 31 + 7) % 997, (page_id * page_id + 1) % 997, (page_id + 1) % 997]) AS dst FROM pages),
w AS (SELECT min(page_id) % 997 AS node, 0 AS depth FROM pages UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 4) SELECT node::VARCHAR AS url, min(depth)::INT AS depth FROM w GROUP BY node""")
def reach_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first depths, up to 4, from the first page over a made graph with many cycles."""
    p, n = F.col("page_id"), 997
    ends = F.explode(F.array((p * 31 + 7) % n, (p * p + 1) % n, (p + 1) % n))
    edges = table(spark, sf_dir, "pages").select((p % n).cast("string").alias("src"), ends.alias("dst")).withColumn("dst", F.col("dst").cast("string"))
    return crawl.reachable(table(spark, sf_dir, "pages").agg((F.min("page_id") % n).cast("string").alias("url")), edges, 4)


# ---- texts ----

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda t: strlen(t) > 2)"


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), T.content_hash("text").alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("seq").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "content_hash", "copies")


@query("SELECT sha256(text) AS content_hash, max(doc_id) + CASE WHEN bool_or(lang = 'de') THEN 1000000000000 ELSE 0 END AS doc_id, bool_or(lang = 'de') AS again FROM documents GROUP BY sha256(text)")
def index_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table merged twice: all documents, then new rows for those that are German."""
    folder = _folder(spark, "upserts")
    docs = table(spark, sf_dir, "documents").select(T.content_hash("text").alias("content_hash"), "doc_id", "lang")
    storage.upsert(folder, docs.select("content_hash", "doc_id", F.lit(False).alias("again")), seq="doc_id")
    german = docs.groupBy("content_hash").agg(F.max("doc_id").alias("doc_id"), F.bool_or(F.col("lang") == "de").alias("again")).where("again")
    storage.upsert(folder, german.withColumn("doc_id", F.col("doc_id") + 1_000_000_000_000), seq="doc_id")
    return storage.read_table(spark, folder).select("content_hash", "doc_id", "again")


@query("SELECT sha256(text) AS content_hash, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY sha256(text)")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(T.content_hash("text").alias("content_hash"), "doc_id", "source")
    return storage.last_write(docs, seq="doc_id")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents) SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct, greatest(len(tokens) - 2, 0)::BIGINT AS n_shingles, len(list_distinct(list_transform(range(1, greatest(len(tokens) - 1, 1)), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2])))::BIGINT AS n_distinct_shingles FROM t")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokenize("text").alias("t"))
    s = t.select("doc_id", "t", T.shingles("t", 3).alias("s"))
    n = lambda c: F.size(c).cast("long")
    return s.select("doc_id", n("t").alias("n_tokens"), n(F.array_distinct("t")).alias("n_distinct"), n("s").alias("n_shingles"), n(F.array_distinct("s")).alias("n_distinct_shingles"))


_FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, len(b) // 2 + 1), lambda i: ('0x' || substr(b, 2 * i - 1, 2))::UHUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"WITH n AS (SELECT DISTINCT p_name AS token, hex(encode(p_name)) AS b FROM part) SELECT token, (CASE WHEN f >= 9223372036854775808::UHUGEINT THEN f::HUGEINT - 18446744073709551616::HUGEINT ELSE f::HUGEINT END)::BIGINT AS fnv FROM (SELECT token, {_FNV_SQL} AS f FROM n)")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("token")).distinct().select("token", T.fnv1a64("token").alias("fnv"))


def _simhash_sql(source: str = "documents", tokens: str = _TOKENS) -> str:
    return f"""toks AS (SELECT doc_id, unnest({tokens}) AS token FROM {source}), tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY ALL),
voc AS (SELECT token, hex(encode(token)) AS b FROM (SELECT DISTINCT token FROM tf)), hashed AS (SELECT token, ({_FNV_SQL})::UBIGINT AS f FROM voc),
bits AS (SELECT doc_id, i, sum(CASE WHEN (f >> i) & 1::UBIGINT = 1::UBIGINT THEN tf ELSE -tf END) AS v FROM tf JOIN hashed USING (token), (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY doc_id, i),
sim AS (SELECT d.doc_id, (CASE WHEN coalesce(h, 0) >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE coalesce(h, 0)::HUGEINT END)::BIGINT AS simhash
  FROM {source} d LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END)::UHUGEINT AS h FROM bits GROUP BY doc_id) USING (doc_id))"""


_SIMHASH = _simhash_sql()
#: Of the fingerprints in ``sim``, by their first row: each is kept unless a kept earlier one is near.
_GREEDY = """firsts AS MATERIALIZED (SELECT h, s, row_number() OVER (ORDER BY s) AS n FROM (SELECT simhash AS h, min(doc_id) AS s FROM sim GROUP BY simhash)),
greedy(n, hs, ids) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT f.n, CASE WHEN near THEN hs ELSE list_append(hs, h) END, CASE WHEN near THEN ids ELSE list_append(ids, s) END
  FROM (SELECT f.n, f.h, f.s, g.hs, g.ids, len(list_filter(g.hs, lambda k: bit_count(xor(k, f.h)) <= 3)) > 0 AS near FROM greedy g JOIN firsts f ON f.n = g.n + 1) f),
kept AS (SELECT unnest(ids) AS doc_id FROM greedy WHERE n = (SELECT count(*) FROM firsts))"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.simhash("text").alias("simhash"))


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sim")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir)


@query(f"WITH {_SIMHASH}, d AS (SELECT DISTINCT simhash AS h FROM sim) SELECT a.h AS h1, b.h AS h2, bit_count(xor(a.h, b.h))::INT AS distance FROM d a JOIN d b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 3")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_signed(spark, sf_dir), 3, "simhash", "doc_id")


@query(f"WITH RECURSIVE {_SIMHASH}, {_GREEDY} SELECT doc_id FROM kept")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_keep(_signed(spark, sf_dir), 3, "simhash", "doc_id").select("doc_id")


@query(f"""WITH RECURSIVE {_SIMHASH}, {_GREEDY}, x AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text))
SELECT d.doc_id, CASE WHEN x.doc_id IS NULL THEN 'exact' WHEN k.doc_id IS NULL THEN 'near' ELSE 'none' END AS duplicate FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN kept k USING (doc_id)""")
def content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document checked against all before it: by digest, then by fingerprint."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), T.content_hash("text").alias("content_hash"), T.simhash("text").alias("simhash"))
    return dedup.check_and_store(rows).select(F.col("seq").alias("doc_id"), "duplicate")


@query(f"WITH {_SIMHASH} SELECT (SELECT count(DISTINCT sha256(text)) FROM documents) AS exact, count(DISTINCT simhash) AS simhashes FROM sim")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signature_stats(table(spark, sf_dir, "documents").select(T.content_hash("text").alias("content_hash"), T.simhash("text").alias("simhash")))


@query("SELECT p_partkey, bit_count(xor(p_partkey, p_partkey * 7))::INT AS distance, bit_count(xor(p_partkey, p_partkey * 7)) <= 5 AS similar FROM part")
def hamming_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("p_partkey") * 7
    return table(spark, sf_dir, "part").select("p_partkey", T.hamming_distance("p_partkey", other).cast("int").alias("distance"), T.is_similar("p_partkey", other, 5).alias("similar"))


@query(f"WITH base AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS w FROM documents), {_simhash_sql('base', "CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END")} SELECT doc_id, simhash FROM sim")
def simhash_by_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.simhash_shingles(3)("text").alias("simhash"))


def _crawl_oracle() -> str:
    """A page is blocked, kept or a copy; links of kept pages that are no pages fail, or are blocked where a page's host forbids them."""
    barred = "starts_with(regexp_replace(normalized, '^[^:/?#]+://[^/?#]*', ''), '/t') AND NOT starts_with(regexp_replace(normalized, '^[^:/?#]+://[^/?#]*', ''), '/th')"
    content = _plain_sql(f"regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), {_NO_CONTENT})")
    return f"""WITH RECURSIVE {_LINKS}, base AS ({_norm_sql('pages', 'url', 'page_id, url, html')}), own AS MATERIALIZED (SELECT normalized, min(host) AS host, min(page_id) AS seq, arg_min(page_id, url) AS page_id, arg_min(html, url) AS html FROM base GROUP BY normalized), judged AS (SELECT *, {barred} AS barred FROM own),
body AS MATERIALIZED (SELECT seq AS doc_id, {content} AS text FROM judged WHERE NOT barred AND seq IN (SELECT min(seq) FROM judged WHERE NOT barred GROUP BY sha256(html))), {_simhash_sql('body')}, {_GREEDY},
linked AS ({_norm_sql('(SELECT page_id, link FROM links WHERE page_id IN (SELECT page_id FROM judged WHERE seq IN (SELECT doc_id FROM kept)))', 'link', 'page_id, link')}),
found AS (SELECT DISTINCT normalized, host, host IN (SELECT host FROM own) AND {barred} AS barred FROM linked WHERE normalized NOT IN (SELECT normalized FROM own)),
log AS (SELECT host, CASE WHEN barred THEN 'blocked' WHEN seq IN (SELECT doc_id FROM kept) THEN 'completed' ELSE 'duplicate' END AS outcome FROM judged UNION ALL SELECT host, CASE WHEN barred THEN 'blocked' ELSE 'failed' END FROM found)
SELECT host, outcome, count(*) AS urls FROM log GROUP BY ALL"""


query(_crawl_oracle())(crawl_rounds)


_QUERY = "from have you"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("url"), F.concat(F.lit("doc "), "source").alias("title"), F.col("text").alias("content"), F.lit("").alias("meta_description"), F.col("lang").alias("domain"), F.lit(None).cast("timestamp").alias("crawled_at"))


def _bm25_sql(domain: str = "", page: str = "LIMIT 10", columns: str = "", order: str = "max(s) DESC, url") -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    words = lambda c: f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '' AND t NOT IN ({stop}))"
    return f"""WITH f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS url, lang AS domain, 'content' AS field, 1.0 AS boost, {words("coalesce(text, '')")} AS w FROM documents
UNION ALL SELECT lpad(doc_id::VARCHAR, 12, '0'), lang, 'title', 2.0, {words("'doc ' || source")} FROM documents),
st AS (SELECT field, count(*) AS docs, avg(len(w)) AS mean FROM f WHERE len(w) > 0 GROUP BY field), q AS (SELECT unnest({words("'" + _QUERY + "'")}) AS term),
hit AS (SELECT * FROM (SELECT url, domain, field, boost, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM f, (SELECT DISTINCT term FROM q)) WHERE tf > 0),
df AS (SELECT field, term, count(*) AS df FROM hit GROUP BY field, term),
s AS (SELECT url, domain, field, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) * boost) AS s FROM hit JOIN df USING (field, term) JOIN st USING (field) GROUP BY url, domain, field)
SELECT url, round(max(s), 6) AS score{columns} FROM s {domain} GROUP BY url ORDER BY {order} {page}"""


@query(_bm25_sql())
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_indexed(spark, sf_dir), _QUERY).select("url", F.round("score", 6).alias("score"))


@query(_bm25_sql("WHERE domain = 'en'"))
def search_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_indexed(spark, sf_dir), _QUERY, domain="en").select("url", F.round("score", 6).alias("score"))


def _search_index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.Index.build(_indexed(spark, sf_dir), _folder(spark, "index"))


@query(_bm25_sql(page="LIMIT 10 OFFSET 5", columns=", true AS marked"))
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of results from a stored index, with marked snippets."""
    rows = _search_index(spark, sf_dir).search(_QUERY, offset=5)
    return rows.select("url", F.round("score", 6).alias("score"), F.col("snippet").contains("<em>").alias("marked"))


@query(_bm25_sql("WHERE domain = 'de'", "LIMIT 7", order="url DESC"))
def search_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_index(spark, sf_dir).search(_QUERY, domain="de", size=7, sort_by="url").select("url", F.round("score", 6).alias("score"))


@query("SELECT lpad(doc_id::VARCHAR, 12, '0') AS url, 'doc ' || source AS title, text AS content FROM documents ORDER BY doc_id LIMIT 1")
def search_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _indexed(spark, sf_dir)
    return search.get_by_url(pages, pages.agg(F.min("url")).first()[0]).select("url", "title", "content")


@query(r"SELECT count(*) AS total FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: t IN ('have', 'you', 'from'))) > 0")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total_hits(_indexed(spark, sf_dir), _QUERY)


# ---- crawl log ----


@query(f"WITH {_LOG} SELECT worker_id, CASE WHEN error = '' AND status_code BETWEEN 200 AND 399 THEN 'success' ELSE 'error' END AS status, count(*) AS value FROM log GROUP BY ALL")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fetch_status(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT worker_id, CASE WHEN error = '' THEN 'http_' || (status_code // 100) || 'xx' WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), 'dns') THEN 'dns' WHEN contains(lower(error), 'connection') THEN 'connection' WHEN contains(lower(error), 'tls') THEN 'tls' ELSE 'other' END AS error_type, count(*) AS value FROM log WHERE NOT (error = '' AND status_code BETWEEN 200 AND 399) GROUP BY ALL")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_counts(_log(spark, sf_dir))


def _histogram_sql(value: str, bounds: list[float]) -> str:
    return f"WITH {_LOG}, b AS (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in bounds)}, 'Infinity'::DOUBLE]) AS le) SELECT worker_id, round(le, 4) AS le, count(*) FILTER ({value} <= le) AS bucket_count, count(*) AS count FROM log, b GROUP BY ALL"


@query(_histogram_sql("fetch_seconds", metrics.FETCH_SECONDS))
def fetch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_log(spark, sf_dir), "fetch_seconds", metrics.FETCH_SECONDS, "worker_id").select("worker_id", F.round("le", 4).alias("le"), "bucket_count", "count")


@query(_histogram_sql("content_length", metrics.CONTENT_BYTES))
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_log(spark, sf_dir), "content_length", metrics.CONTENT_BYTES, "worker_id").select("worker_id", F.round("le", 4).alias("le"), "bucket_count", "count")


@query(f"WITH {_LOG} SELECT worker_id, sum(links_count)::BIGINT AS value FROM log WHERE links_count > 0 AND depth < 10 GROUP BY worker_id")
def links_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.links_extracted(_log(spark, sf_dir), 10)


@query(f"WITH {_LOG} SELECT count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'blocked') AS blocked, 0::BIGINT AS scripted, count(DISTINCT worker_id) AS workers FROM log")
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    one = lambda df, name: df.select(F.col("value").alias(name))
    return one(metrics.duplicates(log), "duplicates").crossJoin(one(metrics.blocked(log), "blocked")).crossJoin(one(metrics.js_required(log), "scripted")).crossJoin(one(metrics.active_workers(log, "1970-01-01"), "workers"))  # one row each


@query(f"WITH {_LOG} SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, count(*) AS pages, count(*) / 60.0::DOUBLE AS pages_per_second, count(*) FILTER (outcome = 'failed') / count(*)::DOUBLE AS error_rate FROM log GROUP BY 1")
def pages_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.outcome_rates(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT worker_id, count(*) AS pages, count(*) FILTER (outcome = 'failed') AS errors, min(ts) AS started_at, max(ts) AS last_seen FROM log GROUP BY worker_id")
def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worker_stats(_log(spark, sf_dir))


@query(f"WITH {_LOG}, {_QUEUE} SELECT (SELECT count(*) FROM queue) AS pending, (SELECT count(DISTINCT host) FROM queue) AS hosts, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed, (SELECT count(*) FROM pages) AS indexed FROM log")
def status_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.composite(_queue(spark, sf_dir), _log(spark, sf_dir), table(spark, sf_dir, "pages"))


@query("SELECT CASE event_type WHEN 'error' THEN 'storage' ELSE 'index' END AS storage, event_type AS operation, CASE WHEN value > 10 THEN 'error' ELSE 'success' END AS status, count(*) AS value FROM events GROUP BY ALL")
def storage_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("event_type") == "error", "storage").otherwise("index").alias("storage"), F.col("event_type").alias("operation"), F.when(F.col("value") > 10, "error").otherwise("success").alias("status"))
    return metrics.storage_operations(rows)


@query(f"WITH {_QUEUE} SELECT count(DISTINCT normalized) AS urls, true AS close FROM queue")
def seen_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate number of seen URLs, and whether it is within 5 % of the exact one."""
    queue = _queue(spark, sf_dir)
    both = metrics.approximate_seen(queue).crossJoin(queue.agg(F.countDistinct("url_hash").alias("urls")))  # one row each
    return both.select("urls", (F.abs(F.col("approx") - F.col("urls")) <= 0.05 * F.col("urls")).alias("close"))


# ---- streams, driven to their end over the table's files ----


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's result, by way of files that all executors share."""
    folder = _folder(stream.sparkSession, name)
    crawl_stream.sink(stream, folder, mode).start().awaitTermination()
    return crawl_stream.result(stream.sparkSession, folder, stream.schema, mode)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) AS start, count(*) AS events, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("outcome"), F.concat(F.lit("h"), "user_id").alias("host"))
    return _drained(crawl_stream.periodic_stats(log), "stream_stats", "complete").select("start", "events", "failed")


@query(f"WITH norm AS ({_norm_sql('pages', 'url', 'page_id')}) SELECT DISTINCT normalized FROM norm")
def stream_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _stream(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("raw"))
    return _drained(crawl_stream.new_urls(urls), "stream_seen").select("normalized")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT 'h' || user_id AS host, event_id AS seq, epoch_us(ts) // 1000 AS arrival_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (SELECT host, seq, k, arrival_ms AS dispatch_ms, CASE bad WHEN 1 THEN 2000 ELSE 1000 END::BIGINT AS delay_ms FROM e WHERE k = 1
  UNION ALL SELECT e.host, e.seq, e.k, greatest(e.arrival_ms, s.dispatch_ms + s.delay_ms), CASE e.bad WHEN 1 THEN least(s.delay_ms * 2, 60000) ELSE 1000 END::BIGINT FROM s JOIN e ON e.host = s.host AND e.k = s.k + 1)
SELECT host, seq, dispatch_ms, delay_ms FROM s""")
def stream_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-host dispatch with back-off, as keyed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _stream(spark, sf_dir, "events").select(F.concat(F.lit("h"), "user_id").alias("host"), F.col("event_id").alias("seq"), F.col("event_type").alias("url"), _millis().alias("arrival_ms"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"))
    return _drained(crawl_stream.dispatch(rows), "stream_dispatch").select("host", "seq", "dispatch_ms", "delay_ms")


def _batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> DataFrame:
    """The versioned table that a batch function leaves."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return storage.read_table(stream.sparkSession, folder)


@query("SELECT sha256(text) AS content_hash, max(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stream_upserts")
    rows = _stream(spark, sf_dir, "documents").select(T.content_hash("text").alias("content_hash"), F.col("doc_id").alias("seq"))
    return _batches(rows, folder, crawl_stream.upsert_sink(folder)).select("content_hash", F.col("seq").alias("doc_id"))


@query(f"WITH RECURSIVE {_SIMHASH}, {_GREEDY} SELECT doc_id FROM kept")
def stream_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stream_near_dedup")
    rows = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), T.content_hash("text").alias("content_hash"), F.col("text").alias("content"))
    return _batches(rows, folder, crawl_stream.near_dedup_sink(folder)).select(F.col("seq").alias("doc_id"))
