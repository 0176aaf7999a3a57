"""URL canonicalisation and classification as Column expressions, without any Python at run time.

A URL is split by the regular expression of RFC 3986, appendix B: Spark's own
parse_url rejects or alters inputs that a crawler must accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions.expr import col, let, struct

# Parameters that only track, and the pattern of session parameters (unanchored on purpose).
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
SESSION_PARAMETER = r"(?i)(session|sid|jsession|phpsess)"
# Links that are never followed; signs that a page needs JavaScript.
SKIPPED_LINK = r"(?i)^(javascript:|mailto:|tel:|data:|#|about:|blob:)"
SCRIPTED_URL = r"angular|react|vue|ember|backbone"
SCRIPTED_HOSTS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com")
SCRIPTED_HOST = r"(?i)(app\.|spa\.|dashboard\.)"

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4
UNSUPPORTED_SCHEME, EMPTY_HOST, MALFORMED = "unsupported scheme", "empty host", "malformed"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"(?s)" + _SPLIT, group)


def trimmed(raw: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(raw, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")


def collapse_slashes(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "/+", "/")


def resolve_dot_segments(path: Column | str) -> Column:
    """Remove ``.`` and ``..``; a ``..`` takes the last kept segment away unless that is empty, so it never leaves the root."""
    start = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.when((F.size(kept) > 0) & (F.element_at(kept, -1) != ""), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.concat(kept, F.array(s)))
    return F.array_join(F.aggregate(F.split(col(path), "/", -1), start, step), "/")


def _escaped_path(path: Column) -> Column:
    """Percent-encode whatever a path may not hold literally, by UTF-8 bytes."""
    one = lambda c: F.when(c.rlike(r"^[A-Za-z0-9!$&'()*+,;=:@/%\[\]._~-]$"), c).when(c == " ", "%20").otherwise(F.url_encode(c))
    return F.when(path.rlike(r"[^A-Za-z0-9!$&'()*+,;=:@/%\[\]._~-]"), F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(path)


def _query_escape(x: Column) -> Column:
    """Form encoding: space is ``+``; letters, digits and ``-_.~`` stay."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column | str) -> Column:
    """Pairs without tracking and session parameters, sorted by key and value, encoded anew; malformed pairs are dropped."""
    pairs = F.filter(F.split(col(query), "&", -1), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    decoded = F.transform(pairs, lambda p: struct(k=F.try_url_decode(F.substring_index(p, "=", 1)), v=F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("")))
    kept = F.filter(decoded, lambda x: x["k"].isNotNull() & x["v"].isNotNull() & ~F.lower(x["k"]).isin(*TRACKING_PARAMETERS) & ~x["k"].rlike(SESSION_PARAMETER))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_query_escape(x["k"]), F.lit("="), _query_escape(x["v"]))), "&")


def _host_of(authority: Column) -> Column:
    return F.lower(F.regexp_replace(authority, "^.*@", ""))


def _without_default_port(scheme: Column, host: Column) -> Column:
    return F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def _analysed(raw: Column) -> Column:
    """struct<scheme, host, path, query, error> of a raw URL; ``query`` holds its question mark."""
    bare = trimmed(raw)
    whole = F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(bare)

    def parts(u: Column) -> Column:
        bad = u.rlike(r"[\x00-\x1F\x7F]") | _part(u, _PATH).rlike("%(?![0-9A-Fa-f]{2})")
        fields = struct(scheme=F.lower(_part(u, _SCHEME)), host=_host_of(_part(u, _AUTHORITY)), path=_part(u, _PATH), query=_part(u, _QUERY), bad=bad)

        def judged(p: Column) -> Column:
            odd_host = p["host"].rlike(r"[\s<>\"\\^`{|}%]|:[^0-9\]]*[^0-9:\]][^\]]*$")
            error = F.when(p["bad"], MALFORMED).when(~p["scheme"].isin("http", "https"), UNSUPPORTED_SCHEME).when(p["host"] == "", EMPTY_HOST).when(odd_host, MALFORMED)
            return struct(**{n: p[n] for n in ("scheme", "host", "path", "query")}, error=error)

        return let(fields, judged)

    return let(whole, parts)


def url_struct(raw: Column | str) -> Column:
    """struct<normalized, host, error>: the canonical URL and its host with port; NULL and a reason where there is none."""

    def built(p: Column) -> Column:
        host = _without_default_port(p["scheme"], p["host"])
        clean = collapse_slashes(resolve_dot_segments(p["path"]))
        path = F.when(p["path"] == "", "/").otherwise(F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(F.when(clean == "", "/").otherwise(clean)))
        query = let(canonical_query(F.substr(p["query"], F.lit(2))), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.when(p["query"] == "?", "?").otherwise("")))
        query = F.when(p["query"] == "", "").otherwise(query)
        whole = F.concat(p["scheme"], F.lit("://"), host, _escaped_path(path), query)
        ok = p["error"].isNull()
        return struct(normalized=F.when(ok, whole), host=F.when(ok, host), error=p["error"])

    r = col(raw)
    return F.when(r.isNotNull(), let(_analysed(r), built))


def normalize_url(raw: Column | str) -> Column:
    """The canonical URL, or NULL where the input is none that can be crawled."""
    return url_struct(raw)["normalized"]


def extract_host(url: Column | str) -> Column:
    """Lower-case host with its port; no check of the scheme."""
    return _host_of(_part(col(url), _AUTHORITY))


def url_hash(normalized: Column | str) -> Column:
    return F.sha2(col(normalized), 256)


def seen_key(url: Column | str) -> Column:
    """The digest of the canonical form, or of the raw string where there is none."""
    u = col(url)
    return F.sha2(F.coalesce(normalize_url(u), u), 256)


def normalize_link(absolute: Column | str) -> Column:
    """The lighter form that extracted links have: query, user and trailing slash stay."""
    u = col(absolute)
    scheme, authority = F.lower(_part(u, _SCHEME)), _part(u, _AUTHORITY)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    path = F.when(_part(u, _PATH) == "", "/").otherwise(_escaped_path(_part(u, _PATH)))
    return F.concat(scheme, F.lit("://"), user, _without_default_port(scheme, _host_of(authority)), path, _part(u, _QUERY))


def should_skip_link(href: Column | str) -> Column:
    h = F.trim(col(href))
    return (h == "") | h.rlike(SKIPPED_LINK)


def resolve_relative(base: Column | str, href: Column | str) -> Column:
    """The absolute form of a reference, by RFC 3986, section 5.2."""
    b, h = col(base), col(href)
    scheme, authority, path, query = (_part(h, g) for g in (_SCHEME, _AUTHORITY, _PATH, _QUERY))
    b_scheme, b_authority, b_path, b_query = (_part(b, g) for g in (_SCHEME, _AUTHORITY, _PATH, _QUERY))
    folder = F.when(b_path == "", "/").otherwise(F.regexp_replace(b_path, "[^/]*$", ""))
    tidy = lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(resolve_dot_segments(p), F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(""))).otherwise(p)
    has_authority = h.rlike(r"^(?:[^:/?#]+:)?//")
    merged = F.when(path == "", b_path).when(path.startswith("/"), tidy(path)).otherwise(tidy(F.concat(folder, path)))
    kept_query = F.when((path == "") & (query == ""), b_query).otherwise(query)
    fragment = F.regexp_extract(h, "(?s)(#.*)$", 1)
    return F.when(scheme != "", h).when(has_authority, F.concat(b_scheme, F.lit(":"), h)).otherwise(F.concat(b_scheme, F.lit("://"), b_authority, merged, kept_query, fragment))


def requires_js(url: Column | str) -> Column:
    u = col(url)
    return F.lower(u).rlike(SCRIPTED_URL) | u.contains("/#/") | u.contains("#!/")


def requires_js_by_host(url: Column | str) -> Column:
    h = extract_host(url)
    return h.isin(*SCRIPTED_HOSTS) | h.rlike(SCRIPTED_HOST)


def error_category(error: Column | str) -> Column:
    e = F.lower(col(error))
    out = F.when(e.contains("timeout"), "timeout")
    for name in ("dns", "connection", "tls"):
        out = out.when(e.contains(name), name)
    return out.otherwise("other")


def raw_path(content_hash: Column | str) -> Column:
    """Where the raw body of a hash is stored."""
    h = col(content_hash)
    return F.concat(F.lit("html/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit(".html.gz"))


def is_success(status: Column | str, error: Column | str) -> Column:
    return (F.coalesce(col(error), F.lit("")) == "") & col(status).between(200, 399)


def url_row(raw: Column | str, depth: Column | int = 0, priority: Column | int = 0, source_url: Column | str = "", discovered_at: Column | None = None) -> Column:
    """A frontier item; its ``normalized`` is NULL where the URL is invalid."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    r = col(raw)
    none = F.array().cast("array<string>")
    found_at = (discovered_at if discovered_at is not None else F.lit(None)).cast("timestamp")
    fields = {"raw": r, "depth": lit(depth).cast("int"), "priority": lit(priority).cast("int"), "discovered_at": found_at, "source_url": lit(source_url), "metadata": F.map_from_arrays(none, none)}
    return let(url_struct(r), lambda u: struct(**fields, normalized=u["normalized"], host=u["host"], error=u["error"]))
