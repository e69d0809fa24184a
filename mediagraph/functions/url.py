"""URL columns: validity, host, the key duplicates share, and parent domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediagraph.functions import fixed

# scheme, optional user part, host (or a bracketed address), port, rest
_HTTP = r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]/?#]+\]|[^:/?#\[\]@]+)(?::[^/?#]*)?(?:[/?#]|$)"
_HTTP_PORT = r"(?i)^https?://(?:[^/?#]*@)?(?:\[[^\]/?#]+\]|[^:/?#\[\]@]+):(\d+)(?:[/?#]|$)"
_PATH = r"(?i)^https?://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def is_http_url(c: Column) -> Column:
    """Present, no white space, http or https, with a host."""
    return F.coalesce(~c.rlike(r"[\s\u00a0\u2028\u2029]") & c.rlike(_HTTP), F.lit(False))


def host_of(c: Column) -> Column:
    """Lower-case host without port or trailing dots; '' when there is none."""
    host = F.regexp_replace(F.regexp_extract(c, _HTTP, 1), r"^\[|\]$", "")
    return F.rtrim(F.lower(host), F.lit("."))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 1)


def query_of(c: Column) -> Column:
    return F.regexp_extract(c, _QUERY, 1)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    """url_encode leaves * and escapes ~; query strings do the opposite."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept_query(query: Column) -> Column:
    """Tracking parameters out, the rest decoded, sorted by (name, value) and encoded again."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*fixed.TRACKING_PARAMS),
    )
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def canonical_key(c: Column) -> Column:
    """What duplicates of one article share. Only compared; the original URL is what gets linked."""
    url = F.trim(c)
    port = F.regexp_extract(url, _HTTP_PORT, 1)
    odd_port = (port != "") & ~F.ltrim(port, F.lit("0")).isin("", "80", "443")
    host = F.concat(without_www(host_of(url)), F.when(odd_port, F.concat(F.lit(":"), F.ltrim(port, F.lit("0")))).otherwise(F.lit("")))
    path = path_of(url)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(path)
    query = query_of(url)
    kept = F.when(query == "", "").otherwise(_kept_query(query))
    tail = F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))
    return F.ltrim(F.concat(host, path, tail), F.lit("/"))


def parent_domains(host: Column) -> Column:
    """The host and each parent with at least two labels, longest first: a.b.ca -> [a.b.ca, b.ca]."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))
