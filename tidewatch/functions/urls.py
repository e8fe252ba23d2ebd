"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Click-tracking parameters dropped from URLs.
TRACKING_PARAMS = ("gclid", "fbclid", "msclkid")

_SCHEME = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"


def _host(u: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(u, _SCHEME + r"//([^/?#]*)", 2)), F.lit("www."), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host (port kept) without any 'www.'; '' when there is none."""
    return _host(F.coalesce(url, F.lit("")))


def path(url: Column) -> Column:
    """Path part of a URL."""
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), _SCHEME + r"(?://[^/?#]*)?", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), r";[^/]*$", "")


def normalise_url(url: Column) -> Column:
    """Canonical URL: https by default, no www, no tracking, no fragment, no doubled slashes."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    p = F.regexp_replace(F.regexp_replace(path(u), r"/{2,}", "/"), r"/+$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    key = lambda q: F.lower(F.substring_index(q, "=", 1))
    kept = F.filter(
        F.split(query, "&"),
        lambda q: (q != "") & ~key(q).startswith("utm_") & ~key(q).isin(*TRACKING_PARAMS),
    )
    tail = F.array_join(kept, "&")
    out = F.concat(scheme, F.lit("://"), _host(u), p, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when(u == "", "").otherwise(out)


def date_in_url(url: Column) -> Column:
    """Date written in the path as /yyyy/mm/dd or /yyyy-mm-dd; else null."""
    u = F.coalesce(url, F.lit(""))
    dates = []
    for sep in ("/", "-"):
        raw = F.regexp_extract(u, rf"/(20\d{{2}}{sep}(?:0[1-9]|1[0-2]){sep}[0-3]\d)(?:/|$)", 1)
        dates.append(F.try_to_date(F.nullif(F.translate(raw, "/", "-"), F.lit("")), "yyyy-MM-dd"))
    return F.coalesce(*dates)
