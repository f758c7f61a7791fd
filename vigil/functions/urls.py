"""URL functions: host, domain, registrable domain, absolute links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import Text, filled, strings


def host(url: Text) -> Column:
    return F.regexp_extract(filled(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Text) -> Column:
    """The host without any `www.`."""
    return F.replace(F.lower(host(url)), F.lit("www."), F.lit(""))


def registrable_domain(url: Text) -> Column:
    """The last two labels, or three where the second-last is a common second-level label."""
    parts = F.split(domain(url), r"\.")
    n = F.size(parts)
    second = F.try_element_at(parts, F.lit(-2))
    last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
    return F.when((n >= 3) & F.array_contains(strings(L.SECOND_LEVEL_LABELS), second), last(3)).when(n >= 2, last(2)).otherwise(domain(url))


def independent_sources(urls: Text) -> Column:
    """Distinct registrable domains of an array of URLs."""
    return F.size(F.array_distinct(F.filter(F.transform(urls, registrable_domain), lambda d: d != "")))


def origin(url: Text) -> Column:
    return F.regexp_extract(filled(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` steps; steps above the root go."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(s))),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def absolute(base: Text, href: Text) -> Column:
    """A link joined to its page: absolute, scheme-relative, rooted, relative to the page's folder (with ../), a query or a fragment alone; empty: the page."""
    b, h = filled(base), F.trim(filled(href))
    page = F.regexp_replace(b, r"[?#].*$", "")
    bare = F.regexp_replace(b, "#.*$", "")
    top = origin(base)
    path = F.regexp_replace(F.substring(page, F.length(top) + 1, F.length(page)), r"[^/]*$", "")
    own, rest = F.regexp_extract(h, r"^([^?#]*)", 1), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    joined = lambda p: F.concat(top, without_dots(p), rest)
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([^:]+:)", 1), h))
        .when(h.startswith("#"), F.concat(bare, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("/"), joined(own))
        .otherwise(joined(F.concat(F.when(path == "", "/").otherwise(path), own)))
    )
