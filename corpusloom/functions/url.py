"""URL expressions. A null URL gives null, or false from a predicate; an unparsable one has empty parts."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Path segments of translations and of pages that are no documentation, and version segments.
SKIPPED_SEGMENTS = "blog tags categories search enterprise zh-cn zh-tw ja-jp fr-fr next".split()
VERSION_SEGMENT = r"v?[0-9]+\.[0-9]+(\.[0-9]+)?"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def netloc(u: Column) -> Column:
    """Host with port and user as written."""
    return F.regexp_extract(u, _SCHEME + r"([^/?#]*)", 2)


def path(u: Column) -> Column:
    return F.regexp_extract(u, _SCHEME + r"[^/?#]*([^?#]*)", 2)


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(netloc(a) == netloc(b), F.lit(False))


def on_host(u: Column, host: str) -> Column:
    """http(s) URL whose host is ``host``; neither side's case matters."""
    return F.coalesce(u.rlike("(?i)^https?://") & (F.lower(netloc(u)) == host.lower()), F.lit(False))


def under_prefix(u: Column, prefix: str | None) -> Column:
    """The path is the prefix or lies below it, by whole segments, without regard to case. No prefix holds for all."""
    p = (prefix or "").strip().strip("/").lower()
    if not p:
        return F.lit(True)
    have = F.lower(path(u))
    return F.coalesce(u.rlike("(?i)^https?://") & ((have == f"/{p}") | have.startswith(f"/{p}/")), F.lit(False))


def without_fragment(u: Column) -> Column:
    return F.regexp_replace(u, "#.*$", "")


def resolve_root(base: Column, href: Column) -> Column:
    """A root-relative link on its base, without fragment; stays inside the JVM."""
    return without_fragment(F.concat(F.regexp_extract(base, _SCHEME + r"[^/?#]*", 0), href))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Any link on its base by the general rules, without fragment; null where it cannot be parsed."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urlunsplit(urlsplit(urljoin(b, h))._replace(fragment=""))
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def canonical(u: Column) -> Column:
    """Host in lower case, no query or fragment, single slashes, and a final slash unless the last segment has a suffix."""
    bare = F.regexp_replace(path(u), "/{2,}", "/")
    closed = F.when(bare.endswith("/") | bare.rlike(r"/[^/]*[^/.]\.[^/.]+$"), bare).otherwise(F.concat(bare, F.lit("/")))
    return F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), closed)


def in_scope(u: Column, root: Column) -> Column:
    """Documentation page below ``root``: same host, no translation, blog or version segment, no suffix but .html."""
    p = path(u)
    bad = r"/(" + "|".join(SKIPPED_SEGMENTS) + r"|" + VERSION_SEGMENT + r")(/|$)"
    suffix = F.regexp_extract(F.lower(p), r"[^/.](\.[^/.]+)$", 1)
    ok = u.rlike("^https?://") & (netloc(u) == netloc(root)) & F.startswith(path(u), path(root)) & ~p.rlike(bad) & suffix.isin("", ".html")
    return F.coalesce(ok, F.lit(False))


def valid(u: Column) -> Column:
    """Absolute http(s) URL with a dotted or local host and no blanks; an approximation of a full grammar."""
    return F.coalesce(u.rlike(r"^https?://([^\s/?#@]+@)?([A-Za-z0-9]([A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(:[0-9]{1,5})?([/?#]\S*)?$"), F.lit(False))


def depth(u: Column) -> Column:
    """Number of path segments."""
    return F.size(F.filter(F.split(path(u), "/"), lambda x: x != ""))
