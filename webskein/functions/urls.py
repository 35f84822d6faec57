"""URL expressions: native parts, and Arrow functions for what has no built-in (relative resolution, address classes, percent encoding)."""

from __future__ import annotations

import ipaddress
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webskein.operators.html import http_url

PATTERN = r"^(https?)://(?:[^/?#@]*@)?([^/?#:@\\]+|\[[0-9a-f:.]+\])(?::([0-9]*))?(?=[/?#]|$)"


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) url, without a final dot; null without one."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, "(?i)" + PATTERN, 2)), F.lit(".")), F.lit(""))


def port(url: Column) -> Column:
    said = F.nullif(F.regexp_extract(url, "(?i)" + PATTERN, 3), F.lit(""))
    return F.coalesce(F.try_to_number(said, F.lit("99999")).cast("int"), F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def is_http(url: Column) -> Column:
    """An absolute http(s) url without blanks or a backslash in its authority."""
    return F.coalesce(url.rlike("(?i)" + PATTERN) & ~url.rlike(r"\s") & ~url.rlike(r"^[^:]*://[^/?#]*\\"), F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host, with a port that isn't the scheme's own; null unless http(s)."""
    own = F.when(scheme(url) == "https", 443).otherwise(80)
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url) == own, "").otherwise(F.concat(F.lit(":"), port(url).cast("string")))))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def any_host(h: Column) -> Column:
    """canonical_host of ASCII names, and of the IDNA form of others."""
    return F.when(h.rlike(r"^[\x00-\x7F]*$"), canonical_host(h)).otherwise(canonical_host(ascii_host(h)))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & (port(a) == port(b))


def canonical_host(h: Column) -> Column:
    """ASCII host names of valid labels and at most 253 characters; null otherwise."""
    x = F.rtrim(F.lower(F.trim(h)), F.lit("."))
    ok = x.rlike(r"^(?=.{1,253}$)[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$")
    return F.when(ok, x)


@F.pandas_udf(T.StringType())
def resolved(href: pd.Series, base: pd.Series) -> pd.Series:
    """The absolute http(s) url of a reference, without fragment, or null."""
    return pd.Series([http_url(h, b) if h is not None and b is not None else None for h, b in zip(href, base)], dtype=object)


@F.pandas_udf(T.StringType())
def ascii_host(h: pd.Series) -> pd.Series:
    """IDNA form of international host names."""

    def one(x):
        try:
            return x.strip().rstrip(".").encode("idna").decode().lower() if x else None
        except UnicodeError:
            return None

    return h.map(one)


@F.pandas_udf(T.StringType())
def address_class(h: pd.Series) -> pd.Series:
    """public, private, loopback, link_local, multicast, reserved or unspecified for addresses; null for names."""

    def one(x):
        try:
            a = ipaddress.ip_address((x or "").strip("[]"))
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        for name in ("unspecified", "loopback", "link_local", "multicast", "reserved", "private"):
            if getattr(a, f"is_{name}"):
                return name
        return "public"

    return h.map(one)


@F.pandas_udf(T.StringType())
def percent_normal(path: pd.Series) -> pd.Series:
    """Percent encoding in one form: unreserved characters plain, all others upper-case escapes."""
    return path.map(lambda p: None if p is None else quote(unquote_to_bytes(p), safe="/?&=*$:@!'(),;+~-._"))
