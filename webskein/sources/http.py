"""A batch data source that fetches pages: ``spark.read.format("pages").option("urls", …)``.

One task fetches a host's urls one after the other, with a pause between. Redirects are followed up to ten and each hop is held against the policy; bodies
have a size cap. A fetch that fails is a row with its error. The fetcher can be replaced, as tests do.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import time
from collections import defaultdict
from collections.abc import Callable
from datetime import datetime, timezone
from http.client import HTTPConnection, HTTPSConnection
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPHandler, HTTPRedirectHandler, HTTPSHandler, ProxyHandler, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, html string, status_code int, content_type string, fetched_at timestamp, error string"


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def public(host: str, port: int) -> list[tuple]:
    """Where a host's name leads, as getaddrinfo says; an error unless all of it is public."""
    found = socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)
    if not all(ipaddress.ip_address(a[4][0].split("%")[0]).is_global for a in found):
        raise PermissionError("refused by policy")
    return found


def connect_public(address: tuple, timeout=None, source_address=None):
    """A connection to one of the very addresses that were checked, so that a name can't lead elsewhere a moment later."""
    failed: OSError = OSError("no address")
    for family, kind, proto, _, to in public(*address):
        s = socket.socket(family, kind, proto)
        try:
            if isinstance(timeout, (int, float)):
                s.settimeout(timeout)
            s.connect(to)
            return s
        except OSError as e:
            s.close()
            failed = e
    raise failed


class _Http(HTTPConnection):
    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self._create_connection = connect_public


class _Https(HTTPSConnection):
    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self._create_connection = connect_public


class _HttpHandler(HTTPHandler):
    def http_open(self, req):
        return self.do_open(_Http, req)


class _HttpsHandler(HTTPSHandler):
    def https_open(self, req):
        return self.do_open(_Https, req, context=self._context)


def allowed(url: str) -> bool:
    """http(s) without credentials; where it leads is checked when connecting."""
    p = urlsplit(url)
    return p.scheme in ("http", "https") and bool(p.hostname) and p.username is None


def fetch(url: str, agent: str = "webskein", cap: int = 5 << 20, timeout: float = 20, hops: int = 10, may=allowed, opener=None) -> dict:
    """A row of SCHEMA."""
    row = {"url": url, "final_url": url, "html": None, "status_code": None, "content_type": None, "fetched_at": datetime.now(timezone.utc), "error": None}
    opener = opener or build_opener(_NoRedirect, _HttpHandler, _HttpsHandler, ProxyHandler({}))
    for _ in range(hops + 1):
        if not may(row["final_url"]):
            return row | {"error": "refused by policy"}
        try:
            r = opener.open(Request(row["final_url"], headers={"User-Agent": agent}), timeout=timeout)
        except Exception as e:  # noqa: BLE001 - an answer of another status is an answer
            r = e if hasattr(e, "headers") and hasattr(e, "code") else None
            if r is None:
                refused = isinstance(e, PermissionError) or isinstance(getattr(e, "reason", None), PermissionError)
                return row | {"error": "refused by policy" if refused else type(e).__name__}
        row["status_code"] = getattr(r, "status", None) or r.code
        to = r.headers.get("Location")
        if row["status_code"] in (301, 302, 303, 307, 308) and to:
            row["final_url"] = urljoin(row["final_url"], to)
            continue
        body = r.read(cap + 1)
        if len(body) > cap:
            return row | {"error": "too large"}
        kind = r.headers.get_content_type()
        return row | {"content_type": kind, "html": body.decode(r.headers.get_content_charset() or "utf-8", "replace")}
    return row | {"error": "too many redirects"}


class _Host(InputPartition):
    def __init__(self, urls):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.pause = json.loads(options["urls"]), float(options.get("pause", 1.0))

    def partitions(self):
        by = defaultdict(list)
        for u in dict.fromkeys(self.urls):
            by[urlsplit(u).hostname].append(u)
        return [_Host(us) for us in by.values()]

    def read(self, partition):
        for i, u in enumerate(partition.urls):
            if i:
                time.sleep(self.pause)
            yield tuple(fetch(u).values())


class PagesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagesDataSource)


def fetched(urls: DataFrame, pause: float = 1.0, one: Callable[[str], dict] = fetch) -> DataFrame:
    """url, status, html, problem of a table of urls; a host's urls one after the other, ``pause`` seconds apart."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, u in enumerate(sorted(pdf["url"])):
            if i:
                time.sleep(pause)
            r = one(u)
            rows.append((u, r["status_code"], r["html"], r["error"]))
        return pd.DataFrame(rows, columns=["url", "status", "html", "problem"]).astype({"status": "Int32"})

    return urls.select("url", host.alias("host")).groupBy("host").applyInPandas(run, "url string, status int, html string, problem string")
