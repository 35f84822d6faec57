"""Sitemaps: parsing, and expansion of index trees with cycle guard and limits."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webskein.plans.staging import stage

KIND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("locations", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType())])


#: Bytes of a sitemap that is read.
MOST = 10 << 20


def parse(xml: str | None) -> dict:
    """kind (urlset, sitemapindex), locations, problem. Document types and entities are refused; namespaces don't matter; an entry without a location is a problem."""
    bad = lambda why: {"kind": None, "locations": [], "problem": why}
    if xml is None or not xml.strip():
        return bad("empty")
    if len(xml.encode("utf-8", "surrogatepass")) > MOST:
        return bad("too large")
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", xml, re.I):
        return bad("document type")
    try:
        root = ET.fromstring(xml.strip().encode())
    except ET.ParseError:
        return bad("not well formed")
    name = lambda e: e.tag.rpartition("}")[2].lower()
    entry = {"urlset": "url", "sitemapindex": "sitemap"}.get(name(root))
    if entry is None:
        return bad("neither urlset nor sitemapindex")
    found = []
    for e in root:
        if name(e) == entry:
            loc = next((c.text.strip() for c in e if name(c) == "loc" and c.text and c.text.strip()), None)
            if loc is None:
                return bad("entry without location")
            found.append(loc)
    return {"kind": name(root), "locations": found, "problem": None}


@F.pandas_udf(KIND)
def parsed(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in xml], columns=["kind", "locations", "problem"])


def expand(roots: DataFrame, documents: DataFrame, max_depth: int = 10, max_sitemaps: int = 100, max_urls: int | None = 50_000) -> DataFrame:
    """url, depth of all pages below root sitemaps. roots: url; documents: url, xml. Each sitemap is read once, whatever cycles there are; limits count in breadth-first order. ``max_urls`` None: no limit of pages."""
    docs = documents.select("url", parsed("xml").alias("s"))
    level = stage(roots.select("url").distinct().limit(max_sitemaps).select("url", F.lit(0).alias("depth")), "sitemaps")
    seen, pages, left = level, None, max_sitemaps - level.count()
    for d in range(max_depth + 1):
        here = stage(level.join(docs, "url").where("s.problem is null").select("url", "depth", "s.kind", F.posexplode("s.locations").alias("pos", "loc")), "locations")
        found = here.where("kind = 'urlset'").select(F.col("loc").alias("url"), "depth", F.col("url").alias("via"), "pos")
        pages = found if pages is None else pages.union(found)
        level = here.where("kind = 'sitemapindex'").groupBy(F.col("loc").alias("url")).agg(F.min(F.struct("url", "pos")).alias("o")).join(seen.select("url"), "url", "left_anti")
        level = stage(level.orderBy("o").limit(max(left, 0)).select("url", F.lit(d + 1).alias("depth")), "sitemaps")
        n = level.count()
        if not n:
            break
        left, seen = left - n, seen.union(level)
    once = pages.groupBy("url").agg(F.min(F.struct("depth", "via", "pos")).alias("o"))
    if max_urls is not None:
        once = once.orderBy("o.depth", "o.via", "o.pos").limit(max_urls)
    return once.select("url", F.col("o.depth").alias("depth"))
