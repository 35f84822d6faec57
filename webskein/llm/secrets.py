"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned once for three base kinds and for ``token`` candidates (long runs with letters and digits). The
values' hashes are then counted over all documents by distinct repositories and owners: a value that at least
``common`` repositories and owners hold is a copied example, any other is owner-specific. A document's spans are all
base spans and its owner-specific tokens that overlap no base span.

Defined results. A null text is an empty one; a null repository or owner counts as none. Each input row gives one row, repeated and null ids
included; a span is found anew in every row. Long texts are scanned whole. An empty table gives no rows. Only the named columns are read; others may have any names.

Scale. The scan's narrow result is written once, so that texts are read once. Matches get their places by running sums over a text's sorted matches, so that work
is linear in them. Counting combines before its shuffle, and the join of counts back to candidates is salted, so that one value in a third of all documents is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webskein.llm.text import text_keys, unused
from webskein.plans.staging import free, stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more: the run is taken to its end
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
SALTS = 16
SPAN = "struct<start:int,ord:int,end:int,value:string>"
MATCHES = "array<struct<ord:int,pos:int,gap:int,match:string>>"


def matches(docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """keep's columns and ``m``: for each match of a pattern its kind, number, the code points since the match before, and the match."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = {"a": ASSIGN, "k": ACCESS, "h": HEX, "t": TOKEN}
    found = docs.select(*(c.alias(n) for n, c in keep.items()), t.alias("whole"), *(F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias(n) for n, p in kinds.items()))

    def steps(order: int, name: str, pattern: str) -> Column:
        gaps = F.transform(F.split("whole", pattern, -1), F.length)
        return F.when(F.size(name) > 0, F.transform(F.array(gaps), lambda gaps: F.transform(F.col(name), lambda m, i: F.struct(F.lit(order).alias("ord"), i.alias("pos"), F.get(gaps, i).alias("gap"), m.alias("match"))))[0]).otherwise(F.array().cast(MATCHES))

    return found.select(*keep, F.concat(*(steps(i, n, p) for i, (n, p) in enumerate(kinds.items()))).alias("m"))


def found_spans(matched: DataFrame) -> DataFrame:
    """row_id, repo, owner, ord, start, end, value, hash: all base spans, and the token candidates that overlap none. A text's matches are sorted, never compared in pairs."""
    each = matched.where(F.size("m") > 0).select("row_id", "repo", "owner", F.explode("m").alias("x")).select("row_id", "repo", "owner", "x.*").repartition("row_id")
    to_here = W.partitionBy("row_id", "ord").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("match")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(to_here).cast("int")).withColumn("start", (F.col("end") - size).cast("int"))
    placed = placed.withColumn("value", F.when(F.col("ord") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match")))
    count = lambda c: F.length(F.regexp_replace("value", f"[^{c}]", ""))
    token = F.col("ord") == 3
    placed = placed.where(F.when(F.col("ord") == 0, F.length("value") >= 6).when(token, (count("0-9") >= 4) & (count("A-Za-z") >= 4)).otherwise(True))
    up, down = (W.partitionBy("row_id").orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    before, after = F.max(F.when(~token, F.col("end"))).over(up), F.min(F.when(~token, F.col("start"))).over(down)
    placed = placed.withColumn("before", before).withColumn("after", after)
    overlaps = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return placed.where(~token | ~overlaps).select("row_id", "repo", "owner", "ord", "start", "end", "value", F.sha2("value", 256).alias("hash"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Counts by value hash: documents' rows, distinct repositories and owners."""
    return candidates.groupBy("hash").agg(F.count("*").alias("n_rows"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def judged_spans(docs: DataFrame, text: str, repo: str, owner: str, common: int, keep: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """All rows (row_id, keep's columns), and their spans (row_id, ord, start, end, value, copied); both staged."""
    columns = {"row_id": F.monotonically_increasing_id(), "repo": F.col(repo), "owner": F.col(owner)} | keep
    matched = stage(matches(docs, text, columns), "matches")
    rows = stage(matched.select("row_id", *keep), "rows")
    spans = stage(found_spans(matched), "spans")
    free(matched)
    counts = ownership(spans).select("hash", ((F.col("n_repos") >= common) & (F.col("n_owners") >= common)).alias("copied"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = stage(spans.withColumn("salt", (F.col("row_id") % SALTS).cast("int")).join(counts, ["hash", "salt"]).select("row_id", "ord", "start", "end", "value", "copied"), "judged")
    free(spans)
    return rows, judged


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "source", owner: str = "source", common: int = 3) -> DataFrame:
    """Per input row: row_id, doc_id, ``base`` and ``spans`` (array of start, ord, end, value; ord counts KINDS), n_owned, n_copied."""
    rows, judged = judged_spans(docs, text, repo, owner, common, {"doc_id": F.col(doc_id)})
    span = F.struct("start", "ord", "end", "value")
    is_base = F.col("ord") < 3
    by_row = judged.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(is_base | ~F.col("copied"), span))).alias("spans"),
        F.count_if(~F.col("copied")).alias("n_owned"),
        F.count_if(F.col("copied")).alias("n_copied"),
    )
    none, zero = F.array().cast(f"array<{SPAN}>"), F.lit(0).cast("long")
    found = rows.join(by_row, "row_id", "left")
    return found.select("row_id", "doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")), *(F.coalesce(c, zero).alias(c) for c in ("n_owned", "n_copied")))


def written(spans: str | Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, runs: str, mark: str = "<secret>", piece: int = 1024) -> Column:
    """The text with each of ``runs`` (disjoint, by start) replaced by ``mark``. It is cut into pieces once, as a position within a long string is found by counting from its start."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def between(cut: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / piece).cast("int")
        some = F.array_join(F.slice(cut, first + 1, F.floor(end / piece).cast("int") - first + 1), "")
        return F.substr(some, begin - first * piece + 1, end - begin)

    n, length = F.size(runs), F.length(text)
    gap = lambda cut, i: between(cut, F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0), F.when(i < n, F.get(runs, i)["start"]).otherwise(length))
    return F.transform(F.array(pieces), lambda cut: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: gap(cut, i)), mark))[0]


def mask_secrets(docs: DataFrame, text: str = "text", size: str = "n_chars", repo: str = "source", owner: str = "source", common: int = 3) -> DataFrame:
    """``docs`` with the spans of each text masked, and ``size``, where there is such a column, following; all other columns as they are, whatever their names.

    Rows are found again by a 128-bit hash of their text, as equal texts have equal spans."""
    columns = docs.columns
    rows, judged = judged_spans(docs, text, repo, owner, common, dict(zip(("k1", "k2"), text_keys(F.col(f"`{text}`")))))
    hidden = judged.where("ord < 3 or not copied")
    by_start = W.partitionBy("row_id").orderBy("start", "ord")
    opens = (F.col("start") >= F.coalesce(F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("int")
    runs = hidden.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("row_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    k1, k2, at, new = unused(columns, "secret_k1", "secret_k2", "secret_runs", "secret_text")
    found = stage(rows.join(runs, "row_id").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.first("runs").alias(at)), "found")
    free(rows, judged)
    one, two = text_keys(F.col(f"`{text}`"))
    # in a step of its own: a later column of the same step would see the new text within lambdas
    hit = docs.withColumn(k1, one).withColumn(k2, two).join(found, [k1, k2], "left")
    hit = hit.withColumn(new, F.when(F.col(at).isNotNull(), masked(F.col(f"`{text}`"), at)).otherwise(F.col(f"`{text}`")))
    length = F.when(F.col(at).isNotNull(), F.length(new))
    special = {text: F.col(new)} | ({size: F.coalesce(length, F.col(f"`{size}`")).cast(docs.schema[size].dataType)} if size in columns else {})
    return hit.select(*(special.get(c, F.col(f"`{c}`")).alias(c) for c in columns))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    n = [of(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *n, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), "n_owned", "n_copied")


def _sql() -> str:
    """The same in DuckDB: positions from the lengths of matches and of the pieces between them."""
    assign = """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    patterns = [assign, ACCESS, HEX, TOKEN]
    find = "\nUNION ALL\n".join(
        f"SELECT doc_id, source, {k} AS ord, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS cut FROM docs" for k, p in enumerate(patterns)
    )
    kinds = reduce(lambda a, b: f"{a}, {b}", (f"'{k}'" for k in KINDS))
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({find}),
each AS (SELECT doc_id, source, ord, m, cut, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT doc_id, source, ord, m[i] AS hit,
         (list_sum(list_transform(cut[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start FROM each),
valued AS (SELECT doc_id, source, ord, start, start + length(hit) AS stop, CASE WHEN ord = 0 THEN regexp_extract(hit, '{assign}', 2) ELSE hit END AS value FROM placed),
base AS (SELECT * FROM valued WHERE ord IN (1, 2) OR (ord = 0 AND length(value) >= 6)),
tokens AS (SELECT * FROM valued v WHERE ord = 3 AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 4
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = v.doc_id AND b.start < v.stop AND v.start < b.stop)),
cands AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
counts AS (SELECT value, count(DISTINCT source) >= 3 AS copied FROM cands GROUP BY value),
judged AS (SELECT c.*, n.copied, ([{kinds}])[ord + 1] || ':' || start || ':' || stop AS said FROM cands c JOIN counts n USING (value)),
rolled AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
           string_agg(said, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
           string_agg(said, ',' ORDER BY start, ord) FILTER (WHERE ord < 3 OR NOT copied) AS spans,
           count(*) FILTER (WHERE NOT copied) AS n_owned, count(*) FILTER (WHERE copied) AS n_copied FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM docs d LEFT JOIN rolled USING (doc_id)
"""


OP3_SQL = _sql()
