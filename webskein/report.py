"""Small results as Markdown, HTML or JSON files, written beside and then renamed."""

from __future__ import annotations

import html
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webskein.operators import compare, crawl, evaluate

ROWS = 1000


def rows_of(df: DataFrame) -> list[dict]:
    """The rows of a summary; more than ROWS of them are no report."""
    rows = [r.asDict(recursive=True) for r in df.limit(ROWS + 1).collect()]
    if len(rows) > ROWS:
        raise ValueError(f"a report holds {ROWS} rows at most")
    return rows


def shown(v: object) -> str:
    return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}", ""]
    for name, df in sections.items():
        cell = lambda v: shown(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
        out += [f"| {' | '.join(cell(r[c]) for c in df.columns)} |" for r in rows_of(df)] + [""]
    return "\n".join(out)


def page(title: str, sections: dict[str, DataFrame]) -> str:
    e = html.escape
    out = [f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{e(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{e(shown(r[c]))}" for c in df.columns) for r in rows_of(df))
        out.append(f"<h2>{e(name)}</h2><table><tr>{head}{body}</table>")
    return "".join(out)


def write(path: str, title: str, sections: dict[str, DataFrame]) -> None:
    """By the path's ending: .md, .html or .json. A failed report leaves an earlier one as it was."""
    kind = Path(path).suffix
    if kind == ".json":
        text = json.dumps({"title": title} | {k: rows_of(v) for k, v in sections.items()}, indent=2, sort_keys=True, default=str)
    else:
        text = {".md": markdown, ".html": page}[kind](title, sections)
    handle, name = tempfile.mkstemp(dir=Path(path).resolve().parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def crawl_report(path: str, log: DataFrame, total: int) -> None:
    """A crawl's statistics. log: url, status, attempt, seconds (since the start), page_id."""
    ok, status = F.col("status").between(200, 399), F.col("status")
    errors = log.where(~F.coalesce(ok, F.lit(False))).select(crawl.error_class(status).alias("error_type"), "url", crawl.may_retry(F.col("attempt"), status).alias("retry_scheduled"), crawl.backoff(F.col("attempt"), status, F.lit(0.0)).alias("retry_delay"))
    write(path, "Crawl", {"Progress": crawl.progress(log, total, F.coalesce(ok, F.lit(False)), F.col("seconds")), "Statuses": crawl.status_histogram(log).orderBy("status"), "Domains": crawl.top_domains(log), "Errors": crawl.retry_statistics(errors).orderBy("error_type")})


def evaluation_report(path: str, title: str, rows: DataFrame, queries: DataFrame, items: DataFrame, latency: DataFrame, warnings: list[str]) -> None:
    """A strategy's evaluation: means by K and category, latency, the strongest and worst queries, false positives, warnings.

    rows: evaluate.metrics() with category; queries: as evaluate.strongest() and worst() take them; items: as false_positives() does; latency: repeat, seconds."""
    said = latency.sparkSession.createDataFrame([(w,) for w in warnings], "warning string")
    sections = {"Means": evaluate.summary(rows).orderBy("k"), "Categories": evaluate.by_category(rows.drop("category"), rows.select("query_id", "category").distinct()).orderBy("k", "category"), "Latency": evaluate.latency(latency, "seconds")}
    write(path, title, sections | {"Strongest queries": evaluate.strongest(queries), "Worst queries": evaluate.worst(queries), "False positives": evaluate.false_positives(items), "Warnings": said})


def comparison_report(path: str, title: str, rows: DataFrame, strategies: tuple[str, str], classes: DataFrame | None = None) -> None:
    """Two strategies' means and their differences, outcomes by query, categories, and the classes of a fused one. rows: query_id, strategy, category, k, failed and metrics."""
    a, b = strategies
    at = rows.where("k = 5")
    sections = {"Differences": compare.deltas(evaluate.summary(rows, "strategy"), a, b).orderBy("k", "metric"), "Outcomes": compare.outcomes(at, a, b).groupBy("outcome", "success", "regression").count(), "Categories": compare.by_category(at, strategies).orderBy("category")}
    write(path, title, sections | ({"Classes": classes} if classes is not None else {}))
