"""Command line: index, embed, search, context, info, crawl, serve, validate, query and evaluate. Exit codes: 0 done, 1 failed queries, 2 an expected error."""

from __future__ import annotations

import argparse
import functools
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webskein", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("index", "index a Parquet table of pages (page_id, url, html)"), ("search", "rank chunks"), ("context", "rank chunks and keep what a token budget allows"), ("info", "what a store holds")):
        s = sub.add_parser(name, help=text)
        s.add_argument("store")
        if name == "index":
            s.add_argument("pages")
        if name in ("search", "context"):
            s.add_argument("queries", nargs="+")
            s.add_argument("--limit", type=int, default=5 if name == "search" else 10)
            s.add_argument("--vectors", help="Parquet table of vectors that embed wrote: semantic search, or hybrid with --hybrid")
            s.add_argument("--hybrid", action="store_true")
        if name == "context":
            s.add_argument("--budget", type=int, default=3000)
    m = sub.add_parser("embed", help="vectors for all chunks, of hashed words; those that are there already stay")
    m.add_argument("store")
    m.add_argument("vectors")
    m.add_argument("--dimension", type=int, default=64)
    c = sub.add_parser("crawl", help="crawl from seeds by the settings of a JSON file and index what is found")
    c.add_argument("store")
    c.add_argument("seeds", nargs="+")
    c.add_argument("--config")
    sub.add_parser("serve", help="bounded tools over standard input and output").add_argument("store")
    v = sub.add_parser("validate", help="what is wrong with an evaluation dataset; exit code 1 if anything is")
    v.add_argument("dataset")
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    e = sub.add_parser("evaluate", help="metrics and comparison of the strategies over a folder of tables, as a report")
    e.add_argument("tables")
    e.add_argument("report")
    return p


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from webskein import catalogue, report, serving
    from webskein.config import CrawlConfig
    from webskein.engine import Engine
    from webskein.operators import evaluate, semantic
    from webskein.sources import datasets

    spark = SparkSession.builder.getOrCreate()
    show = lambda df: print(*(json.dumps(r.asDict(recursive=True), default=str) for r in df.collect()), sep="\n")
    if args.command == "query":
        show(catalogue.QUERIES[args.name](spark, args.tables))
    elif args.command == "evaluate":
        names = ("map_mrr_ndcg", "metrics_by_category", "strategy_deltas", "win_loss", "overlap_jaccard", "coverage_partition", "oracle_union_recall", "fusion_recovery", "bootstrap_interval")
        report.write(args.report, "Retrieval evaluation", {n: catalogue.QUERIES[n](spark, args.tables) for n in names})
    else:
        if args.command == "validate":
            tables = datasets.load(spark, args.dataset)
            bad = evaluate.dataset_problems(tables["documents"], tables["sections"], tables["queries"], tables["judgments"])
            show(bad)
            return int(not bad.isEmpty())
        engine = Engine(spark, args.store)
        if args.command == "index":
            print(json.dumps(engine.index_pages(spark.read.parquet(args.pages))))
        elif args.command == "info":
            show(engine.info())
        elif args.command == "serve":
            serving.serve(engine, sys.stdin, sys.stdout)
        elif args.command == "embed":
            at = spark._jvm.org.apache.hadoop.fs.Path(args.vectors)
            there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
            made = engine.embed(functools.partial(semantic.HashedWords, args.dimension), spark.read.parquet(args.vectors) if there else None)
            made.write.mode("overwrite").parquet(args.vectors)
        elif args.command == "crawl":
            config = CrawlConfig.from_file(args.config) if args.config else CrawlConfig()
            log = engine.crawl(spark.createDataFrame([(u,) for u in args.seeds], "url string"), config)
            show(log.groupBy("status", "problem").count())
        else:
            asked = engine.queries(*args.queries)
            if args.vectors:
                stored = spark.read.parquet(args.vectors)
                dimension = len(stored.first().vector)
                own = semantic.embedded(asked.select(F.col("query_id").alias("chunk_hash"), semantic.query_text(F.col("query")).alias("text")), functools.partial(semantic.HashedWords, dimension)).select(F.col("chunk_hash").alias("query_id"), "vector")
                hits = engine.search_hybrid(asked, stored, own, args.limit) if args.hybrid else engine.search_semantic(stored, own, args.limit)
            else:
                hits = engine.search(asked, args.limit)
            show(hits.orderBy("query_id", "rank") if args.command == "search" else engine.build_context(hits, args.budget))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, KeyError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
