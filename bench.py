"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import shutil
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.index import Index
from quarry.operators.rank import bm25_batch
from quarry.plans.registry import all_queries
from quarry.session import local_session
from quarry.sources import testtables as TT

import quarry.plans.core_queries  # noqa: F401,E402,I001

HEADLINE = (
    "tokenize_terms", "doc_freq", "corpus_stats", "bm25_topk", "bm25_corpus_filter", "bm25_prefix", "cosine_topk", "hybrid_rrf", "title_boost", "graph_boost",
    "batch_bm25", "facet_tag_any", "facet_or", "search_plan", "change_detect", "upsert_latest", "drain_pending", "debounce_first", "html_links",
)


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = all_queries()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(queries["bm25_topk"](spark, sf_dir))  # the JVM compiles
    took = {q: timed(lambda q=q: sink(queries[q](spark, sf_dir))) for q in HEADLINE}
    docs = TT.artifacts(spark, sf_dir).select("doc_id", "corpus", "path", "title", "kind", "text")
    folder = f"/tmp/quarry-bench-{os.getpid()}"
    took["ingest_index"] = timed(lambda: Index.build(docs).save(folder))
    index = Index.open(spark, folder)
    terms = TT.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).distinct()
    took["batch_bm25_on_index"] = timed(lambda: sink(bm25_batch(index.postings, index.stats, terms, limit=10, terms=index.terms)))
    shutil.rmtree(folder)
    n = docs.count()
    asked = TT.table(spark, sf_dir, "benchmark").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "documents": n,
                "ingest_docs_per_sec": round(n / took["ingest_index"], 1),
                "batch_queries_per_sec": round(asked / took["batch_bm25_on_index"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
