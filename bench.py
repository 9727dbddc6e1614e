"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). A query that takes less than ``REPEAT_BELOW`` seconds runs
three times, and its median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from textloom.queries import QUERIES
from textloom.session import build_session

HEADLINE = (
    "clean_plain", "clean_html", "word_token_counts", "word_frequencies", "quality_accept",
    "budget_capped", "corpus_summary", "corpus_shards_written", "quality_corpus", "byte_budget_lines",
    "word_vocabulary", "encoded_with_eos", "packed_rows", "micro_batches", "bpe_vocabulary",
    "loss_curve", "exponential_average", "distinct_ngram_ratios", "corpus_distinct_bigrams",
    "perplexity", "latency_summary",
)


REPEAT_BELOW = 8


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("textloom-bench", f"local[{cpus}]", cpus,
                          {"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python's workers before the clock runs.
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(cpus).groupBy("id").applyInPandas(lambda rows: rows, "id long").collect()
    times = {}
    for name in names:
        took: list[float] = []
        while not took or len(took) < 3 and took[0] < REPEAT_BELOW:
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
