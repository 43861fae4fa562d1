"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import time

import catalog
from textkin.session import build_session

HEADLINE = [
    "flagship_related_documents",  # text to scored volume pairs
    "j18_exact_knn", "j19_approximate_knn", "a1_doc_match_stats",
    "c6_page_jaccard", "c7_alignment_runs", "c11_matrix_stats",
    "a3_reciprocal_mean", "a5_cluster_means", "g1_components", "g4_fold_to_works",
    "g5_pagerank", "g7_best_copies", "g7_best_by_network", "a20_structured_rows",
    "i2_meta_candidates", "v1_hash_projection", "t1_incremental_ingest",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
