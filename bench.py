"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "headline_total", "value": <sum of seconds>, "unit": "sec",
 "queries": {name: seconds}, "sf": <scale factor>}.
Every query runs to completion through the ``noop`` sink (all rows computed,
nothing collected).  Before timing, the JVM is warmed up by running the
headline queries once on a smaller scale factor (``$BENCH_WARM_SF``, default
sf0.01, when present), as a long-running service would be warm; that run is
not counted and shares no data or index with the measured one.  The corpus text
index of the measured scale factor is built once and timed as
``text_index_build``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "search_text_bm25_page",   # flagship: filtered, BM25-ranked first page
    "search_filtered_page",    # filters + size sort + page
    "hit_totals",
    "postings_stats",          # reads the finished index (its build is text_index_build)
    "bm25_any_terms",
    "match_phrase",
    "highlight_snippet",
    "search_page_highlight",
    "path_index",
    "mime_facet",
    "tag_facet_hierarchy",
    "treemap",
    "knn_exact",
    "knn_join",
    "knn_approx",
    "search_ranked_phrase_page",
    "search_query_page",
    "apply_snapshot",
    "apply_tag_edits",
    "markup_to_text",
    "merge_label_spans",
    "keep_last_n",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from docsift.plans.registry import registry
    from docsift.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="docsift-bench",
                      conf={"spark.sql.shuffle.partitions": str(max(int(cpus), 8)),
                            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = registry()
    names = [n for n in HEADLINE if n in reg]
    if len(sys.argv) > 1:
        names = [n for n in names if any(a in n for a in sys.argv[1:])]

    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), os.environ.get("BENCH_WARM_SF", "sf0.01"))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:  # warm-up on tiny data, not counted
        reg[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    # the text index is built once (as an indexer would) and timed on its own;
    # text queries then read only the postings rows of their terms
    from docsift.plans import common
    from docsift.plans.common import text_index

    common._INDEXES.pop((spark.conf.get("spark.app.id", "app"), sf_dir), None)  # time a real build
    t0 = time.perf_counter()
    text_index(spark, sf_dir)
    times["text_index_build"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        df = reg[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
