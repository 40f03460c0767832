"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import adapters, spark_queries as sq  # noqa: E402
from recollect.session import build_session  # noqa: E402

HEADLINE = (
    "rt1_text_search",
    "rt2_phrase_match",
    "rt3_fuzzy_terms",
    "rt4_semantic_search",
    "rt6_vector_search",
    "rt7_vector_search_ann",
    "rt14_rank_delta",
    "cv4_context",
    "cv5_clue_state",
    "hi3_viewed_before",
    "ev1_evaluate",
)
# These work on the results of the hybrid search of all user turns, which is made and written once.
AFTER_SEARCH = ("rt13_rerank", "rt13_requery", "rt15_tune_weights", "ev2_ablate", "ex3_why", "ac1_summarize", "ac2_roadmap")
LATEST_START = 1500  # seconds after which no further query is started; those are named as not run


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    works = {"index_build": lambda: adapters.index(spark, sf_dir).write()}
    works |= {name: lambda name=name: run(sq.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    works["rt12_hybrid_search"] = lambda: adapters.ranked(spark, sf_dir)
    works |= {name: lambda name=name: run(sq.QUERIES[name](spark, sf_dir)) for name in AFTER_SEARCH}
    times = {}
    for name, work in works.items():
        if time.perf_counter() - began < LATEST_START:
            times[name] = timed(work)
    left_out = [name for name in works if name not in times]
    if left_out:
        print(f"not run: {', '.join(left_out)}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "not_run": left_out,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
