"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query is run once to warm up and then timed ``RUNS`` times; the best run
counts.  Results are fully computed and thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pageloom.session import build, drop_stored  # noqa: E402
from rendered.queries import all_queries  # noqa: E402

HEADLINE = (
    "htm_nodes", "htm_find_first", "htm_find_all", "idx_detik", "idx_liputan6", "dtk_article",
    "lpt_article", "rel_new_links", "rel_frontier_take", "rel_hydrate", "rel_contents", "snk_articles",
    "str_poll",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench", spark__master=f"local[{cpus}]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        drop_stored(spark)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
