"""Time the registered queries and print one JSON line.

Each query runs to a sink that keeps nothing, twice; the faster run counts. Building the
staged raw and prepared tables is timed once under its own names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cargolens.session import build_session  # noqa: E402
from workload.queries import mart, queries, raw_items  # noqa: E402


def timed(action) -> float:
    begin = time.perf_counter()
    action()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> None:
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()

    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {
        "build_raw": timed(lambda: raw_items(spark, folder)),
        "build_mart": timed(lambda: mart(spark, folder)),
    }
    for name in registered:
        seconds[name] = min(timed(lambda: run(name)) for _ in range(2))
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 4) for name, value in seconds.items()},
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
