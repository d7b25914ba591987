"""Recovery-panel scaling: the sf price table with every ticker replicated R
times (derived in Spark: ticker' = ticker * R + replica, close scaled by a
replica-specific factor), same storms.  Prints one JSON line per R.

Usage: python scripts/scale_bench.py [sf_dir] [R ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from aftershock.operators.asof import recovery_search  # noqa: E402
from aftershock.plans import proxies  # noqa: E402
from aftershock.session import get_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    reps = [int(x) for x in argv[2:]] or [1, 10]
    spark = get_session("local[8]", app="aftershock-scale", shuffle_partitions=16,
                        extra={"spark.driver.memory": "16g"})
    base = proxies.long_prices(spark, sf_dir)
    storms = proxies.storms(spark, sf_dir)
    recovery_search(base, storms).write.format("noop").mode("overwrite").save()  # warm-up
    for r in reps:
        p = (base.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
             .select((F.col("ticker") * r + F.col("_rep")).alias("ticker"), "date",
                     F.round(F.col("close") * (1 + F.col("_rep") * 0.001), 6).alias("close")))
        t0 = time.perf_counter()
        out = recovery_search(p, storms)
        out.write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        print(json.dumps({"replicas": r, "price_rows": base.count() * r, "panel_rows": out.count(),
                          "seconds": round(dt, 2)}), flush=True)


if __name__ == "__main__":
    main(sys.argv)
