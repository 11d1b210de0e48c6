"""Run every registered query to completion (noop sink) and print timings:
python tools/run_all.py [sf_dir]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.plans.registry import registry  # noqa: E402
from docsift.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]")
    times = {}
    for name, spec in registry().items():
        t0 = time.perf_counter()
        try:
            spec.build(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = time.perf_counter() - t0
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:300]}", flush=True)
    for name, t in sorted(times.items(), key=lambda x: -x[1]):
        print(f"{t:8.2f}  {name}")
    print(f"total {sum(times.values()):.1f}s over {len(times)} queries")
