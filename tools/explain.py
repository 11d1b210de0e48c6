"""Print the physical plan of registered queries: python tools/explain.py name [name...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.plans.registry import registry  # noqa: E402
from docsift.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]")
    reg = registry()
    mode = os.environ.get("MODE", "simple")
    for n in sys.argv[1:]:
        print(f"===== {n}")
        reg[n].build(spark, sf).explain(mode)
