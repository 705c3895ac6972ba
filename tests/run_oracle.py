"""python tests/run_oracle.py sf_dir [name-prefix ...]: compare registered queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                what = "same" if not diff else "DIFF " + "\n   ".join(diff)
            else:
                what = f"rows {df.count()}"
                diff = []
        except Exception as exc:  # report and go on
            diff, what = [exc], f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        bad += bool(diff)
        print(f"{name:32s} {time.time() - t:6.2f}s {what}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
