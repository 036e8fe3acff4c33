"""Compare every query with its SQL: run_oracle.py [--stress] FOLDER [NAME ...].

``--stress`` forces the paths meant for large data: nothing is small enough
to broadcast, and ordered groups are cut into many pieces.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    stress = "--stress" in sys.argv
    folder, *names = [a for a in sys.argv[1:] if a != "--stress"]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    if stress:
        spark.conf.set("haulframe.broadcast.bytes", "0")
        spark.conf.set("haulframe.piece.rows", "50")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    db, sql, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        try:
            out = compare(spark, db, folder, run, sql[name])
        except Exception as e:  # report and go on to the next query
            out = {"problems": [f"{type(e).__name__}: {str(e)[:600]}"], "rows": -1,
                   "seconds": 0, "sql_seconds": 0}
        bad += bool(out["problems"])
        print(f"{'FAIL' if out['problems'] else 'ok':5}{name:32}{out['rows']:>8} rows "
              f"{out['seconds']:6.2f}s sql {out['sql_seconds']:5.2f}s",
              *out["problems"], sep=" ", flush=True)
    print("failed:", bad)
