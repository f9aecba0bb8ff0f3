"""Two short applications whose event logs the tests read: python eventlog_app.py <log dir>."""

import sys

from pyspark.sql import SparkSession

for rolling in ("false", "true"):
    spark = (
        SparkSession.builder.master("local[2]")
        .appName("log source")
        .config("spark.ui.enabled", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", sys.argv[1])
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", rolling)
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.adaptive.enabled", "false")
        .getOrCreate()
    )
    spark.range(0, 1000, 1, 4).groupBy("id").count().count()
    try:
        spark.sql("SELECT raise_error('no')").collect()
    except Exception:
        pass
    spark.stop()
