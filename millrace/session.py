"""Session factory: one place for the settings every plan relies on."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_session(app: str = "millrace", cores: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer.

    What spark-submit or an active session has set stays as it is: master, shuffle partitions, memory
    and all else. The arguments and the small defaults serve local runs, started by plain Python without $MASTER.
    """
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ  # by spark-submit, whose settings are known already
    if submitted:
        SparkContext._ensure_initialized()
    given = SparkConf(loadDefaults=submitted)
    active = SparkSession.getActiveSession()
    local = not submitted and not os.environ.get("MASTER") and active is None
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if local:
        defaults |= {"spark.master": f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]", "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("MILLRACE_DRIVER_MEMORY", "12g")}
    if shuffle_partitions or local:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    builder = SparkSession.builder.appName(app)
    for name, value in defaults.items():
        if not given.contains(name) and (active is None or active.conf.get(name, None) is None):
            builder = builder.config(name, value)
    return builder.getOrCreate()
