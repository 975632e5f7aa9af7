"""The session that the library is written for; every setting can be overridden by the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "visparq", **conf: str) -> SparkSession:
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return SparkSession.builder.appName(app).config(map=own | conf).getOrCreate()


def load_env(text: str, into: dict[str, str]) -> dict[str, str]:
    """``key=value`` lines into ``into``: comments and blank lines skipped, paired quotes stripped, existing keys kept."""
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            into.setdefault(key.strip(), value)
    return into
