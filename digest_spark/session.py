"""The session that the jobs expect."""

from pyspark.sql import SparkSession


def session(app: str = "digest", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution, on whatever master the environment names."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
