"""A session with the settings the jobs rely on."""

from pyspark.sql import SparkSession


def session(app: str = "lorespark") -> SparkSession:
    """UTC, ANSI and adaptive execution; master, memory and shuffle partitions are left to the cluster."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
