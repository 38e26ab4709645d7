"""A session with the settings the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "volreg", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
