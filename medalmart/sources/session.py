"""Session for the command line. Library code always takes the caller's session."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# The rules of a table are one long expression. HotSpot never compiles a method of more than 8000
# bytes of bytecode; below this limit Spark splits the expression instead of running it uncompiled.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def split_long_methods(spark: SparkSession) -> None:
    """Have the session split long expressions, as :data:`SETTINGS` says, unless it has a limit of its own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, SETTINGS[name])


#: Without it, files of a shuffle stay until the driver happens to collect the garbage that refers to them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a query's shuffle files go when the query ends, unless the session has a setting of its own."""
    own = spark.conf.get(RELEASE, None)
    if own is None:
        spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(RELEASE)


def get_spark(settings: Mapping[str, object] | None = None) -> SparkSession:
    """The active session, or a new one from ``settings``.

    ``master`` and ``app_name`` are used when given; under ``conf`` any Spark
    setting may follow. Memory and shuffle width stay the submitter's business.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    settings = settings or {}
    builder = SparkSession.builder.appName(str(settings.get("app_name", "medalmart")))
    if settings.get("master"):
        builder = builder.master(str(settings["master"]))
    for name, value in {**SETTINGS, **dict(settings.get("conf") or {})}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark
