"""A library of computed feature cells: only what is missing is computed, the rest is reused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import exists

CELL = ["feature", "security_id", "session", "dependency_ref"]


def missing_cells(requested: DataFrame, library: DataFrame | None) -> DataFrame:
    """Requested cells (CELL) that the library doesn't have with the same dependencies."""
    return requested.select(*CELL) if library is None else requested.select(*CELL).join(library, CELL, "left_anti")


def _reach(requested: DataFrame, library: DataFrame) -> DataFrame:
    """The library's rows of the requested features and range of sessions; both are partitions, so nothing else is read."""
    asked = requested.agg(F.collect_set("feature"), F.min("session"), F.max("session")).first()
    return library.filter(F.col("feature").isin(asked[0]) & F.col("session").between(F.lit(asked[1]), F.lit(asked[2])))


def ensure(spark: SparkSession, path: str, requested: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The requested cells with their values; those that are missing are computed and appended first.

    compute gets the missing cells and returns them with value and available_at. The library is partitioned by feature and
    session, so a request prunes to its own. Of two writers that fill the same gap both append; a cell is read once, the value
    with the earliest clock.
    """
    library = _reach(requested, spark.read.parquet(path)) if exists(spark, path) else None
    gap = missing_cells(requested, library)
    if not gap.isEmpty():
        compute(gap).select(*CELL, "value", "available_at").write.mode("append").partitionBy("feature", "session").parquet(path)
        library = _reach(requested, spark.read.parquet(path))
    if library is None:
        return gap.withColumns({"value": F.lit(None).cast("double"), "available_at": F.lit(None).cast("timestamp")})
    found = library.join(requested.select(*CELL), CELL, "left_semi")
    return found.groupBy(*CELL).agg(F.min_by("value", F.struct("available_at", "value")).alias("value"), F.min("available_at").alias("available_at"))


def training_view(cells: DataFrame, features: list[str], members: DataFrame) -> DataFrame:
    """One row a member and session with a column a feature, and the latest of their clocks."""
    pick = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    wide = cells.filter(F.col("feature").isin(*features)).groupBy("security_id", "session").agg(*pick, F.max("available_at").alias("available_at"))
    return wide.join(members, ["security_id", "session"])
