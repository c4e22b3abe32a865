"""Helpers shared by the text operators: lineage cuts and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Java's regular expressions write it: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r" \t\n\x0B\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine may it be unset; a temporary folder then takes its place."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sightline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. It's deleted when the driver ends, for it may be read until then."""
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """cut() for loops: the rows without the size that Spark estimates for them.

    A checkpoint keeps the estimate of its plan, and a join's is the product of its sides'. In a loop its digits multiply each
    round, until the driver spends its time and memory on numbers of millions of digits.
    """
    rows = cut(df)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), df.sparkSession)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage: only then does Spark delete shuffles and checkpoints that nothing refers to any more, by default every half hour."""
    spark._jvm.System.gc()


def pieces(batches, rows: int = 256):
    """Arrow batches in slices of few rows: a worker then holds one batch and little besides, however long the texts are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value, body):
    """body(value) with value evaluated once a row, also where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def beside(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of table, which has one row a key.

    The table is usually an aggregation by that key. Joined as it is, it would share its exchange with the aggregation, and no
    frequent key could be split. On a key of its own each side gets an exchange of its own, which adaptive execution splits.
    """
    keys = [key] if isinstance(key, str) else key
    kind = rows.schema[keys[0]].dataType.typeName()
    own = {"long": F.bitwise_not, "integer": F.bitwise_not, "struct": lambda c: F.struct(c, F.lit(0)), "binary": lambda c: F.concat(c, F.lit(b"\0"))}.get(kind, lambda c: F.concat(c, F.lit("~")))
    other = table.select(own(F.col(keys[0])).alias("__own"), *(F.col(k).alias(f"__{k}") for k in keys[1:]), *(c for c in table.columns if c not in keys))
    same = own(F.col(keys[0])) == F.col("__own")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return rows.join(other, same, how).drop("__own", *(f"__{k}" for k in keys[1:]))


def components(links: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    links: columns a and b (any type with an order), either way round, repeats allowed. Returns node, root for every node of a
    link; root is the smallest node of its component. Alternating star contractions: each round replaces a node's neighbours by links to
    their minimum, so rounds grow with the logarithm of a component's size and no neighbourhood is ever gathered in one
    row. A link with a null end, or from a node to itself, joins nothing.
    """
    pairs = fresh(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = now
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = beside(both, low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        pairs = fresh(small.select("e.a", "e.b").filter("a <> b").distinct())
