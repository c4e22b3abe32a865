"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document's number of copies is Poisson with mean (its source's target share * wanted size) / (the source's size). The
variate is the inverse of the distribution at a uniform number that a digest of the seed and the document's id gives, so a
rerun, a lost executor or another partitioning draws the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside

#: Means above this are drawn as a sum of equal parts, so exp(-mean) stays well above the smallest double.
PART = 8.0
#: Terms of the inverse; at a mean of PART the mass beyond them is below 2 ** -60.
TERMS = 48
#: Most sources whose rates are sent to every executor (some 100 bytes each); with more, rates are joined by a shuffle.
BROADCAST_SOURCES = 20_000
TEMPERATURE = 0.5


def _uniform(seed: int, what: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{what}{seed}"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _inverse(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) > u for X of Poisson(mean), mean at most PART."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(acc, i):
        term = acc["term"] * mean / i
        return F.when(acc["sum"] > u, acc).otherwise(F.struct(i.alias("k"), term.alias("term"), (acc["sum"] + term).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """source, n_docs, rate: how often a document of the source is wanted on average.

    weights: relative weights by source; sources it doesn't name weigh 0. None: each source's size to the power TEMPERATURE.
    total: wanted number of documents, by default as many as there are. Null is a source of its own. Counting is a partial
    aggregation, so a source of a third of all rows costs no more than others.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(TEMPERATURE))
    else:
        table = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "named string, weight double")
        sizes = sizes.join(table, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
        weight = F.coalesce("weight", F.lit(0.0))
    sizes = sizes.select("source", "n_docs", weight.alias("weight"))
    sums = sizes.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("n_docs")).first()
    wanted = float(sums.n_docs or 0) if total is None else float(total)
    rate = F.coalesce(F.try_divide(F.col("weight") * wanted, F.lit(sums.weight or 0.0) * F.col("n_docs")), F.lit(0.0))
    return sizes.select("source", "n_docs", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 7) -> DataFrame:
    """docs' columns plus replica (0, 1, ...), rate and mix_key, one row a copy, globally sorted by mix_key.

    docs: doc_id and source are needed. Rows that share doc_id get the same number of copies each; rows without one are told
    apart by their text, if there is one. mix_key is a digest of seed, doc_id and replica, so the order is a uniform shuffle
    with no relation to source. Where docs has columns of these names they are replaced. A table may be empty.
    """
    docs = docs.drop("replica", "rate", "mix_key")
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    table = rates(docs, weights, total).select(named.alias("__source"), "rate")
    rated = docs.withColumn("__source", named)
    rated = rated.join(F.broadcast(table), "__source", "left") if table.count() <= BROADCAST_SOURCES else beside(rated, table, "__source", "left")
    text = F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))) if "text" in docs.columns else F.lit("")
    name = F.coalesce(F.col("doc_id").cast("string"), text)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    draw = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + _inverse(_uniform(seed, "copies", name, i), F.col("rate") / parts))
    counted = rated.drop("__source").withColumn("__copies", draw).filter("__copies > 0")
    copies = counted.withColumn("replica", F.explode(F.expr("sequence(0, __copies - 1)"))).drop("__copies")
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("replica").cast("string")))
    return copies.withColumn("mix_key", key).orderBy("mix_key")
