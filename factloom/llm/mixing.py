"""Mixing sources to target weights by Poisson replication.

A source of size s (characters) that shall make up the share w of a mixture of total size t is repeated w t / s times
on average. Every document draws its number of copies from the Poisson distribution with that mean: a hash of its id
and the seed is the uniform number that the distribution function is inverted at. A mean above PART is the sum of
several independent draws. Documents are exploded by their counts and dealt out globally by a hash of id and copy.

Everything is a DataFrame expression; the only groups are the sources, summed with partial sums, so a source of any
size costs its rows once.

Defined cases: a null source is a source of its own; a null text has size 0; a source of size 0, and one that the
targets don't name (if targets are given), has mean 0 and leaves; rows that repeat an id draw the same count; a row
without an id draws by its text's digest and its number among the rows that equal it in all columns, so many such rows
neither draw alike nor meet in one partition; an empty table gives no rows; the columns copy, rate and shuffle_key
replace such input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import without

#: Largest mean of one draw.
PART = 16
#: Sources up to which their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
SEED = 17


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the SHA-256 of seed and parts as text."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, until the rest is beyond double precision."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * mean / k).alias("cdf")),
        lambda a: a["cdf"],
    )


def rates(docs: DataFrame, targets: dict[str | None, float] | None = None, source: str = "source", text: str = "text", total: float | None = None) -> DataFrame:
    """source, rate (mean copies of its documents): equal shares of all sources unless `targets` gives weights.

    `total` is the mixture's size in characters, by default that of the input.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("size"))
    if targets is not None:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, weight double")
        sizes = sizes.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    sizes = sizes.where("size > 0 and weight > 0")
    sums = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    whole = float(total if total is not None else sums["size"] or 0)
    return sizes.select("source", (F.col("weight") / F.lit(float(sums["weight"] or 1)) * F.lit(whole) / F.col("size")).alias("rate"))


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """`docs` with `_name`, what a row draws by. Equal rows without an id are counted and told apart by number, so none of them move one by one."""
    known = docs.where(F.col(id_col).isNotNull()).withColumn("_name", F.col(id_col).cast("string"))
    bare = docs.where(F.col(id_col).isNull()).groupBy(*docs.columns).agg(F.count("*").alias("_rows"))
    bare = bare.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_nth"))
    name = F.concat_ws(":", F.lit("null"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), F.col("_nth").cast("string"))
    return known.unionByName(bare.withColumn("_name", name).drop("_nth"))


def mix(docs: DataFrame, rated: DataFrame, seed: int = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The copies of `docs`, globally shuffled, with copy (from 1), rate and shuffle_key."""
    rated = rated.select(F.col("source").alias("_source"), F.col("rate").alias("rate"), F.ceil(F.col("rate") / PART).cast("int").alias("_draws"))
    rated = rated.withColumn("_cdf", distribution(F.col("rate") / F.col("_draws")))
    rated = F.broadcast(rated) if rated.count() <= BROADCAST_SOURCES else rated
    docs = without(docs, "copy", "rate", "shuffle_key")
    met = _named(docs, id_col, text).join(rated, F.col(source).eqNullSafe(F.col("_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda j: uniform(seed, F.col("_name"), j))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    drawn = met.withColumn("_n", count).where("_n > 0").select(*docs.columns, "rate", "_name", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    dealt = drawn.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("_name"), F.col("copy"))).drop("_name")
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*docs.columns, "copy", "rate", "shuffle_key")
