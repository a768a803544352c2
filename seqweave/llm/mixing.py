"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fits, free_names, joined_by_group, written

#: Target weights are size ** POWER where none are given; output in sizes of the input; seed of all draws.
POWER, EPOCHS, SEED = 0.7, 1.0, 17
#: A rate above this is the sum of draws with equal rates below it, so that exp(-rate) keeps its digits.
PIECE = 16.0
#: Sources whose rates are broadcast; of more, the rates are joined with salted keys.
BROADCAST, SALTS = 20_000, 32


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, power: float = POWER, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate): the mean number of repetitions of each document of a source.

    size: characters and one for each document. rate: weight of the source x size of the output / size of the source,
    weights being scaled to the sum 1. Sources without a given weight, the null source among them unless the key is None, get 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)).cast("long").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(F.broadcast(known), F.col("source").cast("string").eqNullSafe(F.col("name")), "left").drop("name")
        weight = F.coalesce("weight", F.lit(0.0))
    sizes = written(sizes.select("source", "size", weight.alias("weight")), "sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return sizes.select("source", "size", F.lit(0.0).alias("rate"))
    return sizes.select("source", "size", (F.col("weight") / F.lit(total["weight"]) * F.lit(float(total["size"]) * epochs) / F.col("size")).alias("rate"))


def _steps(rate: Column) -> Column:
    """P(X <= k) for k from 0 until the rest is below any draw, X being Poisson with this rate."""
    p0 = F.exp(-rate)
    start = F.struct(p0.alias("p"), F.array(p0).alias("upto"))
    upto = F.aggregate(
        F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 20).cast("int")),
        start,
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["upto"], F.array(F.element_at(acc["upto"], -1) + acc["p"] * rate / k)).alias("upto")),
    )
    return upto["upto"]


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts (52 bits)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """docs, and the name that a row's draws are seeded with: its id, without one the md5 of its text, and for rows that still share a name their place in the input, too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(text.cast("binary"))))
    place, own, rows = free_names(docs, "place", "hash", "rows")
    again = written(docs.select(F.xxhash64(name).alias(own)).groupBy(own).agg(F.count("*").alias(rows)).where(F.col(rows) > 1), "repeated")
    if again.isEmpty():
        return docs, name
    numbered = docs.withColumn(place, F.monotonically_increasing_id()).withColumn(own, F.xxhash64(name))
    marked = joined_by_group(numbered, again, own, rows, "left")
    return marked, F.concat(name, F.when(F.col(rows).isNotNull(), F.concat(F.lit(" "), F.col(place).cast("string"))).otherwise(""))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, power: float = POWER, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row repeated as its Poisson draw says, and two more columns: copy (from 1) and shuffle_key.

    The draw inverts the distribution of the source's rate at a uniform number from the seed and the id (of rows without
    one, the md5 of the text), so it needs no other row and comes out alike whenever a task is run again. Rows that share
    an id, or have none and equal texts, are drawn one by one: their places in the input count, so that their draws (not
    how many there are on average) depend on how the input is read. Rows of rate 0 or draw 0 are not in the output: that
    is the operator's purpose. Then all rows are dealt to partitions by the md5 of seed, row and copy and sorted by it: a
    global shuffle. Columns of docs with the names of the two are replaced. Null texts count as empty, the null source is
    a source. An empty table stays empty.
    """
    docs = docs.drop("copy", "shuffle_key")
    columns = docs.columns
    table = written(rates(docs, weights, epochs, power, source_col, text_col).select("source", "rate"), "rates")
    few = fits(table, BROADCAST)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PIECE))).cast("int")
    table = table.withColumn("pieces", pieces).withColumn("steps", _steps(F.col("rate") / F.col("pieces")))
    docs, named = _named(docs, id_col, text_col)
    source, plan, salt, own, label, count = free_names(docs, "source", "plan", "salt", "own", "named", "times")
    plans = table.select(F.col("source").alias(source), F.struct("pieces", "steps").alias(plan))
    if few:
        joined = docs.join(F.broadcast(plans), docs[source_col].eqNullSafe(F.col(source)))
    else:
        small = plans.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(own, F.pmod(F.xxhash64(named), F.lit(SALTS)).cast("int"))
        joined = salted.join(small, salted[source_col].eqNullSafe(F.col(source)) & (F.col(own) == F.col(salt)))
    draw = lambda k: F.size(F.filter(F.col(plan)["steps"], lambda x: x <= uniform(seed, named, k.cast("string"))))
    times = F.aggregate(F.sequence(F.lit(1), F.col(plan)["pieces"]), F.lit(0), lambda acc, k: acc + draw(k))
    out = joined.select(*(docs[c] for c in columns), named.alias(label), times.alias(count)).where(F.col(count) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long")))).drop(count)
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label), F.col("copy").cast("string"), F.lit("shuffle")).cast("binary"))).drop(label)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
