"""Shards by a hierarchical weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: Bytes of a row besides its text; parts in which the rows of a shard are numbered, at least (else as many as shuffle partitions).
ROW_BYTES, PARTS = 8, 64
#: Rows that repeat whole which one task numbers.
RUN = 1_000_000


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shard weights as laid out, and what has changed since.

    added: (region, rack, shard, weight) for each later gain, a new shard (with the next number) or more weight for an old
    one. drained: shards that take no rows any more.
    """

    regions: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[tuple[int, int, int, float], ...] = field(default=())
    drained: frozenset[int] = field(default=frozenset())

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        return Tree(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    def shards(self) -> int:
        first = sum(len(rack) for region in self.regions for rack in region)
        return max([first, *(shard + 1 for _, _, shard, _ in self.added)])

    def grown(self, region: int, rack: int, weight: float = 1.0, shard: int | None = None) -> Tree:
        """One more shard in a rack, or more weight for a shard: rows move into that shard only."""
        return replace(self, added=(*self.added, (region, rack, self.shards() if shard is None else shard, weight)))

    def without(self, shard: int) -> Tree:
        """A shard drained: only its rows move, those that it had when the tree was laid out to its rack (or, if that is empty now, its region)."""
        return replace(self, drained=self.drained | {shard})

    def leaves(self) -> list[list[list[tuple[int, float]]]]:
        """For each region and rack the (shard, weight) of its leaves, the weight of drained ones being 0."""
        number, out = 0, []
        for region in self.regions:
            out.append([])
            for rack in region:
                out[-1].append([(number + k, 0.0 if number + k in self.drained else w) for k, w in enumerate(rack)])
                number += len(rack)
        return out


def _draw(key: Column, node: Column, weight: Column, seed: int) -> Column:
    """An exponential time of rate weight from the key's hash for a node: the child that comes first wins in proportion to its weight. A node of no weight never comes."""
    u = (F.shiftrightunsigned(F.xxhash64(key, node, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _first(options: list[tuple[Column, Column]]) -> Column:
    """The value of the earliest of (time, value)."""
    return F.array_min(F.array(*(F.struct(t.alias("t"), v.alias("v")) for t, v in options)))["v"]


def _table(rows: list[list[float]]) -> tuple[int, list[Column]]:
    """The longest row's length, and for each place an array of the rows' values there, 0 where a row is shorter."""
    wide = max(map(len, rows), default=0)
    return wide, [F.array(*(F.lit(float(row[k]) if k < len(row) else 0.0) for row in rows)) for k in range(wide)]


def with_shard(df: DataFrame, key: Column, tree: Tree, seed: int = 0, column: str = "shard") -> DataFrame:
    """df with the shard of each key: region, then rack, then shard, each by the earliest weighted draw among its siblings.

    A gain of weight since the tree was laid out races at the level of regions with a draw of its own. So it takes its
    share from every shard alike, no row moves between other shards, and no draw below an unchanged node is repeated.
    Regions and racks keep the weights that they were laid out with as long as any of their shards takes rows, so a
    drained shard's rows stay in its rack. A row draws once for each region, each rack of one region and each shard of one
    rack. A null key has draws too.
    """
    leaves = tree.leaves()
    live = lambda rack: any(w > 0 for _, w in rack)
    laid = [[sum(w) if live(own) else 0.0 for w, own in zip(region, racks, strict=True)] for region, racks in zip(tree.regions, leaves, strict=True)]
    top = [(_draw(key, F.lit(f"{i}"), F.lit(float(sum(map(sum, region)) if any(map(live, racks)) else 0.0)), seed), F.lit(i)) for i, (region, racks) in enumerate(zip(tree.regions, leaves, strict=True))]
    late = [(_draw(key, F.lit(f"+{k}/{i}/{j}/{shard}"), F.lit(float(0.0 if shard in tree.drained else w)), seed), F.lit(-1 - shard)) for k, (i, j, shard, w) in enumerate(tree.added)]
    regions, racks, found = (f"__{column}_{x}" for x in ("region", "rack", "leaf"))
    out = df.withColumn(regions, _first(top + late))
    region = F.greatest(F.col(regions), F.lit(0))
    wide, weights = _table(laid)
    name = F.concat(region.cast("string"), F.lit("/"))
    out = out.withColumn(racks, _first([(_draw(key, F.concat(name, F.lit(f"{j}")), F.get(weights[j], region), seed), F.lit(j)) for j in range(wide)]))
    most = max(map(len, tree.regions))
    flat = [own[j] if j < len(own) else [] for own in leaves for j in range(most)]
    place = region * most + F.col(racks)
    wide, weights = _table([[w for _, w in rack] for rack in flat])
    first = F.get(F.array(*(F.lit(rack[0][0] if rack else 0) for rack in flat)), place)
    name = F.concat(region.cast("string"), F.lit("/"), F.col(racks).cast("string"), F.lit("/"))
    out = out.withColumn(found, _first([(_draw(key, F.concat(name, (first + n).cast("string")), F.get(weights[n], place), seed), first + n) for n in range(wide)]))
    return out.withColumn(column, F.when(F.col(regions) < 0, -1 - F.col(regions)).otherwise(F.col(found)).cast("int")).drop(regions, racks, found)


def sharded(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, parts: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    The id and the tree alone decide the shard (law `key`), so equal texts may part and rows that share an id stay
    together. size: UTF-8 bytes of the text and ROW_BYTES, a null text having none; its checksum is that of no bytes. Slots
    count from 0 in each shard. They are given in parts of the shard by a hash of id, size and checksum, after a count of
    all parts (shards x parts rows), so that no task holds a shard or an id; rows that repeat whole are counted first and
    take neighbouring slots. A null id is a key like others. grown_shard: the shard in the grown tree, null if none is
    given. Other columns are not read. The rows are written once without their texts.
    """
    parts = parts or max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    rows = with_shard(rows, key, tree, seed).withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)))
    rows = with_shard(rows, key, grown, seed, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = written(rows, "rows")
    counts = rows.groupBy("shard", "part").agg(F.sum("times").alias("count"))
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(starts), ["shard", "part"])  # shards x parts rows at most
    placed = placed.withColumn("first", F.col("start") + F.coalesce(F.sum("times").over(own), F.lit(0)))
    # a row that repeats very often is dealt out in runs
    runs = F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))
    if not rows.where(F.col("times") > RUN).isEmpty():
        placed = placed.withColumn("from", F.explode(runs)).repartition("doc_id", "text_crc32", "size", "from")
    else:
        placed = placed.withColumn("from", F.lit(0).cast("long"))
    slots = F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + RUN, F.col("times")) - 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Tree, id_col: str = "doc_id", seed: int = 0, column: str = "shard") -> None:
    """docs as Parquet, a folder for each shard; the shard's column replaces one of its name."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    with_shard(docs.drop(column), key, tree, seed, column).write.partitionBy(column).parquet(path)
