"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import joined_by_group, written

#: Characters of a chunk at least and at most. Between them a chunk ends after the first place that BREAK describes, so
#: that an edit moves only the ends near it.
LEAST, MOST = 256, 4096


def _quarters(low: int, high: int, size: int) -> str:
    """Every fourth stretch of `size` code points between low and high, as a part of a class of characters."""
    return "".join(rf"\x{{{c:x}}}-\x{{{c + size - 1:x}}}" for c in range(low, high, 4 * size))


#: A quarter of the characters beyond Latin, in stretches that suit alphabets, syllables and ideographs, and pictures.
BEYOND = _quarters(0x280, 0x3400, 16) + _quarters(0x3400, 0x10000, 128) + _quarters(0x1F000, 0x1FB00, 16) + _quarters(0x20000, 0x32000, 1024)
#: A chunk ends after two of these letters in a row and a blank, after a line end, or after two in a row of BEYOND.
BREAK = rf"(?:[a-m][d-t] |\n|(?=[^\x00-\x{{24f}}])[{BEYOND}][{BEYOND}])"


def chunks(text: Column, least: int = LEAST, most: int = MOST, ends: str = BREAK) -> Column:
    """The chunks of a text in order; joined, they give the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?{ends}|.{{1,{most}}}"), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs; of equal texts the largest id stays.

    A text is a recipe: the ordered identifiers of its chunks. An identifier is a hash that has been verified against
    the dictionary of distinct chunks: where two chunks share a hash (none, as a rule), each gets a number besides. So
    chunks move once, to be verified, and documents are grouped by recipes, not by texts: by 128 bits of a recipe, which
    the recipes of each group confirm. The copies of a text that is very common meet in no task. Null counts as empty; empty
    texts are equal. Rows with a null id stay only where no other row of their group has an id. Rows that repeat whole
    are all in the group, and all that carry its keep_id are kept. An empty table gives an empty result. Other columns
    are not read. hash_bits: fewer only in tests, to make hashes collide.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits)
    parts = base.select(F.explode(chunks(F.col("text"), **options)).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk")
    dictionary = parts.distinct()
    shared = written(dictionary.groupBy("h").count().where("count > 1").select("h"), "collisions")
    recipes = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), **options).alias("chunks"))
    plain = recipes.withColumn("recipe", F.transform("chunks", hashed))
    if shared.isEmpty():
        recipes = plain.select("doc_id", "text_sha256", "recipe", F.array().cast("array<int>").alias("numbers"))
    else:
        recipes = _numbered(plain, dictionary, shared)
    digest = lambda seed: F.hex(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "recipe", "numbers"), 64 - hash_bits))
    recipes = written(recipes.withColumn("key", F.concat_ws("-", digest(1), digest(2))).withColumn("recipe", F.struct("recipe", "numbers")).drop("numbers"), "recipes")
    groups = recipes.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), (F.min("recipe") == F.max("recipe")).alias("one")).where("group_size > 1")
    groups = written(groups, "groups")
    if not groups.where("not one").isEmpty():  # digests that several recipes share: the recipes themselves are the keys
        recipes = recipes.withColumn("key", F.to_json("recipe"))
        groups = written(recipes.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    found = joined_by_group(recipes.select("doc_id", "text_sha256", "key"), groups.select("key", "keep_id", "group_size"), "key", "group_size", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _numbered(plain: DataFrame, dictionary: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes with, for each chunk, its rank among the chunks that share its hash (0 of hashes that are not shared).

    Only here, after a collision, are documents matched by the chunks themselves.
    """
    ranks = dictionary.join(shared, "h", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    ranks = written(ranks, "ranks")
    placed = plain.select("chunks").distinct().select("chunks", F.posexplode("chunks").alias("pos", "chunk"))
    found = placed.join(ranks.select("chunk", "number"), "chunk", "left")
    lists = found.groupBy("chunks").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("number", F.lit(0)).alias("number")))).alias("at"))
    return (
        plain.join(lists, "chunks", "left")
        .select("doc_id", "text_sha256", "recipe", F.coalesce(F.transform("at", lambda x: x["number"]), F.array().cast("array<int>")).alias("numbers"))
    )
